"""Rating prediction queries. Customers stand for users, parts for businesses."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import predicting as P
from brindle.plans.registry import query
from brindle.sources import readers, sinks
from brindle.sources import tables as T
from brindle.sources.shared import shared_path, written

_USER = ["user_avg", "yelping_since", "useful", "funny", "cool", "elite", "friends", "fans", "compliment_hot", "compliment_writer", "compliment_photos"]
_BUSINESS = ["biz_avg", "latitude", "longitude"]


def _users(spark: SparkSession, sf_dir: str, ratings: DataFrame) -> DataFrame:
    """Eleven features of every user. Names stand for friends and elite years; orders and what they cost
    for activity and compliments."""
    orders = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("yelping_since"), F.count("*").cast("double").alias("useful"),
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("funny"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("cool"),
        F.max("o_totalprice").alias("compliment_hot"), F.min("o_totalprice").alias("compliment_writer"), F.round(F.avg("o_totalprice"), 6).alias("compliment_photos"),
    )
    names = lambda n: F.array_join(F.array_repeat(F.lit("x"), n.cast("int")), ",")
    key = F.col("c_custkey")
    users = T.table(spark, sf_dir, "customer").select(key.alias("user_id"), names(key % 5).alias("friends"), names(key % 3).alias("elite"), F.col("c_acctbal").alias("fans"))
    got = P.user_features(users.join(orders, "user_id", "left"), P.averages(ratings, "user_id", "user_avg"))
    return got.select("user_id", *(F.col(c).cast("double").alias(c) for c in _USER))


def _businesses(spark: SparkSession, sf_dir: str, ratings: DataFrame) -> DataFrame:
    """Three features of every business; size and price stand for its place."""
    parts = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("business_id"), F.col("p_size").cast("double").alias("latitude"), F.col("p_retailprice").alias("longitude"))
    return parts.join(P.averages(ratings, "business_id", "biz_avg"), "business_id", "left").select("business_id", *_BUSINESS)


def _rows(spark: SparkSession, sf_dir: str, ratings: DataFrame, wanted: DataFrame) -> DataFrame:
    """The fourteen features of pairs; averages are of the training ratings, null for unseen users and
    businesses."""
    return wanted.join(_users(spark, sf_dir, ratings), "user_id", "left").join(_businesses(spark, sf_dir, ratings), "business_id", "left")


def _als(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = T.ratings(spark, sf_dir, train=True)
    return P.als_predictions(P.als_model(train), T.test_pairs(spark, sf_dir), train)


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, DataFrame]:
    """The trees over three fifths of the training pairs, and what they are asked about."""
    train = T.ratings(spark, sf_dir, train=True)
    rows = _rows(spark, sf_dir, train, train)
    learn = written(rows.where(F.pmod(F.xxhash64("user_id", "business_id"), F.lit(5)) < 3), "learn")
    return P.tree_pipeline(_USER + _BUSINESS).fit(learn), _rows(spark, sf_dir, train, T.test_pairs(spark, sf_dir))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tree_predictions(*_fitted(spark, sf_dir))


@query()
def als_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _als(spark, sf_dir)


@query()
def gbt_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir)


@query()
def blend_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models are trained, saved, loaded by another reader, and blended."""
    train, wanted = T.ratings(spark, sf_dir, train=True), T.test_pairs(spark, sf_dir)
    trees, rows = _fitted(spark, sf_dir)
    where = shared_path(spark, "models")
    sinks.model(trees, f"{where}/trees")
    sinks.model(P.als_model(train), f"{where}/factors")
    als = P.als_predictions(readers.factors(f"{where}/factors"), wanted, train)
    return P.blend(als, P.tree_predictions(readers.fitted(f"{where}/trees"), rows))


@query(
    f"""WITH r AS (SELECT * FROM {T.TRAIN}), w AS (SELECT * FROM {T.TEST}),
    u AS (SELECT user_id, avg(stars) AS user_avg FROM r GROUP BY ALL), b AS (SELECT business_id, avg(stars) AS biz_avg FROM r GROUP BY ALL),
    o AS (SELECT o_custkey AS user_id, (2020 - year(min(o_orderdate)))::DOUBLE AS yelping_since, count(*)::DOUBLE AS useful, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS funny,
        count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS cool, max(o_totalprice) AS compliment_hot, min(o_totalprice) AS compliment_writer, avg(o_totalprice) AS compliment_photos FROM orders GROUP BY ALL)
    SELECT w.user_id, w.business_id, round(user_avg, 6) AS user_avg, round(biz_avg, 6) AS biz_avg, yelping_since, useful, funny, cool, (c_custkey % 3)::DOUBLE AS elite, (c_custkey % 5)::DOUBLE AS friends,
        c_acctbal AS fans, compliment_hot, compliment_writer, round(compliment_photos, 4) AS compliment_photos, p_size::DOUBLE AS latitude, p_retailprice AS longitude
    FROM w LEFT JOIN customer ON c_custkey = w.user_id LEFT JOIN o ON o.user_id = c_custkey LEFT JOIN part ON p_partkey = w.business_id
    LEFT JOIN u ON u.user_id = c_custkey LEFT JOIN b ON b.business_id = p_partkey"""
)
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, T.ratings(spark, sf_dir, train=True), T.test_pairs(spark, sf_dir))
    shown = {"user_avg": 6, "biz_avg": 6, "compliment_photos": 4}
    return rows.select("user_id", "business_id", *(F.round(c, shown[c]).alias(c) if c in shown else F.col(c) for c in _USER + _BUSINESS))


@query(
    f"""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 5 END AS friends, (c_custkey % 3) AS elite, 2020 - year(d) AS yelping_since, round(user_avg, 6) AS user_avg
    FROM customer LEFT JOIN (SELECT user_id, min(date) AS d, avg(stars) AS user_avg FROM {T.REVIEWS} GROUP BY ALL) ON user_id = c_custkey"""
)
def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = T.reviews(spark, sf_dir)
    since = reviews.groupBy("user_id").agg(F.date_format(F.min("date"), "yyyy-MM-dd HH:mm:ss").alias("yelping_since"))
    names = lambda n: F.array_join(F.array_repeat(F.lit("x"), n.cast("int")), ",")
    users = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), names(F.col("c_custkey") % 5).alias("friends"), names(F.col("c_custkey") % 3).alias("elite"))
    got = P.user_features(users.join(since, "user_id", "left"), P.averages(reviews, "user_id", "user_avg"))
    return got.select("user_id", F.col("friends").cast("long").alias("friends"), F.col("elite").cast("long").alias("elite"), F.col("yelping_since").cast("long").alias("yelping_since"), F.round("user_avg", 6).alias("user_avg"))


@query(
    f"""SELECT p_partkey AS business_id, 2 AS n_categories, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'd' WHEN 2 THEN 'e' WHEN 3 THEN 'b' ELSE 'd' END AS hrs, round(biz_avg, 6) AS biz_avg
    FROM part LEFT JOIN (SELECT business_id, avg(stars) AS biz_avg FROM {T.REVIEWS} GROUP BY ALL) ON business_id = p_partkey"""
)
def business_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening days by size: none known, working days, weekend, both, no day."""
    day = lambda *d: F.create_map(*(F.lit(x) for n in d for x in (n, "9:0-17:0")))
    kind = F.col("p_size") % 5
    hours = F.when(kind == 1, day("Monday", "Friday")).when(kind == 2, day("Sunday")).when(kind == 3, day("Monday", "Sunday")).when(kind == 4, F.map_filter(day("Monday"), lambda k, v: F.lit(False)))
    businesses = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("business_id"), F.concat_ws(", ", "p_type", "p_brand").alias("categories"), hours.alias("hours"))
    got = P.business_features(businesses, P.averages(T.reviews(spark, sf_dir), "business_id", "biz_avg"))
    return got.select("business_id", F.size("categories").alias("n_categories"), "hrs", F.round("biz_avg", 6).alias("biz_avg"))
