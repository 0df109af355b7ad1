"""The star schema's tables, and the shapes of reviews, ratings, baskets and graphs over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, business: str = "l_partkey") -> DataFrame:
    """review_id, user_id, business_id, date, stars: a line of an order is a review."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col(business).alias("business_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("date"))
    stars = (F.lit(1) + F.col("l_linenumber") % 5).cast("double")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"), "user_id", "business_id", "date", stars.alias("stars")
    )


REVIEWS = """(SELECT l_orderkey || '-' || l_linenumber AS review_id, o_custkey AS user_id, l_partkey AS business_id, l_suppkey AS supplier_id,
              o_orderdate AS date, (1 + l_linenumber % 5)::DOUBLE AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, categories (comma-separated)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("business_id"), F.concat_ws(", ", "p_type", "p_brand").alias("categories"))


BUSINESSES = "(SELECT p_partkey AS business_id, p_type || ', ' || p_brand AS categories FROM part)"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, name, state, stars."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("business_id"), F.col("s_name").alias("name"), F.col("n_name").alias("state"), (F.lit(1) + F.col("s_suppkey") % 5).cast("double").alias("stars")
    )


SUPPLIERS = """(SELECT s_suppkey AS business_id, s_name AS name, n_name AS state, (1 + s_suppkey % 5)::DOUBLE AS stars
                FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, business_id, stars of every event."""
    item = F.from_json("props", "k int")["k"].cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", item.alias("business_id"), (F.lit(1) + F.col("event_id") % 5).cast("double").alias("stars"))


RATED = "(SELECT event_id, user_id, json_extract(props, '$.k')::BIGINT AS business_id, (1 + event_id % 5)::DOUBLE AS stars FROM events)"


def ratings(spark: SparkSession, sf_dir: str, train: bool = False) -> DataFrame:
    """user_id, business_id, stars: one averaged rating per pair."""
    events = rated(spark, sf_dir)
    events = events.where("event_id % 7 != 0") if train else events
    return events.groupBy("user_id", "business_id").agg(F.round(F.avg("stars"), 9).alias("stars"))


RATINGS = f"(SELECT user_id, business_id, round(avg(stars), 9) AS stars FROM {RATED} GROUP BY ALL)"
TRAIN = f"(SELECT user_id, business_id, round(avg(stars), 9) AS stars FROM {RATED} WHERE event_id % 7 <> 0 GROUP BY ALL)"


def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).where("event_id % 7 = 0").select("user_id", "business_id").distinct()


TEST = f"(SELECT DISTINCT user_id, business_id FROM {RATED} WHERE event_id % 7 = 0)"


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (user), item of purchase events."""
    item = F.from_json("props", "k int")["k"].cast("long")
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("key"), item.alias("item"))


PURCHASES = "(SELECT DISTINCT user_id AS key, json_extract(props, '$.k')::BIGINT AS item FROM events WHERE event_type = 'purchase')"


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (order), item (brand)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("key"), F.col("p_brand").alias("item"))


BASKETS = "(SELECT DISTINCT l_orderkey AS key, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("business_id").alias("item"))


CUSTOMER_PARTS = f"(SELECT DISTINCT user_id AS key, business_id AS item FROM {REVIEWS})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features (array of double)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


POINTS = "(SELECT vec_id AS id, embedding::DOUBLE[] AS features FROM embeddings)"
