"""Relational and scalar primitives, one query per family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import numeric as N
from brindle.functions import text as X
from brindle.operators.clustering import farthest_first
from brindle.operators.ordering import dense_index
from brindle.plans.registry import query
from brindle.sources import readers, sinks
from brindle.sources import tables as T
from brindle.sources.schemas import REVIEW
from brindle.sources.shared import shared_path


@query(rf"""SELECT doc_id, md5(trim({X.cleaned_sql("text")})) AS cleaned, md5(trim(translate(lower(text), '([,.!?:;])', ''))) AS plain, length(text) AS n_chars,
    regexp_matches(lang, '^[A-Za-z]*$') AS letters FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.md5(F.trim(X.cleaned(F.col("text"))).cast("binary")).alias("cleaned"), F.md5(F.trim(X.plain(F.col("text"))).cast("binary")).alias("plain"),
        F.length("text").cast("long").alias("n_chars"), X.letters_only(F.col("lang")).alias("letters"),
    )


@query(
    f"""SELECT c_custkey, ({N.text_mod_sql("c_name", 80_000_000)} * 926 + 1500) % 80000000 AS position, c_custkey % 97 AS x,
    CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE length(bin(c_custkey % 97)) - length(rtrim(bin(c_custkey % 97), '0')) END AS zeros, round(log2(c_custkey + 1), 9) AS log2,
    CASE WHEN c_acctbal < 1 THEN 1.0 WHEN c_acctbal > 5000 THEN 5000.0 ELSE c_acctbal END AS clamped FROM customer"""
)
def hash_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_custkey") % 97
    return T.table(spark, sf_dir, "customer").select(
        "c_custkey", N.affine(N.text_mod(F.col("c_name"), 80_000_000), 926, 1500, 80_000_000).alias("position"), x.alias("x"), N.trailing_zeros(x).cast("long").alias("zeros"),
        F.round(F.log2(F.col("c_custkey") + 1), 9).alias("log2"), N.clamped(F.col("c_acctbal"), 1.0, 5000.0).alias("clamped"),
    )


@query(
    f"""WITH p AS (SELECT id, features AS f, lag(features, 1, features) OVER (ORDER BY id) AS g FROM {T.POINTS})
    SELECT id, round(list_distance(f, g), 6) AS distance, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (f[i] - g[i]) * (f[i] - g[i]) / 0.5))), 6) AS mahalanobis FROM p"""
)
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.points(spark, sf_dir)
    numbered = points.join(dense_index(points, "id"), "id")
    before = numbered.select((F.col("index") + 1).alias("index"), F.col("features").alias("g"))
    both = numbered.join(before, "index", "left").withColumn("g", F.coalesce("g", "features"))
    half = F.array_repeat(F.lit(0.5), F.size("features"))
    return both.select("id", F.round(N.distance(F.col("features"), F.col("g")), 6).alias("distance"), F.round(N.mahalanobis(F.col("features"), F.col("g"), half), 6).alias("mahalanobis"))


@query("SELECT c_name AS name, row_number() OVER (ORDER BY c_name) - 1 AS index FROM (SELECT DISTINCT c_name FROM customer)")
def dense_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(T.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "name")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)
    UNION ALL SELECT 'first only', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.table(spark, sf_dir, "orders")
    a = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    b = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).distinct()
    # one pass: which sides each key has
    sides = a.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(b.withColumn("a", F.lit(0)).withColumn("b", F.lit(1))).groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = sides.agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both"), F.count("*").alias("either"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("first"), F.sum(F.col("a") + F.col("b")).alias("all"))
    return n.select(F.explode(F.create_map(F.lit("both"), "both", F.lit("either"), "either", F.lit("first only"), "first", F.lit("all"), "all")).alias("part", "n"))


@query(
    """SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey)))::VARCHAR AS suppliers, len(list_distinct(list(l_suppkey)))::INT AS n,
    len(list_intersect(list_distinct(list(l_suppkey)), [1, 2, 3, 4, 5]))::INT AS common, list_has_all(list_distinct(list(l_suppkey)), [1]) AS has_one FROM lineitem GROUP BY l_orderkey"""
)
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.array(*(F.lit(i).cast("long") for i in range(1, 6)))
    sets = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    shown = F.concat(F.lit("["), F.array_join(F.col("s").cast("array<string>"), ", "), F.lit("]"))
    return sets.select("l_orderkey", shown.alias("suppliers"), F.size("s").alias("n"), F.size(F.array_intersect("s", some)).alias("common"), (F.size(F.array_except(F.array(F.lit(1).cast("long")), "s")) == 0).alias("has_one"))


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(top, 'UNKNOWN') AS top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS top FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("top"))
    return T.table(spark, sf_dir, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit("UNKNOWN")).alias("top"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = T.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return T.table(spark, sf_dir, "customer").select("c_custkey").join(dear, "c_custkey", "left_anti")


@query("SELECT n_regionkey, s_suppkey, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).select("n_regionkey", "s_suppkey", "s_acctbal")
    return joined.withColumn("place", place).where("place <= 3").drop("place")


@query(
    """SELECT n_regionkey, covar_pop(s_acctbal, s_suppkey)::DECIMAL(20, 2)::DOUBLE AS covariance, min(s_suppkey) AS low, arg_max(s_suppkey, s_acctbal) AS richest,
    round(median(s_acctbal), 4) AS median FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL"""
)
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_regionkey").agg(
        F.covar_pop("s_acctbal", "s_suppkey").cast("decimal(20,2)").cast("double").alias("covariance"), F.min("s_suppkey").alias("low"),
        F.max_by("s_suppkey", "s_acctbal").alias("richest"), F.round(F.median("s_acctbal"), 4).alias("median"),
    )


_REVIEW_SQL = f"SELECT count(*) AS n, count(DISTINCT user_id) AS users, sum(stars) AS stars FROM {T.REVIEWS}"


def _as_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reviews(spark, sf_dir).select("review_id", F.col("user_id").cast("string").alias("user_id"), F.col("business_id").cast("string").alias("business_id"), "stars", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("stars").alias("stars"))


@query(_REVIEW_SQL)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews to JSON lines and back by an explicit schema."""
    path = shared_path(spark, "json")
    sinks.json_lines(_as_reviews(spark, sf_dir), path)
    return _counted(readers.json_table(spark, path, REVIEW))


@query("SELECT count(*) AS n, count(DISTINCT item) AS items FROM (SELECT l_orderkey AS key, 'Brand \"' || p_brand || '\", ' || p_type AS item FROM lineitem JOIN part ON p_partkey = l_partkey)")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns, with quotes and commas inside, to one CSV file and back."""
    path = shared_path(spark, "csv")
    lines, parts = T.table(spark, sf_dir, "lineitem"), T.table(spark, sf_dir, "part")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("key"), F.concat(F.lit('Brand "'), "p_brand", F.lit('", '), "p_type").alias("item"))
    sinks.csv_file(rows, path)
    return readers.csv_pairs(spark, path).agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"))


@query(f"SELECT count(*) AS n, round(sum(features[1]), 6) AS first, round(sum(features[64]), 6) AS last FROM {T.POINTS}")
def points_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to `id,f1,...` text and back."""
    path = shared_path(spark, "points")
    T.points(spark, sf_dir).select(F.concat_ws(",", F.col("id").cast("string"), F.col("features").cast("array<string>")).alias("value")).write.text(path)
    back = readers.points(spark, path)
    return back.agg(F.count("*").alias("n"), F.round(F.sum(F.col("features")[0]), 6).alias("first"), F.round(F.sum(F.element_at("features", -1)), 6).alias("last"))


def _farthest(k: int) -> str:
    """Each centre in turn: the point farthest from its nearest centre so far, the least id at ties."""
    steps = ["p AS (SELECT * FROM " + T.POINTS + ")", "c0 AS (SELECT 0 AS place, id, features FROM p WHERE id = 0)"]
    for i in range(1, k):
        steps.append(
            f"c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT {i}, id, features FROM (SELECT p.id, p.features, min(list_distance(p.features, c.features)) AS d FROM p, c{i - 1} c GROUP BY ALL) "
            f"WHERE d > 0 QUALIFY row_number() OVER (ORDER BY d DESC, id) = 1)"
        )
    return f"WITH {', '.join(steps)} SELECT place, features AS centre FROM c{k - 1}"


@query(_farthest(5))
def farthest_first_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = farthest_first(T.points(spark, sf_dir), 5, first=0)
    return spark.createDataFrame(sorted(found.items()), "place int, centre array<double>")
