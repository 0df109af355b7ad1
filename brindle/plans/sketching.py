"""Sketch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.numeric import text_mod_sql
from brindle.operators import sketches as K
from brindle.plans.registry import query
from brindle.sources import tables as T

_A, _B = K.BLOOM[0]
_BIT = f"({text_mod_sql('name', K.BLOOM_BITS)} * {_A} + {_B}) % {K.BLOOM_BITS}"


def _bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = T.suppliers(spark, sf_dir)
    return K.bloom_probe(suppliers.select("name"), "name", K.bloom_filter(suppliers.where("stars >= 4"), "name"))


@query(f"WITH s AS (SELECT name, stars, {_BIT} AS bit FROM {T.SUPPLIERS}) SELECT name, CASE WHEN bit IN (SELECT bit FROM s WHERE stars >= 4) THEN 'T' ELSE 'F' END AS flag FROM s")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bloom(spark, sf_dir).select("name", F.when(F.col("member"), "T").otherwise("F").alias("flag"))


@query(f"SELECT name FROM {T.SUPPLIERS} WHERE name IN (SELECT name FROM {T.SUPPLIERS} WHERE stars >= 4)")
def exact_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = T.suppliers(spark, sf_dir)
    return suppliers.select("name").join(suppliers.where("stars >= 4").select("name"), "name", "left_semi")


_FM = "h(g, f, a, b, m) AS (VALUES " + ", ".join(f"({i // K.FM_PER}, {i}, {a}, {b}, {m})" for i, (a, b, m) in enumerate(K.FM)) + ")"
_FOLD = (
    "list_reduce([0::BIGINT] || list_transform(range(1, octet_length(encode(v)) + 1), lambda i: ('0x' || substr(hex(encode(v)), (2 * i - 1)::INT, 2))::BIGINT), "
    "lambda acc, x: (acc * 256 + x) % h.m)"
)


def _fm_sql(values: str) -> str:
    return f"""WITH v AS (SELECT DISTINCT k, v FROM ({values})), {_FM},
        x AS (SELECT k, g, f, bin(({_FOLD} * a + b) % m) AS z FROM v, h),
        r AS (SELECT k, g, f, max(length(z) - length(rtrim(z, '0'))) AS r FROM x GROUP BY ALL),
        w AS (SELECT k, g, avg(pow(2, r)) AS w FROM r GROUP BY ALL)
        SELECT k, (SELECT count(*) FROM v WHERE v.k = w.k) AS truth, median(w)::DOUBLE AS estimate FROM w GROUP BY k"""


@query(_fm_sql(f"SELECT stars AS k, state AS v FROM {T.SUPPLIERS}"))
def fm_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.flajolet_martin(T.suppliers(spark, sf_dir).select(F.col("stars").alias("k"), "state"), "state", ["k"])


@query()
def hll_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog per event type, and of all types by merging their sketches."""
    per = T.table(spark, sf_dir, "events").groupBy("event_type").agg(F.hll_sketch_agg("user_id").alias("sketch"))
    each = per.select("event_type", F.hll_sketch_estimate("sketch").alias("estimate"))
    return each.unionByName(per.agg(F.hll_union_agg("sketch").alias("s")).select(F.lit("all").alias("event_type"), F.hll_sketch_estimate("s").alias("estimate")))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sample(T.table(spark, sf_dir, "events"), "event_id", 100).select("event_id", "user_id", "event_type")


@query(
    """WITH s AS (SELECT props->>'$.k' AS tag FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100), c AS (SELECT tag, count(*) AS n FROM s GROUP BY tag)
    SELECT tag, n, place::INT AS place FROM (SELECT tag, n, dense_rank() OVER (ORDER BY n DESC) AS place FROM c) WHERE place <= 3"""
)
def hashtag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.sample(T.table(spark, sf_dir, "events"), "event_id", 100)
    return K.top_frequencies(rows.select(F.get_json_object("props", "$.k").alias("tag")), "tag", 3)
