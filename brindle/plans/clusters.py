"""Clustering queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import clustering as C
from brindle.plans.registry import query
from brindle.sources import readers
from brindle.sources import tables as T
from brindle.sources.shared import shared_path
from brindle.streaming import stateful

_K = 10


def _first_centres(points: DataFrame) -> C.Centres:
    return {i: list(r.features) for i, r in enumerate(points.orderBy("id").limit(_K).collect())}


def _round_sql(k: int) -> str:
    return (
        f"a{k} AS (SELECT p.id, p.features, c.cluster FROM p, c{k - 1} c QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.features, c.centre), c.cluster) = 1), "
        f"m{k} AS (SELECT cluster, i, avg(features[i]) AS m FROM a{k}, range(1, 65) t(i) GROUP BY ALL), "
        f"c{k} AS (SELECT cluster, list(m ORDER BY i) AS centre FROM m{k} GROUP BY cluster)"
    )


_LLOYD = f"WITH p AS (SELECT * FROM {T.POINTS}), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, features AS centre FROM p ORDER BY id LIMIT {_K}), " + ", ".join(map(_round_sql, (1, 2, 3)))


@query(f"{_LLOYD} SELECT id, cluster::INT AS cluster FROM a3")
def kmeans_lloyd_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three assignments from the first points as centres."""
    points = T.points(spark, sf_dir)
    centres = _first_centres(points)
    for _ in range(2):
        centres, _ = C.moved(points, centres)
    return C.assigned(points, centres).select("id", "cluster")


@query(
    f"""WITH p AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS f FROM embeddings)
    SELECT cluster, i - 1 AS dim, count(*) AS n, round(sum(f[i]), 6) AS total, round(sum(f[i] * f[i]), 6) AS squares FROM p, range(1, 65) t(i) GROUP BY ALL"""
)
def bfr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))
    stats = C.statistics(rows)
    zipped = stats.select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "v"))
    return zipped.select("cluster", F.col("dim").cast("long").alias("dim"), "n", F.round("v.sum", 6).alias("total"), F.round("v.sumsq", 6).alias("squares"))


@query()
def kmeans_farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kmeans(T.points(spark, sf_dir), _K)


@query()
def kmeans_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kmeans_builtin(T.points(spark, sf_dir), _K).select("id", "cluster")


def _streamed(spark: SparkSession, sf_dir: str) -> C.Bfr:
    """Three chunks by id, each a file of a stream."""
    points, folder = T.points(spark, sf_dir), shared_path(spark, "chunks")
    for chunk in range(3):
        points.where(F.col("id") % 3 == chunk).coalesce(1).write.mode("append").parquet(folder)
    bfr = C.Bfr(_K, small=5)
    stream = readers.file_stream(spark, folder, points.schema, "*.parquet")
    stateful.each_chunk(stream, lambda batch, _: bfr.add(batch)).awaitTermination()
    return bfr


@query()
def bfr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).finish()


@query()
def bfr_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every point in the end in a discard cluster."""
    return _streamed(spark, sf_dir).finish(T.points(spark, sf_dir))


@query("SELECT i::INT AS round_id, (SELECT count(*) FROM embeddings WHERE vec_id % 3 < i) AS n_points FROM range(1, 4) t(i)")
def bfr_round_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that a round's report has in all: each is discarded, compressed or retained."""
    got = bfr_rounds(spark, sf_dir)
    return got.select("round_id", (F.col("n_discard_points") + F.col("n_compressed_points") + F.col("n_retained_points")).alias("n_points"))


@query()
def bfr_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each round."""
    bfr = _streamed(spark, sf_dir)
    names = "round_id int, n_discard_clusters long, n_discard_points long, n_compressed_clusters long, n_compressed_points long, n_retained_points long"
    return spark.createDataFrame(bfr.reports, names)
