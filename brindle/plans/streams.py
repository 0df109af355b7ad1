"""Streaming queries: the events file as a stream, run over all that is there, read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.registry import query
from brindle.plans.sketching import _fm_sql
from brindle.sources import readers, sinks
from brindle.sources.schemas import EVENT
from brindle.sources.shared import shared_path
from brindle.streaming import stateful, windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.timed(readers.file_stream(spark, sf_dir, EVENT, "events.parquet"))


def _all(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The stream's result once it has read all files."""
    spark = stream.sparkSession
    path = shared_path(spark, "result")
    sinks.stream_to_table(stream, path, mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.tumbling(_events(spark, sf_dir), "1 day", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), by=("event_type",))
    return _all(got)


@query(
    """SELECT time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE AS window_start, time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE + INTERVAL 30 MINUTE AS window_end, count(*) AS n
    FROM events, range(3) t(i) GROUP BY ALL"""
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(windows.sliding(_events(spark, sf_dir), "30 minutes", "10 minutes"))


@query(
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    s AS (SELECT user_id, ts, count(*) FILTER (WHERE gap IS NULL OR gap >= INTERVAL 30 MINUTE) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e),
    w AS (SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS n FROM s GROUP BY user_id, no)
    SELECT window_start, window_end, user_id, n FROM w WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: sessions that the watermark has closed."""
    return _all(windows.sessions(_events(spark, sf_dir), "30 minutes", ("user_id",)), "append")


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY ALL")
def stateful_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(stateful.running_counts(_events(spark, sf_dir).select("ts", "event_type"), "event_type"), "update")


@query("SELECT count(*) AS n FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(windows.first_only(_events(spark, sf_dir), "event_id").select("event_id"), "append").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100")
def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = readers.file_stream(spark, sf_dir, EVENT, "events.parquet")
    path = shared_path(spark, "reservoir")
    query = stateful.reservoir(events, "event_id", path)
    query.awaitTermination()
    last = query.lastProgress.batchId if query.lastProgress else 0
    return spark.read.schema(EVENT).parquet(f"{path}/{last}").select("event_id", "user_id", "event_type")


@query(
    "SELECT k AS window_start, truth, estimate FROM ("
    + _fm_sql("SELECT time_bucket(INTERVAL 1 DAY, ts) - i * INTERVAL 1 DAY AS k, props->>'$.k' AS v FROM events, range(3) t(i)")
    + ")"
)
def stream_fm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _events(spark, sf_dir).withColumn("tag", F.get_json_object("props", "$.k"))
    path = shared_path(spark, "fm")
    stateful.distinct_windows(tagged, "tag", path, "3 days", "1 day").awaitTermination()
    return spark.read.schema("window_start timestamp_ntz, truth long, estimate double").parquet(path)
