"""Streams whose result depends on all that came before: running counts, reservoirs, sketches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators.sketches import flajolet_martin, sample
from brindle.sources.shared import shared_path


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """(key, n) after each micro-batch, for the keys that it has. The state is one number per key."""

    def update(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        state.update((n,))
        yield pd.DataFrame({"key": [group[0]], "n": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"key {kind}, n long", "n long", "update", GroupStateTimeout.NoTimeout)


def _each(stream: DataFrame, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    path = shared_path(stream.sparkSession, "state")
    return stream.writeStream.option("checkpointLocation", path).trigger(availableNow=True).foreachBatch(step).start()


def reservoir(stream: DataFrame, key: str, path: str, n: int = 100) -> StreamingQuery:
    """Keeps a uniform sample of n rows of all that came, as a table per micro-batch under `path`:
    the sample of the last one and of the new rows together. A batch that runs again gives the same."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/{number - 1}").unionByName(batch)
        sample(rows.dropDuplicates([key]), key, n).write.mode("overwrite").parquet(f"{path}/{number}")

    return _each(stream, step)


def each_chunk(stream: DataFrame, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls `step` with every chunk that a stream has now, one after the other."""
    return _each(stream, step)


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Lets a query run for so long at most, then stops it. Whether it had ended by itself."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


class StopOn(StreamingQueryListener):
    """Stops other queries of the session once one fails with an error for which `wanted` holds (a rate
    limit's code, for instance): a failed source then leaves no consumer running."""

    def __init__(self, spark: SparkSession, wanted: Callable[[str], bool]) -> None:
        super().__init__()
        self.spark, self.wanted, self.reason = spark, wanted, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception and self.wanted(event.exception):
            self.reason = event.exception
            for query in self.spark.streams.active:
                if str(query.runId) != str(event.runId):
                    query.stop()


def distinct_windows(stream: DataFrame, column: str, path: str, size: str = "30 seconds", step: str = "10 seconds") -> StreamingQuery:
    """Per sliding window: the distinct values, exact and by Flajolet-Martin, over all batches so far.
    The state is each window's distinct values."""
    windowed = stream.groupBy(F.window("ts", size, step).alias("window"), F.col(column).alias("value")).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, _: int) -> None:
        plain = batch.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "value")
        flajolet_martin(plain, "value", ["window_start"]).write.mode("overwrite").parquet(path)

    where = shared_path(stream.sparkSession, "state")
    return windowed.writeStream.outputMode("complete").option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(write).start()
