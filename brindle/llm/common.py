"""Plumbing shared by the training-data operators: tables in the shared folder, row numbers,
skew-proof attachment of group facts, and removal of rows without moving texts when that is safe.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import shared_dir, written

#: Whitespace of the operators' contracts: space, tab, LF, VT, FF, CR.
SPACES = "[\\x20\\x09-\\x0D]+"

#: The most group rows that are ever broadcast by `attach_groups`.
HOT_GROUPS = 1000

#: The most ids that `without_rows` broadcasts; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_caches: dict[str, Callable[[], None]] = {}
_busy_with = [""]


def remembers(work: str, forget: Callable[[], None]) -> None:
    """Says how workers forget what they keep from task to task for some kind of work."""
    _caches[work] = forget


def take_up(work: str) -> None:
    """Called at the start of a task in a Python worker, which Spark uses again for other operators:
    what another kind of work remembered is dropped and given back to the system."""
    if _busy_with[0] == work:
        return
    _busy_with[0] = work
    for name, forget in _caches.items():
        if name != work:
            forget()
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def smaller_batches(spark: SparkSession, size: str = "12m") -> Iterator[None]:
    """Texts reach Python in smaller batches while this holds, which is for jobs that run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number for each row, so that repeated rows, null ids and equal ids stay apart. The numbers
    hold for one scan: how files are cut into tasks follows the cores that are registered at that
    moment. What several scans must agree on has to be `numbered`."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """`df` with a number for each row, written once, so that every scan finds the same numbers."""
    return written(with_row_id(df, name), "numbered", compression="zstd")


def fresh(df: DataFrame, name: str = "_row") -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, id_col: str, text_col: str, row: str | None = None) -> DataFrame:
    """row_id, id and text. `row` names the column of numbers that `docs` has, if it is `numbered`."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(row).alias("row_id")] if row else []))
    return (picked if row else with_row_id(picked)).select("row_id", "id", "text")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` left-joined to one row per key of `groups`.

    The HOT_GROUPS largest groups are broadcast (their number bounds that side), so that a key
    which holds a third of all rows never becomes one task; every other key has less than
    1/HOT_GROUPS of the rows and goes through a shuffle. `groups` is evaluated twice: write it first.
    """
    hot = groups.orderBy(F.desc(size), key).limit(HOT_GROUPS)
    facts = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = groups.join(F.broadcast(hot.select(key)), key, "left_anti")
    done = marked.where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    rest = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot", *facts)
    return done.unionByName(rest.join(cold, key, "left"))


def without_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`df` without the rows whose key is in `ids`, a written table. Up to BROADCAST_IDS ids the
    texts stay where they are; beyond that it is a shuffled anti join, sorted by key so that a
    second evaluation gives the same order."""
    ids = ids.select(key)
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), key, "left_anti")
    return df.join(ids.hint("shuffle_hash"), key, "left_anti").sortWithinPartitions(key)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, weight, text) of at most `per_class` labelled documents of each class for which
    `learn`, a condition on `labels`, holds: those whose ids hash lowest. Weights make up for the classes' different shares.
    The ids, at most twice `per_class`, are broadcast; only the sample's texts move."""
    docs, labels = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labels.where(learn).select(F.col(id_col).alias("id"), F.col(label).alias("y"))
    known = labels.where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = known.join(docs.where("text is not null").select("id").distinct(), "id", "left_semi")
    known = written(known, "labelled")
    sizes = {bool(r.y): r.n for r in known.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    parts = []
    for y in (False, True):
        n = sizes.get(y, 0)
        weight = max(n, 1) / max(min(n, per_class), 1)
        mine = known.where((F.col("y") > 0) == y).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(per_class)
        parts.append(mine.select("id", F.lit(int(y)).alias("y"), F.lit(weight).alias("weight")))
    chosen = parts[0].unionByName(parts[1])
    return docs.join(F.broadcast(chosen), "id").groupBy("id", "y", "weight").agg(F.min("text").alias("text"))
