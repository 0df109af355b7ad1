"""Sharding along a Hilbert curve.

Language, source and size are cut into at most 16 bins each at quantiles of the table, whole values
compared, so that a hot value fills its own bin; the bins' cell has a place on a three-dimensional Hilbert curve. Rows are
sorted by that place, then equal texts together, then id, and the sorted run is cut into shards
whose row counts differ by at most one. Rows near each other in all dimensions share a shard, and a
shard's files cover few values of each.

Null metadata sort first; null texts have no bytes. Repeated rows each get a slot of their own; rows
that tie in all else go by row number. Other columns don't matter. An empty table gives an empty
result.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import documents, fresh, numbered, with_row_id, written

SHARDS = 16

#: Bits per dimension. 2^(3 * BITS) cells bound the broadcast table of curve places.
BITS, DIMENSIONS = 4, 3


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place on the Hilbert curve of a point with coordinates under 2^bits."""
    x, n, top = list(point), len(point), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | ((x[i] ^ t) >> b & 1)
    return place


@lru_cache
def curve() -> list[tuple[int, int]]:
    """(cell, place) of every cell."""
    side = 1 << BITS
    return [((a * side + b) * side + c, hilbert_index((a, b, c), BITS)) for a in range(side) for b in range(side) for c in range(side)]


def cuts(facts: DataFrame, column: str) -> list:
    """The at most 2^BITS - 1 values that cut a column's rows into parts of equal size: the k-th is the
    least value up to which at least k 2^-BITS of the rows lie, nulls first. Rows are counted by whole
    value before anything moves, so a hot value is one row; the counts are summed up range by range."""
    counted = written(facts.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(F.col(column).asc_nulls_first()).withColumn("part", F.spark_partition_id()), "values")
    # as many rows as there are ranges
    before, total = [], 0
    for part, n in sorted(counted.groupBy("part").agg(F.sum("n")).collect()):
        before.append((part, total))
        total += n
    if not total:
        return []
    spark, bins = facts.sparkSession, 1 << BITS
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_first()))
    summed = counted.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").withColumn("upto", upto)
    crossed = F.expr(f"floor(upto * {bins}D / {total}) > floor((upto - n) * {bins}D / {total})")
    found = summed.where(crossed & (F.col("upto") < total)).select(column).collect()
    return sorted((r[0] for r in found), key=lambda v: (v is not None, v))


def _bin(column: str, edges: list) -> Column:
    """How many cuts lie below a value; null lies below all else."""
    above = lambda e: F.col(column).isNotNull() if e is None else F.coalesce(F.col(column) > F.lit(e), F.lit(False))
    return sum((above(e).cast("int") for e in edges), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("lang", "source"), row: str | None = None) -> DataFrame:
    """One row per row of `docs`: row_id, its id, size (UTF-8 bytes plus 1), text_crc32, place on
    the curve, shard and slot. `docs` must be a stable scan. Texts are read once and don't move."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    facts = written(
        (docs.withColumn("row_id", F.col(row)) if row else with_row_id(docs)).select(
            "row_id", F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.col(dims[0]).alias("d0"), F.col(dims[1]).alias("d1"),
        ),
        "facts",
    )
    cell = F.lit(0)
    for column in ("d0", "d1", "size"):
        cell = cell * (1 << BITS) + _bin(column, cuts(facts, column))
    places = spark.createDataFrame(curve(), "cell int, place int")
    placed = facts.withColumn("cell", cell).join(F.broadcast(places), "cell").drop("cell", "d0", "d1")
    order = ["place", "text_crc32", "size", "id", "row_id"]
    run = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "run")
    # rows of each sorted partition: as many rows as there are partitions
    part = F.shiftright("at", 33).alias("part")
    counts = sorted(run.groupBy(part).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    before = spark.createDataFrame(offsets, "part long, before long")
    least, more = divmod(total, shards)
    # the first `more` shards have one row more than the others
    rank, edge = F.col("rank"), more * (least + 1)
    in_long, in_short = F.expr(f"rank div {least + 1}"), F.expr(f"{more} + (rank - {edge}) div {max(least, 1)}")
    number = F.when(rank < edge, in_long).otherwise(in_short)
    start = F.when(rank < edge, F.col("number") * (least + 1)).otherwise(edge + (F.col("number") - more) * least)
    return (
        run.join(F.broadcast(before), F.shiftright("at", 33) == F.col("part"))
        .withColumn("rank", F.col("before") + F.expr("at & 8589934591"))
        .withColumn("number", number)
        .select("row_id", F.col("id").alias(id_col), "size", "text_crc32", "place", F.col("number").cast("int").alias("shard"), (rank - start).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """`docs` as files, one folder per shard (`shard=0` and so on; `shard_=0` where `docs` itself has
    a column of that name), rows in slot order."""
    row, folder, slot = fresh(docs), fresh(docs, "shard"), fresh(docs, "slot")
    rows = numbered(docs, row)
    where = shard(rows, shards, row=row).select(F.col("row_id").alias(row), F.col("shard").alias(folder), F.col("slot").alias(slot))
    placed = rows.join(where, row).drop(row).repartitionByRange(folder, slot).sortWithinPartitions(folder, slot)
    placed.drop(slot).write.partitionBy(folder).parquet(path)


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard(documents(spark, sf_dir))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")
