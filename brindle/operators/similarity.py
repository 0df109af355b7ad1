"""Similar sets: exact Jaccard by co-occurrence counts, and MinHash with banding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.numeric import affine, affine_constants, binary_cosine, jaccard
from brindle.operators import blocks
from brindle.operators.ordering import dense_index
from brindle.sources.shared import written

#: 50 functions (a x + b) mod m.
LSH = tuple(affine_constants(50, 2, (0, 10_000), (20_000, 30_000)))

#: Pairs that meet at items, for each task that counts them.
PAIRS_A_TASK = 2_000_000


def sets(rows: DataFrame, key: str = "key", item: str = "item") -> DataFrame:
    """Distinct (key, item)."""
    return rows.select(F.col(key).alias("key"), F.col(item).alias("item")).where("key is not null and item is not null").distinct()


def sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count("*").alias("n"))


def common_counts(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, common), a < b, of keys that share at least `least` items; `pairs` is read several times. Tasks grow with
    the pairs that meet, not with the rows that they come from: each has some PAIRS_A_TASK, and an item at which more
    meet is shared out."""
    per = pairs.groupBy("item").agg(F.count("*").alias("c")).withColumn("met", F.col("c").cast("double") * F.col("c") / 2)
    tasks = int((per.agg(F.sum("met")).first()[0] or 0) // PAIRS_A_TASK) + 1
    x, y = pairs.select(F.col("key").alias("a"), "item"), pairs.select(F.col("key").alias("b"), "item")
    if tasks == 1:
        counted = x.join(y, "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    else:
        hot = F.broadcast(per.where(F.col("met") > PAIRS_A_TASK).select("item", F.ceil(F.col("met") / PAIRS_A_TASK).cast("int").alias("parts")))
        x = x.join(hot, "item", "left").select("a", "item", F.coalesce(F.pmod(F.hash("a"), "parts"), F.lit(0)).alias("part"))
        y = y.join(hot, "item", "left").select("b", "item", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        met = x.repartition(tasks, "item", "part").join(y.repartition(tasks, "item", "part"), ["item", "part"]).where("a < b").select("a", "b")
        counted = met.repartition(tasks, "a").groupBy("a", "b").agg(F.count("*").alias("common"))
    return counted.where(F.col("common") >= least) if least > 1 else counted


def _with_sizes(counted: DataFrame, size: DataFrame) -> DataFrame:
    return counted.join(size.select(F.col("key").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("key").alias("b"), F.col("n").alias("n_b")), "b")


def jaccard_pairs(pairs: DataFrame, least: float, counted: DataFrame | None = None) -> DataFrame:
    """(a, b, sim) of all pairs with Jaccard >= least. Where few items make nearly all sets share some,
    pairs are counted in blocks, and only those that pass leave them."""
    if counted is None:
        pairs = written(pairs, "sets")
        if blocks.few_items(pairs):
            found = blocks.classes(pairs)
            return blocks.expanded(written(blocks.class_pairs(found, blocks.set_measure(least)), "pairs"), found.members)
    both = _with_sizes(common_counts(pairs) if counted is None else counted, sizes(pairs))
    sim = jaccard(F.col("common"), F.col("n_a"), F.col("n_b"))
    return both.select("a", "b", sim.alias("sim")).where(F.col("sim") >= least)


def ordered(pairs: DataFrame) -> DataFrame:
    """By the first key, then the second."""
    return pairs.orderBy("a", "b")


def signatures(pairs: DataFrame, constants: tuple = LSH) -> DataFrame:
    """key and signature (array of long): the least hash of each function over the items' dense
    numbers. One aggregation with a minimum per function; no row is multiplied by the functions."""
    numbered = pairs.join(dense_index(pairs, "item"), "item").select("key", "index")
    mins = [F.min(affine(F.col("index"), *c)).alias(f"h{i}") for i, c in enumerate(constants)]
    return numbered.groupBy("key").agg(*mins).select("key", F.array(*(f"h{i}" for i in range(len(constants)))).alias("signature"))


def affine_table(index: DataFrame, constants: tuple) -> np.ndarray:
    """The functions' values for each number of an item."""
    return blocks.hash_table(index, [affine(F.col("index"), *c) for c in constants])


def bands(signed: DataFrame, rows: int = 1) -> DataFrame:
    """(key, band, value): the signature cut into bands of so many rows."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("signature") - 1) / rows).cast("int")), lambda i: F.slice("signature", i * rows + 1, rows))
    return signed.select("key", F.posexplode(cut).alias("band", "value"))


def candidates(banded: DataFrame) -> DataFrame:
    """(a, b), a < b, of keys that agree in a band."""
    x, y = banded.withColumnRenamed("key", "a"), banded.withColumnRenamed("key", "b")
    return x.join(y, ["band", "value"]).where("a < b").select("a", "b").distinct()


def lsh_pairs(pairs: DataFrame, least: float, rows: int = 1, constants: tuple = LSH, shared: int = 1) -> DataFrame:
    """(a, b, sim) of the candidates with Jaccard >= least: a subset of the exact join's result."""
    pairs = written(pairs, "sets")
    if blocks.few_items(pairs):
        found = blocks.classes(pairs)
        return blocks.expanded(blocks.class_pairs(found, blocks.set_measure(least, shared), affine_table(found.index, constants), rows), found.members)
    close = candidates(bands(signatures(pairs, constants), rows))
    x, y = pairs.select(F.col("key").alias("a"), "item"), pairs.select(F.col("key").alias("b"), "item")
    counted = close.join(x, "a").join(y, ["b", "item"]).groupBy("a", "b").agg(F.count("*").alias("common")).where(F.col("common") >= shared)
    return jaccard_pairs(pairs, least, counted)


def cosine_pairs(left: DataFrame, right: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, sim): binary cosine of left set a and right set b for wanted pairs (0 if disjoint);
    pairs with an unknown side drop out."""
    n_a = sizes(left).select(F.col("key").alias("a"), F.col("n").alias("n_a"))
    n_b = sizes(right).select(F.col("key").alias("b"), F.col("n").alias("n_b"))
    x, y = left.select(F.col("key").alias("a"), "item"), right.select(F.col("key").alias("b"), "item")
    known = wanted.join(n_a, "a").join(n_b, "b")
    common = known.join(x, "a").join(y, ["b", "item"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    both = known.join(common, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return both.select("a", "b", binary_cosine(F.col("common"), F.col("n_a"), F.col("n_b")).alias("sim"))
