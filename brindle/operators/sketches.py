"""Membership, distinct counts and samples in bounded space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numeric import affine, affine_constants, text_mod, trailing_zeros

BLOOM_BITS = 80_000_000
BLOOM = tuple(affine_constants(1, 2, (0, 10_000)))

#: 121 groups of two hash functions.
FM_GROUPS, FM_PER = 121, 2
FM = tuple(affine_constants(FM_GROUPS * FM_PER, 3, (0, 200), (201, 300)))


def positions(name: Column, bits: int = BLOOM_BITS, constants: tuple = BLOOM) -> Column:
    """The bits that a name sets; null for null and empty names."""
    folded = text_mod(name, bits)
    return F.when(folded.isNotNull(), F.array(*(affine(folded, a, b, bits) for a, b in constants)))


def bloom_filter(names: DataFrame, column: str, bits: int = BLOOM_BITS, constants: tuple = BLOOM) -> DataFrame:
    """(bit): the set bits only, as a table, however many bits the filter has."""
    return names.select(F.explode(positions(F.col(column), bits, constants)).alias("bit")).distinct()


def bloom_probe(names: DataFrame, column: str, filter: DataFrame, bits: int = BLOOM_BITS, constants: tuple = BLOOM) -> DataFrame:
    """`names` with `member`: no member is missed, few others pass; null and empty names are none."""
    asked = names.select(column, F.monotonically_increasing_id().alias("_row"), F.explode_outer(positions(F.col(column), bits, constants)).alias("bit"))
    hit = filter.withColumn("_set", F.lit(True))
    met = asked.join(hit, "bit", "left")
    if len(constants) == 1:
        return met.select(column, F.coalesce("_set", F.lit(False)).alias("member"))
    return met.groupBy("_row", column).agg(F.coalesce(F.every(F.coalesce("_set", F.lit(False))), F.lit(False)).alias("member")).drop("_row")


def flajolet_martin(values: DataFrame, column: str, by: list[str], constants: tuple = FM, per: int = FM_PER) -> DataFrame:
    """by..., truth, estimate: the median over groups of functions of the mean of 2^r, r being the most
    trailing zeros that a function's hashes have. Each distinct value is hashed once."""
    known = values.select(*by, F.col(column).alias("_v")).where("_v is not null").distinct()
    # the text's number is folded modulo each function's own modulus
    consts = [F.lit([int(c[k]) for c in constants]).cast("array<long>") for k in range(3)]
    spread = known.select(*by, "_v", F.explode(F.sequence(F.lit(0), F.lit(len(constants) - 1))).alias("f"))
    spread = spread.select(*by, "_v", "f", F.floor(F.col("f") / per).alias("g"), *(F.get(c, F.col("f")).alias(n) for c, n in zip(consts, "abm")))
    zeros = trailing_zeros((_fold(F.col("_v"), F.col("m")) * F.col("a") + F.col("b")) % F.col("m"))
    longest = spread.select(*by, "g", "f", zeros.alias("r")).groupBy(*by, "g", "f").agg(F.max("r").alias("r"))
    means = longest.groupBy(*by, "g").agg(F.avg(F.pow(F.lit(2.0), "r")).alias("mean"))
    estimate = means.groupBy(*by).agg(F.median("mean").alias("estimate"))
    truth = known.groupBy(*by).agg(F.count("*").alias("truth"))
    if by:
        return truth.join(estimate, by)
    one = F.lit(1)
    return truth.withColumn("_", one).join(estimate.withColumn("_", one), "_").drop("_")


def _fold(text: Column, m: Column) -> Column:
    raw = F.hex(text.cast("binary"))
    digits = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(F.when(F.octet_length(text) > 0, digits), F.lit(0).cast("long"), lambda acc, d: (acc * 256 + d) % m)


def sample(rows: DataFrame, key: str, n: int = 100) -> DataFrame:
    """A uniform sample of n rows: those whose keys' MD5 is least. The same rows come out whatever the
    partitions, and samples of parts merge into that of the whole."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def top_frequencies(rows: DataFrame, column: str, n: int = 3) -> DataFrame:
    """Values with one of the n highest frequencies, ties included."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    place = F.dense_rank().over(Window.orderBy(F.desc("n")))
    # the window sorts one row per frequency, not per value
    kept = counted.groupBy("n").agg(F.lit(1).alias("_")).withColumn("place", place).where(F.col("place") <= n).drop("_")
    return counted.join(F.broadcast(kept), "n").select(column, "n", "place")
