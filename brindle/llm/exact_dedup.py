"""Exact deduplication by progressive refinement.

Texts are equal when they are identical after each run of white space became one space. Rows are
grouped by the length of that form and a hash of its beginning; only rows of groups with company
get a full hash. Which rows those are reaches the second scan as a bitmap of fixed size: a row that
it lets through for nothing merely costs one more hash, so the result does not depend on it.

Null texts count as empty and are equal to empty ones. Of equal texts the row with the smallest id
stays (null ids come last); of repeated rows with equal ids just one stays. An empty table gives an
empty result. Other columns don't matter, whatever their names; `drop_duplicates` keeps them. Asked
for digests, as its query is, it hashes every text, survivor or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, attach_groups, documents, fresh, numbered, texts, without_rows, written

#: Characters of the normalised text under the prefix hash.
PREFIX = 64

#: log2 of the bits of the survivors' bitmap: 2^23 bits are 1 MB at any size of input.
BITMAP = 23

_WORDS = 1 << 9


def normal(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def _slot(size: Column, prefix: Column) -> Column:
    return F.pmod(F.xxhash64(size, prefix), F.lit(1 << BITMAP))


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, row: str | None = None) -> DataFrame:
    """One row per row of `docs`: row_id, its id, keep_id, group_size, kept; with `digests` also
    `sha`, the SHA-256 of every normalised text (binary), else of surviving groups' only. `docs`
    must be a stable scan, as of files, since it is read twice; the numbers are the second scan's."""
    rows = texts(docs, id_col, text_col, row)
    keyed = rows.withColumn("form", normal("text")).select("row_id", "id", "form", F.octet_length("form").alias("size"), F.xxhash64(F.substring("form", 1, PREFIX)).alias("prefix"))
    # the smallest groups' keys never leave the map side whole: one row per (size, prefix)
    company = keyed.groupBy("size", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    bit = _slot(F.col("size"), F.col("prefix"))
    bitmap = (
        company.select(bit.alias("b"))
        .select(F.shiftright("b", 6).alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("mask"))
        .groupBy("word").agg(F.bit_or("mask").alias("mask"))
        .groupBy(F.expr(f"word div {_WORDS}").alias("page")).agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("masks"))
        .select("page", F.transform(F.sequence(F.col("page") * _WORDS, F.col("page") * _WORDS + (_WORDS - 1)), lambda w: F.coalesce(F.try_element_at("masks", w), F.lit(0))).alias("masks"))
    )
    pages = written(bitmap, "survivors")
    second = (
        keyed.withColumn("slot", bit)
        .join(F.broadcast(pages), F.expr(f"(slot div {64 * _WORDS}) = page"), "left")
        .withColumn("survives", F.coalesce(F.expr(f"getbit(masks[cast((slot div 64) % {_WORDS} as int)], cast(slot % 64 as int)) = 1"), F.lit(False)))
    )
    sha = F.unhex(F.sha2(F.col("form").cast("binary"), 256))
    scanned = written(second.select("row_id", "id", "survives", (sha if digests else F.when(F.col("survives"), sha)).alias("sha")), "hashes")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row_id").alias("row_id"))
    groups = written(
        scanned.where("survives").groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("group_size"))
        .where("group_size > 1").select("sha", F.col("first.id").alias("keep_id"), F.col("first.row_id").alias("keep_row"), "group_size"),
        "groups",
    )
    got = attach_groups(scanned.where("survives"), groups, "sha", "group_size").drop("survives")
    alone = scanned.where("not survives").drop("survives").withColumns({"keep_id": F.lit(None), "keep_row": F.lit(None), "group_size": F.lit(None)})
    single = F.col("keep_row").isNull()
    return got.unionByName(alone).select(
        "row_id",
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("keep_row") == F.col("row_id"))).alias("kept"),
        "sha",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `refine` does not keep."""
    row = fresh(docs)
    rows = numbered(docs, row)
    gone = written(refine(rows, id_col, text_col, row=row).where("not kept").select(F.col("row_id").alias(row)), "dropped")
    return without_rows(rows, gone, row).drop(row)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = refine(documents(spark, sf_dir), digests=True)
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
