"""From raw documents to tokens, in five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's docs. All but the last return documents' own columns. A filtering stage's result
does not depend on its number of tasks, and rows that it doesn't reject are left as they are, with
whatever other columns docs has, under any names. Rows repeat, ids and texts may be null; an empty
table stays one. What a stage wrote to the shared folder on its way goes when the next one begins, whose docs
are its written result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import byte_bpe, decontamination, exact_dedup, jaccard_join, toxicity
from brindle.llm.common import documents, shared_dir, table
from brindle.sources.shared import recorded, remove, scratch
from brindle.sources.shipping import ship


#: What the stage before left in the shared folder, by application.
_left: dict[str, list[str]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the one before left, unless its docs are read from there still."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        app = spark.sparkContext.applicationId
        old = _left.pop(app, [])
        read = docs.inputFiles() if old else []
        needed = [path for path in old if any(path.rsplit("/", 1)[1] in name for name in read)]
        for path in set(old) - set(needed):
            remove(spark, path)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _left[app] = needed + paths
        return out

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose noisy-or over sentences reaches the threshold, which a tie does. Null and
    empty texts stay, and where no labels of both classes are known, all documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space (null is equal to empty), the one with the smallest id; null ids
    come last, and of equal ids the first row stays."""
    return exact_dedup.drop_duplicates(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of 3-word-shingle Jaccard 0.7 or more, the one with the smallest id;
    null ids come last, and of equal ids the first row stays. Texts without words all stay."""
    return jaccard_join.drop_similar(docs)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a benchmark passage occurs. Null and empty texts stay, as does all
    without a benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (byte-level BPE) and n_tokens of every text: none for null and empty texts, a row for
    each repeated one. Other columns are left out."""
    return byte_bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenise),
]

#: A learned filter can't be put in SQL; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = f"{shared_dir(spark)}/brindle-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        if k:
            remove(spark, f"{path}/{k - 1}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
