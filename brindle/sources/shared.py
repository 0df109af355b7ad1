"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder serves, but only in local mode (tests); on a cluster a
    folder of one machine would lose data with that machine, so there it is an error.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="brindle-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_scopes: list[list[str]] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path there."""
    path = f"{shared_dir(spark)}/brindle-{what}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are written within."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        paths = _scopes.pop()
        if _scopes:
            _scopes[-1] += paths


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written within goes when it ends: results must have been written elsewhere by then."""
    with recorded() as paths:
        yield
    for path in paths:
        remove(spark, path)


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """`df`, computed once and read back from the shared folder: it cuts lineage, survives the loss
    of executors, and fixes anything (row numbers, samples) that a second evaluation might change."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
