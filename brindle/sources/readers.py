"""Batch and stream sources. Each returns a DataFrame and reads nothing before an action."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.ml import PipelineModel
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; missing fields are null; a byte-order mark before the first line is no
    part of it. Only the selected fields are parsed."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where("trim(value) != ''")
    return text.select(F.from_json("value", schema).alias("r")).select("r.*")


def json_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by the built-in reader, which prunes columns; for files without a byte-order mark."""
    return spark.read.schema(schema).json(path)


def csv_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("key", "item")) -> DataFrame:
    """Two string columns of a quoted CSV file with a header. Like its header, any row equal to it
    is dropped."""
    raw = spark.read.option("header", True).csv(path)
    a, b = raw.columns[:2]
    same = (F.col(f"`{a}`").eqNullSafe(F.lit(a))) & (F.col(f"`{b}`").eqNullSafe(F.lit(b)))
    return raw.where(~same).select(F.col(f"`{a}`").alias(names[0]), F.col(f"`{b}`").alias(names[1]))


def points(spark: SparkSession, path: str) -> DataFrame:
    """`id,f1,f2,...` per line, without a header: id and features (array of double)."""
    parts = spark.read.text(path).where("trim(value) != ''").select(F.split("value", ",").alias("p"))
    return parts.select(F.trim(F.col("p")[0]).cast("long").alias("id"), F.transform(F.slice("p", 2, 1 << 30), lambda x: F.trim(x).cast("double")).alias("features"))


def point_chunks(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    """(path, points) of each text file of a folder, in path order. The files are listed, not read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(s.getPath().toString() for s in found if s.isFile() and ".txt" in s.getPath().getName())
    return [(name, points(spark, name)) for name in names]


def word_list(spark: SparkSession, path: str, more: tuple[str, ...] = ("", " ")) -> DataFrame:
    """One word per line, and some more."""
    words = spark.read.text(path).select(F.regexp_replace("value", "[\r\n]", "").alias("word"))
    return words.union(spark.createDataFrame([(w,) for w in more], "word string")).distinct()


def dictionary(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A file that is one JSON object: a row per entry, with the value as double."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,double>")).alias(key, value))


def collection(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def pair_model(spark: SparkSession, path: str, names: tuple[str, str]) -> DataFrame:
    """A similarity model in JSON lines, under the column names that its sink gave."""
    a, b = names
    return spark.read.schema(f"{a} string, {b} string, sim double").json(path).select(F.col(a).alias("id1"), F.col(b).alias("id2"), "sim")


def fitted(path: str) -> PipelineModel:
    """A pipeline of fitted stages, as its sink saved it."""
    return PipelineModel.load(path)


def factors(path: str) -> ALSModel:
    """A factor model, as its sink saved it."""
    return ALSModel.load(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A model or result that was saved as a table."""
    return spark.read.parquet(path)


def socket_lines(spark: SparkSession, host: str, port: int, schema: str) -> DataFrame:
    """A stream of JSON lines from a TCP server."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*", kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """A stream over the files of a folder, so many per micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


class _Landed(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PushReader(DataSourceStreamReader):
    """What a push source's receiver has put into its buffer: JSON lines, file after file under ascending
    names, in a folder that all machines mount. Offsets count files, so that a batch can be read again;
    each file is read by a task of its own."""

    def __init__(self, folder: str) -> None:
        self.folder = urlparse(folder).path

    def _files(self) -> list[str]:
        return sorted(name for name in os.listdir(self.folder) if name.endswith(".json"))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> list[_Landed]:
        return [_Landed(f"{self.folder}/{name}") for name in self._files()[start["files"] : end["files"]]]

    def read(self, partition: _Landed) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            yield from ((line.rstrip("\n"),) for line in f if line.strip())

    def commit(self, end: dict) -> None:
        pass


class PushSource(DataSource):
    """`spark.readStream.format("push").option("path", buffer)`: a column `value`."""

    @classmethod
    def name(cls) -> str:
        return "push"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema: StructType) -> PushReader:
        return PushReader(self.options["path"])


def pushed_tags(spark: SparkSession, buffer: str, language: str = "en") -> DataFrame:
    """A stream of the hashtags of a push source's statuses in one language."""
    spark.dataSource.register(PushSource)
    schema = "id long, lang string, entities struct<hashtags: array<struct<text: string>>>"
    status = spark.readStream.format("push").option("path", buffer).load().select(F.from_json("value", schema).alias("s")).select("s.*")
    return status.where(F.col("lang") == language).select("id", F.posexplode("entities.hashtags.text").alias("place", "tag"))


def tag_stream(spark: SparkSession, folder: str, kind: str = "json") -> DataFrame:
    """Statuses of a push source as it lands them in a folder: one row per hashtag of each."""
    schema = "id long, lang string, entities struct<hashtags: array<struct<text: string>>>"
    status = file_stream(spark, folder, schema, kind=kind)
    return status.where("lang = 'en'").select("id", F.posexplode("entities.hashtags.text").alias("place", "tag"))
