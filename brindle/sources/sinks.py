"""Sinks. Every one overwrites, so that a second run does not add to the first one's result."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.shared import shared_path


def json_object(result: DataFrame, path: str) -> None:
    """A one-row result as one JSON object in one file."""
    result.limit(1).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def json_lines(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").json(path)


def csv_file(result: DataFrame, path: str) -> None:
    """A folder with one CSV file with a header. Tasks write parts of it, whose bytes are appended to the
    header in the result's order; no task has all rows, and a part goes when it has been appended."""
    spark, made = result.sparkSession, [f"{path}.{what}" for what in ("header", "parts")]
    spark.createDataFrame([tuple(result.columns)], ", ".join(f"c{i} string" for i in range(len(result.columns)))).coalesce(1).write.mode("overwrite").csv(made[0])
    result.write.mode("overwrite").csv(made[1])
    hadoop, conf = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    folder = hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    files.delete(folder, True)
    out = files.create(hadoop.fs.Path(folder, "part-00000.csv"))
    try:
        for each in made:
            parts = sorted((s.getPath() for s in files.listStatus(hadoop.fs.Path(each)) if s.getPath().getName().startswith("part-")), key=lambda part: part.getName())
            for part in parts:
                piece = files.open(part)
                try:
                    hadoop.io.IOUtils.copyBytes(piece, out, conf, False)
                finally:
                    piece.close()
                files.delete(part, True)
            files.delete(hadoop.fs.Path(each), True)
    finally:
        out.close()


def text_file(lines: DataFrame, path: str) -> None:
    """A column of lines as one text file of that very name; the folder that Spark writes goes."""
    spark, made = lines.sparkSession, f"{path}.parts"
    lines.coalesce(1).write.mode("overwrite").text(made)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(made)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    files.delete(hadoop.Path(path), True)
    files.rename(part, hadoop.Path(path))
    files.delete(folder, True)


def tuple_lines(result: DataFrame, path: str) -> None:
    """One row per line, its columns quoted and separated by commas, in the result's order."""
    shown = [F.concat(F.lit("'"), F.col(c), F.lit("'")) if t == "string" else F.col(c).cast("string") for c, t in result.dtypes]
    result.select(F.concat_ws(", ", *shown).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def flags_line(flags: DataFrame, order: str, flag: str, path: str) -> None:
    """Booleans as T and F in order, a space after each, without line ends: the files in the order of
    their names are one line. Rows are sorted in ranges; no task has them all."""
    letter = F.when(F.col(flag), "T").otherwise("F")
    flags.repartitionByRange(order).sortWithinPartitions(order).select(letter.alias("value")).write.mode("overwrite").option("lineSep", " ").text(path)


def itemset_text(itemsets: DataFrame, path: str) -> None:
    """Itemsets of each phase by size, each as a parenthesised tuple, sizes in lines of their own: the
    files in the order of their names are the text. Rows are sorted in ranges, and an itemset brings
    what goes before it (a comma; a line end where a size begins; the phase's name where that does),
    for which the first itemset of each size is looked up: a row per phase and size."""
    # the closing sign of a tuple serves as the end of a row
    one = F.concat(F.lit("('"), F.array_join("itemset", "', '"), F.lit("'"))
    rows = itemsets.select("phase", F.size("itemset").alias("k"), one.alias("t"))
    starts = rows.groupBy("phase", "k").agg(F.min("t").alias("first"))
    begins = starts.join(starts.groupBy("phase").agg(F.min("k").alias("least")), "phase")
    whole = starts.agg(F.min("phase").alias("top"))
    marked = rows.join(F.broadcast(begins), ["phase", "k"]).join(F.broadcast(whole.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))
    name = F.concat(F.when(F.col("phase") == F.col("top"), "").otherwise("\n"), F.col("phase"), F.lit(":\n"))
    before = F.when(F.col("t") != F.col("first"), ",").when(F.col("k") == F.col("least"), name).otherwise("\n")
    order = ["phase", "k", "t"]
    text = marked.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat(before, "t").alias("value"))
    text.write.mode("overwrite").option("lineSep", ")").text(path)


def model(fitted: MLWritable, path: str) -> None:
    fitted.write().overwrite().save(path)


def table(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").parquet(path)


def appended_csv(batch: DataFrame, path: str, number: int) -> None:
    """What a window, a tag or a round adds to a result: a CSV part with a header under `path`, in a
    folder of the batch's number, so that a batch that runs again replaces its own part only."""
    batch.write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")


def stream_to_csv(stream: DataFrame, path: str, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Each micro-batch's result as `appended_csv`: all that there is now, or a batch at every so long
    a time, until it is stopped."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(stream.sparkSession, "stream"))
    out = out.trigger(processingTime=every) if every else out.trigger(availableNow=True)
    return out.foreachBatch(lambda batch, number: appended_csv(batch, path, number)).start()


def stream_to_table(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """All that a stream has now, as Parquet. In complete mode each batch replaces the one before."""
    spark = stream.sparkSession
    out = stream.writeStream.option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True)
    if mode == "append":
        return out.outputMode("append").format("parquet").option("path", path).start()
    return out.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
