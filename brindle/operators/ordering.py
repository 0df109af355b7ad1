"""Dense numbers without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.shared import written


def dense_index(df: DataFrame, column: str, name: str = "index") -> DataFrame:
    """The distinct non-null values of a column, numbered from 0 in their order. Values are sorted in
    ranges; a range's first number is the count of values in the ranges before it, so only one
    number per partition reaches the driver."""
    spark = df.sparkSession
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    run = written(values.repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()), "index")
    part = F.shiftright("_at", 33)
    total, before = 0, []
    for p, n in sorted(run.groupBy(part).count().collect()):
        before.append((p, total))
        total += n
    first = spark.createDataFrame(before, "_part long, _first long")
    return run.join(F.broadcast(first), part == F.col("_part")).select(column, (F.col("_first") + F.expr("_at & 8589934591")).alias(name))
