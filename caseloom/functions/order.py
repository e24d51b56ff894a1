"""Places in an order over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """df with ``part``: numbers of ranges that follow each other in the order of the keys; written, so that the numbers stay."""
    return kept(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranged")


def indexed(df: DataFrame, *keys: str) -> DataFrame:
    """df with ``index``: the place of each row in the order of the keys, from 0.

    Rows are numbered inside ranges and moved on by the rows of earlier ranges; a window over the whole sees a row a range.
    """
    rows = ranged(df, *keys)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    offsets = counts.select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("index", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def lagged(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """df with ``before``: a column's value in the row before in the order of the keys, null in the first row and after a null value."""
    rows = ranged(df, *keys)
    last = rows.groupBy("part").agg(F.max_by(column, F.struct(*keys)).alias("last"))
    carried = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("carried"))  # a row a range
    w = Window.partitionBy("part").orderBy(*keys)
    inside = rows.withColumns({"before": F.lag(column).over(w), "first": F.row_number().over(w) == 1})
    out = inside.join(F.broadcast(carried), "part", "left")
    return out.withColumn("before", F.when(F.col("first"), F.col("carried")).otherwise(F.col("before"))).drop("part", "first", "carried")
