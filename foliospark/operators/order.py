"""Order within groups of any size: what stands before, after, and the running sum.

A group as large as a third of all rows must not be sorted by one task. Rows are
range-partitioned by group and order, so that a large group spans several parts; within
a part a window does the work, and what crosses a boundary is carried by one summary
row per group and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

PART = "_part"


def parts(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with the number of the part each row lies in. The rows of one key and order must not be null in either."""
    return written(df.repartitionByRange(key, *order).withColumn(PART, F.spark_partition_id()))


def _carried(df: DataFrame, key: str, summary: Column, across: Column) -> DataFrame:
    return df.groupBy(key, PART).agg(summary.alias("_s")).select(key, PART, across.alias("_c"))


def before(df: DataFrame, key: str, order: str, name: str, value: Column) -> DataFrame:
    """``name``: ``value`` of the row before in its group; null for the first."""
    boxed = F.struct(value.alias("v"))
    ends = _carried(df, key, F.max_by(boxed, order), F.lag("_s").over(Window.partitionBy(key).orderBy(PART)))
    out = df.withColumn("_w", F.lag(boxed).over(Window.partitionBy(key, PART).orderBy(order))).join(ends, [key, PART])
    return out.withColumn(name, F.coalesce("_w", "_c")["v"]).drop("_w", "_c")


def after(df: DataFrame, key: str, order: str, name: str, value: Column) -> DataFrame:
    """``name``: ``value`` of the row after in its group; null for the last."""
    boxed = F.struct(value.alias("v"))
    heads = _carried(df, key, F.min_by(boxed, order), F.lead("_s").over(Window.partitionBy(key).orderBy(PART)))
    out = df.withColumn("_w", F.lead(boxed).over(Window.partitionBy(key, PART).orderBy(order))).join(heads, [key, PART])
    return out.withColumn(name, F.coalesce("_w", "_c")["v"]).drop("_w", "_c")


def latest(df: DataFrame, key: str, order: str, name: str, value: Column) -> DataFrame:
    """``name``: the last ``value`` up to this row that isn't null."""
    boxed = F.when(value.isNotNull(), F.struct(value.alias("v")))
    earlier = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = _carried(df, key, F.max_by(boxed, F.when(value.isNotNull(), F.col(order))), F.last("_s", ignorenulls=True).over(earlier))
    out = df.withColumn("_w", F.last(boxed, ignorenulls=True).over(Window.partitionBy(key, PART).orderBy(order))).join(ends, [key, PART])
    return out.withColumn(name, F.coalesce("_w", "_c")["v"]).drop("_w", "_c")


def running(df: DataFrame, key: str, order: str, name: str, value: Column) -> DataFrame:
    """``name``: the sum of ``value`` up to and with this row."""
    earlier = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = _carried(df, key, F.sum(value), F.sum("_s").over(earlier))
    out = df.withColumn("_w", F.sum(value).over(Window.partitionBy(key, PART).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).join(sums, [key, PART])
    return out.withColumn(name, F.col("_w") + F.coalesce("_c", F.lit(0))).drop("_w", "_c")
