"""Positions, running sums and last values within groups of any size, without a window over a whole group.

Rows are range-partitioned by group and order, so a group however large spans partitions of bounded size. Each partition is
worked on by itself; what comes before it is one row a group and partition, and added afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

_PART = "__part"


def laid(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df range-partitioned by group and order, each row with its partition's number; made once."""
    return cut(df.repartitionByRange(by, *order).withColumn(_PART, F.spark_partition_id()))


def _before(rows: DataFrame, by: str, value: Column, combine: Column, name: str) -> DataFrame:
    """(by, part, name): the partitions' values of each group combined over the partitions before."""
    each = rows.groupBy(by, _PART).agg(value.alias("__v"))
    return each.select(by, _PART, combine.over(Window.partitionBy(by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def _joined(rows: DataFrame, before: DataFrame, by: str) -> DataFrame:
    b = before.withColumnsRenamed({by: "__by", _PART: "__p"})
    return rows.join(b, F.col(by).eqNullSafe(F.col("__by")) & (F.col(_PART) == F.col("__p")), "left").drop("__by", "__p")


def running_sum(rows: DataFrame, by: str, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """rows (of laid) with the sum of ``value`` up to and with each row."""
    d = rows.withColumn("__x", value)
    before = _before(d, by, F.sum("__x"), F.sum("__v"), "__b")
    local = F.sum("__x").over(Window.partitionBy(_PART, by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(d.withColumn("__l", local), before, by).withColumn(name, F.col("__l") + F.coalesce("__b", F.lit(0))).drop("__x", "__l", "__b")


def last_before(rows: DataFrame, by: str, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """rows (of laid) with the last value that is not null before each row."""
    d = rows.withColumn("__x", value)
    last = F.max_by("__x", F.when(F.col("__x").isNotNull(), F.struct(*order)))
    before = _before(d, by, last, F.last("__v", ignorenulls=True), "__b")
    local = F.last("__x", ignorenulls=True).over(Window.partitionBy(_PART, by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return _joined(d.withColumn("__l", local), before, by).withColumn(name, F.coalesce("__l", "__b")).drop("__x", "__l", "__b")


def numbered(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with ``n``, the 1-based position of each row within its ``by`` by ``order``."""
    return running_sum(laid(df, by, order), by, (order,), F.lit(1), "n").drop(_PART)
