"""Global row numbers and running sums without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.working import settle


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows by ranges of a total order, with the number of each range as __part. They are written
    down: sampled splitters may differ between two runs of a plan."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def running(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` (integers) over all rows before each, in a total order.

    Rows are range-partitioned and summed within their range; each range is moved on by the sums of
    those before it, of which there are as many as partitions.
    """
    ranged = _ranged(rows, order)
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = (F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long")
    return ranged.join(F.broadcast(base), "__part").withColumn(name, total).drop("__part", "__base")


def running_max(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the largest `value` of all rows up to each, in a total order, range by range as `running`."""
    ranged = _ranged(rows, order)
    tops = ranged.groupBy("__part").agg(F.max(value).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select("__part", F.max("__n").over(before).alias("__base"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(base), "__part").withColumn(name, F.greatest("__base", F.max(value).over(within))).drop("__part", "__base")


def zipped(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], name: str = "ordinal") -> DataFrame:
    """The i-th row of one side with the i-th of the other, each in its order; of a longer side the
    rest has nulls beside it. Column names of both sides should differ."""
    a, b = numbered(left, left_order, name), numbered(right, right_order, "__ordinal")
    joined = a.join(b, F.col(name) == F.col("__ordinal"), "full")
    return joined.withColumn(name, F.coalesce(name, "__ordinal")).drop("__ordinal")


def numbered(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the rows' number from 0 in a total order."""
    return running(rows.withColumn("__one", F.lit(1)), order, "__one", name).drop("__one")
