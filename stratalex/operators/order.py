"""Running sums over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalex.sources.scratch import written


def with_sum_before(rows: DataFrame, group: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, in the group's order.

    Rows are dealt by ranges of (group, order), so that a group of a third of all rows is
    spread over many tasks.  Each task sums up its own rows, and the totals of the tasks
    before, one row for each task and group, are added.
    """
    ranged = rows.withColumn("_value", value).repartitionByRange(group, *order).withColumn("_task", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    before = lambda w: F.coalesce(F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = ranged.withColumn("_inner", before(Window.partitionBy("_task", group).orderBy(*order)))
    totals = ranged.groupBy(group, "_task").agg(F.sum("_value").alias("_value"))
    totals = totals.withColumn("_base", before(Window.partitionBy(group).orderBy("_task"))).select(F.col(group).alias("_group"), F.col("_task").alias("_of"), "_base")
    both = inner.join(totals, (F.col("_task") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn(name, F.col("_inner") + F.col("_base")).drop("_value", "_task", "_inner", "_group", "_of", "_base")
