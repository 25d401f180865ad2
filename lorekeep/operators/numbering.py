"""Running sums over groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage


def running_sums(rows: DataFrame, group: list[str], order: list[str], amount: str, name: str = "before", total: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows that come before in ``order`` within ``group``
    (and, if ``total`` is given, over the whole group).

    Rows are range-partitioned by (group, order) and written; each range adds up its share of a group, and the
    sums of the ranges before it are added: a table of one row for each range and group in it. So a group
    that holds most rows is as many tasks as it fills ranges. Group columns hold no nulls; rows alike in all
    ``order`` columns fall into one range and come in any order. ``rows`` is evaluated twice (once for
    the bounds of the ranges), so pass a written table if it is costly. Columns named _range, _before, _sum and _whole
    are reserved.
    """
    placed = cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy("_range", *group).agg(F.sum(amount).alias("_sum"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)), "_whole": F.sum("_sum").over(whole)})
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_sum", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    summed = local.join(starts.drop("_sum"), ["_range", *group])
    result = summed.withColumn(name, F.col("_sum") + F.col("_before"))
    if total:
        result = result.withColumn(total, F.col("_whole"))
    return result.select(*rows.columns, name, *([total] if total else []))
