"""Distributed prefix sums: no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.plans.lineage import materialize


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], value: str | Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come earlier.

    ``bucket`` is a column that is monotone in ``order`` and cuts a group into bounded ranges (leading
    hex digits of a random key do). Bucket totals are summed map-side, turned into offsets by a window
    over buckets only, and joined back; the last window sorts single buckets. ``group`` and ``bucket``
    must not be null. ``df`` is read twice, so pass a materialised table.
    """
    keys = [*group, bucket]
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("_value", value)
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.sum("_value").alias("_total")).select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(offsets, keys).withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_value", "_offset")


def numbered(df: DataFrame, order: list[str | Column], out: str, group: list[str] | None = None, start: int = 1) -> DataFrame:
    """Add ``out``: the place of each row in ``order``, counted from ``start``, over all rows or within each ``group``.

    Rows are range-partitioned by group and order and sorted inside the ranges; the driver's part is one row of counts for each
    range and group that meets it, so no group and no table is one task's. Where ``order`` leaves ties, which of the tied rows comes first
    is fixed by the table that is written on the way. ``group`` must not be null; an empty table stays empty.
    """
    keys = group or []
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")
    parts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row to each range (and group in it): as many as there are partitions and groups
    earlier = (Window.partitionBy(*keys) if keys else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + start).alias("_offset"))
    return ranged.join(offsets, [*keys, "_part"]).withColumn(out, (F.col("_at") + F.col("_offset")).cast("long")).drop("_part", "_at", "_offset")
