"""Gap-free row numbers in a total order, without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

# monotonically_increasing_id() keeps the row number of a partition in its low bits
ROW_BITS = 33


def dense_ids(df: DataFrame, order: Sequence[Column | str], name: str = "id") -> DataFrame:
    """Number the rows 1, 2, 3 ... by ``order``, which must be a total order.

    The rows are range-partitioned and sorted once and stored together with
    their place inside the slice, so that a retry cannot number them
    differently. Only one offset per slice is broadcast.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    stored = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "dense-ids",
    )
    slice_no = F.shiftrightunsigned("_place", ROW_BITS)
    placed = stored.withColumn("_slice", slice_no).withColumn(
        "_row", F.col("_place") - F.shiftleft(slice_no, ROW_BITS)
    )
    # at most one row per partition, so the unpartitioned window stays small
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice")
        .agg((F.max("_row") + 1).alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return placed.join(F.broadcast(offsets), "_slice").select(
        (F.col("_offset") + F.col("_row") + 1).alias(name), *df.columns
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str = "sum"
) -> DataFrame:
    """Add the running sum of ``value`` within each group of ``keys``, in a total order. Groups may be of any size.

    The rows are range-partitioned by keys and order and stored, as for :func:`dense_ids`. Within a slice the sums
    run by themselves; a group that goes on from earlier slices starts with what they have of it. Only a slice's first group can go on,
    so there is one such row per slice.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    stored = materialise(
        df.withColumn("_value", value.cast("long"))
        .repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "running-sums",
    )
    group = F.struct(*keys).alias("_group")
    placed = stored.withColumn("_slice", F.shiftrightunsigned("_place", ROW_BITS))
    first = placed.groupBy("_slice").agg(F.min(F.struct("_place", group))["_group"].alias("_group"))
    # what each slice has of the groups that stand first in some slice: a few rows per slice
    going_on = F.broadcast(first.select("_group").distinct())
    parts = placed.withColumn("_group", group).join(going_on, "_group").groupBy("_group", "_slice").agg(F.sum("_value").alias("_part"))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_group", "_slice", F.sum("_part").over(earlier).alias("_offset")).filter("_offset is not null")
    inside = Window.partitionBy("_slice", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_sum", F.sum("_value").over(inside)).withColumn("_group", group)
    return local.join(F.broadcast(offsets), ["_slice", "_group"], "left").select(
        *df.columns, (F.col("_sum") + F.coalesce("_offset", F.lit(0))).alias(name)
    )
