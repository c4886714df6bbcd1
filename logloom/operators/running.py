"""Running totals and running last values per key that never put a hot key into one task.

A key's rows are cut into segments that follow its order (an hour of a
session, a prefix of a time string). The running sum inside a segment is a
window over (keys, segment); what comes before a segment is the prefix sum of
the segment totals, one row per key and segment, joined on the partitioning
that the window already has. Only as many rows meet in a task as one segment
of one key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def running_sum(rows: DataFrame, keys: list[str], segment: Column, order: list[str], value: Column, name: str, only: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the sum of value over the rows of the same keys up to and including this one.

    segment must not decrease in the given order; keys and segment must not be
    null (a plain equality lets the join use the window's partitioning). order
    must be total within the keys for a deterministic result. only (unique
    keys) leaves out the rows of all other keys: it meets the segment totals,
    never the rows, so a hot key isn't gathered to be filtered.
    """
    cut = rows.withColumn("_seg", segment).withColumn("_val", value.cast("bigint"))
    inner = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_seg").agg(F.sum("_val").alias("_total"))
    if only is not None:
        totals = totals.join(only.select(*keys), keys, "left_semi")
    offsets = totals.select(*keys, "_seg", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    joined = cut.withColumn("_sum", F.sum("_val").over(inner)).join(offsets, [*keys, "_seg"])
    return joined.withColumn(name, F.col("_sum") + F.col("_before")).drop("_seg", "_val", "_sum", "_before")


def running_last(rows: DataFrame, keys: list[str], segment: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the last value that isn't null in the rows of the same keys up to and including this one.

    The rules of running_sum hold for keys, segment and order.
    """
    cut = rows.withColumn("_seg", segment).withColumn("_val", value)
    inner = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_seg").agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.struct(*order))).alias("_end"))
    carried = ends.select(*keys, "_seg", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    joined = cut.withColumn("_own", F.last("_val", ignorenulls=True).over(inner)).join(carried, [*keys, "_seg"])
    return joined.withColumn(name, F.coalesce("_own", "_before")).drop("_seg", "_val", "_own", "_before")


def arrival_numbers(rows: DataFrame, group: Column, segment: Column, order: list[Column | str], name: str, back: bool = False) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... over all rows, by group, segment and order; from the last one if back.

    No task sees all rows or all segments: segments are counted within their
    group, and only the groups' totals, as many as there are groups, meet.
    """
    cut = rows.withColumn("_group", group)
    totals = cut.groupBy("_group").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = totals.select("_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), F.sum("_size").over(every).alias("_all"))
    at = F.col("_at") + F.col("_offset")
    numbered = running_sum(cut, ["_group"], segment, order, F.lit(1), "_at").join(offsets, "_group")
    return numbered.withColumn(name, F.col("_all") + 1 - at if back else at).drop("_group", "_at", "_offset", "_all")


ONE_TASK = 100_000  # rows that may meet in one task to be ranked


def ranked(rows: DataFrame, time: str, ties: list[Column | str], back: bool = False) -> DataFrame:
    """Add ``rank``: the place in the order by a time string (nulls lowest) and ties, from the last one if back.

    Rows are written once and counted on the way; up to ONE_TASK one window ranks them, beyond that months are the groups
    and hours the segments of a count. Ties are in ascending order even of a rank from the last one, so there they are
    given descending.
    """
    rows = materialize(rows, "listing", counts={"n": F.count("*")})
    n = rows._logloom_counts["n"] or 0
    if n <= ONE_TASK:
        at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(time), *ties)).cast("bigint")
        return rows.withColumn("rank", n + 1 - at if back else at)
    t = F.coalesce(F.col(time), F.lit(""))
    return arrival_numbers(rows, F.substring(t, 1, 7), F.substring(t, 1, 13), [F.col(time), *ties], "rank", back)
