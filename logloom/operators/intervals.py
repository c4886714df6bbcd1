"""Overlapping and touching intervals per entity: continuous periods and gaps.

Spark's session_window with a row-specific duration merges the intervals that
start on the same day of an entity; a day's periods are then stitched to those
before it through one summary row per entity and day (the highest end so far),
so that an entity with a third of all rows is spread over its days and no task
sees more than one day of it. session_window drops empty windows and joins what
touches, so each closed interval [a, b] enters on a doubled scale as
[2a, 2b + 1]: none is empty, and two touch or overlap exactly if the closed
intervals share an instant.

Nulls: rows without entity or readable start don't count; a missing or
unreadable end equals the start; rows with end before start don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utrim, worktree_root
from ..functions.times import rfc3339_micros
from ..runtime import materialize

DAY_US = 86_400_000_000


def repo_entity(c: Column) -> Column:
    """A repo_path without outer spaces, worktree part and slashes at its end; null if nothing is left."""
    return F.nullif(F.regexp_replace(utrim(worktree_root(utrim(c))), r"/+\z", ""), F.lit(""))


def merge_intervals(rows: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """From (entity, a, b) in microseconds, a <= b: periods (entity, bucket, a, b, prev_end).

    prev_end is the end of the period before it of the same entity, null for the first.
    """
    iv = rows.select("entity", F.floor(F.col("a") / F.lit(bucket_us)).alias("bucket"), F.timestamp_micros(F.col("a") * 2).alias("ts"), F.expr("cast(concat(2 * (b - a) + 1, ' microseconds') as interval)").alias("dur"))
    part = (
        iv.groupBy("entity", "bucket", F.session_window("ts", F.col("dur")).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("entity", "bucket", F.shiftright(F.unix_micros("w.start"), 1).alias("a"), F.shiftright(F.unix_micros("w.end") - 1, 1).alias("b"))
    )
    part = materialize(part, "day-periods")  # read four times
    # What earlier buckets of the entity reach into this one: bounded by its days.
    days = part.groupBy("entity", "bucket").agg(F.max("b").alias("top"))
    before = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select("entity", "bucket", F.max("top").over(before).alias("carry"))
    inside = Window.partitionBy("entity", "bucket").orderBy("a")
    reach = part.join(carry, ["entity", "bucket"]).withColumn(
        "prev_end", F.greatest("carry", F.max("b").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    )
    opened = reach.withColumn("opens", F.col("prev_end").isNull() | (F.col("a") > F.col("prev_end")))
    # The period a row belongs to: the last one opened at or before it, in its bucket or an earlier one.
    last_open = opened.where("opens").groupBy("entity", "bucket").agg(F.max("a").alias("last_a"))
    marks = days.join(last_open, ["entity", "bucket"], "left").select("entity", "bucket", F.max("last_a").over(before).alias("open_a"))
    owned = opened.join(marks, ["entity", "bucket"]).withColumn(
        "start", F.coalesce(F.max(F.when(F.col("opens"), F.col("a"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "open_a")
    )
    return owned.groupBy("entity", "start").agg(F.max("b").alias("b"), F.max(F.when(F.col("opens"), F.col("prev_end"))).alias("prev_end")).select("entity", F.col("start").alias("a"), "b", "prev_end")


def periods_and_gaps(rows: DataFrame) -> DataFrame:
    """(entity, span_kind, from_us, to_us): the periods, and the gaps between successive ones."""
    p = merge_intervals(rows)
    spans = F.array(
        F.struct(F.lit("period").alias("span_kind"), F.col("a").alias("from_us"), F.col("b").alias("to_us")),
        F.struct(F.lit("gap").alias("span_kind"), F.col("prev_end").alias("from_us"), F.col("a").alias("to_us")),
    )
    return p.select("entity", F.inline(F.filter(spans, lambda s: s["from_us"].isNotNull())))


def find_spans(sessions: DataFrame) -> DataFrame:
    """Rows of p6_found: repo_path, span_kind, from_ms, to_ms."""
    iv = (
        sessions.select(repo_entity(F.col("repo_path")).alias("entity"), rfc3339_micros(F.col("started_at")).alias("a"), rfc3339_micros(F.col("ended_at")).alias("e"))
        .where("entity is not null and a is not null")
        .select("entity", "a", F.coalesce("e", "a").alias("b"))
        .where("a <= b")
    )
    ms = lambda c: F.floor(F.col(c) / F.lit(1000)).cast("bigint")
    return periods_and_gaps(iv).select(F.col("entity").alias("repo_path"), "span_kind", ms("from_us").alias("from_ms"), ms("to_us").alias("to_ms")).distinct()
