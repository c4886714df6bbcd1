"""The stored tables and the two views that every query starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_id
from ..functions.times import rfc3339_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def first_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order (unique within a key for a deterministic result); at most one per key and task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_by_uuid(messages: DataFrame, *keep: Column) -> DataFrame:
    """One row per uuid, the one that arrived first (lowest seq).

    messages has uuid and seq; keep are the columns to carry, so that the one
    shuffle by uuid moves nothing else. The result has uuid (normalised, null
    as ''), seq and those columns. A null seq loses to any other.
    """
    slim = messages.select(F.coalesce(norm_id(F.col("uuid")), F.lit("")).alias("uuid"), F.col("seq"), *keep)
    return first_of(slim, ["uuid"], F.col("seq").asc_nulls_last())


FILTER_BYTES = 1 << 29  # below that, shuffling all rows again costs less than a scan for those wanted, or a copy


def stored_bytes(df: DataFrame) -> int:
    """An estimate from the sizes of the files read; the plan isn't optimised for it."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


BROADCAST_ROWS = 1_000_000  # of ids of 100 bytes at most


def small(rows: DataFrame) -> DataFrame:
    """rows of ids with the hint to broadcast them if there are few: they are counted, up to that bound."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def with_content(slim: DataFrame, messages: DataFrame) -> DataFrame:
    """slim (uuid, seq and others, one row per uuid) with the content of that very row.

    What narrow rows decided is fetched last: contents of other rows meet at most the join.
    """
    raw = messages.select(F.coalesce(norm_id(F.col("uuid")), F.lit("")).alias("uuid"), F.col("seq").alias("_seq"), "content")
    got = slim.join(raw, (slim["uuid"] == raw["uuid"]) & slim["seq"].eqNullSafe(raw["_seq"])).drop(raw["uuid"]).drop("_seq")
    return first_of(got, ["uuid"], "seq")  # a row that came twice


def canonical_messages(spark: SparkSession, sf_dir: str, *columns: str | Column, where: Column | None = None) -> DataFrame:
    """messages with one row per uuid and normalised session ids (the reference's table).

    columns are names or expressions; expressions are evaluated before the
    shuffle by uuid, so it can carry a length or a flag in place of a content.
    where (on the rows as stored) leaves, of a table over FILTER_BYTES, the
    messages of which some version meets it: if these are few, no other row is
    shuffled. What counts may be another version, so a filter on the result is
    still needed.
    """
    m = table(spark, sf_dir, "messages")
    if where is not None and stored_bytes(m) > FILTER_BYTES:
        its = m.where(where).select(norm_id(F.col("uuid")).alias("_u")).distinct()
        m = m.join(small(its), norm_id(m["uuid"]).eqNullSafe(F.col("_u")), "left_semi")
    cols = columns or ("source", "session_id", "parent_uuid", "role", "content", "timestamp", "is_sidechain")
    ids = ("session_id", "parent_uuid")
    keep = [c if not isinstance(c, str) else norm_id(F.col(c)).alias(c) if c in ids else F.col(c) for c in cols]
    return first_by_uuid(m, *keep)


def canonical_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions merged to one row per (source, session_id), as the importer's upsert would.

    In order of loading (loaded_at, then imported_at, then the value) the last
    non-empty value of each text column wins; started_at is the lowest and
    ended_at the highest stored string; no value at all gives '' for cwd,
    git_branch and version and null for the rest.
    """
    s = table(spark, sf_dir, "sessions")
    return merge_sessions(s, [F.coalesce("loaded_at", F.timestamp_micros(F.lit(0))), F.coalesce("imported_at", F.lit(""))])


def merge_sessions(s: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of each session merged, ids normalised; rows without source or id don't count."""
    known = s.withColumn("session_id", norm_id(F.col("session_id"))).where("session_id is not null and session_id <> '' and source is not null and source <> ''")
    return upsert_sessions(known, order)


def upsert_sessions(rows: DataFrame, order: list[Column], *more: Column) -> DataFrame:
    """The upsert of session rows: the last non-empty text of each column in the given order, the lowest start, the highest end."""

    def last(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c) != "", F.struct(*order, F.col(c))))

    return rows.groupBy("source", "session_id").agg(
        F.coalesce(last("cwd"), F.lit("")).alias("cwd"),
        last("repo_path").alias("repo_path"),
        F.coalesce(last("git_branch"), F.lit("")).alias("git_branch"),
        F.coalesce(last("version"), F.lit("")).alias("version"),
        last("custom_title").alias("custom_title"),
        last("agent_name").alias("agent_name"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.max("imported_at").alias("imported_at"),
        *more,
    )


def instant(c: str) -> Column:
    return rfc3339_micros(F.col(c))
