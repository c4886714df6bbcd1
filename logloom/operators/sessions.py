"""Session and project listings, lookups, and what keeps the tables consistent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import worktree_root
from ..functions.timeref import logical_day, time_range
from ..sources.config import Config
from .filters import SessionFilter
from .turns import KEYS, body_columns, command_column, noncommand_aggregates

ROW = ["source", "session_id", "cwd", "repo_path", "started_at", "ended_at", "custom_title", "message_count", "body_size"]


def list_sessions(sessions: DataFrame, messages: DataFrame, where: SessionFilter | Column | None = None, more: list[Column] | None = None) -> DataFrame:
    """Session rows with message count (sidechains included) and bytes of main messages.

    Messages are aggregated before the join, so wide session rows are not
    repeated; sessions without messages stay. more are further aggregates over
    a session's messages.
    """
    s = sessions
    if where is not None:
        s = s.where(where.sessions() if isinstance(where, SessionFilter) else where)
    size = F.col("bytes") if "bytes" in messages.columns else F.octet_length("content")
    per = messages.groupBy(*KEYS).agg(F.count("uuid").alias("message_count"), F.sum(F.when(~F.col("is_sidechain"), size)).alias("body_size"), *(more or []))
    added = [c for c in per.columns if c not in (*KEYS, "message_count", "body_size")]
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return s.join(per, KEYS, "left").select(*KEYS, *map(blank, ["cwd", "repo_path", "started_at", "ended_at", "custom_title"]), zero("message_count"), zero("body_size"), *added)


def sessions_report(sessions: DataFrame, messages: DataFrame, config: Config, where: SessionFilter | None, tz: str, boundary: dt.timedelta = dt.timedelta(), short: bool = False) -> DataFrame:
    """The sessions listing: session rows with project, day, range and non-command user turns.

    One aggregate over the messages, sidechains included, gives everything; of
    a sidechain row only the count is used. messages has content, or the
    columns that listings take from it.
    """
    m = messages
    if "command" not in m.columns:
        m = m.select("uuid", *KEYS, "timestamp", "seq", "role", "is_sidechain", *body_columns(), command_column(config.patterns))
    m = m.withColumn("command", F.col("command") | F.col("is_sidechain"))
    rows = list_sessions(sessions, m, where, noncommand_aggregates())
    return rows.select(
        *ROW,
        config.display(F.col("repo_path"), short).alias("project"),
        time_range(F.col("started_at"), F.col("ended_at"), tz).alias("time_range"),
        logical_day(F.col("started_at"), F.col("ended_at"), tz, boundary).alias("logical_day"),
        F.coalesce("noncommand_turns", F.lit(0)).cast("bigint").alias("noncommand_turns"),
        F.coalesce("first_noncommand_line", F.lit("")).alias("first_noncommand_line"),
    )


def list_projects(sessions: DataFrame, where: SessionFilter | None = None) -> DataFrame:
    """(repo_path, session_count, last_started): null and '' are one project; projects of the filter don't apply."""
    s = sessions.where(where.time("started_at")) if where else sessions
    return s.groupBy(F.coalesce("repo_path", F.lit("")).alias("repo_path")).agg(F.count("*").alias("session_count"), F.max("started_at").alias("last_started"))


def projects_report(sessions: DataFrame, config: Config, where: SessionFilter | None = None, short: bool = False) -> DataFrame:
    """Projects with aliased ones merged under their canonical name; others stay apart even if they print alike. repo_path tells them apart."""
    p = list_projects(sessions, where)
    alias = config.canonical(F.col("repo_path"))
    key = F.when(alias.isNotNull(), F.concat(F.lit("alias:"), alias)).otherwise(F.concat(F.lit("raw:"), F.col("repo_path")))
    return (
        p.select(key.alias("_key"), config.display(F.col("repo_path"), short).alias("project"), "session_count", "last_started")
        .groupBy("_key")
        .agg(F.first("project").alias("project"), F.sum("session_count").alias("session_count"), F.max("last_started").alias("last_started"))
        .withColumnRenamed("_key", "repo_path")
    )


def session_lookup(sessions: DataFrame, messages: DataFrame, session_id: str) -> DataFrame:
    """Session rows with this id in any source."""
    same = F.col("session_id") == session_id
    return list_sessions(sessions.where(same), messages.where(same))


def ambiguous_ids(sessions: DataFrame) -> DataFrame:
    """(session_id, n_sources) of ids that more than one source has."""
    return sessions.groupBy("session_id").agg(F.count_distinct("source").alias("n_sources")).where("n_sources > 1")


def orphan_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions without any message."""
    return sessions.join(messages.select(*KEYS), KEYS, "left_anti")


def backfill_targets(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with messages and a cwd, but without repo_path, and the path their cwd gives by itself."""
    todo = sessions.where("repo_path is null and cwd is not null and cwd <> ''")
    return todo.join(messages.select(*KEYS), KEYS, "left_semi").select(*KEYS, "cwd", worktree_root(F.col("cwd")).alias("resolved"))


def backfill(sessions: DataFrame, messages: DataFrame, resolved: DataFrame) -> DataFrame:
    """sessions without orphans, repo_path filled from resolved (cwd, repo): one row per distinct cwd."""
    kept = sessions.join(messages.select(*KEYS), KEYS, "left_semi")
    r = resolved.select(F.col("cwd").alias("_cwd"), F.nullif("repo", F.lit("")).alias("_repo"))
    need = F.col("repo_path").isNull() & (F.coalesce("cwd", F.lit("")) != "")
    return kept.join(r, need & (F.col("cwd") == F.col("_cwd")), "left").withColumn("repo_path", F.coalesce("repo_path", "_repo")).drop("_cwd", "_repo")
