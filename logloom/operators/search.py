"""Substring search over main messages, with turn numbers and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_like, snippet, tsv_sanitize
from ..functions.timeref import local_time
from ..sources.config import Config
from .filters import SessionFilter
from .turns import KEYS, main_messages, with_turns


def may_hit(query: str, where: SessionFilter | None = None) -> Column:
    """Whether a row as stored may be a hit."""
    return ~F.col("is_sidechain") & contains_like(F.col("content"), query) & (where or SessionFilter()).time("timestamp")


def hit_content(query: str, where: SessionFilter | None = None) -> Column:
    """The content of rows that may be hits, null for all others: what a shuffle before search_hits has to carry."""
    return F.when(may_hit(query, where), F.col("content")).alias("content")


def search_hits(messages: DataFrame, sessions: DataFrame, query: str, where: SessionFilter | None = None) -> DataFrame:
    """Main messages of known sessions that contain the query, ignoring ASCII case; times filter the message."""
    where = where or SessionFilter()
    hits = main_messages(messages).where(contains_like(F.col("content"), query) & where.time("timestamp"))
    s = sessions.select(*KEYS, F.coalesce("repo_path", F.lit("")).alias("repo_path")).where(where.project())
    return hits.join(s, KEYS).select(*KEYS, "uuid", "seq", "repo_path", "timestamp", "content")


def search_with_turns(messages: DataFrame, sessions: DataFrame, query: str, where: SessionFilter | None = None) -> DataFrame:
    """Hits with their turn.

    Turns are counted over all main messages, so contents are filtered only
    after them; until then rows carry the content of possible hits alone.
    """
    where = where or SessionFilter()
    main = main_messages(messages).select("uuid", "seq", *KEYS, "timestamp", "role", "is_sidechain", hit_content(query, where))
    s = sessions.select(*KEYS, F.coalesce("repo_path", F.lit("")).alias("repo_path")).where(where.project())
    return with_turns(main).where("content is not null").join(s, KEYS).select(*KEYS, "uuid", "seq", "repo_path", "timestamp", "content", "turn")


def search_report(messages: DataFrame, sessions: DataFrame, query: str, config: Config, where: SessionFilter | None, tz: str) -> DataFrame:
    """The search listing's columns, and the order it prints in (timestamp, seq descending)."""
    h = search_with_turns(messages, sessions, query, where)
    return h.select(
        "source", "session_id", "uuid", "turn", "timestamp", "seq",
        tsv_sanitize(local_time(F.col("timestamp"), tz)).alias("time"),
        tsv_sanitize(config.display(F.col("repo_path"))).alias("project"),
        tsv_sanitize(snippet(F.col("content"), query)).alias("snippet"),
    )
