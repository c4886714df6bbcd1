"""Turns: a session's main messages in order, numbered by its user messages.

A turn starts at each user message; messages before the first belong to turn 1.
Order is the stored time string, then arrival. Numbers come from a running
count in segments of a session's hours, so a session with a third of all rows
is spread over its hours.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_line, is_command, not_synthetic
from ..functions.timeref import UsageError
from ..runtime import materialize
from ..sources import tables
from .running import running_sum

KEYS = ["source", "session_id"]


def main_messages(messages: DataFrame) -> DataFrame:
    """Without sidechains and without rows that name no session."""
    return messages.where("is_sidechain = false and source is not null and session_id is not null")


def hour() -> Column:
    """The segments of a session: a prefix of a string grows with it in byte order, so it can cut the order of times."""
    return F.substring(F.coalesce("timestamp", F.lit("")), 1, 13)


def with_turns(messages: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """main messages (of the sessions in only) with their turn number. Filter content only after this, or turns renumber."""
    if tables.stored_bytes(messages) > tables.FILTER_BYTES:  # read for the totals and for the rows
        messages = materialize(messages, "turn-rows")
    counted = running_sum(messages, KEYS, hour(), ["timestamp", "seq"], F.when(F.col("role") == "user", 1).otherwise(0), "_users", only)
    return counted.withColumn("turn", F.greatest(F.col("_users"), F.lit(1)).cast("bigint")).drop("_users")


def user_turns(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'")


def body_columns() -> list[Column]:
    """What listings need of a content: its bytes and, of user messages, the first line. Far narrower than the content."""
    return [F.octet_length("content").alias("bytes"), F.when(F.col("role") == "user", first_line(F.col("content"))).alias("line")]


def outline(messages: DataFrame) -> DataFrame:
    """One row per user message: turn, its time, bytes of the whole turn, first line.

    messages has content or the body_columns. A turn has one user message at
    most, so one aggregate gives all of it.
    """
    slim = messages if "bytes" in messages.columns else messages.select(*KEYS, "seq", "timestamp", "role", *body_columns())
    user = F.col("role") == "user"
    return (
        with_turns(slim)
        .groupBy(*KEYS, "turn")
        .agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("body_size"), F.max(F.when(user, F.struct("timestamp", "line"))).alias("_head"))
        .where("_head is not null")
        .select(*KEYS, "turn", "body_size", F.col("_head.timestamp").alias("timestamp"), F.col("_head.line").alias("first_line"))
    )


def turn_range(turns: DataFrame, lo: int, hi: int) -> DataFrame:
    return turns.where(F.col("turn").between(lo, hi))


def parse_turn_range(s: str) -> tuple[int, int]:
    """'N' or 'N..M', from 1, not reversed."""
    m = re.fullmatch(r"([0-9]+)(?:\.\.([0-9]+))?", s, re.ASCII)
    if not m:
        raise UsageError(f"{s!r} is no turn and no range of turns like 2..5")
    lo, hi = int(m[1]), int(m[2] or m[1])
    if lo < 1 or hi < lo:
        raise UsageError(f"{s!r} is no turn and no range of turns like 2..5")
    return lo, hi


def tail_turns(messages: DataFrame, n: int) -> DataFrame:
    """Messages of the last n turns of each session."""
    last = messages.groupBy(*KEYS).agg(F.greatest(F.count_if(F.col("role") == "user"), F.lit(1)).alias("last_turn"))
    return with_turns(messages).join(last, KEYS).where(F.col("turn") >= F.greatest(F.col("last_turn") - (n - 1), F.lit(1))).drop("last_turn")


def first_user_messages(messages: DataFrame, n: int, include_clear: bool = False) -> DataFrame:
    """The first n user messages of each session (top-k per group: cut before the shuffle, too)."""
    if n <= 0:
        raise UsageError("a summary has 1 message at least")
    rows = messages.where("role = 'user'")
    if not include_clear:
        rows = rows.where(not_synthetic(F.col("content")))
    w = Window.partitionBy(*KEYS).orderBy("timestamp", "seq")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def command_column(patterns: tuple[str, ...] = ()) -> Column:
    return F.coalesce(is_command(F.col("content"), patterns), F.lit(False)).alias("command")


def noncommand_aggregates() -> list[Column]:
    """Over messages with role, command and line: user turns that are no commands, and the first non-empty first line of one."""
    counts = (F.col("role") == "user") & ~F.col("command")
    first = F.min_by("line", F.when(counts & (F.col("line") != ""), F.struct("timestamp", "seq")))
    return [F.count_if(counts).alias("noncommand_turns"), F.coalesce(first, F.lit("")).alias("first_noncommand_line")]


def noncommand_turns(messages: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Per session with such turns: noncommand_turns and first_noncommand_line. messages has content, or line and command."""
    slim = messages if "command" in messages.columns else messages.select(*KEYS, "timestamp", "seq", "role", *body_columns(), command_column(patterns))
    return slim.groupBy(*KEYS).agg(*noncommand_aggregates()).where("noncommand_turns > 0")
