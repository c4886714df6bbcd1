"""Rebuilding conversations from message rows.

The rows are an event log: every row of one uuid is a version of one turn. The
fold keeps one version per turn (``first``: a retry or a second load with other
values never replaces a stored turn; ``last``: later versions are edits, and a
blank last version is a delete). Final turns are ordered by time, then arrival,
and conversations are validated by aggregates only, so a session with a third
of all rows costs no more than its partial sums. Turn numbers of the surviving
conversations are assigned in segments of a session's time (see
operators.running), never in one task per session.

Nulls and odd values: sidechain rows and rows with a null or blank session_id
belong to no conversation; a null is_sidechain is false; a null source is ''; a
null role or timestamp breaks its conversation; a null content is empty. Ties
of time are ordered by seq. An empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, norm_id, utrim
from ..functions.times import rfc3339_micros
from ..operators.running import running_sum
from ..runtime import materialize
from ..sources.tables import with_content

ROLES = ("user", "assistant", "system")


def role_of(c: Column) -> Column:
    return F.lower(utrim(c))


def fold_turns(messages: DataFrame, *extra: Column, policy: str = "first") -> DataFrame:
    """Final turns: uuid, seq, source, session_id, role, us, filled and the extra columns.

    Only what validation needs goes through the shuffle by uuid: the role as a
    word, the time as microseconds and whether there is content.
    """
    slim = messages.select(
        F.coalesce(norm_id(F.col("uuid")), F.lit("")).alias("uuid"),
        "seq",
        F.coalesce("source", F.lit("")).alias("source"),
        norm_id(F.col("session_id")).alias("session_id"),
        F.coalesce("is_sidechain", F.lit(False)).alias("side"),
        role_of(F.col("role")).alias("role"),
        rfc3339_micros(F.col("timestamp")).alias("us"),
        (~is_blank(F.col("content"))).alias("filled"),
        *extra,
    )
    order = F.col("seq").asc_nulls_last() if policy == "first" else F.col("seq").desc_nulls_last()
    turns = slim.withColumn("_rn", F.row_number().over(Window.partitionBy("uuid").orderBy(order))).where("_rn = 1")
    if policy == "last":
        turns = turns.where("filled")  # the last version of a deleted turn is blank
    return turns.where("not side and session_id <> ''").drop("_rn", "side")


def validate(turns: DataFrame) -> DataFrame:
    """(source, session_id, drop_reason): null for conversations that survive."""
    bad = F.coalesce(~F.col("role").isin(*ROLES), F.lit(True)) | F.col("us").isNull()
    talk = F.col("filled") & (F.col("role") != "system")
    agg = turns.groupBy("source", "session_id").agg(
        F.max(bad).alias("broken"),
        F.max("filled").alias("filled"),
        F.max(talk & (F.col("role") == "user")).alias("asked"),
        F.max(F.when(talk, F.struct("us", "seq", (F.col("role") == "assistant").alias("reply")))).alias("last"),
    )
    return agg.select(
        "source",
        "session_id",
        F.when(F.col("broken"), "broken")
        .when(~F.col("filled"), "empty")
        .when(~F.coalesce("asked", F.lit(False)), "no_user")
        .when(~F.coalesce(F.col("last.reply"), F.lit(False)), "no_reply")
        .alias("drop_reason"),
    )


def find_dropped(messages: DataFrame) -> DataFrame:
    """Rows of p5_found: source, session_id, drop_reason."""
    return validate(fold_turns(messages)).where("drop_reason is not null")


def survivors(turns: DataFrame) -> DataFrame:
    """(source, session_id) of the conversations that aren't dropped: written once, as several joins read it."""
    return materialize(validate(turns).where("drop_reason is null").select("source", "session_id"), "conversations")


def conversations(messages: DataFrame) -> DataFrame:
    """Ordered turns of the surviving conversations: source, session_id, turn_no, uuid, role, us, content.

    Rows without content are no turns; turn_no counts from 1. Turns are folded
    once and numbered as narrow rows, and contents fetched for those that are left.
    """
    turns = materialize(fold_turns(messages), "turns")
    keep = survivors(turns)
    hour = F.floor(F.col("us") / F.lit(3_600_000_000))
    numbered = running_sum(turns.where("filled"), ["source", "session_id"], hour, ["us", "seq"], F.lit(1), "turn_no", only=keep)
    return with_content(numbered, messages).select("source", "session_id", "turn_no", "uuid", "role", "us", "content")


def versions(messages: DataFrame) -> DataFrame:
    """(uuid, n_versions, first_seq, last_seq, state) of every uuid that came more than once.

    The log is folded by version: ``retry`` if role, time and content never changed, ``delete`` if the last version is
    blank and the first isn't, else ``edit``. Contents are compared by their hash.
    """
    row = F.struct("seq", is_blank(F.col("content")).alias("blank"))
    what = F.xxhash64(*[F.coalesce(c, F.lit("")) for c in ("role", "timestamp", "content")])
    per = messages.select(F.coalesce(norm_id(F.col("uuid")), F.lit("")).alias("uuid"), "seq", row.alias("row"), what.alias("what")).groupBy("uuid").agg(
        F.count("*").alias("n_versions"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min("row").alias("old"), F.max("row").alias("new"), F.min("what").alias("lo"), F.max("what").alias("hi"),
    )
    state = F.when(F.col("lo") == F.col("hi"), "retry").when(F.col("new.blank") & ~F.col("old.blank"), "delete").otherwise("edit")
    return per.where("n_versions > 1").select("uuid", "n_versions", "first_seq", "last_seq", state.alias("state"))


def conversation_sizes(messages: DataFrame) -> DataFrame:
    """One row per surviving conversation: turns by role, characters, first and last time."""
    t = materialize(fold_turns(messages, F.char_length("content").alias("chars")), "turns")
    keep = survivors(t)
    sizes = t.where("filled").groupBy("source", "session_id").agg(
        F.count("*").alias("n_turns"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.sum("chars").cast("bigint").alias("n_chars"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
    return sizes.join(keep, ["source", "session_id"], "left_semi")
