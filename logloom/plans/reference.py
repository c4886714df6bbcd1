"""Queries of the session-log engine over the stored tables, one per operator.

messages are read with one row per uuid (the first that arrived), sessions
merged to one row per key: the tables an importer would have written. Flags
that a command line would take are constants here.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timeref as R
from ..operators import search as SE
from ..operators import sessions as SS
from ..operators import turns as TU
from ..operators.filters import SessionFilter, build_filter
from ..operators.running import ranked, running_sum
from ..runtime import scratch_path
from ..sources.config import Config
from ..sources.dialects import classify_lines, parse_lines, session_in_force
from ..sources.ingest import last_names
from ..sources.jsonl import plan_files
from ..sources.store import Store
from ..sources.tables import canonical_messages, canonical_sessions, table, with_content

SINCE, UNTIL = "2024-06-01T00:00:00.000Z", "2025-03-01T00:00:00.000Z"
TZ, BOUNDARY = "Asia/Tokyo", dt.timedelta(hours=4)
QUERY, LOOKUP = "Scheduler", "9e1b223c-9dac-4ed1-a44d-7640366c7f54"
CONFIG = Config(
    aliases={"keeper": ["ledgerkit-38d70", "/work/ledgerkit-db434"], "pebbles": ["pebblework-f5ce1", "pebblework-68c52"]},
    patterns=("^Look at", "(?i)checks only"),
    day_boundary="04:00",
)
N = 2


def _m(s: SparkSession, d: str, *cols: str | Column, where: Column | None = None) -> DataFrame:
    return canonical_messages(s, d, *cols, where=where)


def _main(s: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    return TU.main_messages(_m(s, d, *cols))


_ORDER = ("source", "session_id", "timestamp", "is_sidechain")


def _sizes() -> tuple[str | Column, ...]:
    return ("source", "session_id", "is_sidechain", F.octet_length("content").alias("bytes"))


def incremental_plan(s, d):
    """What an import would do with each file, had the stored ones grown or shrunk to a listing's size and each raw log been copied."""
    st = table(s, d, "import_state").where("jsonl_path is not null")
    grown = st.select("jsonl_path", (F.col("file_size") + F.pmod(F.length("jsonl_path"), F.lit(3)) - 1).alias("size"))
    copies = table(s, d, "raw_records").groupBy(F.concat("jsonl_path", F.lit(".copy")).alias("jsonl_path")).agg(F.sum(F.octet_length("line") + 1).alias("size"))
    return plan_files(grown.unionByName(copies.where("jsonl_path is not null")), st.select("jsonl_path", "file_size", "last_offset"))


def session_upsert(s, d):
    return canonical_sessions(s, d)


def dedup_first_wins(s, d):
    return _m(s, d, "source", "session_id", "role")


def _latest_first(rows: DataFrame) -> DataFrame:
    return ranked(rows, "started_at", [F.col("source").desc(), F.col("session_id").desc()], back=True)


def sessions_list(s, d):
    """Session rows, with their place in the listing."""
    return _latest_first(SS.list_sessions(canonical_sessions(s, d), _m(s, d, *_sizes())))


def _sessions_where(where):
    return lambda s, d: _latest_first(SS.list_sessions(canonical_sessions(s, d), _m(s, d, *_sizes()), where))


NOW = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)


def _sessions_flags(since: str, until: str, project: str):
    """The listing as the command line asks for it: flags resolved in local time, with the day's boundary, at NOW."""

    def run(s, d):
        return _sessions_where(build_filter(since, until, project, CONFIG, R.zone(TZ), R.parse_day_boundary(CONFIG.day_boundary), NOW))(s, d)

    return run


def nonblank_messages(s, d):
    return _m(s, d, "source", "session_id", (~T.is_blank(F.col("content"))).alias("filled")).where("filled").select("uuid", "source", "session_id")


def messages_main(s, d):
    """Main messages, with their place in their session."""
    m = running_sum(_main(s, d, *_ORDER, "role"), TU.KEYS, TU.hour(), ["timestamp", "seq"], F.lit(1), "rank")
    return with_content(m, table(s, d, "messages")).select("uuid", "seq", "source", "session_id", "role", "content", "timestamp", "rank")


def turns(s, d):
    return TU.with_turns(_main(s, d, *_ORDER, "role")).select("uuid", "source", "session_id", "role", "turn")


def user_turns(s, d):
    return TU.user_turns(TU.with_turns(_main(s, d, *_ORDER, "role"))).select("uuid", "source", "session_id", "turn")


def turn_range(s, d):
    return TU.turn_range(TU.with_turns(_main(s, d, *_ORDER, "role")), *TU.parse_turn_range("2..3")).select("uuid", "source", "session_id", "turn")


def tail_n(s, d):
    return TU.tail_turns(_main(s, d, *_ORDER, "role"), N).select("uuid", "source", "session_id", "turn")


def outline(s, d):
    return TU.outline(_main(s, d, *_ORDER, "role", *TU.body_columns()))


def _summary(include_clear: bool):
    def run(s, d):
        return TU.first_user_messages(_main(s, d, *_ORDER, "role", "content"), N, include_clear).select("uuid", "source", "session_id", "rank", "content")

    return run


def noncommand_turns(s, d):
    return TU.noncommand_turns(_main(s, d, *_ORDER, "role", *TU.body_columns(), TU.command_column(CONFIG.patterns)))


def _hits(s: SparkSession, d: str, query: str, where: SessionFilter | None = None) -> DataFrame:
    rows = _m(s, d, *_ORDER, SE.hit_content(query, where), where=SE.may_hit(query, where))
    return SE.search_hits(rows, canonical_sessions(s, d), query, where)


def search_hits(s, d):
    """Hits, with their place in the listing: the latest first."""
    return ranked(_hits(s, d, QUERY), "timestamp", ["seq"], back=True).drop("seq")


def search_time(s, d):
    return _hits(s, d, QUERY, SessionFilter(SINCE, UNTIL)).drop("seq")


def search_wildcard(s, d):
    return _hits(s, d, "the%OLD_handle").drop("seq")


def search_with_turns(s, d):
    return SE.search_with_turns(_m(s, d, *_ORDER, "role", SE.hit_content(QUERY)), canonical_sessions(s, d), QUERY).select("uuid", "source", "session_id", "turn")


def search_snippet(s, d):
    h = _hits(s, d, QUERY)
    return h.select("uuid", T.snippet(F.col("content"), QUERY).alias("snippet"))


def search_full(s, d):
    hits = SE.search_report(_m(s, d, *_ORDER, "role", SE.hit_content(QUERY, SessionFilter(SINCE, ""))), canonical_sessions(s, d), QUERY, CONFIG, SessionFilter(SINCE, ""), TZ)
    return ranked(hits, "timestamp", ["seq"], back=True)


def sessions_full(s, d):
    return _latest_first(SS.sessions_report(canonical_sessions(s, d), _m(s, d, *_ORDER, "role", *TU.body_columns(), TU.command_column(CONFIG.patterns)), CONFIG, SessionFilter(SINCE, UNTIL), TZ, BOUNDARY, short=True))


def projects_list(s, d):
    return ranked(SS.list_projects(canonical_sessions(s, d), SessionFilter(SINCE, UNTIL)), "last_started", [F.col("repo_path").desc()], back=True)


def projects_alias(s, d):
    return ranked(SS.projects_report(canonical_sessions(s, d), CONFIG, short=True), "last_started", [F.col("project").desc(), F.col("repo_path").desc()], back=True).drop("repo_path")


def project_display(s, d):
    c = canonical_sessions(s, d).select("source", "session_id", F.coalesce("repo_path", F.lit("")).alias("repo_path"))
    return c.select("source", "session_id", CONFIG.display(F.col("repo_path")).alias("project"), CONFIG.display(F.col("repo_path"), True).alias("short_project"))


def session_get(s, d):
    return session_lookup(s, d).where("source = 'codex'")


def session_lookup(s, d):
    """Session rows with one id, at most one per source, in the order of sources."""
    rows = SS.session_lookup(canonical_sessions(s, d), _m(s, d, *_sizes(), where=T.norm_id(F.col("session_id")) == LOOKUP), LOOKUP)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy("source")).cast("bigint"))


def ambiguous_ids(s, d):
    """Ids that more than one source uses, in sessions or messages."""
    keys = _m(s, d, "source", "session_id").where("session_id <> '' and source <> ''").select("source", "session_id")
    return SS.ambiguous_ids(canonical_sessions(s, d).select("source", "session_id").unionByName(keys))


def orphan_sessions(s, d):
    return SS.orphan_sessions(canonical_sessions(s, d), _m(s, d, "source", "session_id")).select("source", "session_id")


def orphan_count(s, d):
    return orphan_sessions(s, d).agg(F.count("*").alias("orphans"))


def backfill_targets(s, d):
    return SS.backfill_targets(canonical_sessions(s, d), _m(s, d, "source", "session_id"))


def repo_path_worktree(s, d):
    return canonical_sessions(s, d).select("source", "session_id", T.worktree_root(F.col("cwd")).alias("root"))


def derived_uuid(s, d):
    r = table(s, d, "raw_records").where("source = 'codex'")
    return r.select("record_id", T.derived_uuid(F.col("jsonl_path"), F.col("line_number")).alias("uuid"))


def forward_fill(s, d):
    """The session that each dialect-B line belongs to: the last session_meta before it in its file."""
    raw = table(s, d, "raw_records").where((F.col("source") == "codex") & ~T.is_blank(F.col("line"))).fillna("", ["jsonl_path"])
    p = parse_lines(raw.select("record_id", "source", "jsonl_path", "line_number", "line"))
    return session_in_force(p, "in_force", F.col("session_id"), ["line_number", "record_id"]).select("record_id", F.col("in_force").alias("session_id"))


def last_title(s, d):
    """The last title line of each session that has a row; an empty title counts."""
    raw = table(s, d, "raw_records").where("source = 'claude_code'")
    p = parse_lines(raw.select("record_id", "source", "line")).where("kind in ('title', 'agent')")
    names = p.select("source", T.norm_id(F.col("session_id")).alias("session_id"), F.col("kind").alias("outcome"), "value", "record_id")
    last = last_names(names, F.col("record_id")).where("_title is not null or _agent is not null")
    return last.select("source", "session_id", F.col("_title").alias("custom_title"), F.col("_agent").alias("agent_name")).join(canonical_sessions(s, d).select("source", "session_id"), ["source", "session_id"], "left_semi")


def first_line(s, d):
    return _m(s, d, T.first_line(F.col("content")).alias("line")).select("uuid", "line")


def tsv_sanitize(s, d):
    return _m(s, d, "content").select("uuid", T.tsv_sanitize(F.col("content")).alias("cell"))


def local_time(s, d):
    return _m(s, d, "timestamp").select("uuid", R.local_time(F.col("timestamp"), TZ).alias("local_time"))


def _times(s, d):
    b = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return canonical_sessions(s, d).select("source", "session_id", b("started_at"), b("ended_at"))


def time_range(s, d):
    return _times(s, d).select("source", "session_id", R.time_range(F.col("started_at"), F.col("ended_at"), TZ).alias("time_range"))


def logical_day(s, d):
    return _times(s, d).select("source", "session_id", R.logical_day(F.col("started_at"), F.col("ended_at"), TZ, BOUNDARY).alias("logical_day"))


def show_json(s, d):
    """One JSON object per main message, as show prints them."""
    m = _main(s, d, *_ORDER, "role", "content")
    return m.select("uuid", F.to_json(F.struct("role", "content", "timestamp"), {"ignoreNullFields": "false"}).alias("message"))


def show_markdown(s, d):
    """Heading and body of each main message, and the header of its session."""
    m = _main(s, d, *_ORDER, "role", "content")
    return m.select("uuid", _markdown().alias("markdown"))


def _parts(messages: DataFrame, text: Column, between: str) -> DataFrame:
    """(source, session_id, part, n_messages, text): a session's messages in order, by hours, so that no session meets in one row."""
    cut = messages.withColumn("_seg", TU.hour()).groupBy(*TU.KEYS, "_seg").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("timestamp", "seq", text.alias("text")))).alias("m"))
    at = F.row_number().over(Window.partitionBy(*TU.KEYS).orderBy("_seg")).cast("bigint")  # one row per hour
    return cut.select(*TU.KEYS, at.alias("part"), "n_messages", F.array_join(F.col("m.text"), between).alias("text"))


def show_arrays(s, d):
    """Each session's messages as JSON, in parts: joined by commas they are the array of its document."""
    m = _main(s, d, *_ORDER, "role", "content").withColumn("timestamp", F.coalesce("timestamp", F.lit("")))
    return _parts(m, F.to_json(F.struct("role", "content", "timestamp"), {"ignoreNullFields": "false"}), ",")


def show_documents(s, d):
    """Each session as Markdown, in parts: 0 is its header, the rest its messages; they are joined as they are."""
    m = _main(s, d, *_ORDER, "role", "content").withColumn("timestamp", F.coalesce("timestamp", F.lit("")))
    body = _parts(m, F.coalesce(_markdown(), F.lit("")), "")
    head = show_header(s, d).select("source", "session_id", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("n_messages"), F.col("header").alias("text"))
    return head.unionByName(body.join(head.select(*TU.KEYS), TU.KEYS, "left_semi"))


def _markdown() -> Column:
    return F.concat(F.lit("\n### "), T.role_heading(F.col("role")), F.lit("\n\n"), F.col("content"), F.lit("\n"))


def show_header(s, d):
    c = canonical_sessions(s, d)
    b = lambda x: F.coalesce(F.col(x), F.lit(""))
    title = T.title_sanitize(F.when(b("custom_title") != "", b("custom_title")).otherwise(F.col("session_id")))
    text = F.concat(
        F.lit("## "), title, F.lit("\n\n- **Session**: `"), F.col("session_id"), F.lit("`\n- **Project**: `"), CONFIG.display(b("repo_path")),
        F.lit("`\n- **Started**: `"), R.time_range(b("started_at"), b("ended_at"), TZ), F.lit("`\n"),
    )
    return c.select("source", "session_id", text.alias("header"))


def show_bulk(s, d):
    """Main messages of the sessions that started in the range, with their turn."""
    f = SessionFilter(SINCE, UNTIL, CONFIG.expand_project("keeper"))
    keys = canonical_sessions(s, d).where(f.sessions()).select("source", "session_id")
    turns = TU.with_turns(_main(s, d, *_ORDER, "role"), keys)
    return with_content(turns, table(s, d, "messages")).select("uuid", "source", "session_id", "turn", "role", "content")


def log_messages(s, d):
    """The message that an import makes of each raw line with a body."""
    raw = table(s, d, "raw_records").where("jsonl_path is not null and source is not null")
    lines = classify_lines(raw.select("record_id", "source", "jsonl_path", "line_number", "line")).where("outcome = 'body'")
    fields = ("session_id", "parent_uuid", "role", "content", "timestamp", "cwd", "git_branch", "version", "is_sidechain", "has_content")
    return lines.select("record_id", "source", "uuid", *fields)


def parse_outcomes(s, d):
    """Lines by dialect and what an import does with them."""
    raw = table(s, d, "raw_records")
    return classify_lines(raw.select("source", "jsonl_path", "line_number", "line")).groupBy("source", "outcome").agg(F.count("*").alias("lines"))


def migrate_stamp_source(s, d):
    """A store of the older layout, written from the tables of the only source it had, after its migration."""
    old = canonical_sessions(s, d).where("source = 'claude_code'").drop("source")
    store = Store(s, scratch_path(s, "store"))
    store.publish(replace={"sessions": old, "messages": _m(s, d, "source", "session_id").where("source = 'claude_code'").drop("source")}, version=3)
    store.migrate()
    rows = [store.read(t).select(F.lit(t).alias("table_name"), "source", "session_id") for t in ("sessions", "messages")]
    return rows[0].unionByName(rows[1]).groupBy("table_name", "source", "session_id").agg(F.count("*").alias("n_rows"))


QUERIES = {
    "incremental_plan": incremental_plan,
    "parse_outcomes": parse_outcomes,
    "log_messages": log_messages,
    "session_upsert": session_upsert,
    "dedup_first_wins": dedup_first_wins,
    "sessions_list": sessions_list,
    "sessions_since_until": _sessions_where(SessionFilter(SINCE, UNTIL)),
    "sessions_project": _sessions_where(SessionFilter(projects=["LEDGER%38"])),
    "sessions_alias_filter": _sessions_where(SessionFilter(projects=CONFIG.expand_project("pebbles"))),
    "sessions_combined": _sessions_where(SessionFilter(SINCE, UNTIL, ["pebble", "larkspur"])),
    "sessions_dates": _sessions_flags("2024-06-01", "2024-12-31", ""),
    "sessions_last": _sessions_flags("300d", "2025-01-31T09:30", "pebbles"),
    "nonblank_messages": nonblank_messages,
    "messages_main": messages_main,
    "turns": turns,
    "user_turns": user_turns,
    "turn_range": turn_range,
    "tail_n": tail_n,
    "outline": outline,
    "summary_n": _summary(False),
    "summary_include_clear": _summary(True),
    "noncommand_turns": noncommand_turns,
    "search_hits": search_hits,
    "search_time": search_time,
    "search_wildcard": search_wildcard,
    "search_with_turns": search_with_turns,
    "search_snippet": search_snippet,
    "search_full": search_full,
    "sessions_full": sessions_full,
    "projects_list": projects_list,
    "projects_alias": projects_alias,
    "project_display": project_display,
    "session_get": session_get,
    "session_lookup": session_lookup,
    "ambiguous_ids": ambiguous_ids,
    "orphan_sessions": orphan_sessions,
    "orphan_count": orphan_count,
    "backfill_targets": backfill_targets,
    "repo_path_worktree": repo_path_worktree,
    "derived_uuid": derived_uuid,
    "forward_fill": forward_fill,
    "last_title": last_title,
    "first_line": first_line,
    "tsv_sanitize": tsv_sanitize,
    "local_time": local_time,
    "time_range": time_range,
    "logical_day": logical_day,
    "show_json": show_json,
    "show_markdown": show_markdown,
    "show_header": show_header,
    "show_arrays": show_arrays,
    "show_documents": show_documents,
    "show_bulk": show_bulk,
    "migrate_stamp_source": migrate_stamp_source,
}
