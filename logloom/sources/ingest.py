"""Differential import of log files into the store: one plan per run, one publish at its end."""

from __future__ import annotations

import datetime as dt
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeref import UsageError
from ..operators.running import arrival_numbers
from ..runtime import materialize
from .dialects import classify_lines
from .jsonl import SOURCES, list_files, listing_table, plan_files, read_lines
from .store import Store
from .tables import first_of, upsert_sessions

MAX_DIAGNOSTICS = 5
MARKER = "/.claude/worktrees/"


@dataclass
class ImportResult:
    imported: int = 0
    scanned: int = 0
    skipped: int = 0
    failed: int = 0
    unparsed: int = 0
    errors: list[str] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)

    def summary(self) -> str:
        return f"{self.imported} of {self.scanned} files imported, {self.skipped} unchanged, {self.failed} failed; {self.unparsed} lines not parsed"


def resolve_repo(cwd: str) -> str:
    """The repository of a working directory: before a worktree folder, else git's top level, else itself."""
    if not cwd:
        return ""
    if MARKER in cwd:
        return cwd.split(MARKER, 1)[0]
    try:
        out = subprocess.run(["git", "-C", cwd, "rev-parse", "--show-toplevel"], capture_output=True, check=True, timeout=30).stdout
    except (OSError, subprocess.SubprocessError):
        return cwd
    return out.decode("utf-8", "replace").rstrip("\r\n")


def resolved_paths(cwds: DataFrame, resolver=resolve_repo) -> DataFrame:
    """(cwd, repo) of the distinct working directories; git is asked once each, by the executors, which have to see the folders as the logs' writers did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["cwd"], pa.array([resolver(c) for c in b["cwd"].to_pylist()], pa.string())], names=["cwd", "repo"])

    return cwds.select("cwd").where("cwd <> ''").distinct().mapInArrow(run, "cwd string, repo string")


def chosen_sources(name: str) -> list[str]:
    if name in ("", "all"):
        return list(SOURCES.values())
    if name not in SOURCES:
        raise UsageError(f"--source {name!r} is none of all, {', '.join(SOURCES)}")
    return [SOURCES[name]]


def merge_bodies(stored: DataFrame, bodies: DataFrame, imported_at: str) -> DataFrame:
    """Stored sessions with the bodies of a run merged in, after them in order of files and lines."""
    text = lambda c: F.lit(c).cast("string")
    old = stored.withColumn("file_ord", F.lit(-1).cast("bigint")).withColumn("line_number", F.lit(-1))
    new = bodies.select(
        "source", "session_id", "cwd", "repo_path", "git_branch", "version", text(None).alias("custom_title"), text(None).alias("agent_name"),
        F.col("timestamp").alias("started_at"), F.col("timestamp").alias("ended_at"), text(imported_at).alias("imported_at"), "file_ord", "line_number",
    )
    # _born: when the session's row came to be, before this run or with its first body.
    return upsert_sessions(old.unionByName(new), [F.col("file_ord"), F.col("line_number")], F.min("file_ord").alias("_born"))


def last_names(names: DataFrame, place: Column) -> DataFrame:
    """(source, session_id, _title, _agent): of lines (outcome title or agent, value) the last one of each session; '' counts, null means none."""
    pick = lambda k: F.max_by("value", F.when(F.col("outcome") == k, place))
    return names.groupBy("source", "session_id").agg(pick("title").alias("_title"), pick("agent").alias("_agent"))


def apply_names(sessions: DataFrame, names: DataFrame, imported_at: str) -> DataFrame:
    """Titles and agent names of a run: the last per session, from files read when its row existed; '' overwrites."""
    known = names.join(sessions.select("source", "session_id", "_born"), ["source", "session_id"]).where(F.col("file_ord") >= F.col("_born"))
    j = sessions.join(last_names(known, F.struct("file_ord", "line_number")), ["source", "session_id"], "left")
    touched = F.col("_title").isNotNull() | F.col("_agent").isNotNull()
    return j.select(
        "source", "session_id", "cwd", "repo_path", "git_branch", "version", F.coalesce("_title", "custom_title").alias("custom_title"),
        F.coalesce("_agent", "agent_name").alias("agent_name"), "started_at", "ended_at", F.when(touched, F.lit(imported_at)).otherwise(F.col("imported_at")).alias("imported_at"),
    )


FILES = 4096  # whose messages are numbered in one group


def run_import(store: Store, roots: dict[str, str], source: str = "all", full: bool = False, now: dt.datetime | None = None, resolver=resolve_repo) -> ImportResult:
    """Import what is new below roots ({source: folder}). The source is checked before anything is deleted.

    A file that can't be read is reported and left as it was; all others are imported.
    """
    wanted = chosen_sources(source)
    imported_at = (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    if full:
        store.delete_all()
    spark = store.spark
    listing = list_files({s: roots.get(s, "") for s in wanted})
    res = ImportResult(scanned=listing.scanned, failed=listing.failed, errors=listing.errors)
    if not listing.files:
        return res
    state = store.read("import_state")
    plan = materialize(plan_files(listing_table(spark, listing), state), "import-plan")
    todo = plan.where("start is not null")
    tally = plan.agg(F.count("*").alias("files"), F.count("start").alias("todo")).first()
    res.skipped = tally.files - tally.todo
    if not tally.todo:
        return res
    every = read_lines(todo)
    broken = materialize(every.where("error is not null").groupBy("jsonl_path").agg(F.min("error").alias("error")), "import-failed")
    failed = [r.error for r in broken.orderBy("jsonl_path").collect()]  # at most as many as were listed
    res.errors += failed
    res.failed += len(failed)
    res.imported = tally.todo - len(failed)
    good = every.where("error is null").join(broken, "jsonl_path", "left_anti").drop("error")
    lines = materialize(classify_lines(good).where("is_new"), "import-lines")
    bad = lines.where("outcome = 'unparsed'")
    res.unparsed = bad.count()
    res.diagnostics = [f"{r.jsonl_path}:{r.line_number}: {r.error}" for r in bad.orderBy("file_ord", "line_number").limit(MAX_DIAGNOSTICS).collect()]

    # A file in which no body was ever seen commits nothing and is read again.
    seen = lines.groupBy("jsonl_path").agg(
        (F.max(F.col("outcome") == "body") | (F.max("start") > 0)).alias("ok"), F.max(F.col("line_number") - F.when(F.col("ended"), 0).otherwise(1)).cast("bigint").alias("line_feeds")
    )
    bodied = seen.where("ok").select("jsonl_path", "line_feeds")
    kept = lines.join(bodied, "jsonl_path", "left_semi")
    raw_bodies = kept.where("outcome = 'body'")
    repos = resolved_paths(raw_bodies.select("cwd"), resolver)
    bodies = raw_bodies.join(repos.withColumnRenamed("repo", "repo_path"), "cwd", "left")

    sessions = apply_names(merge_bodies(store.read("sessions"), bodies, imported_at), kept.where("outcome in ('title', 'agent')"), imported_at)
    fresh = first_of(bodies.where("has_content"), ["uuid"], "file_ord", "line_number").join(store.read("messages").select("uuid"), "uuid", "left_anti")
    # Arrival numbers follow files and lines.
    base = store.manifest()["next_seq"]
    numbered = materialize(arrival_numbers(fresh, F.floor(F.col("file_ord") / FILES), F.col("file_ord"), ["file_ord", "line_number"], "_n"), "import-messages")
    messages = numbered.select((F.col("_n") + (base - 1)).alias("seq"), "uuid", "source", "session_id", "parent_uuid", "role", "content", "timestamp", "is_sidechain")
    new_state = todo.select("jsonl_path", "source", F.col("size").alias("file_size"), F.col("size").alias("last_offset"), F.lit(imported_at).alias("imported_at")).join(bodied, "jsonl_path")
    states = state.join(new_state, "jsonl_path", "left_anti").unionByName(new_state)
    store.publish(replace={"sessions": sessions, "import_state": states}, append={"messages": messages}, next_seq=base + numbered.count())
    return res


def run_backfill(store: Store, resolver=resolve_repo) -> dict[str, int]:
    """Delete sessions without messages, fill missing repo_path; counts of deleted, resolved and unresolved."""
    from ..operators import sessions as SS

    s, m = store.read("sessions"), store.read("messages")
    orphans = SS.orphan_sessions(s, m).count()
    targets = materialize(SS.backfill_targets(s, m), "backfill")
    repos = resolved_paths(targets.select("cwd"), resolver)
    done = targets.join(repos.where("repo <> ''"), "cwd", "left_semi").count()
    total = targets.count()
    store.publish(replace={"sessions": SS.backfill(s, m, repos)})
    return {"deleted": orphans, "resolved": done, "unresolved": total - done}
