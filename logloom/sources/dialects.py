"""The two log dialects: what a line is, and the rows an import makes of it.

A line is judged on its own first (one Arrow pass); what depends on lines
before it, the session a dialect-B message belongs to, is a forward fill over
the file's lines, in stretches, so that a file may hold a third of all lines. Fields of the wrong JSON type make a line unparsed; unknown
fields don't matter. Field names match without case, as in the logs' own
readers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import derived_uuid, is_blank, worktree_root
from ..operators.running import running_last
from .strict_json import WHITE_SPACE, parse

A, B = "claude_code", "codex"
PARSED_DDL = (
    "kind string, session_id string, uuid string, parent_uuid string, role string, content string, content_ok boolean, timestamp string, "
    "cwd string, git_branch string, version string, is_sidechain boolean, value string, error string"
)
_FIELDS = [f.split(" ")[0] for f in PARSED_DDL.split(", ")]
_BOOLS = {"content_ok", "is_sidechain"}


class Unparsed(ValueError):
    pass


def _take(o: dict, **kinds: type) -> dict[str, Any]:
    """Typed fields of an object: null and absent give None, another type is an error."""
    lower = {k.lower(): k for k in kinds}
    out: dict[str, Any] = dict.fromkeys(kinds)
    for k, v in o.items():
        name = k if k in kinds else lower.get(k.lower())
        if name is None or v is None:
            continue
        if kinds[name] is not object and not isinstance(v, kinds[name]):
            raise Unparsed(f"{name} is not a {kinds[name].__name__}")
        out[name] = v
    return out


def _raw(o: dict, name: str) -> tuple[bool, Any]:
    """(present, value) of a field that is decoded later."""
    hit, out = False, None
    for k, v in o.items():
        if k.lower() == name:
            hit, out = True, v
    return hit, out


def _texts(blocks: Any, kinds: tuple[str, ...]) -> str:
    if blocks is None:
        return ""
    if not isinstance(blocks, list):
        raise Unparsed("content is not a list")
    out = []
    for b in blocks:
        if b is None:
            continue
        if not isinstance(b, dict):
            raise Unparsed("a content block is not an object")
        f = _take(b, type=str, text=str)
        if f["type"] in kinds and f["text"]:
            out.append(f["text"])
    return "\n\n".join(out)


def _object(present: bool, v: Any, name: str) -> dict:
    if not present:
        raise Unparsed(f"{name} is missing")
    if v is None:
        return {}
    if not isinstance(v, dict):
        raise Unparsed(f"{name} is not an object")
    return v


def parse_a(rec: dict) -> dict[str, Any]:
    f = _take(rec, type=str, uuid=str, parentUuid=str, sessionId=str, timestamp=str, cwd=str, gitBranch=str, version=str, isSidechain=bool, customTitle=str, agentName=str)
    base = {"session_id": f["sessionId"] or ""}
    if f["type"] == "custom-title":
        return base | {"kind": "title", "value": f["customTitle"] or ""}
    if f["type"] == "agent-name":
        return base | {"kind": "agent", "value": f["agentName"] or ""}
    if f["type"] not in ("user", "assistant"):
        return {"kind": "ignored"}
    env = _object(*_raw(rec, "message"), "message")
    role = _take(env, role=str)["role"]
    present, content = _raw(env, "content")
    if not present:
        raise Unparsed("content is missing")
    text = content if isinstance(content, str) else _texts(content, ("text",))
    return base | {
        "kind": "body", "uuid": f["uuid"] or "", "parent_uuid": f["parentUuid"], "role": role or "", "content": text, "content_ok": True, "timestamp": f["timestamp"] or "",
        "cwd": f["cwd"] or "", "git_branch": f["gitBranch"] or "", "version": f["version"] or "", "is_sidechain": bool(f["isSidechain"]),
    }


def parse_b(rec: dict) -> dict[str, Any]:
    f = _take(rec, type=str, timestamp=str)
    if f["type"] == "session_meta":
        p = _take(_object(*_raw(rec, "payload"), "payload"), id=str, cwd=str, cli_version=str, git=dict)
        git = _take(p["git"] or {}, branch=str)
        return {"kind": "meta", "session_id": p["id"] or "", "cwd": p["cwd"] or "", "version": p["cli_version"] or "", "git_branch": git["branch"] or "", "timestamp": f["timestamp"] or ""}
    if f["type"] != "response_item":
        return {"kind": "ignored"}
    payload = _object(*_raw(rec, "payload"), "payload")
    p = _take(payload, type=str, role=str)
    if p["type"] != "message" or p["role"] not in ("user", "assistant"):
        return {"kind": "ignored"}
    out = {"kind": "body", "role": p["role"], "timestamp": f["timestamp"] or "", "is_sidechain": False, "content_ok": True, "content": ""}
    present, content = _raw(payload, "content")
    try:  # counts as unparsed only where a session is known
        if not present:
            raise Unparsed("content is missing")
        out["content"] = _texts(content, ("input_text", "output_text", "text"))
    except Unparsed as e:
        out |= {"content_ok": False, "error": str(e)}
    return out


def parse_line(source: str, line: str) -> dict[str, Any]:
    text = line.strip(WHITE_SPACE)
    if not text:
        return {"kind": "ignored"}
    try:
        rec = parse(text)
        if rec is None:
            return {"kind": "ignored"}
        if not isinstance(rec, dict):
            raise Unparsed("the line is no object")
        return parse_a(rec) if source == A else parse_b(rec) if source == B else {"kind": "ignored"}
    except ValueError as e:
        return {"kind": "unparsed", "error": str(e)}


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (source, line and others) with the columns of PARSED_DDL."""
    keep = [c for c in lines.columns if c != "line"]
    types = {f: pa.bool_() if f in _BOOLS else pa.string() for f in _FIELDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse_line(s, x or "") for s, x in zip(b["source"].to_pylist(), b["line"].to_pylist())]
            cols = [b[c] for c in keep] + [pa.array([r.get(f) for r in rows], t) for f, t in types.items()]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *_FIELDS])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name != "line")
    return lines.mapInArrow(run, f"{ddl}, {PARSED_DDL}")


SEGMENT = 4096  # lines of a file that one window sees


def session_in_force(parsed: DataFrame, name: str, value: Column, order: list[str]) -> DataFrame:
    """Add ``name``: value of the last dialect-B session line of the file at or before each line."""
    meta = F.when((F.col("source") == B) & (F.col("kind") == "meta"), value)
    stretch = F.floor(F.coalesce("line_number", F.lit(0)) / F.lit(SEGMENT))
    return running_last(parsed, ["source", "jsonl_path"], stretch, order, meta, name)


def classify_lines(lines: DataFrame) -> DataFrame:
    """Parsed lines with ``outcome`` (body, unparsed, ignored, meta, title, agent) and, for bodies, the row's fields.

    lines: source, jsonl_path, line_number, line and any others; a null source
    or path counts as ''. The fill runs in stretches of a file's lines.
    """
    parsed = parse_lines(lines.fillna("", ["source", "jsonl_path"]))
    p = session_in_force(parsed, "_m", F.struct("session_id", "cwd", "git_branch", "version", "timestamp"), ["line_number"])
    is_b = F.col("source") == B
    body = F.col("kind") == "body"
    outcome = (
        F.when(body & is_b & F.col("_m").isNull(), "ignored")
        .when(body & ~F.coalesce("content_ok", F.lit(False)), "unparsed")
        .otherwise(F.col("kind"))
    )
    b = lambda c, m: F.when(is_b & body, F.col(f"_m.{m}")).otherwise(F.col(c)).alias(c)
    others = [c for c in lines.columns if c != "line"]
    ts = F.when(is_b & body & (F.col("timestamp") == ""), F.col("_m.timestamp")).otherwise(F.col("timestamp")).alias("timestamp")
    uid = F.when(is_b & body, derived_uuid(F.col("jsonl_path"), F.col("line_number"))).otherwise(F.col("uuid")).alias("uuid")
    cwd = F.when(is_b & body, F.col("_m.cwd")).otherwise(F.col("cwd"))
    return p.select(
        *others, outcome.alias("outcome"), b("session_id", "session_id"), uid, "parent_uuid", "role", "content", ts,
        cwd.alias("cwd"), worktree_root(cwd).alias("worktree"), b("git_branch", "git_branch"), b("version", "version"), "is_sidechain", "value", "error",
        (~is_blank(F.col("content"))).alias("has_content"),
    )
