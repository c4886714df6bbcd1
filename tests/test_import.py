"""Log files to stored tables and back out through the command line."""

import io
import json

import pytest

from logloom.cli import App, check_show, parser
from logloom.functions.timeref import UsageError
from logloom.sources.ingest import run_backfill, run_import
from logloom.sources.jsonl import lines_from, list_files
from logloom.sources.store import Store


def body(uuid, role="user", text="hello", sid="s1", ts="2026-03-28T15:00:00.000Z", **more):
    content = text if role == "user" else [{"type": "text", "text": text}]
    return {"type": role, "uuid": uuid, "sessionId": sid, "timestamp": ts, "cwd": "/work/app", "gitBranch": "main", "version": "2.1", "message": {"role": role, "content": content}} | more


def b_meta(sid="c1", cwd="/work/app", ts="2026-03-28T10:00:00Z"):
    return {"timestamp": ts, "type": "session_meta", "payload": {"id": sid, "cwd": cwd, "cli_version": "0.5", "git": {"branch": "dev"}}}


def b_item(role, text, ts="2026-03-28T10:01:00Z", kind="message"):
    return {"timestamp": ts, "type": "response_item", "payload": {"type": kind, "role": role, "content": [{"type": "input_text", "text": text}]}}


class World:
    def __init__(self, spark, tmp):
        self.spark, self.tmp = spark, tmp
        self.a, self.b = tmp / "a" / "proj", tmp / "b" / "2026" / "03"
        self.a.mkdir(parents=True)
        self.b.mkdir(parents=True)
        self.store = Store(spark, str(tmp / "store"))

    def put(self, path, *records, end="\n", mode="a"):
        with open(path, mode) as f:
            f.write("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + end)

    def load(self, **kw):
        kw.setdefault("resolver", lambda c: c)
        return run_import(self.store, {"claude_code": str(self.tmp / "a"), "codex": str(self.tmp / "b")}, **kw)

    def rows(self, name, *cols):
        return sorted((tuple(r) for r in self.store.read(name).select(*cols).collect()), key=str)

    def cli(self, *argv, stdin=""):
        out, err = io.StringIO(), io.StringIO()
        app = App(lambda: self.spark, out, err, io.StringIO(stdin), tz="UTC")
        code = app.run(["--db", str(self.tmp / "store"), "--config", str(self.tmp / "config.json"), *argv])
        return code, out.getvalue(), err.getvalue()


@pytest.fixture
def w(spark, tmp_path):
    return World(spark, tmp_path)


def test_dialect_a(w):
    f = w.a / "s1.jsonl"
    w.put(f, body("u1"), body("a1", "assistant", "hi", ts="2026-03-28T15:01:00.000Z"), {"type": "custom-title", "customTitle": "T", "sessionId": "s1"}, {"type": "progress"})
    r = w.load()
    assert (r.imported, r.scanned, r.skipped, r.failed, r.unparsed) == (1, 1, 0, 0, 0)
    assert w.rows("messages", "seq", "uuid", "role", "content") == [(1, "u1", "user", "hello"), (2, "a1", "assistant", "hi")]
    assert w.rows("sessions", "session_id", "custom_title", "started_at", "ended_at", "repo_path") == [("s1", "T", "2026-03-28T15:00:00.000Z", "2026-03-28T15:01:00.000Z", "/work/app")]
    assert w.rows("import_state", "jsonl_path", "last_offset") == [(str(f), f.stat().st_size)]
    assert w.load().skipped == 1
    w.put(f, body("u2", text="more"), body("u1", text="a later version"))
    assert w.load().imported == 1
    assert w.rows("messages", "seq", "uuid", "content")[-1] == (3, "u2", "more") and len(w.rows("messages", "uuid")) == 3


def test_unparsed_lines(w):
    f = w.a / "s1.jsonl"
    w.put(f, body("u1"), "{broken json", body("u2", message={"role": "user", "content": 5}), body("u3", timestamp=7), body("u4", message=None), "", '["x"]', "null", body("u5", message={"role": "user", "content": None}))
    r = w.load()
    assert r.unparsed == 5 and [d.split(":")[1] for d in r.diagnostics] == ["2", "3", "4", "5", "7"]
    assert w.rows("messages", "uuid") == [("u1",)]
    for i in range(6):
        w.put(w.a / "s2.jsonl", "{broken" if i else body("x1", sid="s2"))
    w.put(w.a / "s2.jsonl", "{", "{")
    r = w.load()
    assert r.unparsed == 7 and len(r.diagnostics) == 5


def test_unterminated_line_and_shrunk_file(w):
    f = w.a / "s1.jsonl"
    w.put(f, body("u1"), end="")
    w.load()
    w.put(f, "{broken json")
    r = w.load()
    assert r.unparsed == 1 and r.diagnostics[0].startswith(f"{f}:1:")
    w.put(f, body("u9"), mode="w")
    w.load()
    assert w.rows("messages", "uuid") == [("u1",), ("u9",)]


def test_meta_only_files_commit_nothing(w):
    f = w.a / "s1.jsonl"
    w.put(f, {"type": "custom-title", "customTitle": "early", "sessionId": "s1"}, {"type": "agent-name", "agentName": "bot", "sessionId": "s1"})
    w.put(w.b / "r.jsonl", b_meta())
    w.load()
    assert not w.rows("sessions", "session_id") and not w.rows("import_state", "jsonl_path")
    w.put(f, body("u1", text=" \n"))
    w.load()
    assert w.rows("sessions", "session_id", "custom_title", "agent_name") == [("s1", "early", "bot")] and not w.rows("messages", "uuid")
    w.put(f, {"type": "custom-title", "customTitle": "", "sessionId": "s1"}, {"type": "custom-title", "customTitle": "x", "sessionId": "unknown"})
    w.load()
    assert w.rows("sessions", "session_id", "custom_title") == [("s1", "")]


def test_title_needs_the_row_at_its_time(w):
    w.put(w.a / "a.jsonl", body("u1", sid="s1"), {"type": "custom-title", "customTitle": "too early", "sessionId": "s2"})
    w.put(w.a / "b.jsonl", body("u2", sid="s2"), {"type": "custom-title", "customTitle": "across", "sessionId": "s1"})
    w.load()
    assert w.rows("sessions", "session_id", "custom_title") == [("s1", "across"), ("s2", None)]


def test_dialect_b(w):
    from hashlib import sha256

    f = w.b / "rollout.jsonl"
    w.put(f, b_item("user", "before any session"), b_meta(), {"type": "event_msg", "payload": {}}, b_item("user", "hello"), b_item("assistant", "x", kind="function_call"), b_item("assistant", "hi there", ts=""), b_item("system", "no"))
    r = w.load()
    assert r.unparsed == 0
    uid = lambda n: "codex:" + sha256(f"{f}\0{n}".encode()).hexdigest()
    assert w.rows("messages", "uuid", "role", "content", "timestamp", "session_id") == sorted([(uid(4), "user", "hello", "2026-03-28T10:01:00Z", "c1"), (uid(6), "assistant", "hi there", "2026-03-28T10:00:00Z", "c1")])
    assert w.rows("sessions", "source", "session_id", "git_branch", "version", "started_at") == [("codex", "c1", "dev", "0.5", "2026-03-28T10:00:00Z")]
    w.put(f, b_item("user", "resumed"), {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "text"}}, {"type": "response_item", "payload": "x"})
    r = w.load()
    assert r.unparsed == 2 and (uid(8), "c1") in w.rows("messages", "uuid", "session_id")


def test_sources_and_full(w):
    w.put(w.a / "s.jsonl", body("u1"))
    w.put(w.b / "r.jsonl", b_meta(), b_item("user", "x"))
    w.put(w.a / "note.JSONL", body("no"))
    assert w.load().imported == 2
    with pytest.raises(UsageError):
        w.load(source="nope", full=True)
    assert len(w.rows("messages", "uuid")) == 2
    w.load(source="codex", full=True)
    assert w.rows("messages", "seq", "source") == [(1, "codex")]


def test_import_in_steps_equals_import_at_once(w, spark, tmp_path):
    lines = [body(f"u{i}", "user" if i % 3 == 0 else "assistant", f"text {i}", sid=f"s{i % 2}", ts=f"2026-03-28T15:{i:02d}:00.000Z", cwd="" if i % 4 else f"/work/w{i}") for i in range(12)]
    w.put(w.a / "x.jsonl", *lines[:5])
    w.load()
    w.put(w.a / "x.jsonl", *lines[5:6], end="")
    w.load()
    w.put(w.a / "x.jsonl", "\n" + json.dumps(lines[6]), *lines[7:])
    w.load()
    (tmp_path / "other").mkdir()
    v = World(spark, tmp_path / "other")
    v.put(v.a / "x.jsonl", *lines)
    v.load()
    for name, cols in (("messages", ["seq", "uuid", "content"]), ("sessions", ["session_id", "cwd", "repo_path", "started_at", "ended_at"])):
        assert w.rows(name, *cols) == v.rows(name, *cols)


def test_listing(tmp_path):
    for p in ("a/p/x.jsonl", "a/p/deep/y.jsonl", "a/top.jsonl", "b/1/2/z.jsonl", "b/w.jsonl", "b/q.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("{}")
    got = list_files({"claude_code": str(tmp_path / "a"), "codex": str(tmp_path / "b")})
    assert [f[1].replace(str(tmp_path), "") for f in got.files] == ["/a/p/x.jsonl", "/b/1/2/z.jsonl", "/b/w.jsonl"] and not got.errors
    assert list_files({"claude_code": str(tmp_path / "none")}).files == []


def lines_of(content, lo, hi, end, first):
    return list(lines_from(io.BytesIO(content), lo, hi, end, first))


def test_lines_of_ranges():
    assert lines_of(b"a\r\nb\n\nc", 0, 7, 7, True) == [(b"a\r", True), (b"b", True), (b"", True), (b"c", False)]
    assert lines_of(b"a\nb\nc\n", 3, 6, 6, True) == [(b"", True), (b"c", True)] and lines_of(b"", 0, 0, 0, True) == []
    content = b"one\n\ntwo two\n" + b"x" * 40 + b"\nlast"
    whole = lines_of(content, 0, len(content), len(content), True)
    for step in range(1, 30):
        parts = [x for lo in range(0, len(content), step) for x in lines_of(content, lo, min(lo + step, len(content)), len(content), lo == 0)]
        assert parts == whole


def test_a_file_in_ranges(w, monkeypatch):
    monkeypatch.setattr("logloom.sources.jsonl.RANGE", 100)
    lines = [body(f"u{i}", text="x" * (1 + i * 7 % 90)) for i in range(20)]
    w.put(w.a / "x.jsonl", "", *lines[:11], "{broken", end="")
    r = w.load()
    assert [d.split(":")[1] for d in r.diagnostics] == ["13"]
    w.put(w.a / "x.jsonl", "", "{broken", *lines[11:])
    r = w.load()
    assert [d.split(":")[1] for d in r.diagnostics] == ["14"]
    assert w.rows("messages", "seq", "uuid") == sorted(((i + 1, f"u{i}") for i in range(20)), key=str)


def test_a_file_that_fails_stops_no_other(w, monkeypatch):
    for n in "abc":
        w.put(w.a / f"{n}.jsonl", body(f"u{n}"))
    # It goes away between listing and reading.
    real = list_files

    def listing(roots):
        out = real(roots)
        (w.a / "b.jsonl").unlink()
        return out

    monkeypatch.setattr("logloom.sources.ingest.list_files", listing)
    r = w.load()
    assert (r.imported, r.scanned, r.failed, len(r.errors)) == (2, 3, 1, 1) and "b.jsonl" in r.errors[0]
    assert w.rows("messages", "seq", "uuid") == [(1, "ua"), (2, "uc")] and len(w.rows("import_state", "jsonl_path")) == 2


def test_the_prefix_of_a_grown_file_is_not_read(w):
    f = w.a / "s1.jsonl"
    w.put(f, body("u1"), body("u2"))
    w.load()
    size = f.stat().st_size
    with open(f, "r+b") as x:  # were it read, it would be unparsed and count another line feed
        x.write(b"{" + b"\n" * (size - 2))
    w.put(f, body("u3"), "{broken")
    r = w.load()
    assert r.unparsed == 1 and r.diagnostics[0].startswith(f"{f}:4:") and ("u3",) in w.rows("messages", "uuid")


def test_of_two_writers_the_second_fails(w):
    w.put(w.a / "s.jsonl", body("u1"))
    w.load()
    seen = w.store.manifest()
    w.store._switch({k: v for k, v in seen.items() if k != "number"}, seen["number"])
    with pytest.raises(Exception, match="exist"):
        w.store._switch({"version": 1, "next_seq": 1, "parts": {}}, seen["number"])
    assert w.store.manifest() == seen | {"number": seen["number"] + 1} and len(w.rows("messages", "uuid")) == 1


def test_failed_publish_changes_nothing(w):
    w.put(w.a / "s.jsonl", body("u1"))
    w.load()
    before = w.store.manifest()
    with pytest.raises(Exception):
        w.store.publish(replace={"sessions": w.store.read("sessions"), "messages": w.spark.range(1).selectExpr("raise_error('x') as uuid")})
    assert w.store.manifest() == before and len(w.rows("messages", "uuid")) == 1


def test_migration_and_backfill(w):
    s = w.spark
    sess = s.createDataFrame([("s1", "/work/app", None), ("s2", "/w/.claude/worktrees/x", None), ("s3", "", None), ("old", "/o", None)], "session_id string, cwd string, repo_path string")
    msgs = s.createDataFrame([(1, "u1", "s1"), (2, "u2", "s2"), (3, "u3", "s3")], "seq bigint, uuid string, session_id string")
    w.store.publish(replace={"sessions": sess, "messages": msgs}, version=3)
    assert w.store.migrate() == {"sessions": 4, "messages": 3, "import_state": 0}
    assert w.store.migrate() == {"sessions": 0, "messages": 0, "import_state": 0}
    assert {r[0] for r in w.rows("sessions", "source")} == {"claude_code"}
    resolver = lambda c: "" if c == "/work/app" else c.split("/.claude/")[0]
    assert run_backfill(w.store, resolver) == {"deleted": 1, "resolved": 1, "unresolved": 1}
    assert w.rows("sessions", "session_id", "repo_path") == [("s1", None), ("s2", "/w"), ("s3", None)]
    assert run_backfill(w.store, resolver) == {"deleted": 0, "resolved": 0, "unresolved": 1}


def test_cli(w):
    w.put(
        w.a / "sess-1.jsonl",
        body("u1", text="first question\nwith detail", sid="sess-1", ts="2026-03-28T15:00:00Z"), body("a1", "assistant", "answer one", sid="sess-1", ts="2026-03-28T15:01:00Z"),
        body("s1", text="sidechain prompt", sid="sess-1", ts="2026-03-28T15:02:00Z", isSidechain=True), body("u2", text="\n\nsecond\tquestion after blank lines", sid="sess-1", ts="2026-03-28T15:03:00Z"),
        {"type": "custom-title", "customTitle": "My\ttitle", "sessionId": "sess-1"},
    )
    w.put(w.b / "r.jsonl", b_meta("sess-2", "/work/other"), b_item("user", "/briefing daily"), b_item("user", "日報 second"))
    code, out, err = w.cli("import", "--projects-dir", str(w.tmp / "a"), "--codex-dir", str(w.tmp / "b"))
    assert (code, out) == (0, "2 of 2 files imported, 0 unchanged, 0 failed; 0 lines not parsed\n")
    assert w.cli("outline", "sess-1")[1] == "1\t2026-03-28 15:00\t36\tfirst question\n2\t2026-03-28 15:03\t35\tsecond question after blank lines\n"
    assert json.loads(w.cli("outline", "sess-1", "--format", "json")[1])[1] == {"turn": 2, "timestamp": "2026-03-28T15:03:00Z", "bodySize": 35, "firstLine": "second\tquestion after blank lines"}
    (w.tmp / "config.json").write_text('{"projectAliases": {"App": ["/work/app"]}, "dayBoundary": "16:00"}')
    lines = w.cli("sessions")[1].splitlines()
    assert lines[0] == "sess-1\t2026-03-28 15:00 ~ 2026-03-28 15:03\t2026-03-27\tApp\tMy title\t4\t71\t2\tfirst question"
    assert lines[1].split("\t")[3:] == ["/work/other", "", "2", "28", "1", "日報 second"]
    assert [s["sessionId"] for s in json.loads(w.cli("sessions", "--format", "json", "--project", "App")[1])] == ["sess-1"]
    assert w.cli("projects")[1] == "App\t1\n/work/other\t1\n"
    assert json.loads(w.cli("projects", "--short", "--format", "json")[1]) == [{"project": "App", "sessionCount": 1}, {"project": "other", "sessionCount": 1}]
    assert w.cli("search", "SECOND")[1] == "sess-1\t2\t2026-03-28 15:03\tApp\tsecond question after blank lines\nsess-2\t2\t2026-03-28 10:01\t/work/other\t日報 second\n"
    assert w.cli("search", "sidechain")[1] == ""
    shown = w.cli("show", "sess-1", "--turn", "1")[1]
    assert shown == "## My\ttitle\n\n- **Session**: `sess-1`\n- **Project**: `App`\n- **Started**: `2026-03-28 15:00 ~ 2026-03-28 15:03`\n\n### User\n\nfirst question\nwith detail\n\n### Assistant\n\nanswer one\n"
    assert [m["content"] for m in json.loads(w.cli("show", "sess-1", "--tail", "1", "--format", "json")[1])[0]["messages"]] == ["\n\nsecond\tquestion after blank lines"]
    assert len(json.loads(w.cli("show", "--since", "2026-03-28", "--summary", "1", "--format", "json")[1])) == 2
    assert w.cli("show", "--since", "2030-01-01")[1] == "" and w.cli("show", "--since", "2030-01-01", "--format", "json")[1] == "[]\n"
    assert w.cli("show", "sess-1", "--turn", "9")[1].count("###") == 0
    assert w.cli("show", "nope") == (1, "", "error: no session has the id nope\n")
    assert "\n---\n\n## " in w.cli("show", "--since", "2026-03-28")[1]
    assert w.cli("backfill")[:2] == (0, "0 sessions without messages deleted, 0 repo paths filled, 0 left open\n")
    for bad in (["sessions", "--format", "xml"], ["show"], ["sessions", "--since", "2026-03-29", "--until", "2026-03-28"], ["import", "--full"], ["import", "--source", "x"], ["outline"], ["search", ""], ["sessions", "--day-boundary", "9"], ["nonsense"]):
        assert w.cli(*bad)[0] == 1, bad
    (w.tmp / "config.json").write_text("{")
    assert w.cli("sessions")[0] == 1 and w.cli("outline", "sess-1")[0] == 0
    assert w.cli("--help")[0] == 0


def test_ambiguous_id(w):
    w.put(w.a / "s.jsonl", body("u1", sid="same"))
    w.put(w.b / "r.jsonl", b_meta("same"), b_item("user", "x"))
    w.load()
    code, out, err = w.cli("show", "same")
    assert (code, out) == (1, "") and err == 'error: session id "same" belongs to several sources:\n  claude_code\tsame\n  codex\tsame\n'


@pytest.mark.parametrize("argv", [
    ["x", "--summary", "-1"], ["x", "--tail", "-1"], ["x", "--include-clear"], ["x", "--turn", "1", "--tail", "2"], ["x", "--turn", "1", "--summary", "2"], ["x", "--tail", "1", "--summary", "2"],
    ["x", "--turn", ""], ["x", "--since", "1d"], [],
])
def test_show_rules(argv):
    with pytest.raises(UsageError):
        check_show(parser().parse_args(["show", *argv]))
