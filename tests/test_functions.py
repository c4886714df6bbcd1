import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.functions import timeref as R
from logloom.functions.times import readable_py, rfc3339_micros
from logloom.operators.turns import parse_turn_range
from logloom.sources.config import Config, load_config

NOW = dt.datetime(2026, 3, 29, 12, tzinfo=dt.timezone.utc)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c"))).first()[0]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


TIMES = {
    "2024-01-29T07:07:54.327Z": 1706512074327000,
    "2024-01-29T15:02:01.729+09:00": 1706508121729000,
    "2024-01-29t07:07:54z": 1706512074000000,
    "2024-01-29T07:07:54.1234567Z": 1706512074123456,
    "2024-01-29T07:07:54-23:59": 1706512074000000 + (23 * 60 + 59) * 60_000_000,
    "1969-12-31T23:59:59.5Z": -500000,
    "2024-02-30T08:15:00.000Z": None,
    "2025-06-11T25:07:00.000Z": None,
    "2024-13-04T10:00:00Z": None,
    "2024-01-29T07:07:60Z": None,
    "2024-01-29 07:07:54Z": None,
    "2024-01-29T07:07:54": None,
    "2024-01-29T07:07Z": None,
    "2024-01-29": None,
    "2024-01-29T07:07:54.Z": None,
    "2024-01-29T07:07:54+24:00": None,
    "2024-01-29T07:07:54Z\n": None,
    "1714257564": None,
    "": None,
    None: None,
}


def test_rfc3339(spark):
    assert column(spark, list(TIMES), rfc3339_micros) == list(TIMES.values())
    for s, v in TIMES.items():
        assert s is None or readable_py(s) == (v is not None), s


@settings(max_examples=40, deadline=None)
@given(st.datetimes(min_value=dt.datetime(1, 1, 2), max_value=dt.datetime(9999, 12, 30)))
def test_readable_py_takes_all_dates(d):
    assert readable_py(d.strftime("%Y").zfill(4) + d.strftime("-%m-%dT%H:%M:%SZ"))


def test_trim_and_first_line(spark):
    cases = ["single", "\n\n  lead blank\nrest", "crlf line\r\nnext", "", "　 x ", None]
    assert column(spark, cases, T.first_line) == ["single", "lead blank", "crlf line", "", "x", None]
    assert column(spark, ["　", " \t\n", "", None, "a"], T.is_blank) == [True, True, True, True, False]
    assert all(ch.isspace() for ch in T.WHITE_SPACE) and len(T.WHITE_SPACE) == len(set(T.WHITE_SPACE)) == 25


@pytest.mark.parametrize(("text", "pattern", "hit"), [
    ("The AUTH module", "%auth%", True), ("ÉCOLE", "%école%", False), ("a_b", "%A_B%", True), ("axb", "%a_b%", True), ("100%", "%0\\%", False),
    ("Brimday", "%Brim%day%", True), ("/x", "/%", True), ("x/", "/%", False), ("a\\b", "%a\\b%", True), ("abc", "%", True), ("abc", "abc", True), ("abc", "ab", False), ("a.c", "%a.c%", True), ("abc", "%a.c%", False),
])
def test_ascii_like(spark, text, pattern, hit):
    assert one(spark, text, lambda c: T.ascii_like(c, pattern)) is hit


def plain_snippet(text, query):
    """Stated on bytes."""
    b, q = text.encode(), query.encode()
    at = b.find(q)
    if at < 0:
        at = text.lower().encode().find(query.lower().encode())
    at = 0 if at < 0 or at >= len(b) else at
    inside = lambda i: i < len(b) and b[i] & 0xC0 == 0x80
    while at > 0 and inside(at):
        at -= 1
    end = min(len(b), at + len(q))
    while 0 < end < len(b) and inside(end):
        end -= 1
    lo, hi = len(b[:at].decode()), len(b[:end].decode())
    lo, hi = max(0, lo - 40), min(len(text), hi + 40)
    return "..." * (lo > 0) + text[lo:hi].strip() + "..." * (hi < len(text))


def test_snippet(spark):
    long = "a" * 60 + "NEEDLE" + "b" * 60
    assert one(spark, long, lambda c: T.snippet(c, "NEEDLE")) == "..." + "a" * 40 + "NEEDLE" + "b" * 40 + "..."
    assert one(spark, long, lambda c: T.snippet(c, "needle")) == "..." + "a" * 40 + "NEEDLE" + "b" * 40 + "..."
    assert one(spark, "NEEDLE" + "b" * 60, lambda c: T.snippet(c, "NEEDLE")) == "NEEDLE" + "b" * 40 + "..."
    assert one(spark, "次" * 50 + "見" + "次" * 2, lambda c: T.snippet(c, "見")) == "..." + "次" * 40 + "見次次"
    assert one(spark, "", lambda c: T.snippet(c, "x")) == ""
    # Lowering makes each dotted capital I a byte longer.
    for text, query in (("İİİİauth", "AUTH"), ("İ" * 10 + "auth", "AUTH"), ("İ" * 60 + "auth" + "b" * 60, "AUTH"), ("次İ見" * 30 + "Auth" + "次" * 70, "AUTH"), ("ab", "abc"), ("x次見", "次"), ("K" * 50 + "key", "KEY")):
        assert one(spark, text, lambda c, q=query: T.snippet(c, q)) == plain_snippet(text, query), (text, query)
    assert one(spark, None, lambda c: T.snippet(c, "x")) is None


def test_paths_and_ids(spark):
    assert column(spark, ["/a/b", "/a/b//", "/", "//", "", "x", None], T.basename) == ["b", "b", "/", "/", "", "x", None]
    assert one(spark, "/r/.claude/worktrees/x/.claude/worktrees/y", T.worktree_root) == "/r"
    import hashlib

    got = spark.sql("select '/p/f.jsonl' p, 12 n").select(T.derived_uuid(F.col("p"), F.col("n"))).first()[0]
    assert got == "codex:" + hashlib.sha256(b"/p/f.jsonl\x0012").hexdigest()
    assert column(spark, ["user", "", "élan"], T.role_heading)[:2] == ["User", ""]


def test_commands(spark):
    cmd = lambda c: T.is_command(c, ("^日報生成",))
    assert column(spark, ["/briefing daily", "  /x", "日報生成\nfor", "real work", ""], cmd) == [True, True, True, False, False]
    keep = ["<command-name>/clear</command-name>x", "<LOCAL-command-caveat>", "hi"]
    assert column(spark, keep, T.not_synthetic) == [False, False, True]


def test_durations():
    assert [R.parse_duration(x).total_seconds() for x in ("24h", "7d", "30m", "0h")] == [86400, 604800, 1800, 0]
    for bad in ("", "abc", "d", "-1h", "1.5h", "5s"):
        with pytest.raises(R.UsageError):
            R.parse_duration(bad)


def test_bounds():
    utc, jst = dt.timezone.utc, R.zone("Asia/Tokyo")
    four = dt.timedelta(hours=4)
    f = lambda s, until, tz, b=dt.timedelta(): R.resolve_bound(s, NOW, until, tz, b)
    assert f("24h", False, utc) == "2026-03-28T12:00:00.000Z"
    assert f("2026-03-28", False, utc) == "2026-03-28T00:00:00.000Z"
    assert f("2026-03-28", True, utc) == "2026-03-29T00:00:00.000Z"
    assert f("2026-03-28T15:00", True, utc) == "2026-03-28T15:00:00.000Z"
    assert (f("2026-03-28", False, jst), f("2026-03-28", True, jst)) == ("2026-03-27T15:00:00.000Z", "2026-03-28T15:00:00.000Z")
    assert (f("2026-03-28", False, jst, four), f("2026-03-28", True, jst, four)) == ("2026-03-27T19:00:00.000Z", "2026-03-28T19:00:00.000Z")
    for bad in ("2026-02-30", "2026-3-1", "x-y"):
        with pytest.raises(R.UsageError):
            f(bad, False, utc)
    # The night the clock goes forward: the until day is a calendar day, the boundary elapsed time.
    berlin = R.zone("Europe/Berlin")
    assert f("2026-03-28", True, berlin, four) == "2026-03-29T02:00:00.000Z"
    assert f("2026-03-29", False, berlin, four) == "2026-03-29T03:00:00.000Z"


def test_day_boundary():
    assert R.parse_day_boundary("04:30") == dt.timedelta(hours=4, minutes=30)
    for bad in ("4:00", "24:00", "04:60", "0400", "ab:cd"):
        with pytest.raises(R.UsageError):
            R.parse_day_boundary(bad)


def test_logical_day_and_ranges(spark):
    rows = [("", "2026-03-28T18:30:00Z"), ("", "2026-03-28T19:00:00Z"), ("2026-03-28T18:30:00Z", ""), ("", ""), ("x", "bad")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i")
    day = R.logical_day(F.col("a"), F.col("b"), "Asia/Tokyo", dt.timedelta(hours=4))
    assert [r[0] for r in df.select(day).collect()] == ["2026-03-28", "2026-03-29", "2026-03-28", "", ""]
    rng = R.time_range(F.col("a"), F.col("b"), "Asia/Tokyo")
    assert [r[0] for r in df.select(rng).collect()][2:4] == ["2026-03-29 03:30 ~", " ~"]


def test_turn_range():
    assert [parse_turn_range(s) for s in ("40", "40..60", "1..1")] == [(40, 40), (40, 60), (1, 1)]
    for bad in ("0", "-1", "60..40", "a", "1..b", "1..2..3", "..", ""):
        with pytest.raises(R.UsageError):
            parse_turn_range(bad)


def test_config(tmp_path, spark):
    assert load_config(str(tmp_path / "none")) == Config()
    good = tmp_path / "c.json"
    good.write_text('{"projectAliases": {"new": ["old1", "old2"]}, "commandPatterns": ["^x"], "dayBoundary": "04:00"}')
    c = load_config(str(good))
    assert c.expand_project("new") == c.expand_project("old1") == ["new", "old1", "old2"]
    assert (c.expand_project("else"), c.expand_project("")) == (["else"], [])
    shown = column(spark, ["/w/old1", "/w/new", "old2", "/w/other"], lambda x: c.display(x))
    assert shown == ["new", "new", "new", "/w/other"]
    assert column(spark, ["/w/other", ""], lambda x: c.display(x, True)) == ["other", ""]
    for text in ("{", '{"commandPatterns": ["("]}', '{"commandPatterns": ["(?=x)"]}', '{"dayBoundary": "25:00"}', '{"projectAliases": {"a": "b"}}', "[]"):
        good.write_text(text)
        with pytest.raises(R.UsageError):
            load_config(str(good))


def test_json_arrays_are_written_item_by_item():
    import io
    import json

    from logloom.render import write_json

    for rows in ([], [{"a": 1, "b": "x\u2028\n[]"}], [{"a": [], "m": [{"r": "[]"}, {"r": "é"}]}, {"a": 2, "m": []}]):
        out = io.StringIO()
        write_json(out, ({k: iter(v) if k == "m" else v for k, v in r.items()} for r in rows))
        assert out.getvalue() == json.dumps(rows, indent=2, ensure_ascii=False) + "\n"
