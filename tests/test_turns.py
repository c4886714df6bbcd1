"""Turns, listings and search on small hand-made sessions."""

import pytest
from pyspark.sql import functions as F

from logloom.functions.timeref import UsageError
from logloom.operators import search as SE
from logloom.operators import sessions as SS
from logloom.operators import turns as TU
from logloom.operators.filters import SessionFilter
from logloom.sources.config import Config

DDL = "seq bigint, uuid string, source string, session_id string, role string, content string, timestamp string, is_sidechain boolean"
SESSIONS = "source string, session_id string, cwd string, repo_path string, started_at string, ended_at string, custom_title string"
ROLE = {"u": "user", "a": "assistant"}


def talk(spark, spec, sid="s", t="2026-03-28T15:{:02d}:00Z"):
    """spec: (role letter, content, sidechain?) in order; equal times where t has no place for the number."""
    rows = [(i, f"{sid}{i}", "a", sid, ROLE[r[0]], r[1] if len(r) > 1 else "x", t.format(i), len(r) > 2 and r[2]) for i, r in enumerate(spec)]
    return spark.createDataFrame(rows, DDL)


def numbers(df):
    return [r.turn for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize(("roles", "want"), [("uaauau", [1, 1, 1, 2, 2, 3]), ("aua", [1, 1, 1]), ("aa", [1, 1]), ("uuu", [1, 2, 3]), ("auuu", [1, 1, 2, 3])])
@pytest.mark.parametrize("t", ["2026-03-28T15:{:02d}:00Z", "2026-03-28T15:00:00Z"])
def test_numbering(spark, roles, want, t):
    assert numbers(TU.with_turns(TU.main_messages(talk(spark, [(r,) for r in roles], t=t)))) == want


def test_sidechains_and_unnamed_sessions_have_no_turns(spark):
    m = talk(spark, [("u",), ("u", "side", True), ("a",), ("u",)])
    assert numbers(TU.with_turns(TU.main_messages(m))) == [1, 1, 2]
    assert TU.main_messages(m.withColumn("session_id", F.lit(None).cast("string"))).count() == 0
    assert TU.main_messages(m.withColumn("is_sidechain", F.lit(None).cast("boolean"))).count() == 0


def test_outline_counts_bytes(spark):
    m = talk(spark, [("a", "pre"), ("u", "héllo"), ("a", "abcd"), ("u", "次"), ("a", None)])
    got = [(r.turn, r.body_size, r.first_line) for r in TU.outline(m).orderBy("turn").collect()]
    assert got == [(1, 13, "héllo"), (2, 3, "次")]
    assert TU.outline(m.limit(0)).count() == 0


def test_tail_and_range(spark):
    m = talk(spark, [("u",), ("a",), ("u",), ("u",), ("a",)])
    assert [r.seq for r in TU.tail_turns(m, 2).orderBy("seq").collect()] == [2, 3, 4]
    assert TU.tail_turns(m, 99).count() == 5
    assert [r.seq for r in TU.turn_range(TU.with_turns(m), 2, 2).collect()] == [2]
    assert TU.turn_range(TU.with_turns(m), 9, 9).count() == 0
    assert [r.turn for r in TU.user_turns(TU.with_turns(m)).orderBy("seq").collect()] == [1, 2, 3]


def test_first_messages(spark):
    m = talk(spark, [("u", "<command-name>/clear</command-name>"), ("u", "<LOCAL-command-caveat>x"), ("a", "r"), ("u", "one"), ("u", "two")])
    assert [r.content for r in TU.first_user_messages(m, 1).collect()] == ["one"]
    assert TU.first_user_messages(m, 2, include_clear=True).count() == 2
    with pytest.raises(UsageError):
        TU.first_user_messages(m, 0)


def test_noncommand_turns(spark):
    m = talk(spark, [("u", "/briefing daily"), ("a", "reply"), ("u", "日報生成\nfor today"), ("u", "side", True), ("u", " \n"), ("u", "\n\nreal work\trequest\nwith detail"), ("u", "follow up")])
    r = TU.noncommand_turns(TU.main_messages(m), ("^日報生成",)).first()
    assert (r.noncommand_turns, r.first_noncommand_line) == (3, "real work\trequest")


def sessions(spark, *rows):
    return spark.createDataFrame([("a", s, None, repo, start, end, None) for s, repo, start, end in rows], SESSIONS)


def test_listing(spark):
    m = talk(spark, [("u", "héllo"), ("a", "abcd"), ("u", "not counted", True)])
    s = sessions(spark, ("s", "/Users/test/Brimday", "2026-03-28T10:00:00Z", None), ("none", None, "", ""))
    got = {r.session_id: (r.message_count, r.body_size, r.repo_path) for r in SS.list_sessions(s, m).collect()}
    assert got == {"s": (3, 10, "/Users/test/Brimday"), "none": (0, 0, "")}
    ids = lambda **kw: sorted(r.session_id for r in SS.list_sessions(s, m, SessionFilter(**kw)).collect())
    assert ids(projects=["brim%DAY"]) == ["s"] and ids(projects=["x", "Brim"]) == ["s"] and ids(projects=["Brim_y"]) == []
    # The stored string equals the bound's second: since takes it, until doesn't.
    assert ids(since="2026-03-28T10:00:00.000Z") == ["s"] and ids(until="2026-03-28T10:00:00.000Z") == ["none"]
    report = {r.session_id: r for r in SS.sessions_report(s, m, Config(), None, "UTC").collect()}
    assert (report["s"].noncommand_turns, report["s"].first_noncommand_line, report["none"].noncommand_turns) == (1, "héllo", 0)


def test_projects(spark):
    s = sessions(spark, ("1", "/Users/a/app", "3", ""), ("2", "/Users/b/app", "2", ""), ("3", "/w/new", "1", ""), ("4", "/w/old", "5", ""), ("5", None, "0", ""), ("6", "", "0", ""))
    c = Config(aliases={"new": ["old"]})
    got = sorted((r.project, r.session_count, r.last_started) for r in SS.projects_report(s, c, short=True).collect())
    assert got == [("", 2, "0"), ("app", 1, "2"), ("app", 1, "3"), ("new", 2, "5")]


def test_search(spark):
    m = talk(spark, [("u", "fix the auth bug"), ("a", "the AUTH module looks fine"), ("u", "auth aside", True), ("u", "ÄUTH")], "s1").unionByName(talk(spark, [("u", "auth on another day"), ("u", "nothing relevant")], "s2", "2026-03-29T15:{:02d}:00Z"))
    s = sessions(spark, ("s1", "/r/one", "", ""), ("s2", "/r/two", "", ""))
    rows = SE.search_report(m, s, "auth", Config(), None, "UTC").orderBy(F.col("timestamp").desc(), F.col("seq").desc()).collect()
    assert [(r.session_id, r.turn, r.snippet) for r in rows] == [("s2", 1, "auth on another day"), ("s1", 1, "the AUTH module looks fine"), ("s1", 1, "fix the auth bug")]
    assert SE.search_hits(m, s, "auth", SessionFilter("2026-03-29", "", ["two"])).count() == 1
    assert SE.search_hits(m, s.where("session_id = 's2'"), "auth").count() == 1
    assert SE.search_hits(m, s, "a_th%module").count() == 1
