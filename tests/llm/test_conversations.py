import datetime as dt
import random

from logloom.llm import conversations as C

DDL = "seq bigint, uuid string, source string, session_id string, parent_uuid string, role string, content string, timestamp string, is_sidechain boolean, loaded_at timestamp, filled string, last int"
T = "2024-01-01T00:{:02d}:00Z"


def rows(spark, data):
    return spark.createDataFrame([(i if q is ... else q, u if u is not ... else f"u{i}", src, sid, None, role, text, t, side, dt.datetime(2024, 1, 1), "x", 1) for i, (q, u, src, sid, role, text, t, side) in enumerate(data)], DDL)


def msg(sid, role, text, minute=0, side=False, seq=..., uuid=..., src="a", t=None):
    return (seq, uuid, src, sid, role, text, T.format(minute) if t is None else t, side)


def dropped(spark, data):
    return {(r.source, r.session_id): r.drop_reason for r in C.find_dropped(rows(spark, data)).collect()}


def test_reasons(spark):
    data = [
        msg("ok", " User ", "q"), msg("ok", "ASSISTANT", "r", 1),
        msg("role", "user", "q"), msg("role", "bot", "r", 1),
        msg("null role", "user", "q"), msg("null role", None, "r", 1),
        msg("time", "user", "q"), msg("time", "assistant", "r", t="n/a"),
        msg("no time", "user", "q"), msg("no time", "assistant", "r", t=""),
        msg("empty", "user", "　\n"), msg("empty", "assistant", None, 1), msg("empty", "system", "", 2),
        msg("system only", "system", "text"),
        msg("no user", "assistant", "r"), msg("no user", "user", " ", 1),
        msg("no reply", "assistant", "r"), msg("no reply", "user", "q", 1),
        msg("late blank", "user", "q"), msg("late blank", "assistant", "r", 1), msg("late blank", "user", "\t", 2), msg("late blank", "system", "s", 3),
        msg("tie", "assistant", "r", 1, seq=900), msg("tie", "user", "q", 1, seq=100),
        msg("side", "user", "q", side=True), msg("side", "bot", "r", side=True),
        msg(None, "bot", "x"), msg("  ", "bot", "x"),
        msg(" SPACED ", "user", "q"), msg("spaced", "assistant", "r", 1),
        msg("ok", "user", "q", src="b"),
        msg("offset", "user", "q", t="2024-01-01T09:00:00+09:00"), msg("offset", "assistant", "r", t="2023-12-31T23:59:59Z"),
    ]
    assert dropped(spark, data) == {
        ("a", "role"): "broken", ("a", "null role"): "broken", ("a", "time"): "broken", ("a", "no time"): "broken", ("a", "empty"): "empty", ("a", "system only"): "no_user",
        ("a", "no user"): "no_user", ("a", "no reply"): "no_reply", ("b", "ok"): "no_reply", ("a", "offset"): "no_reply",
    }
    assert dropped(spark, []) == {}


def test_first_version_counts(spark):
    data = [msg("s", "user", "q"), msg("s", "assistant", "r", 1, uuid="X", seq=50), msg("s", "bot", "r", 1, uuid=" x ", seq=51), msg("s", "bot", "r", 1, uuid="x", seq=None)]
    assert dropped(spark, data) == {}
    last = C.validate(C.fold_turns(rows(spark, data), policy="last")).collect()
    assert [r.drop_reason for r in last] == ["broken"]


def test_deleted_turns_go_with_the_last_policy(spark):
    data = [msg("s", "user", "q"), msg("s", "assistant", "r", 1, uuid="x", seq=50), msg("s", "assistant", " ", 1, uuid="x", seq=51)]
    assert C.validate(C.fold_turns(rows(spark, data), policy="last")).first().drop_reason == "no_reply"


def test_order_of_a_hot_session(spark):
    r = random.Random(1)
    data = [msg("hot", "user" if i % 2 == 0 else "assistant", f"m{i}", t=f"2024-01-{1 + i // 200:02d}T{i // 20 % 10:02d}:{i % 20 // 2:02d}:00Z", seq=i) for i in range(400)]
    data += [msg("cold", "user", "q"), msg("cold", "assistant", "r", 1)]
    r.shuffle(data)
    got = sorted((x.turn_no, x.content) for x in C.conversations(rows(spark, data)).where("session_id = 'hot'").collect())
    assert got == [(i + 1, f"m{i}") for i in range(400)]
