"""The core data problems on small tables: brute force, and the odd cases each docstring names."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import drift, hierarchy, intervals, nested, orphans
from logloom.sources.tables import table

U = dt.timezone.utc
T0 = dt.datetime(2024, 1, 31, 23, 0)


def ts(h):
    return T0 + dt.timedelta(hours=h)


M = "seq bigint, uuid string, source string, session_id string, parent_uuid string, loaded_at timestamp, period string, id bigint"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], M)


def test_orphans(spark):
    m = messages(spark, [
        (1, "U1 ", "a", " S1", None, ts(0)),  # before its session arrives
        (2, "u2", "a", "s1", None, ts(2)),  # after it
        (3, "u3", "a", "gone", None, ts(2)),
        (4, "u4", "a", "nowhere", None, ts(0)),
        (5, "u4", "a", "s1", None, ts(9)),  # a second version of u4 doesn't count
        (6, "u5", "b", "s1", None, ts(0)),  # another source
        (7, "u6", "a", None, None, ts(0)),
        (8, "u7", "a", "  ", None, ts(0)),
        (9, "u8", "a", "s1", None, None),
        (10, "u9", "a", "gone2", None, None),
    ])
    s = spark.createDataFrame([("a", "s1", ts(1)), ("a", "S1", ts(5)), ("a", "idle", ts(3)), ("a", None, ts(0)), ("a", "gone", None)][:4], "source string, session_id string, loaded_at timestamp")
    d = spark.createDataFrame([("a", "gone"), ("a", "s1"), ("a", "gone2")], "source string, session_id string")
    got = {tuple(r) for r in orphans.find_orphans(m, s, d, key_ranges=3).collect()}
    assert got == {
        ("messages", "a", "u1", "late", "2024-01"), ("messages", "a", "u3", "deleted", "2024-02"), ("messages", "a", "u4", "missing", "2024-01"),
        ("messages", "b", "u5", "missing", "2024-01"), ("messages", "a", "u9", "deleted", ""), ("sessions", "a", "idle", "unused", "2024-02"),
    }
    assert orphans.find_orphans(m.limit(0), s.limit(0), d.limit(0)).count() == 0


def brute_orphans(ms, ss):
    arr = {}
    for src, k, t in ss:
        arr[src, k] = min(arr.get((src, k), t), t)
    out = {("messages", s, u, "missing" if (s, k) not in arr else "late", t.strftime("%Y-%m")) for _, u, s, k, _, t in ms if (s, k) not in arr or arr[s, k] > t}
    used = {(s, k) for _, _, s, k, _, _ in ms}
    return out | {("sessions", s, k, "unused", t.strftime("%Y-%m")) for (s, k), t in arr.items() if (s, k) not in used}


@pytest.mark.parametrize("seed", range(3))
def test_orphans_against_brute_force(spark, seed):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < 0.4 else f"k{r.randrange(30)}"
    ms = [(i, f"u{i}", r.choice("ab"), key(), None, ts(r.randrange(3000))) for i in range(400)]
    ss = [(r.choice("ab"), key(), ts(r.randrange(3000))) for _ in range(40)]
    got = orphans.find_orphans(messages(spark, ms), spark.createDataFrame(ss, "source string, session_id string, loaded_at timestamp"), spark.createDataFrame([], "source string, session_id string"), key_ranges=2)
    assert {tuple(x) for x in got.collect()} == brute_orphans(ms, ss)


def test_bitmap_ids_are_dense_and_stable(spark):
    ev = spark.range(1000).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("skey")).crossJoin(spark.range(2).select(F.col("id").alias("x")))
    a, b = (orphans.encode_keys(e, 5).select("skey", "id").distinct().collect() for e in (ev, ev.repartition(7)))
    assert dict(map(tuple, a)) == dict(map(tuple, b)) and len({r.id for r in a}) == 1000
    assert all(r.id & 0xFFFFFFFF <= 1000 for r in a)


def brute_tree(par):
    out = {}
    for u in par:
        seen, x = [], u
        while par[x] in par and x not in seen:
            seen.append(x)
            x = par[x]
        if x in seen:
            circle = seen[seen.index(x):]
            out[u] = ("", -1, "cycle" if u in circle else "hung")
        elif seen:
            out[u] = (x, len(seen), "tree")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_against_brute_force(spark, seed):
    r = random.Random(seed)
    n = 300
    names = [f"n{i}" for i in range(n)]
    if seed == 0:  # one long chain
        par = {names[i]: names[i - 1] if i else None for i in range(n)}
    elif seed == 1:  # one circle with tails
        par = {names[i]: names[(i + 1) % 100] if i < 100 else names[i - 1] for i in range(n)}
    else:
        par = {x: r.choice(names + [None, "", " ", "lost"]) for x in names}
    rows = [(i, u.upper() + " ", "a", "s", p, T0) for i, (u, p) in enumerate(par.items())]
    rows += [(n + i, u, "a", "s", "n7", T0) for i, u in enumerate(names[:20])]  # later versions don't count
    r.shuffle(rows)
    m = messages(spark, rows)
    want = brute_tree(par)
    assert {x.uuid: (x.root_uuid, x.node_depth, x.link_state) for x in hierarchy.find_hierarchy(m).collect()} == want
    paths = {x.uuid: x for x in hierarchy.find_paths(m).collect()}
    tree = {u for u, v in want.items() if v[2] == "tree"}
    assert set(paths) == tree | (set(par) - set(want))
    for u in tree:
        p = paths[u]["path"]
        assert p[-1] == u and all(par[b] == a for a, b in zip(p, p[1:])) and len(p) == want[u][1] + 1


def test_hierarchy_odd_rows(spark):
    m = messages(spark, [(1, "a", "x", "s", "a", T0), (2, None, "x", "s", "b", T0), (None, "b", "x", "s", None, T0), (3, "c", "x", "s", "B ", T0)])
    got = {x.uuid: (x.root_uuid, x.node_depth, x.link_state) for x in hierarchy.find_hierarchy(m).collect()}
    assert got == {"a": ("", -1, "cycle"), "": ("b", 1, "tree"), "c": ("b", 1, "tree")}
    assert hierarchy.find_hierarchy(m.limit(0)).count() == 0


def test_descendants(spark):
    m = messages(spark, [(1, "r", "x", "s", None, T0), (2, "a", "x", "s", "r", T0), (3, "b", "x", "s", "r", T0), (4, "c", "x", "s", "a", T0)])
    got = {x.uuid: tuple(x)[1:] for x in hierarchy.descendants(m).collect()}
    assert got == {"r": (2, 3, 2), "a": (1, 1, 1), "b": (0, 0, 0), "c": (0, 0, 0)}


def test_descendants_of_a_long_chain(spark):
    n = 100_000
    m = spark.range(n).select(
        F.col("id").alias("seq"), F.concat(F.lit("u"), "id").alias("uuid"), F.when(F.col("id") > 0, F.concat(F.lit("u"), F.col("id") - 1)).alias("parent_uuid"),
    )
    m = m.unionByName(spark.createDataFrame([(n, "c1", "c2"), (n + 1, "c2", "c1"), (n + 2, "h", "c1"), (n + 3, "leaf", "u7")], "seq bigint, uuid string, parent_uuid string"))
    got = hierarchy.descendants(m)
    assert got.count() == n + 1
    assert got.where(f"uuid not in ('u7', 'leaf') and try_cast(substr(uuid, 2) as int) > 7 and (n_descendants <> {n - 1} - try_cast(substr(uuid, 2) as int) or height <> n_descendants or n_children <> if(height > 0, 1, 0))").count() == 0
    assert {r.uuid: tuple(r)[1:] for r in got.where("uuid in ('u0', 'u7', 'leaf')").collect()} == {"u0": (1, n, n - 1), "u7": (2, n - 7, n - 8), "leaf": (0, 0, 0)}


@pytest.mark.parametrize("seed", range(2))
def test_descendant_pairs_against_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(120)]
    par = {x: names[i - 1] if seed == 0 and i else r.choice([*names, None, None, "", "lost"]) if seed else None for i, x in enumerate(names)}
    m = messages(spark, [(i, u.upper() + " ", "a", "s", p, T0) for i, (u, p) in enumerate(par.items())] + [(200, "n5", "a", "s", "n9", T0)])
    loose = {u for u, v in brute_tree(par).items() if v[2] != "tree"}
    want = set()
    for u in set(par) - loose:
        x, n = par[u], 1
        while x in par:
            want.add((x, u, n))
            x, n = par[x], n + 1
    got = hierarchy.descendant_pairs(m).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert hierarchy.descendant_pairs(m.limit(0)).count() == 0
    below = {u: [(v, n) for a, v, n in want if a == u] for u in set(par) - loose}
    assert {x.uuid: tuple(x)[1:] for x in hierarchy.descendants(m).collect()} == {u: (sum(n == 1 for _, n in x), len(x), max((n for _, n in x), default=0)) for u, x in below.items()}
    assert hierarchy.descendants(m.limit(0)).count() == 0


def brute_spans(rows):
    out = set()
    by = {}
    for e, a, b in rows:
        by.setdefault(e, []).append((a, b))
    for e, iv in by.items():
        cur = None
        for a, b in sorted(iv):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    out |= {(e, "period", *cur), (e, "gap", cur[1], a)}
                cur = [a, b]
        out.add((e, "period", *cur))
    return out


@pytest.mark.parametrize(("seed", "bucket"), [(0, 10), (1, 7), (2, 1000), (3, 1), (4, 10)])
def test_intervals_against_brute_force(spark, seed, bucket):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        a = r.randrange(-50, 400)
        rows.append((r.choice(["hot", "hot", "x", "y"]), a, a + r.choice([0, 0, 1, 2, 5, 90 if r.random() < 0.1 else 1])))
    p = intervals.merge_intervals(spark.createDataFrame(rows, "entity string, a bigint, b bigint"), bucket)
    got = set()
    for x in p.collect():
        got.add((x.entity, "period", x.a, x.b))
        if x.prev_end is not None:
            got.add((x.entity, "gap", x.prev_end, x.a))
    assert got == brute_spans(rows)


def test_spans_odd_rows(spark):
    rows = [
        (" /r/x// ", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"), ("/r/x/.claude/worktrees/w", "2024-01-01T10:00:00+09:00", None),  # touches
        ("/r/x", "2024-01-01T03:00:00Z", "bad"), ("/r/x", "2024-01-01T05:00:00Z", "2024-01-01T04:00:00Z"), ("/r/x", None, "2024-01-01T04:00:00Z"),
        (None, "2024-01-01T00:00:00Z", None), ("  ", "2024-01-01T00:00:00Z", None), ("///", "2024-01-01T00:00:00Z", None),
    ]
    df = spark.createDataFrame([(*r, "w") for r in rows], "repo_path string, started_at string, ended_at string, w string")
    h = 3_600_000
    base = 1704067200000
    assert {tuple(x) for x in intervals.find_spans(df).collect()} == {("/r/x", "period", base, base + h), ("/r/x", "gap", base + h, base + 3 * h), ("/r/x", "period", base + 3 * h, base + 3 * h)}
    assert intervals.find_spans(df.limit(0)).count() == 0


def brute_nodes(v, path, parent, out):
    if isinstance(v, dict):
        t = v.get("type")
        out.add((path, parent, t if isinstance(t, str) else ""))
        for k, x in v.items():
            brute_nodes(x, f"{path}.{k}", path, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            brute_nodes(x, f"{path}[{i}]", parent, out)


def test_nodes_against_brute_force(spark, sf):
    import json

    from logloom.operators.bad_rows import find_bad_rows

    raw = table(spark, sf, "raw_records")
    bad = {r.record_id for r in find_bad_rows(raw).collect()}
    want = set()
    for r in raw.collect():
        if r.record_id in bad or not (r.line or "").strip():
            continue
        name = {"claude_code": "message", "codex": "payload"}[r.source]
        body = json.loads(r.line).get(name)
        if isinstance(body, dict):
            out = set()
            brute_nodes(body, name, "", out)
            want |= {(r.record_id, *x) for x in out}
    got = nested.find_nodes(raw).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_nodes_odd_rows(spark):
    deep = '{"type":"x","payload":' + '{"a":[' * 3000 + "{}" + "]}" * 3000 + "}"
    rows = [(1, "codex", deep), (2, "codex", '{"payload":{"a.b":{"type":5},"a":{"b":{"type":"t"}}}}'), (3, "codex", None), (4, None, "{}"), (5, "codex", '{"payload":{"content":[1]}}'), (6, "claude_code", '{"type":"x","message":{"content":5}}')]
    raw = spark.createDataFrame(rows, "record_id bigint, source string, line string")
    nodes = nested.node_table(raw)
    n = {r.record_id: r["count"] for r in nodes.groupBy("record_id").count().collect()}
    assert n == {1: 3001, 2: 3, 6: 1}
    below = nested.enclosed(nodes, F.expr("record_id = 1 and depth = 2990"))
    assert below.count() == 10
    assert nested.find_nodes(raw.limit(0)).count() == 0


def leaves(v, out):
    """Every scalar, as text, and every empty array below v."""
    for x in v.values() if isinstance(v, dict) else v:
        if isinstance(x, (dict, list)) and x:
            leaves(x, out)
        elif x != {}:
            out.append(x if isinstance(x, str) or x is None else json.dumps(x))
    return out


def test_nodes_lose_no_value(spark, sf):
    body = {
        "cmd": ["make", "extract"], "none": [], "gone": None, "grid": [[1, 2], [[True]]], "mixed": ["a", {"id": 7}, [5, {"x": "y"}, []], None, [[]]],
        "a.b": {"v": 1}, "a": {"b": {"v": 2, "w": {"z": 3}}},
    }
    rows = [(1, "codex", json.dumps({"payload": body})), (2, "codex", json.dumps({"payload": {"only": [{}]}}))]
    raw = spark.createDataFrame(rows, "record_id bigint, source string, line string").unionByName(table(spark, sf, "raw_records").select(F.col("record_id") + 10, "source", "line").toDF("record_id", "source", "line"))
    nodes = nested.node_table(raw, every=True).select("record_id", "pre", "parent_pre", "node_path", F.to_json("fields").alias("fields")).collect()
    first = {(n.pre, n.node_path): json.loads(n.fields) for n in nodes if n.record_id == 1}
    assert [f for (_, path), f in first.items() if path == "payload"] == [{
        "cmd": '["make","extract"]', "none": "[]", "gone": None, "grid": "[[1,2],[[true]]]", "mixed[0]": "a", "mixed[2][0]": "5", "mixed[2][2]": "[]", "mixed[3]": None, "mixed[4][0]": "[]",
    }]
    assert sorted(f["v"] for (_, path), f in first.items() if path == "payload.a.b") == ["1", "2"]
    pres = {(n.record_id, n.pre) for n in nodes}
    assert all(n.parent_pre is None or (n.record_id, n.parent_pre) in pres for n in nodes) and len(pres) == len(nodes)
    got = {}
    for n in nodes:
        for v in json.loads(n.fields).values():
            part = json.loads(v) if v and v.startswith("[") else None
            got.setdefault(n.record_id, []).extend(leaves(part, []) if part else [v])
    lines = {r.record_id: json.loads(r.line) for r in raw.collect() if r.record_id in got}
    key = lambda x: (x is None, x or "")
    for rid, rec in lines.items():
        assert sorted(got[rid], key=key) == sorted(leaves(rec.get("payload", rec.get("message")), []), key=key), rid


def test_node_tables_by_type(spark, tmp_path):
    raw = spark.createDataFrame([(1, "codex", '{"payload":{"type":"p","in":[{"type":"c","cmd":["ls"]},{"type":"d"}]}}')], "record_id bigint, source string, line string")
    t = nested.node_tables(raw, f"file://{tmp_path}/nodes")
    assert sorted(p.name for p in (tmp_path / "nodes").glob("node_type=*")) == ["node_type=c", "node_type=d", "node_type=p"]
    assert [(r.parent_pre, r.fields) for r in t.where("node_type = 'c'").collect()] == [(0, {"type": "c", "cmd": '["ls"]'})] and [r.pre for r in t.where("node_type = 'p'").collect()] == [0]


def test_nodes_of_equal_paths_all_stay(spark):
    line = '{"type":"x","message":{"a.b":{"type":"x","c":{"v":1}},"a":{"b":{"type":"y","c":{"v":2}}}}}'
    raw = spark.createDataFrame([(1, "claude_code", line)], "record_id bigint, source string, line string")
    n = nested.node_table(raw, every=True).collect()
    assert len(n) == 6 and sorted(r.fields["v"] for r in n if "v" in r.fields) == ["1", "2"] and {r.node_type for r in n} == {"", "x", "y"}


EXPECTED = [
    ("codex", "m", "type", "string", True), ("codex", "m", "payload", "object", True), ("codex", "m", "payload.id", "string|number", True), ("codex", "m", "payload.tag", "string", False),
    ("codex", "m", "payload.items", "array", False), ("codex", "m", "payload.items[].a", "string", True),
]


def changes(spark, lines, path="f"):
    raw = spark.createDataFrame([(i, "codex", p, 1, x) for i, (p, x) in enumerate((path, x) if isinstance(x, str) else x for x in lines)], "record_id bigint, source string, jsonl_path string, line_number int, line string")
    exp = spark.createDataFrame(EXPECTED, "source string, record_type string, field_path string, json_types string, is_required boolean")
    return {tuple(r)[2:] for r in drift.find_changes(raw, exp).collect()}, drift.unify(raw, exp)


@pytest.mark.parametrize(("lines", "want"), [
    (['{"type":"m","payload":{"id":"x"}}'], set()),
    (['{"type":"m","payload":{"id":null}}'], set()),
    (['{"type":"m","payload":{"id":true}}'], {("retyped", "payload.id", "")}),
    (['{"type":"m","payload":{"ident":"x"}}'], {("renamed", "payload.id", "payload.ident")}),
    (['{"type":"m","payload":{"ident":null}}'], {("renamed", "payload.id", "payload.ident")}),
    (['{"type":"m","payload":{"ident":[]}}'], {("removed", "payload.id", ""), ("added", "payload.ident", "")}),
    (['{"type":"m","payload":{"n1":"x","n2":"y"}}'], {("removed", "payload.id", ""), ("added", "payload.n1", ""), ("added", "payload.n2", "")}),
    (['{"type":"m","payload":{"n1":"x","n2":[]}}'], {("renamed", "payload.id", "payload.n1"), ("added", "payload.n2", "")}),
    (['{"type":"m","payload":{"n1":"x"}}', '{"type":"m","payload":{}}'], {("removed", "payload.id", ""), ("added", "payload.n1", "")}),
    (['{"type":"m","payload":{"n1":"x"}}', '{"type":"m","payload":{"id":"x"}}'], {("added", "payload.n1", "")}),
    (['{"type":"m","payload":{"id":"x","items":[{"a":"1"},{"b":2}]}}'], {("added", "payload.items[].b", "")}),
    (['{"type":"m","payload":{"id":"x","items":[{"c":"1"},{"c":"2"}]}}'], {("renamed", "payload.items[].a", "payload.items[].c")}),
    (['{"type":"m","payload":{"id":"x","items":[]}}'], set()),
    (['{"type":"m","payload":{"id":"x","items":"s"}}'], {("retyped", "payload.items", "")}),
    (['{"type":"m","payload":{"id":"x","items":[1,{"z":1}]}}'], set()),
    (['{"type":"zz","payload":{"q":1}}', '{"type":"zz","payload":{}}'], {("added", "type", "")}),
    (['{"type":"response_item","payload":{"type":"new"}}'], {("added", "payload.type", "")}),
    (['{"payload":{}}'], {("added", "type", "")}),
    (["nonsense", " ", '{"type":"m","payload":5}'], set()),
])
def test_drift(spark, lines, want):
    assert changes(spark, lines)[0] == want


def test_drift_per_file_and_unified(spark):
    got, u = changes(spark, [("f", '{"type":"m","payload":{"id":"x"}}'), ("g", '{"type":"m","payload":{"ident":"y","more":1}}'), ("g", '{"type":"m","payload":{"ident":"z"}}')])
    assert got == {("renamed", "payload.id", "payload.ident"), ("added", "payload.more", "")}
    rows = sorted(u.collect(), key=lambda r: r.record_id)
    assert [r.fields["payload.id"] for r in rows] == ["x", "y", "z"] and rows[1].other == {"payload.more": "1"}


def test_unify_keeps_places_in_arrays(spark):
    got, u = changes(spark, ['{"type":"m","payload":{"id":"x","items":[{"c":"1"},{"c":"2"}]}}'])
    assert got == {("renamed", "payload.items[].a", "payload.items[].c")}
    f = u.first().fields
    assert (f["payload.items[0].a"], f["payload.items[1].a"]) == ("1", "2") and u.first().other == {}


def test_unify_keeps_deep_values(spark):
    deep = "[" * 50_000 + "]" * 50_000
    _, u = changes(spark, ['{"type":"m","payload":{"id":"x","items":' + deep + ',"more":' + deep + "}}"])
    r = u.first()
    assert r.fields["payload.items"] == deep and r.other == {"payload.more": deep}


def test_matching_is_one_to_one():
    listed = {"id": (("string",), True), "role": (("string",), True)}
    fields = {"ident": (3, {"string"}, None), "rolle": (3, {"string"}, None)}
    both = drift.match_object(fields, 3, listed)
    assert both.renamed == [] and {r: a for r, (a, _) in both.pairs.items()} == {"id": "ident", "role": "rolle"}
    two = drift.match_object({**fields, "role": (3, {"string"}, None)}, 3, listed)
    assert two.renamed == [] and two.pairs["id"][0] == "ident"
    assert drift.match_object({"ident": (3, {"string"}, None), "role": (3, {"string"}, None)}, 3, listed).renamed[0][:2] == ("id", "ident")


@pytest.mark.parametrize("seed", range(30))
def test_assignment_against_brute_force(seed):
    from itertools import permutations

    r = random.Random(seed)
    left, right = [f"l{i}" for i in range(r.randrange(0, 5))], [f"r{i}" for i in range(r.randrange(1, 6))]
    edges = {x: [(r.choice([0.1, 0.5, r.random()]), y) for y in right if r.random() < 0.6] for x in left}
    got = drift.assign(edges)
    assert len({a for a, _ in got.values()}) == len(got) and all((w, a) in edges[x] for x, (a, w) in got.items())
    best = (0, 0.0)
    for order in permutations([*right, *[None] * len(left)], len(left)):
        w = [dict((a, w) for w, a in edges[x]).get(y) for x, y in zip(left, order) if y]
        w = [x for x in w if x is not None]
        best = max(best, (len(w), sum(w)))
    assert (len(got), pytest.approx(sum(w for _, w in got.values()))) == best


def test_unify_keeps_the_place_in_each_array(spark):
    exp = spark.createDataFrame([("codex", "m", p, "x", False) for p in ("payload.content", "payload.content[].content", "payload.content[].content[].text", "payload.git", "payload.git.sha")], "source string, record_type string, field_path string, json_types string, is_required boolean")
    line = '{"type":"m","payload":{"content":[{"content":[{"text":"x"},{"text":"y"}]},{"content":[{"text":"z"}]},{"content":[]}],"git":{}}}'
    raw = spark.createDataFrame([(1, "codex", "f", 1, line)], "record_id bigint, source string, jsonl_path string, line_number int, line string")
    r = drift.unify(raw, exp).first()
    want = {"content[0].content[0].text": "x", "content[0].content[1].text": "y", "content[1].content[0].text": "z", "content[2].content": "[]", "git": "{}"}
    assert r.fields == {"payload." + k: v for k, v in want.items()}
    assert r.other == {"type": "m"} and set(r.retyped) == set(r.fields)


def test_rename_edges_are_weighted_by_whole_values(spark):
    v = lambda i: "x" * 70 + f"{i:04}"  # differs, and has digits, only after 64 characters
    lines = [("f", '{"type":"m","payload":{"id":"%s"}}' % v(i)) for i in range(40)]
    lines += [("g", '{"type":"m","payload":{"k1":"%s","k2":"%s"}}' % (v(i), "x" * 70 + "abcd")) for i in range(40)]
    lines += [("h", '{"type":"m","payload":{"ident":5}}')]
    raw = spark.createDataFrame([(i, "codex", p, 1, x) for i, (p, x) in enumerate(lines)], "record_id bigint, source string, jsonl_path string, line_number int, line string")
    exp = spark.createDataFrame(EXPECTED, "source string, record_type string, field_path string, json_types string, is_required boolean")
    got = {(r.jsonl_path, r.field_path, r.new_path): r for r in drift.find_matches(raw, exp).collect()}
    assert {k: r.is_rename for k, r in got.items()} == {("g", "payload.id", "payload.k1"): False, ("g", "payload.id", "payload.k2"): False, ("h", "payload.id", "payload.ident"): True}
    k1, k2 = got["g", "payload.id", "payload.k1"].weight, got["g", "payload.id", "payload.k2"].weight
    assert k1 - k2 > 0.1 and all(0 <= r.weight <= 1 for r in got.values())
    assert got["g", "payload.id", "payload.k1"].is_matched and not got["g", "payload.id", "payload.k2"].is_matched


def test_rename_edges_hold_the_renames(spark, sf):
    raw, exp = table(spark, sf, "raw_records"), table(spark, sf, "expected_fields")
    want = {(r.jsonl_path, r.record_type, r.field_path, r.new_path) for r in drift.find_changes(raw, exp).where("change_kind = 'renamed'").collect()}
    assert {tuple(r)[1:5] for r in drift.find_matches(raw, exp).where("is_rename").collect()} == want


def brute_changes(raw, expected, bad):
    """p2_found stated plainly: collect every object, then look at each listed one."""
    import json

    listed = {}
    for source, rt, path, types, must in expected:
        listed.setdefault((source, rt), {})[path] = (types.split("|"), must)
    groups = {}
    for rid, source, path, line in raw:
        if rid in bad or line is None or not line.strip():
            continue
        rec = json.loads(line)
        rt = rec.get("type", "")
        if source == "codex" and rt == "response_item":
            rt = f"response_item:{rec['payload'].get('type', '')}"
        groups.setdefault((source, path, rt), []).append(rec)
    kind = lambda v: {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array"}.get(type(v), "null")
    out = set()
    for (source, path, rt), recs in groups.items():
        fields = listed.get((source, rt))
        if fields is None:
            out.add((path, rt, "added", "payload.type" if rt.startswith("response_item:") else "type", ""))
            continue
        for obj in {p.rpartition(".")[0] for p in fields}:
            found = []
            for rec in recs:
                at = [rec]
                for step in obj.split(".") if obj else []:
                    if step.endswith("[]"):
                        at = [x for o in at if isinstance(o.get(step[:-2]), list) for x in o[step[:-2]] if isinstance(x, dict)]
                    else:
                        at = [o[step] for o in at if isinstance(o.get(step), dict)]
                found += at
            if not found:
                continue
            full = lambda k, obj=obj: f"{obj}.{k}" if obj else k
            seen = {k for o in found for k in o}
            types = {k: {kind(o[k]) for o in found if k in o} - {"null"} for k in seen}
            removed = [p for p, (_, must) in fields.items() if p.rpartition(".")[0] == obj and must and p.rpartition(".")[2] not in seen]
            added = [k for k in seen if full(k) not in fields]
            out |= {(path, rt, "retyped", full(k), "") for k in seen if full(k) in fields and types[k] - set(fields[full(k)][0])}
            fit = [k for k in added if len(removed) == 1 and all(k in o for o in found) and types[k] <= set(fields[removed[0]][0])]
            if len(fit) == 1:
                out.add((path, rt, "renamed", removed[0], full(fit[0])))
                removed, added = [], [k for k in added if k != fit[0]]
            out |= {(path, rt, "removed", p, "") for p in removed} | {(path, rt, "added", full(k), "") for k in added}
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_drift_against_brute_force(spark, sf, scale):
    from logloom.operators.bad_rows import find_bad_rows

    d = sf.replace("sf0.001", scale)
    raw, exp = table(spark, d, "raw_records"), table(spark, d, "expected_fields")
    bad = {r.record_id for r in find_bad_rows(raw).collect()}
    rows = [(r.record_id, r.source, r.jsonl_path, r.line) for r in raw.collect()]
    want = brute_changes(rows, [tuple(r) for r in exp.select("source", "record_type", "field_path", "json_types", "is_required").collect()], bad)
    got = drift.find_changes(raw, exp).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
