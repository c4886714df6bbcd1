import random

import pytest
from pyspark.sql import functions as F

from logloom.operators.running import ranked, running_last, running_sum
from logloom.sources.tables import first_by_uuid, with_content


@pytest.mark.parametrize(("seed", "width"), [(0, 1), (1, 7), (2, 50), (3, 1000)])
def test_against_plain_loops(spark, seed, width):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "b"]), i, r.randrange(-3, 9), r.choice([None, None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k string, o int, x int, v string")
    seg = F.floor(F.col("o") / width)
    got = running_last(running_sum(df, ["k"], seg, ["o"], F.col("x"), "total"), ["k"], seg, ["o"], F.col("v"), "seen")
    sums, last, want = {}, {}, {}
    for k, o, x, v in rows:
        sums[k] = sums.get(k, 0) + x
        last[k] = v if v is not None else last.get(k)
        want[o] = (sums[k], last[k])
    assert {t.o: (t.total, t.seen) for t in got.collect()} == want
    kept = running_sum(df, ["k"], seg, ["o"], F.col("x"), "total", only=spark.createDataFrame([("b", 1)], "k string, other int"))
    assert {t.o: t.total for t in kept.collect()} == {o: want[o][0] for k, o, _, _ in rows if k == "b"}
    assert got.columns == ["k", "o", "x", "v", "total", "seen"]


@pytest.mark.parametrize("one_task", [0, 100_000])
@pytest.mark.parametrize("back", [False, True])
def test_ranks_against_brute_force(spark, monkeypatch, back, one_task):
    monkeypatch.setattr("logloom.operators.running.ONE_TASK", one_task)
    r = random.Random(back)
    rows = [(i, r.choice([None, "", *(f"20{y}-{m:02d}-01T{h:02d}:00" for y in (24, 25) for m in (1, 12) for h in (3, 21))])) for i in range(500)]
    got = {x.i: x["rank"] for x in ranked(spark.createDataFrame(rows, "i bigint, t string"), "t", ["i"], back).collect()}
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0]), reverse=back)
    assert got == {i: k + 1 for k, (i, _) in enumerate(order)}
    assert ranked(spark.createDataFrame([], "i bigint, t string"), "t", ["i"]).count() == 0


def test_contents_are_those_of_the_rows_that_count(spark):
    m = spark.createDataFrame([(1, "U1 ", "first"), (2, "u1", "second"), (None, "u2", "unnumbered"), (3, None, "no uuid"), (3, None, "no uuid"), (4, "u4", None)], "seq bigint, uuid string, content string")
    got = sorted(((x.uuid, x.seq, x.content) for x in with_content(first_by_uuid(m), m).collect()))
    assert got == [("", 3, "no uuid"), ("u1", 1, "first"), ("u2", None, "unnumbered"), ("u4", 4, None)]


@pytest.mark.parametrize("name", ["search_hits", "search_wildcard", "session_lookup", "outline", "show_bulk"])
def test_large_tables_go_another_way_to_the_same_rows(spark, sf, monkeypatch, name):
    from logloom.plans.reference import QUERIES

    d = sf.replace("sf0.001", "sf0.01")
    want = sorted(map(str, QUERIES[name](spark, d).collect()))
    monkeypatch.setattr("logloom.sources.tables.FILTER_BYTES", 0)
    assert sorted(map(str, QUERIES[name](spark, d).collect())) == want and want


def test_scratch_deletes_what_was_written(spark):
    import os

    from logloom.runtime import materialize, scratch

    kept = materialize(spark.range(3), "kept")
    with scratch():
        gone = materialize(spark.range(3), "gone")
        assert gone.count() == 3
    path = lambda df: df._logloom_path.removeprefix("file://")
    assert os.path.isdir(path(kept)) and not os.path.exists(path(gone)) and kept.count() == 3
