import random

import numpy as np
import pytest

from logloom.llm import mixing as X
from logloom.sources.tables import table

NOUNS = {"code": ["func", "return", "class", "import"], "chat": ["hello", "please", "thanks", "maybe"], "log": ["ERROR", "WARN", "stack", "trace"]}


def corpus(seed, sizes, unlabelled=0):
    r = random.Random(seed)
    out = []
    for s, n in sizes.items():
        out += [(s, " ".join(r.choice(NOUNS[s]) for _ in range(r.randrange(5, 60)))) for _ in range(n)]
    out += [(None, " ".join(r.choice(NOUNS[s]) for _ in range(20))) for s in [*sizes] * unlabelled]
    return [(i, t, s, "x", 1) for i, (s, t) in enumerate(out)]


def frames(spark, docs, targets):
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, domain string, cap int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_reach_targets_and_caps_hold(spark):
    docs, targets = frames(spark, corpus(1, {"code": 300, "chat": 200, "log": 30}), [("code", 0.5, 1), (" Chat", 0.3, 2), ("log", 0.2, 5), ("none", 0.1, 3)])
    mixed = X.mix(docs, targets).collect()
    caps = {"code": 1, "chat": 2, "log": 5}
    assert all(0 <= r.uses <= caps[r.domain] for r in mixed) and len(mixed) == 530
    used = {d: sum(r.uses * r.n_tokens for r in mixed if r.domain == d) for d in caps}
    total = sum(used.values())
    for d, w in (("code", 0.5), ("chat", 0.3), ("log", 0.2)):
        assert used[d] / total == pytest.approx(w, abs=0.01)
    # One source is used up to its limit: the mixture can't grow.
    assert any(all(r.uses == caps[d] for r in mixed if r.domain == d) for d in caps)
    checks = {r.source: tuple(r)[1:] for r in X.check_mix(X.mix(docs, targets), targets).collect()}
    assert checks == {"code": (0.5, True, True), "chat": (0.3, True, True), "log": (0.2, True, True), "none": (0.0, True, True)}
    got = {r.source: r for r in X.shares(X.mix(docs, targets), targets).collect()}
    assert got["none"].actual_share == 0 and sum(r.actual_share for r in got.values()) == pytest.approx(1, abs=1e-4)


def test_unlabelled_documents_get_soft_members(spark):
    docs, targets = frames(spark, corpus(2, {"code": 60, "chat": 60, "log": 60}, unlabelled=30), [("code", 0.4, 2), ("chat", 0.4, 2), ("log", 0.2, 2)])
    mixed = X.mix(docs, targets).collect()
    assert sum(not r.labelled for r in mixed) == 90
    total = sum(r.uses * r.n_tokens for r in mixed)
    for i, w in ((0, 0.4), (1, 0.4), (2, 0.2)):  # domains in alphabetical order
        at = {0: 1, 1: 0, 2: 2}[i]
        assert sum(r.uses * r.n_tokens * r.p[at] for r in mixed) / total == pytest.approx(w, abs=0.02)


def test_odd_tables(spark):
    docs, targets = frames(spark, [(1, None, "code", "x", 1), (2, "", "code", "x", 1), (3, " ", "CODE ", "x", 1), (None, "hi", "code", "x", 1), (5, "yo", "else", "x", 1)], [("code", 1.0, 2), (None, 0.5, 1)])
    rows = X.mix(docs, targets).collect()
    assert sorted((r.doc_id is None, r.uses) for r in rows) == [(False, 2), (False, 2), (True, 2)]
    assert X.mix(docs.limit(0), targets).count() == 0


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.1"), "documents")
    want = [d for d, _, _ in X.read_targets(table(spark, sf, "mix_targets"))]
    from pyspark.sql import functions as F

    from logloom.functions.text import norm_source

    rows = docs.select(norm_source(F.col("source")).alias("domain"), "text", (F.xxhash64("doc_id") % 5 == 0).alias("held")).where(F.col("domain").isin(want) & (F.char_length("text") > 0))
    weights = X.fit(rows.where("not held").select("domain", "text"), want)
    held = rows.where("held").collect()
    right = sum(want[int(X.posteriors(weights, r.text).argmax())] == r.domain for r in held)
    assert len(held) > 1000 and right / len(held) >= 0.9


def test_rates_replay():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    r = X.rates_of(p, np.array([1.0, 2.0]), [np.array([3.0, 0.0]), np.array([-0.5, 0.0])])
    assert r.tolist() == [0.5, 1.25]
