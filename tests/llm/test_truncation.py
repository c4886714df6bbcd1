import random

import pytest

from logloom.llm import truncation as X

SUBJECTS = ["the parser", "the old cache", "a worker", "the index", "this branch", "the nightly job"]
VERBS = ["drops", "rebuilds", "ignores", "repeats", "compares"]
OBJECTS = ["the first line", "every stored row", "a closed session", "the wrong offset", "two files"]


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)}".capitalize() + "."


def paragraph(r, n):
    return " ".join(sentence(r) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string, sig string, n int")


def judged(spark, rows):
    return {r.doc_id: r.reason for r in X.judge(frame(spark, rows)).collect()}


@pytest.fixture(scope="module")
def base():
    r = random.Random(7)
    return [("note", paragraph(r, r.randrange(2, 7))) for _ in range(400)]


PREFIX = {"copy", "segment", "run"}
MARKS = ["\n[connection closed]", " <cut>", "\n-- rest not received --", "�", "…"]


def test_cut_and_whole_texts(spark, base):
    r = random.Random(1)
    whole = paragraph(r, 4)
    heads = [" The old ca", " A wor", " The", " This bran", " The nightly jo"]
    cases = {
        "prefix": [whole[:-5], whole + " The nightly jo", whole + " The nightly job rebuilds the ", whole + " The old"],
        "mark": [paragraph(r, 3) + h + m for m in MARKS for h in heads],
        "open_block": [whole + "\n\n```python\nThe old cache drops"],
        None: [whole, whole[:-1], whole + "\n", "not sure yet…", whole + "\n\n```\nx\n```", "thanks 🙏", "ok", whole + " Done ✅"],
    }
    rows, want = list(base), {}
    for reason, texts in cases.items():
        for t in texts:
            want[len(rows)] = reason
            rows.append(("Note ", t))
    got = {r.doc_id: (r.reason, r.ways) for r in X.judge(frame(spark, rows)).collect()}
    for i, w in want.items():
        reason, ways = got[i]
        assert (reason in PREFIX) if w == "prefix" else (w in ways) if w == "open_block" else reason == w, (rows[i][1][-40:], w, ways)
    assert all(got[i][0] is None for i in range(len(base)))


def test_a_tail_is_no_mark_by_its_shape(spark, base):
    r = random.Random(4)
    whole = lambda: paragraph(r, 3)
    rare = [whole()[:-1] + " [appendix]", whole()[:-1] + " <br>", whole() + " See you soon. -- Jane Doe --"]
    # Recurring, but after whole sentences.
    often = [whole() + x for x in (" [appendix]", " <br>", "\n-- Jane Doe --", "\nexit status 0") for _ in range(8)]
    block = [whole() + "\n\n```\n" + sentence(r) + "\n"]
    rows = [*base, *(("note", t) for t in [*rare, *often, *block])]
    got = judged(spark, rows)
    assert [got[i] for i in range(len(base), len(rows) - 1)] == [None] * (len(rare) + len(often))


def test_limit(spark, base):
    r = random.Random(3)
    rows = list(base)
    first = len(rows)
    rows += [("brief", paragraph(r, 9)[:160]) for _ in range(60)] + [("brief", paragraph(r, 1)) for _ in range(60)]
    got = judged(spark, rows)
    assert sum(got[i] is not None for i in range(first, first + 60)) >= 58
    assert not any(got[i] for i in range(first + 60, first + 120))


def test_odd_rows(spark, base):
    rows = [*base[:50], ("note", None), ("note", ""), ("note", " 　\n"), (None, base[0][1][:-4]), (None, base[0][1][:-4]), ("note", " ".join([base[1][1]] * 300))]
    got = judged(spark, rows)
    assert {50, 51, 52}.isdisjoint(got) and got[53] == got[54] and got[55] is None
    assert judged(spark, []) == {}
    assert X.find_cut(frame(spark, rows)).columns == ["doc_id"]
    rates = {r.source: r for r in X.cut_rates(frame(spark, rows)).collect()}
    assert rates[""].n_docs == 2


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_prefix_copies_against_brute_force(spark, parts):
    r = random.Random(parts)
    texts = {"".join(r.choice("ab ") for _ in range(r.randrange(1, 9))) for _ in range(300)} | {"次", "次の", "次の行"}
    want = {t for t in texts if any(u != t and u.startswith(t) for u in texts)}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(t.encode(), t) for t in texts], "tkey binary, text string")
        got = X.prefix_copies(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {bytes(x.tkey).decode() for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("parts", [1, 3, 7, 40])
def test_all_extensions_tell_how_a_prefix_goes_on(spark, parts):
    r = random.Random(parts)
    texts = {"".join(r.choice("ab .\n") for _ in range(r.randrange(1, 8))) for _ in range(400)} | {"foo ba", "foo ba\n[output truncated]", "foo bar baz", "b" * 60, "b" * 60 + " c", "b" * 61}
    want = {}
    for t in texts:
        flags = [X.goes_on(t, u) for u in texts if u != t and u.startswith(t)]
        if flags:
            want[t] = (any(f[0] for f in flags), any(f[1] for f in flags))
    assert want["foo ba"] == (True, True)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(t.encode(), t) for t in texts], "tkey binary, text string")
        got = X.prefix_copies(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {bytes(x.tkey).decode(): tuple(x)[1:] for x in got} == want and len(got) == len(want)


def test_a_longer_copy_is_evidence(spark):
    assert X.goes_on("Compare the side", "Compare the sidecar now") == (True, True)
    assert X.goes_on("Compare it", "Compare it with that") == (False, True)
    assert X.goes_on("Compare it", "Compare it. Then stop") == (False, False)
    assert X.goes_on("Compare it.", "Compare it. Then stop") == (False, False)
    assert X.goes_on("list what broke", "list what broke (no rush)") == (False, False)
    assert X.goes_on("次はdrumlin", "次はdrumlinの境界") == (False, True)


def test_tokens():
    assert X.tokens("See v1.3, id 9f3ab2c and x_3bf.\n\nEnd") == ["see", " ", "v", "0", ".", "0", ",", " ", "id", " ", "#", " ", "and", " ", "x", "_", "#", ".", "\n", "end"]
    assert X.ending("one two ") == [X.BEGIN, "one", " ", "two", " "]
    assert X.ending("one. ") == [X.BEGIN, "one", "."]
    voc = X.Vocabulary()
    for text in ("", " \n", "one two ", "one. ", "A b\n\nc 12 9f3ab2c"):
        assert [voc.tokens[i] for i in voc.encode(text)] == X.ending(text)


def test_japanese_after_latin_letters(spark, base):
    assert X.tokens("a.tsをまとめ") == ["a", ".", "ts", "を", "ま", "と", "め"]
    assert X.tokens("版9f3ab2cの人々") == ["版", "#", "の", "人", "々"]
    r = random.Random(5)
    part = lambda: r.choice(["古い索引", "長い履歴", "別の設定", "次の行"])
    rows = [*base[:100], *(("note", f"{part()}をまとめてから再開位置を{r.choice(['確認', '記録', '変更'])}してください。{i}") for i in range(40))]
    n = len(rows)
    rows += [("note", f"{part()}を見ました。ledgerkit/noisy_buffer.tsをまとめてから再開位置を"), ("note", f"{part()}を見ました。noisy_buffer.tsをまとめてから再開位置を確認してください。")]
    got = judged(spark, rows)
    assert got[n] in PREFIX and got[n + 1] is None


def test_endings_without_evidence(spark, base):
    r = random.Random(11)
    rare = lambda i: "qzx" + "abcdefghij"[i] * 3 + "vw"
    whole = paragraph(r, 2)
    rows = [*base[:200], ("note", f"{whole} See {rare(0)}"), ("note", f"{whole} See {rare(0)}kk now."), ("note", f"{whole} See {rare(1)}")]
    n = len(rows)
    rows += [("brief", f"{paragraph(r, 9)[:151]} {rare(i)}") for i in range(2, 10)] + [("brief", paragraph(r, 9)[:160]) for _ in range(30)] + [("brief", paragraph(r, 1)) for _ in range(30)]
    got = judged(spark, rows)
    assert (got[n - 3], got[n - 2], got[n - 1]) == ("copy", None, None)
    assert [got[i] for i in range(n, n + 8)] == ["limit"] * 8


class Sent:
    value = X.Filter(X.np.full(1 << 12, 255, X.np.uint8))


def key_of(run, level):
    g = 0
    for x in run:
        g = (g * X._BASE + X._token_hash(x)) & X._WORD
    return int(X._mixed(X.np.array([g], X.np.uint64), level).view(X.np.int64)[0])


def segments(toks):
    """For each token the first one of its segment, None where none is open."""
    out, start, closed = [], None, True
    for i, x in enumerate(toks):
        if x not in (" ", "\n", X.BEGIN) and x not in X.STOPS and closed:
            start, closed = i, False
        out.append(None if closed else start)
        n1, n2 = (toks[j] if j < len(toks) else X.END for j in (i + 1, i + 2))
        closed = closed or X.stops(x, n1, n2)
    return out


def brute_counts(texts):
    out = {}

    def add(k, *v):
        out[k] = [a + b for a, b in zip(out.get(k, [0, 0, 0, 0]), v)]

    for text in texts:
        toks = X.ending(text)
        starts = segments(toks)
        for k in range(1, len(toks)):
            n1, n2 = (toks[i] if i < len(toks) else X.END for i in (k + 1, k + 2))
            runs = [(n, toks[k - n + 1 : k + 1]) for n in range(1, min(X.RUN, k + 1) + 1)]
            if starts[k] is not None:
                runs.append((X.SEGMENT, toks[starts[k] : k + 1]))
            for n, run in runs:
                add(key_of(run, n), 1, int(X.stops(toks[k], n1, n2)), int(n1 == X.END), 0)
                for j in range(1, len(run[-1]) if run[-1].isalpha() else 1):
                    add(key_of([*run[:-1], run[-1][:j]], n), 0, 0, 0, 1)
    return out


def packs(texts):
    import pyarrow as pa

    half = len(texts) // 2 + 1
    batches = [pa.RecordBatch.from_pydict({"tkey": [t.encode() for t in part], "text": part}) for part in (texts[:half], texts[half:]) if part]
    out = list(X._tokenise(iter(batches)))
    return [b.filter(X.pa.compute.equal(b["kind"], "pack")) for b in out], [r for b in out for r in b.to_pylist() if r["kind"] == "tail"]


TEXTS = ["x", "ok ", "one two ", "次の行を見ます。もし", "a\n\nb\n", "Wait…", "The ca\n[connection closed]", "v1.2 and 9f3ab2c", "日本", "!?!. .", "a b c d e f g h. i j", "no end here at all and on"]


@pytest.mark.parametrize("flush", [1, 2, 5, 7, 50, 10_000])
def test_counts_against_brute_force(monkeypatch, flush):
    import pyarrow.compute  # noqa: F401

    r = random.Random(flush)
    texts = [paragraph(r, 3) for _ in range(12)] + [paragraph(r, 2)[:-4], *TEXTS, paragraph(r, 12)]
    got = {}
    rows, _ = packs(texts)
    monkeypatch.setattr(X, "FLUSH", flush)
    monkeypatch.setattr(X, "WIDTH", flush)
    for b in X._counter(Sent, Sent)(iter(rows)):
        for k, *v in zip(*(b[c].to_pylist() for c in ("key", "n", "e", "x", "p"))):
            got[k] = [a + int(c) for a, c in zip(got.get(k, [0, 0, 0, 0]), v)]
    assert got == brute_counts(texts)


@pytest.mark.parametrize("flush", [3, 1000])
def test_readings_have_the_keys_of_their_ends(monkeypatch, flush):
    import pyarrow.compute  # noqa: F401

    texts = [*TEXTS, "one more <cut>", "and a wor <cut>", "the <cut>"]
    rows, tails = packs(texts)
    cut = key_of(X.tokens(" <cut>"), 100 + 4)
    monkeypatch.setattr(X, "WIDTH", flush)
    keep = X.Tails(X.np.array([cut], X.np.int64).view(X.np.uint64), X.np.array([3]), X.np.array([True]))
    got = {(r["tkey"].decode(), r["tail_size"]): r for b in X._readings(keep)(iter(rows)) for r in b.to_pylist()}
    assert len(got) == len(texts) + 3
    for (text, k), row in got.items():
        every = X.ending(text)
        toks = every[: len(every) - k]
        assert row["n_tokens"] == len(toks) - 1
        for n in range(1, X.RUN + 1):
            assert row["keys"][n - 1] == (key_of(toks[-n:], n) if n <= len(toks) and len(toks) > 1 else None)
        start = segments(every)[len(toks) - 1]
        assert row["keys"][X.SEGMENT - 1] == (None if start is None else key_of(toks[start:], X.SEGMENT))
        assert row["keys"][X.SEGMENT] == (key_of(every[len(toks) - 1 : len(toks) + 2], 3) if k else None)
    assert {t["tail"] for t in tails} >= {cut}


def test_rounds_of_the_filter_count_alike(spark, base, monkeypatch):
    rows = [*base[:120], ("note", base[0][1][:-7]), ("note", base[5][1][:-9])]
    want = judged(spark, rows)
    monkeypatch.setattr(X, "FILTER_BITS", 1 << 15)
    assert judged(spark, rows) == want


def test_long_words_and_texts_are_counted(monkeypatch):
    import pyarrow.compute  # noqa: F401

    text = "a" * 200_000 + " b" * 200_000
    rows, _ = packs([text])
    out = {}
    monkeypatch.setattr(X, "WIDTH", 150_000)
    for b in X._counter(Sent, Sent)(iter(rows)):
        for k, n in zip(b["key"].to_pylist(), b["n"].to_pylist()):
            out[k] = out.get(k, 0) + n
    assert out[key_of(["b"], 1)] == 200_000 and out[key_of([" ", "b"], 2)] == 200_000
