import random

import pytest

from logloom.llm import tokens as X

WORDS = ["the", "Übergang", "re-read", "it's", "区切り", "もし", "123", "3.14", "  ", "\n\n", "\t", "🙂", "<|endoftext|>", "x" * 30, "!?!", "a" * 5, " ", "'ll", "\r\n", "　"]


def text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice(["", " ", "", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def enc():
    return X.encoding(X.read_vocab())


def encode(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    return {r.doc_id: r.ids for r in X.encode_documents(docs, **kw).collect()}


def test_nulls_blanks_and_specials(spark, enc):
    texts = [None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|>b", "👩‍💻", "日本"]
    got = encode(spark, texts)
    assert [got[0], got[1]] == [[], []]
    assert all(got[i] == enc.encode_ordinary(t) for i, t in enumerate(texts) if t)
    assert 50256 not in got[4]
    assert encode(spark, []) == {}


def test_against_the_other_library(spark, enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(X.VOCAB_PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = [text(i, 40) for i in range(60)]
    got = encode(spark, texts)
    assert [got[i] for i in range(60)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 12), (64, 40), (17, 16), (200, 5)])
def test_chunked_equals_whole(spark, enc, chunk, overlap):
    texts = [text(i, n) for i, n in enumerate([5, 30, 80, 200, 400, 900])]
    texts += ["a" * 3000, " " * 500, "ab " * 700, "\n" * 300, "x" * 120 + " y" * 200, "'s" * 300, texts[3], texts[3]]
    got = encode(spark, texts, chunk=chunk, overlap=overlap)
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t), i


def test_stitches_are_shared_sure_and_after_no_space():
    # "ab cd" + " ef gh": the left chunk is sure of what isn't near its end.
    assert X.edges_of("ab cd ef gh ij", 100, 5, 3) == ([100, 102], [105])
    assert X.edges_of("ab cd\n\nef gh ij", 0, 5, 3) == ([0, 2], [5])  # not at 6 and 7, after the line feeds
    assert X.stitches([([0, 2], [5, 8]), ([7, 8], [])]) == [0, 8] and X.stitches([([0], [5]), ([6], [])]) == [0]


@pytest.mark.parametrize("spread", [1 << 20, 150, 700])
def test_chunks_of_every_place(spark, enc, spread):
    texts = ["a\n\nb c\t\td  e\r\n\r\nf" * 30, "word \n\n next\n\n\nline" * 25, "x.\n\ny" * 60]
    for chunk in (10, 23, 64):
        got = encode(spark, texts, chunk=chunk, overlap=16, spread=spread)
        assert [got[i] for i in range(3)] == [enc.encode_ordinary(t) for t in texts]


def test_round_trip(spark, enc):
    texts = [text(i, 60) for i in range(20)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in X.decode_ids(X.encode_documents(docs)).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_counts(spark, enc):
    docs = spark.createDataFrame([(1, "hello there"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in X.count_tokens(docs).collect()} == {1: 2, 2: 0, 3: 0}


def test_vocabulary_size_is_checked(tmp_path, monkeypatch):
    p = tmp_path / "v"
    p.write_bytes(b"x" * 100)
    monkeypatch.setattr(X, "MAX_VOCAB_BYTES", 50)
    with pytest.raises(ValueError):
        X.read_vocab(str(p))
