import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.sources.strict_json import cells_of, dump, dump_deep, fail_reason, kind_of, parse, parse_deep, record_type

GOOD = ['{"a":1}', ' {"a" : [1, -0.5e+3, true, null, "x\\u00e9"]} ', "{}", "[]", '"s"', "0", "-0", "1e400", "1" * 5000, '{"a":1,"a":2}', '"\\ud800"']
BAD = ["", "{", '{"a":1}]', '{"a":1} x', "{'a':1}", '{"a":1,}', '{"a":01}', '{"a":.5}', '{"a":1.}', '{"a":NaN}', "Infinity", "[1,]", "[,]", '{"a"}', '{"a":}', '{a:1}', '"\t"', '"\\x"', "tru", "1 2", '{"a":1}{"b":2}', "-", "+1", '["\x00"]', "﻿{}", '{"a" 1}', '{1:2}', "]", '{"a":1;"b":2}', '{"a":progress"}']


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert kind_of(parse(text)) == kind_of(parse_deep(text))


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    for f in (parse, parse_deep):
        with pytest.raises(ValueError):
            f(text)


def test_deep():
    n = 200_000
    v = parse("[" * n + "]" * n)
    for _ in range(n - 1):
        v = v[0]
    assert v == []
    with pytest.raises(ValueError):
        parse("[" * n + "]" * (n - 1))


def test_deep_values_are_written():
    n = 100_000
    for text in ("[" * n + "]" * n, '{"a":[1,' * n + "null" + "]}" * n):
        assert dump(parse(text)) == text


def test_half_pairs_become_whole_characters():
    assert parse('{"\\ud800k": ["\\udc00", "\\ud83d\\ude00"]}') == {"�k": ["�", "😀"]}


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_both_parsers_agree(v):
    text = json.dumps(v)
    assert parse_deep(text) == parse(text) == json.loads(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]",:0123.eE-+truefalsn\\u \n', max_size=14))
def test_both_parsers_refuse_alike(text):
    out = []
    for f in (parse, parse_deep):
        try:
            f(text)
            out.append(True)
        except ValueError:
            out.append(False)
    assert out[0] == out[1], text


CASES = [
    ("claude_code", '{"type":"user","message":{"content":"x"}}', ""),
    ("claude_code", '[{"type":"user"}]', "not_json"),
    ("claude_code", "null", "not_json"),
    ("claude_code", '{"type":"user"}', "no_body"),
    ("claude_code", '{"type":"assistant","message":"x"}', "no_body"),
    ("claude_code", '{"type":"progress"}', ""),
    ("claude_code", '{"type":"progress","message":5}', ""),
    ("claude_code", '{"type":"user","message":{"content":5}}', "bad_content"),
    ("claude_code", '{"type":"user","message":{"content":[{"a":1},2]}}', "bad_content"),
    ("claude_code", '{"type":"user","message":{"content":[]}}', ""),
    ("claude_code", '{"type":"user","message":{"content":null}}', ""),
    ("claude_code", '{"type":"user","message":{"content":{}}}', ""),
    ("claude_code", '{"type":"progress","message":{"content":true}}', ""),
    ("codex", '{"type":"event_msg"}', "no_body"),
    ("codex", '{"payload":{"content":false}}', "bad_content"),
    ("codex", '{"payload":{},"timestamp":"nope"}', "bad_time"),
    ("codex", '{"payload":{},"timestamp":""}', ""),
    ("codex", '{"payload":{},"timestamp":12}', ""),
    ("codex", '{"payload":5,"timestamp":"nope"}', "no_body"),
    ("other", '{"timestamp":"nope"}', "bad_time"),
    ("other", '{"payload":5}', ""),
]


@pytest.mark.parametrize(("source", "line", "reason"), CASES)
def test_rules(source, line, reason):
    rtype, cells, _ = cells_of(line, source)
    assert fail_reason(source, rtype, cells) == reason


def test_bad_rows_operator_agrees_with_the_rules(spark):
    from logloom.operators.bad_rows import clean_rows, find_bad_rows

    rows = [(i, s, line) for i, (s, line, _) in enumerate(CASES)] + [(100, "codex", " \t　"), (101, "codex", None), (102, None, '{"a":1}')]
    raw = spark.createDataFrame([(*r, "x") for r in rows], "record_id bigint, source string, line string, kind string")
    want = {i: r for i, (_, _, r) in enumerate(CASES) if r}
    assert {r.record_id: r.fail_reason for r in find_bad_rows(raw).collect()} == want
    clean = {r.record_id for r in clean_rows(raw).collect()}
    assert clean == ({r[0] for r in rows} - set(want) - {100, 101})
    assert find_bad_rows(raw.limit(0)).count() == 0


def test_record_type():
    assert record_type("codex", {"type": "response_item", "payload": {"type": "message"}}) == "response_item:message"
    assert record_type("codex", {"type": "response_item", "payload": {}}) == "response_item:"
    assert record_type("claude_code", {}) == ""


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_both_writers_agree(v):
    assert dump_deep(v) == json.dumps(v, ensure_ascii=False, separators=(",", ":"))
