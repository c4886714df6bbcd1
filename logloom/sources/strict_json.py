"""Strict JSON (RFC 8259) for log lines, and the rules by which a line loads.

``parse`` is the standard library's parser with its leniencies closed (NaN and
Infinity are refused, integers of any length pass) and a stack-based parser
behind it for lines nested deeper than the C stack allows.

``RULES`` is the one definition of what keeps a line from loading. The bad-rows
operator joins it as a table; the operators that only need to know whether a
line loads evaluate the same rows with ``fail_reason``.
"""

from __future__ import annotations

import json
import re
from typing import Any

from ..functions.text import WHITE_SPACE
from ..functions.times import readable_py


class _Refused(ValueError):
    pass


def _refuse(_: str) -> None:
    raise _Refused


def _int(s: str) -> float:
    return int(s) if len(s) < 4000 else float(s)  # int() refuses more digits


_DECODER = json.JSONDecoder(parse_int=_int, parse_constant=_refuse)
_TOKEN = re.compile(
    r'[ \t\n\r]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<l>true|false|null)|(?P<p>[\[\]{}:,]))"
)
_LITERALS = {"true": True, "false": False, "null": None}


_HALF_PAIR = re.compile(r"\\u[dD][89a-fA-F]")


def parse(text: str) -> Any:
    """The one JSON value in text; ValueError if it isn't exactly one. Half surrogate pairs become U+FFFD."""
    try:
        out = _DECODER.decode(text)
    except RecursionError:
        out = parse_deep(text)
    return _whole_characters(out) if _HALF_PAIR.search(text) else out


def _whole_characters(root: Any) -> Any:
    fix = lambda s: s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    holder = [root]
    stack: list = [holder]
    while stack:
        c = stack.pop()
        for k, v in list(enumerate(c) if isinstance(c, list) else c.items()):
            if isinstance(v, str):
                v = fix(v)
            elif isinstance(v, (dict, list)):
                stack.append(v)
            if isinstance(c, dict) and (k2 := fix(k)) != k:
                del c[k]
                k = k2
            c[k] = v
    return holder[0]


def parse_deep(text: str) -> Any:
    """parse() without recursion: values are hung on a stack of open containers."""
    holder: list = []
    stack: list[tuple[Any, str]] = []  # container, what may come next
    current, want, key = holder, "value", None
    pos, end = 0, len(text.rstrip(" \t\n\r"))

    def put(value: Any) -> None:
        if isinstance(current, dict):
            current[key] = value
        else:
            current.append(value)

    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"no token at {pos}")
        pos, kind = m.end(), m.lastgroup
        tok = m.group(kind)
        if kind == "p" and tok in "]}":
            if not stack or (tok == "]") != isinstance(current, list) or want not in ("comma", "first"):
                raise ValueError(f"'{tok}' at {pos}")
            current = stack.pop()[0]
            want = "comma" if current is not holder else "end"
        elif want == "comma":
            if tok != "," or kind != "p":
                raise ValueError(f"no comma at {pos}")
            want = "key" if isinstance(current, dict) else "value"
        elif want == "colon":
            if tok != ":" or kind != "p":
                raise ValueError(f"no colon at {pos}")
            want = "value"
        elif want == "end":
            raise ValueError(f"more than one value at {pos}")
        elif isinstance(current, dict) and want in ("key", "first"):
            if kind != "s":
                raise ValueError(f"no key at {pos}")
            key, want = json.loads(tok), "colon"
        elif kind == "p":
            if tok not in "[{":
                raise ValueError(f"'{tok}' at {pos}")
            new: Any = [] if tok == "[" else {}
            put(new)
            stack.append((current, want))
            current, want = new, "first"
        else:
            put(json.loads(tok) if kind == "s" else (float(tok) if re.search("[.eE]", tok) else _int(tok)) if kind == "n" else _LITERALS[tok])
            want = "end" if current is holder else "comma"
    if stack or len(holder) != 1:
        raise ValueError("unfinished")
    return holder[0]


def kind_of(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return "string"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    return "number"


def dump(v: Any) -> str | None:
    """A cell's value as text: strings as they are, the rest as JSON; null as None."""
    if v is None or isinstance(v, str):
        return v
    try:
        return json.dumps(v, ensure_ascii=False, default=str, separators=(",", ":"))
    except RecursionError:
        return dump_deep(v)


def dump_deep(root: Any) -> str:
    """dump() of objects and arrays without recursion, as parse_deep() reads them."""
    plain = lambda x: json.dumps(x, ensure_ascii=False, default=str)
    out: list[str] = []
    stack: list[tuple[bool, Any]] = [(False, root)]  # whether it is text already, text or value
    while stack:
        done, v = stack.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict) and v:
            stack.append((True, "}"))
            for i, (k, x) in reversed(list(enumerate(v.items()))):
                stack += [(False, x), (True, ("," if i else "{") + plain(k) + ":")]
        elif isinstance(v, list) and v:
            stack.append((True, "]"))
            for i in range(len(v) - 1, -1, -1):
                stack += [(False, v[i]), (True, "," if i else "[")]
        else:
            out.append(plain(v))
    return "".join(out)


BODY = {"claude_code": "message", "codex": "payload"}
#: The reasons in the order of their check: rule number, reason, source ('' any), the record types it is
#: for ('' any), the cell it looks at, and the kinds of value that break it.
RULES = [
    (1, "not_json", "", "", "$", "invalid,null,string,boolean,number,array"),
    (2, "no_body", "claude_code", "user,assistant", "message", "absent,null,string,boolean,number,array"),
    (3, "no_body", "codex", "", "payload", "absent,null,string,boolean,number,array"),
    (4, "bad_content", "claude_code", "user,assistant", "message.content", "boolean,number,mixed_array"),
    (5, "bad_content", "codex", "", "payload.content", "boolean,number,mixed_array"),
    (6, "bad_time", "", "", "timestamp", "unreadable"),
]
RULES_SCHEMA = "rule int, reason string, rule_source string, record_types string, cell string, bad_kinds string"


def cells_of(line: str, source: str) -> tuple[str, list[tuple[str, str, str | None]], Any]:
    """(type, cells, record): what the rules look at, as (column, kind, value) rows."""
    body = line.strip(WHITE_SPACE)
    try:
        rec = parse(body)
        k = kind_of(rec)
    except ValueError:
        return "", [("$", "invalid", None)], None
    cells: list[tuple[str, str, str | None]] = [("$", k, None)]
    if k != "object":
        return "", cells, None
    rtype = rec.get("type")
    name = BODY.get(source, "")
    if name:
        inner = rec.get(name)
        cells.append((name, kind_of(inner) if name in rec else "absent", None))
        if isinstance(inner, dict) and "content" in inner:
            content = inner["content"]
            kind = kind_of(content)
            if kind == "array" and not all(isinstance(x, dict) for x in content):
                kind = "mixed_array"
            cells.append((f"{name}.content", kind, None))
    if "timestamp" in rec:
        ts = rec["timestamp"]
        if isinstance(ts, str):
            cells.append(("timestamp", "string" if ts == "" or readable_py(ts) else "unreadable", ts))
        else:
            cells.append(("timestamp", kind_of(ts), None))
    return rtype if isinstance(rtype, str) else "", cells, rec


def fail_reason(source: str, rtype: str, cells: list[tuple[str, str, str | None]]) -> str:
    """The reason of the first rule that a cell breaks, '' if the line loads."""
    for _, reason, rsource, rtypes, cell, bad in RULES:
        if (rsource and rsource != source) or (rtypes and rtype not in rtypes.split(",")):
            continue
        for column, kind, _ in cells:
            if column == cell and kind in bad.split(","):
                return reason
    return ""


def record_type(source: str, rec: dict) -> str:
    t = rec.get("type")
    t = t if isinstance(t, str) else "" if t is None else dump(t) or ""
    if source == "codex" and t == "response_item":
        p = rec.get("payload")
        sub = p.get("type") if isinstance(p, dict) else None
        return f"{t}:{sub if isinstance(sub, str) else '' if sub is None else dump(sub) or ''}"
    return t


def is_blank_line(line: str | None) -> bool:
    return line is None or not line.strip(WHITE_SPACE)
