"""Rows of a report to TSV, JSON and Markdown on the driver, row by row."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any, TextIO

_TSV = str.maketrans("\t\n\r", "   ")


def cell(s: Any) -> str:
    return str(s).translate(_TSV)


def write_json(out: TextIO, rows: Iterable[dict[str, Any]]) -> None:
    """Always an array, indented by two; a value that is an iterator is written as an array, item by item."""
    wrote = False
    for row in rows:
        out.write(",\n  " if wrote else "[\n  ")
        wrote = True
        stream = next((k for k, v in row.items() if isinstance(v, Iterator)), None)
        if stream is None:
            out.write(_indented(row, 2))
            continue
        head, tail = _indented(row | {stream: []}, 2).rsplit("[]", 1)
        out.write(head)
        some = False
        for item in row[stream]:
            out.write((",\n      " if some else "[\n      ") + _indented(item, 6))
            some = True
        out.write(("\n    ]" if some else "[]") + tail)
    out.write("\n]\n" if wrote else "[]\n")


def _indented(v: Any, by: int) -> str:
    return json.dumps(v, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * by)


def write_session(out: TextIO, s: dict[str, Any], project: str, started: str, messages: Iterable[dict[str, Any]]) -> None:
    title = (s["custom_title"] or s["session_id"]).replace("\n", " ").replace("\r", " ")
    out.write(f"## {title}\n\n- **Session**: `{s['session_id']}`\n- **Project**: `{project}`\n- **Started**: `{started}`\n")
    for m in messages:
        role = m["role"]
        out.write(f"\n### {role[:1].upper() + role[1:]}\n\n{m['content']}\n")
