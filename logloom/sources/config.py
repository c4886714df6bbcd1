"""The optional JSON config: project aliases, command patterns, day boundary."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import basename
from ..functions.timeref import UsageError, parse_day_boundary

#: Constructs of Java's regex that a linear-time dialect lacks: refused, so that patterns mean the same everywhere.
_REFUSED = re.compile(r"\(\?<?[=!]|\(\?>|\\[1-9]|[*+?}]\+")


@dataclass
class Config:
    aliases: dict[str, list[str]] = field(default_factory=dict)
    patterns: tuple[str, ...] = ()
    day_boundary: str = ""

    def expand_project(self, project: str) -> list[str]:
        """All names of the group that has exactly this name, else the name itself; nothing for ''."""
        if not project:
            return []
        for canonical in sorted(self.aliases):
            if project == canonical or project in self.aliases[canonical]:
                return [canonical, *self.aliases[canonical]]
        return [project]

    def canonical(self, repo: Column) -> Column:
        """The group's canonical name if the path or its base name is one of the group's, else null."""
        base = basename(repo)
        out = None
        for canonical in sorted(self.aliases):
            names = [canonical, *self.aliases[canonical]]
            hit = repo.isin(names) | base.isin(names)
            out = F.when(hit, canonical) if out is None else out.when(hit, canonical)
        return out if out is not None else F.lit(None).cast("string")

    def display(self, repo: Column, short: bool = False) -> Column:
        """What listings print for a repo_path."""
        return F.coalesce(self.canonical(repo), basename(repo) if short else repo)


def check_pattern(p: str) -> str:
    try:
        re.compile(p)
    except re.error as e:
        raise UsageError(f"the command pattern {p!r} can't be read: {e}") from e
    if _REFUSED.search(p):
        raise UsageError(f"the command pattern {p!r} needs more than a linear-time regex")
    return p


def load_config(path: str) -> Config:
    """A missing file is an empty config; broken JSON, patterns or boundaries are errors."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = f.read()
    except FileNotFoundError:
        return Config()
    except OSError as e:
        raise UsageError(f"the config can't be read: {e}") from e
    try:
        d = json.loads(raw)
        if not isinstance(d, dict):
            raise UsageError("not an object")
        aliases = d.get("projectAliases") or {}
        patterns = d.get("commandPatterns") or []
        boundary = d.get("dayBoundary") or ""
        if not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in aliases.values()) or not all(isinstance(p, str) for p in patterns) or not isinstance(boundary, str):
            raise UsageError("a value has the wrong type")
        parse_day_boundary(boundary)
        return Config(aliases, tuple(check_pattern(p) for p in patterns), boundary)
    except (json.JSONDecodeError, AttributeError, UsageError) as e:
        raise UsageError(f"the config {path} is wrong: {e}") from e
