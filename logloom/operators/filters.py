"""Filters of the session and message listings."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_like
from ..functions.timeref import UsageError, resolve_bound
from ..sources.config import Config


@dataclass
class SessionFilter:
    """since is inclusive, until exclusive; both compare as strings with stored times. projects are alternatives."""

    since: str = ""
    until: str = ""
    projects: list[str] = field(default_factory=list)

    def time(self, c: str) -> Column:
        out = F.lit(True)
        if self.since:
            out = out & (F.col(c) >= self.since)
        if self.until:
            out = out & (F.col(c) < self.until)
        return out

    def project(self, c: str = "repo_path") -> Column:
        out = None
        for p in self.projects:
            hit = contains_like(F.coalesce(F.col(c), F.lit("")), p)
            out = hit if out is None else out | hit
        return out if out is not None else F.lit(True)

    def sessions(self) -> Column:
        return self.time("started_at") & self.project()


def build_filter(since: str, until: str, project: str, config: Config, tz: dt.tzinfo, boundary: dt.timedelta = dt.timedelta(), now: dt.datetime | None = None) -> SessionFilter:
    """Flags to a filter; now is taken once."""
    now = now or dt.datetime.now(dt.timezone.utc)
    lo = resolve_bound(since, now, False, tz, boundary) if since else ""
    hi = resolve_bound(until, now, True, tz, boundary) if until else ""
    if lo and hi and lo >= hi:
        raise UsageError("--since has to come before --until")
    return SessionFilter(lo, hi, config.expand_project(project))
