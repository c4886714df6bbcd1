"""Time flags, day boundaries and durations: resolved on the driver before any plan is built."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import rfc3339_micros

UTC = dt.timezone.utc
_UNITS = {"m": 60, "h": 3600, "d": 86400}


class UsageError(ValueError):
    """A flag or config value that can't be used."""


def parse_duration(s: str) -> dt.timedelta:
    """30m, 24h, 7d; not negative."""
    if len(s) < 2 or not re.fullmatch(r"[+-]?[0-9]+", s[:-1]):
        raise UsageError(f"{s!r} is no duration")
    if int(s[:-1]) < 0:
        raise UsageError(f"the duration {s!r} is negative")
    if s[-1] not in _UNITS:
        raise UsageError(f"{s!r} ends in none of the units m, h and d")
    return dt.timedelta(seconds=int(s[:-1]) * _UNITS[s[-1]])


def parse_time_ref(s: str, now: dt.datetime, tz: dt.tzinfo) -> tuple[dt.datetime, bool]:
    """(time in tz or now's zone, whether only a date was given)."""
    if "-" not in s:
        return now - parse_duration(s), False
    for shape, layout, date_only in ((r"\d{4}-\d\d-\d\dT\d\d:\d\d", "%Y-%m-%dT%H:%M", False), (r"\d{4}-\d\d-\d\d", "%Y-%m-%d", True)):
        if re.fullmatch(shape, s, re.ASCII):
            try:
                return dt.datetime.strptime(s, layout).replace(tzinfo=tz), date_only
            except ValueError:
                break
    raise UsageError(f"{s!r} is neither a date nor a date and time")


def parse_day_boundary(s: str) -> dt.timedelta:
    """HH:MM after midnight at which a logical day starts; '' is midnight."""
    if not s:
        return dt.timedelta()
    if not re.fullmatch(r"([01][0-9]|2[0-3]):[0-5][0-9]", s, re.ASCII):
        raise UsageError(f"the day boundary {s!r} is no time of day like 04:00")
    return dt.timedelta(hours=int(s[:2]), minutes=int(s[3:]))


def resolve_bound(s: str, now: dt.datetime, is_until: bool, tz: dt.tzinfo, boundary: dt.timedelta = dt.timedelta()) -> str:
    """A flag's bound as the millisecond string that stored times are compared with.

    A date gets the boundary as elapsed time and, for until, one more calendar
    day of wall time, in this order.
    """
    t, date_only = parse_time_ref(s, now, tz)
    if date_only:
        t = (t.astimezone(UTC) + boundary).astimezone(tz)
        if is_until:
            t = (t.replace(tzinfo=None) + dt.timedelta(days=1)).replace(tzinfo=tz)
    u = t.astimezone(UTC)
    return u.strftime("%Y-%m-%dT%H:%M:%S.") + f"{u.microsecond // 1000:03d}Z"


def zone(name: str | None = None) -> dt.tzinfo:
    return ZoneInfo(name) if name else dt.datetime.now().astimezone().tzinfo or UTC


def local_ts(c: Column, tz: str) -> Column:
    """Wall-clock timestamp of a readable time in tz, else null."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.timestamp_micros(rfc3339_micros(c)).cast("timestamp_ntz"))


def local_time(c: Column, tz: str) -> Column:
    """yyyy-MM-dd HH:mm in tz; an unreadable time stays as it is."""
    return F.coalesce(F.date_format(local_ts(c, tz), "yyyy-MM-dd HH:mm"), c)


def time_range(start: Column, end: Column, tz: str) -> Column:
    return F.when(end == "", F.concat(local_time(start, tz), F.lit(" ~"))).otherwise(F.concat(local_time(start, tz), F.lit(" ~ "), local_time(end, tz)))


def logical_day(start: Column, end: Column, tz: str, boundary: dt.timedelta = dt.timedelta()) -> Column:
    """The local day of the end, else the start, with days starting at the boundary; '' if unreadable."""
    value = F.when(end != "", end).otherwise(start)
    micros = rfc3339_micros(value) - F.lit(int(boundary.total_seconds()) * 1_000_000)
    # The boundary is elapsed time, so it is subtracted before the zone applies.
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.timestamp_micros(micros).cast("timestamp_ntz"))
    return F.coalesce(F.date_format(local, "yyyy-MM-dd"), F.lit(""))
