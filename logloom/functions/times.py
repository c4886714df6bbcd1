"""Times written as strings: full RFC 3339 date-times, compared as instants."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A full date-time with seconds and zone; Java's and Python's regex read it alike.
RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
_PY = re.compile(RFC3339.replace(r"\z", r"\Z"), re.ASCII)


def rfc3339_micros(c: Column) -> Column:
    """Epoch microseconds of a readable time string, else null.

    The calendar check is Spark's own string-to-timestamp cast of the local part
    (30 February, month 13, hour 24 and second 60 give null); the offset is
    subtracted by hand, so that all offsets up to 23:59 count. Digits beyond
    microseconds are cut.
    """
    ok = c.rlike(RFC3339)
    z = F.upper(F.right(c, F.lit(1))) == "Z"
    body = F.upper(F.when(z, c.substr(F.lit(1), F.length(c) - 1)).otherwise(c.substr(F.lit(1), F.length(c) - 6)))
    local = F.unix_micros(F.concat(body, F.lit("Z")).try_cast("timestamp"))
    hh = F.substring(F.right(c, F.lit(5)), 1, 2).try_cast("bigint")
    mm = F.right(c, F.lit(2)).try_cast("bigint")
    sign = F.when(F.substring(F.right(c, F.lit(6)), 1, 1) == "-", -1).otherwise(1)
    off = F.when(z, F.lit(0)).otherwise(sign * (hh * 60 + mm))
    return F.when(ok, local - off * F.lit(60_000_000))


def readable_py(s: str) -> bool:
    """rfc3339_micros is not null, for Python strings."""
    if not _PY.match(s):
        return False
    try:
        dt.datetime(int(s[0:4]), int(s[5:7]), int(s[8:10]), int(s[11:13]), int(s[14:16]), int(s[17:19]))
    except ValueError:
        return s.startswith("0000") and readable_py("0004" + s[4:])  # Python has no year 0, which leaps
    return True
