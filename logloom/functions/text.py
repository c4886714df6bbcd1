"""String functions as Catalyst expressions (all of them stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with Unicode's White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: How the rows begin that a cleared or local command leaves behind.
CLEAR_PREFIXES = ("<command-name>/clear</command-name>", "<local-command-caveat>")
SNIPPET_CONTEXT = 40


def utrim(c: Column) -> Column:
    """Trim Unicode white space (Spark's trim strips U+0020 only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only strings."""
    return F.coalesce(utrim(c) == "", F.lit(True))


def norm_id(c: Column) -> Column:
    """Session ids and uuids compare without case and surrounding space; null stays null."""
    return F.lower(utrim(c))


def norm_source(c: Column) -> Column:
    return F.lower(utrim(c))


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only: the fold of a LIKE that ignores ASCII case."""
    return F.translate(c, UPPER, LOWER)


def ascii_like(c: Column, pattern: str) -> Column:
    """LIKE that ignores ASCII case, with live % and _ and no escape character.

    The pattern becomes an anchored regex only when it holds an inner wildcard;
    plain ``%text%``, ``text%`` and ``text`` use contains / startswith / equality.
    """
    p = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in pattern)
    folded = ascii_fold(c)
    core = p.strip("%")
    if "%" not in core and "_" not in core:
        head, tail = p.startswith("%"), p.endswith("%")
        if p and not core:
            return c.isNotNull() & F.lit(True)
        if head and tail:
            return F.contains(folded, F.lit(core))
        if tail:
            return F.startswith(folded, F.lit(core))
        if head:
            return F.endswith(folded, F.lit(core))
        return folded == core
    return folded.like(p.replace("\\", "\\\\"))


def contains_like(c: Column, text: str) -> Column:
    """c LIKE '%' || text || '%' with the rules of ``ascii_like``."""
    return ascii_like(c, f"%{text}%")


def first_line(c: Column) -> Column:
    """The first line of the trimmed text, without carriage returns at its end."""
    return F.regexp_replace(F.substring_index(utrim(c), "\n", 1), r"\r+\z", "")


def tsv_sanitize(c: Column) -> Column:
    return F.translate(c, "\t\n\r", "   ")


def title_sanitize(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def basename(c: Column) -> Column:
    """Last path segment: '/' for only slashes, '' stays ''."""
    bare = F.regexp_replace(c, r"/+\z", "")
    return F.when(c == "", "").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def worktree_root(c: Column) -> Column:
    """The path before the first worktree folder."""
    return F.substring_index(c, "/.claude/worktrees/", 1)


def derived_uuid(path: Column, line: Column) -> Column:
    """Deterministic id of a dialect-B message: path, a zero byte, the line number."""
    return F.concat(F.lit("codex:"), F.sha2(F.concat(path, F.lit("\x00"), line.cast("string")), 256))


def role_heading(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def is_command(c: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Trimmed text starts with '/' or matches a configured pattern anywhere."""
    t = utrim(c)
    out = t.startswith("/")
    for p in patterns:
        out = out | t.rlike(p)
    return out


def not_synthetic(c: Column) -> Column:
    """Not one of the rows that a cleared or local command leaves behind."""
    out = F.lit(True)
    for p in CLEAR_PREFIXES:
        out = out & ~ascii_like(c, p + "%")
    return out


def _chars_before(c: Column, byte: Column) -> Column:
    """Characters of c that end at or before the one that holds the byte at this place, counted from 0."""
    return F.char_length(F.substring(c.cast("binary"), F.lit(1), byte.cast("int") + 1).cast("string")) - 1


def snippet(c: Column, query: str) -> Column:
    """The first hit with 40 characters on each side, trimmed, with dots where cut.

    The place is the exact hit, else the first hit ignoring case, else the start. It is a place in bytes: where
    lowering changes the width of a character, the place in the lowered text is taken as one in the text.
    """
    size, width = F.octet_length(c), len(query.encode())
    exact = F.instr(c, query) if query else F.lit(1)
    low = F.lower(c)
    folded = F.instr(low, query.lower()) if query else F.lit(1)
    before = lambda t, at: F.octet_length(F.substr(t, F.lit(1), at - 1))
    byte = F.when(exact > 0, before(c, exact)).when((folded > 0) & (before(low, folded) < size), before(low, folded)).otherwise(0)
    at = _chars_before(c, byte)
    stop = F.octet_length(F.substr(c, F.lit(1), at)) + width
    end = F.when(stop < size, _chars_before(c, stop)).otherwise(F.char_length(c))
    lo, hi = F.greatest(at - SNIPPET_CONTEXT, F.lit(0)), F.least(end + SNIPPET_CONTEXT, F.char_length(c))
    body = utrim(F.substr(c, lo + 1, hi - lo))
    return F.concat(F.when(lo > 0, "...").otherwise(""), body, F.when(hi < F.char_length(c), "...").otherwise(""))


def sql_trim_class() -> str:
    """WHITE_SPACE as an SQL expression for DuckDB oracles."""
    return " || ".join(f"chr({ord(ch)})" for ch in WHITE_SPACE)


def strip_py(s: str) -> str:
    """utrim for Python strings."""
    return s.strip(WHITE_SPACE)

