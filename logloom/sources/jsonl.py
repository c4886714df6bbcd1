"""JSONL files: listing, differential plan and byte-exact lines.

The listing is driver-side, as it decides which paths are read at all; files
are read by the executors in ranges of bytes, so no file is one row and a file
may hold a third of all bytes. A line belongs to the range that it starts in.
Lines are numbered by the line feeds before them: counts per range, summed up
over a file's ranges. Of a file that grew only what is new is read, after its
stored offset and the line feeds counted up to it; of dialect B, and where no
count is stored, the prefix is read, too, as it may name the session, but its
lines never count again. A file that can't be read gives one row with the
error and keeps no other file from being read.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize

SOURCES = {"claude-code": "claude_code", "codex": "codex"}
LISTING_DDL = "source string, jsonl_path string, size bigint, file_ord bigint"


@dataclass
class Listing:
    files: list[tuple[str, str, int, int]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    failed: int = 0
    scanned: int = 0


def _names(folder: str, errors: list[str]) -> list[str]:
    try:
        return sorted(os.listdir(folder))
    except OSError as e:
        errors.append(f"{folder}: {e.strerror or e}")
        return []


def scan_two_levels(root: str, errors: list[str]) -> list[str]:
    """<root>/<folder>/*.jsonl: files of the first level and folders of the second don't count."""
    out = []
    for name in _names(root, errors):
        folder = os.path.join(root, name)
        if os.path.isdir(folder) and not os.path.islink(folder):
            out += [p for f in _names(folder, errors) if f.endswith(".jsonl") and not os.path.isdir(p := os.path.join(folder, f))]
    return out


def scan_any_level(root: str, errors: list[str]) -> list[str]:
    """*.jsonl below root at any depth, each folder's entries in name order."""
    out = []
    for name in _names(root, errors):
        p = os.path.join(root, name)
        if os.path.isdir(p) and not os.path.islink(p):
            out += scan_any_level(p, errors)
        elif name.endswith(".jsonl"):
            out.append(p)
    return out


SCANS = {"claude_code": scan_two_levels, "codex": scan_any_level}


def list_files(roots: dict[str, str]) -> Listing:
    """Files of the given sources ({source: root}) in import order. A missing root has none."""
    out = Listing()
    for source in ("claude_code", "codex"):
        root = roots.get(source)
        if not root or not os.path.exists(root):
            continue
        for path in SCANS[source](root, out.errors):
            out.scanned += 1
            try:
                size = os.stat(path).st_size
                with open(path, "rb"):
                    pass
            except OSError as e:
                out.failed += 1
                out.errors.append(f"{path}: {e.strerror or e}")
                continue
            out.files.append((source, path, size, len(out.files)))
    return out


def listing_table(spark: SparkSession, listing: Listing) -> DataFrame:
    return spark.createDataFrame(listing.files, LISTING_DDL)


def plan_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """files (jsonl_path, size and others) with ``action`` (new, skip, resume, reread) and ``start``, where reading starts: null for unchanged files."""
    stored = [c for c in ("file_size", "last_offset", "line_feeds") if c in state.columns]
    j = files.join(state.select("jsonl_path", *stored), "jsonl_path", "left")
    act = F.when(F.col("file_size").isNull(), "new").when(F.col("file_size") == F.col("size"), "skip").when(F.col("file_size") < F.col("size"), "resume").otherwise("reread")
    start = F.when(act == "resume", F.col("last_offset")).when(act != "skip", 0).cast("bigint")
    feeds = [F.when(act == "resume", F.col("line_feeds")).alias("line_feeds")] if "line_feeds" in stored else []
    return j.select(*files.columns, act.alias("action"), start.alias("start"), *feeds)


RANGE = 32 << 20  # bytes
BATCH = 4 << 20  # bytes of lines in an Arrow batch


def lines_from(f: BinaryIO, lo: int, hi: int, end: int, first: bool) -> Iterator[tuple[bytes, bool]]:
    """(line without its line feed, whether it had one) of the lines that start at lo to hi - 1, read up to end; first: a line starts at lo."""
    f.seek(lo if first else lo - 1)
    at = lo
    if not first:  # the rest of the line that holds the byte before lo
        at = lo - 1 + len(f.readline(end - lo + 1))
    while at < hi:
        line = f.readline(end - at)
        if not line:
            return
        at += len(line)
        yield (line[:-1], True) if line.endswith(b"\n") else (line, False)


def _open(path: str) -> BinaryIO:
    if "://" in path:
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        return io.BufferedReader(where.open_input_file(name))
    return open(path, "rb")


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["jsonl_path", "is_new", "lo", "i", "line", "ended", "error"]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names=names)
    for b in batches:
        for path, new, lo, hi, begin, end in zip(*(b[c].to_pylist() for c in ("jsonl_path", "is_new", "lo", "hi", "begin", "end"))):
            rows, size = [], 0
            try:
                with _open(path) as f:
                    for i, (line, ended) in enumerate(lines_from(f, lo, hi, end, lo == begin)):
                        rows.append((path, new, lo, i, line.decode("utf-8", "replace"), ended, None))
                        size += len(line)
                        if size >= BATCH:
                            yield make(rows)
                            rows, size = [], 0
            except OSError as e:
                rows.append((path, new, lo, -1, None, False, f"{path}: {e.strerror or e}"))
            yield make(rows)


def read_lines(todo: DataFrame) -> DataFrame:
    """(source, jsonl_path, file_ord, start, line_number, is_new, line, ended, error) of the files to read.

    todo: source, jsonl_path, size, file_ord, start and, where known, line_feeds before start. Malformed UTF-8 becomes
    U+FFFD. error rows have no line.
    """
    keep = todo.withColumn("_feeds", F.col("line_feeds") if "line_feeds" in todo.columns else F.lit(None).cast("bigint"))
    # What was read before is a part of its own: a line that ends with it ends there.
    prefix = (F.col("start") > 0) & ((F.col("source") == "codex") | F.col("_feeds").isNull())
    part = lambda new, lo, hi: F.struct(F.lit(new).alias("is_new"), lo.alias("begin"), hi.alias("end"))
    parts = F.filter(F.array(F.when(prefix, part(False, F.lit(0).cast("bigint"), F.col("start"))), part(True, F.col("start"), F.col("size"))), lambda x: x.isNotNull() & (x["begin"] < x["end"]))
    cut = keep.select("jsonl_path", F.explode(parts).alias("x")).select("jsonl_path", "x.*").withColumn("lo", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(RANGE).cast("bigint"))))
    ranges = cut.withColumn("hi", F.least(F.col("lo") + RANGE, "end")).repartition("jsonl_path", "lo")
    lines = materialize(ranges.mapInArrow(_read_ranges, "jsonl_path string, is_new boolean, lo bigint, i bigint, line string, ended boolean, error string"), "lines")
    feeds = lines.groupBy("jsonl_path", "is_new", "lo").agg(F.count_if("ended").alias("n"))
    before = feeds.select("jsonl_path", "is_new", "lo", F.coalesce(F.sum("n").over(Window.partitionBy("jsonl_path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    base = F.when(prefix, 0).otherwise(F.coalesce("_feeds", F.lit(0)))
    return (
        lines.join(before, ["jsonl_path", "is_new", "lo"]).join(keep, "jsonl_path")
        .select("source", "jsonl_path", "file_ord", "start", (F.col("i") + 1 + F.col("before") + base).cast("int").alias("line_number"), "is_new", "line", "ended", "error")
    )
