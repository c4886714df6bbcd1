"""Rows that fail to parse, apart from those that load.

Each line is parsed once into cells (record_id, column, kind, value); the rule
table is joined to the cells by column, a broken rule is an error, the errors
of a record are aggregated to the first by rule order, and the clean rows are
the anti-join of all records with the errors. Only broken cells are shuffled.

Nulls: a null line is no record, like one of white space only. A null source
matches no dialect, so only the rules for any source hold. Cells of a record
come from its own line, so repeated lines are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..runtime import materialize
from ..sources.strict_json import RULES, RULES_SCHEMA, cells_of
from ..sources.tables import small

_CELLS = pa.schema([("record_id", pa.int64()), ("source", pa.string()), ("record_type", pa.string()), ("cell", pa.string()), ("kind", pa.string()), ("value", pa.string())])


def _explode_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for rid, source, line in zip(batch["record_id"].to_pylist(), batch["source"].to_pylist(), batch["line"].to_pylist()):
            rtype, cells, _ = cells_of(line, source)
            out += [(rid, source, rtype, *c) for c in cells]
        yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out) if out else [[]] * 6, _CELLS)], schema=_CELLS)


def parse_cells(raw: DataFrame) -> DataFrame:
    """(record_id, source, record_type, cell, kind, value): one row per cell that a rule may look at."""
    lines = raw.where(~is_blank(F.col("line"))).select("record_id", F.coalesce("source", F.lit("")).alias("source"), "line")
    return lines.mapInArrow(_explode_cells, "record_id bigint, source string, record_type string, cell string, kind string, value string")


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame(RULES, RULES_SCHEMA)


def find_bad_rows(raw: DataFrame) -> DataFrame:
    """Rows of p7_found: record_id, fail_reason (the first broken rule's)."""
    rules = F.broadcast(rule_table(raw.sparkSession))  # six rows, fixed
    errors = (
        parse_cells(raw)
        .join(rules, "cell")
        .where("(rule_source = '' or rule_source = source) and (record_types = '' or find_in_set(record_type, record_types) > 0)")
        .where("find_in_set(kind, bad_kinds) > 0")
    )
    return errors.groupBy("record_id").agg(F.min_by("reason", "rule").alias("fail_reason"))


def clean_rows(raw: DataFrame) -> DataFrame:
    """The records that load: not blank and in no error. Few errors, by their number, are sent to the records; else the records are shuffled."""
    bad = materialize(find_bad_rows(raw).select("record_id"), "bad-rows")
    return raw.where(~is_blank(F.col("line"))).join(small(bad), "record_id", "left_anti")
