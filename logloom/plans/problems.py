"""The queries pN_ of the core's data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bad_rows, drift, hierarchy, intervals, nested, orphans
from ..sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(table(spark, d, "messages"), table(spark, d, "sessions"), table(spark, d, "deleted_sessions"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rates(_orphans(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.find_changes(table(spark, d, "raw_records"), table(spark, d, "expected_fields"))


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    return drift.find_matches(table(spark, d, "raw_records"), table(spark, d, "expected_fields"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    u = drift.unify(table(spark, d, "raw_records"), table(spark, d, "expected_fields"))
    return u.select("record_id", "source", "jsonl_path", "line_number", "record_type", *map(_sorted_json, ("fields", "other", "retyped")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.find_hierarchy(table(spark, d, "messages"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    p = hierarchy.find_paths(table(spark, d, "messages"))
    return p.select("uuid", "root_uuid", "node_depth", F.array_join("path", "/").alias("path"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_pairs(table(spark, d, "messages"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.find_nodes(table(spark, d, "raw_records"))


def _sorted_json(c: str) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c)


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = nested.node_table(table(spark, d, "raw_records"), every=True)
    return n.select("record_id", "source", "pre", "post", "depth", "node_path", "parent_pre", "node_type", _sorted_json("fields"))


def p4_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The tables that node_tables writes: each type's fields, and in how many nodes each is."""
    n = nested.node_table(table(spark, d, "raw_records"), every=True)
    return n.select("node_type", F.explode(F.map_keys("fields")).alias("field")).groupBy("node_type", "field").agg(F.count("*").alias("n_nodes"))


def p4_enclosed(spark: SparkSession, d: str) -> DataFrame:
    """Everything inside of tool calls and results, by interval containment."""
    n = nested.node_table(table(spark, d, "raw_records"), with_fields=False, every=True)
    return nested.enclosed(n, F.col("node_type").isin("tool_use", "tool_result", "function_call"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.find_spans(table(spark, d, "sessions"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.find_bad_rows(table(spark, d, "raw_records"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.clean_rows(table(spark, d, "raw_records"))


QUERIES = {
    "p1_found": _orphans,
    "p1_rates": p1_rates,
    "p2_found": p2_found,
    "p2_matches": p2_matches,
    "p2_unified": p2_unified,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_pairs": p3_pairs,
    "p3_descendants": p3_descendants,
    "p4_found": p4_found,
    "p4_nodes": p4_nodes,
    "p4_by_type": p4_by_type,
    "p4_enclosed": p4_enclosed,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
}
