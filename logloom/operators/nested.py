"""Deeply nested records to flat tables that keep parent-child links.

Every JSON object of a record's body gets an interval label by one depth-first
walk: pre-order and post-order number. A node encloses another exactly if its
interval holds the other's, so links, ancestors and descendants are interval
comparisons within one record and need no keys from the data. The walk is
iterative, so depth is bounded by memory only; the link sweep is one pass over
the labels with a stack. Records are independent: no shuffle.

A node's fields hold all of its object that lies in no node below it: scalars by
their key, arrays without any object as JSON text by their key, and what is no
object in other arrays by key and indexes, as in node_path (``content[1]``).

Nulls and odd rows: a null or blank line, one that doesn't load, and one whose
body isn't an object have no nodes. Scalars, arrays and JSON inside strings
are no nodes. Equal paths in one record (keys with dots) count once, unless
every node is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..sources.strict_json import BODY, cells_of, dump, fail_reason

NODES_DDL = (
    "record_id bigint, source string, pre int, post int, depth int, node_path string, parent_path string, "
    "parent_pre int, node_type string, fields map<string,string>"
)
_NODES = pa.schema([
    ("record_id", pa.int64()), ("source", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()),
    ("node_path", pa.string()), ("parent_path", pa.string()), ("parent_pre", pa.int32()), ("node_type", pa.string()),
    ("fields", pa.map_(pa.string(), pa.string())),
])


def label(root: dict, name: str) -> list[list]:
    """[pre, post, path, object] of every object at or below root, in pre-order."""
    nodes: list[list] = []
    count = 0
    stack: list = [(name, root)]
    while stack:
        path, v = stack.pop()
        if path is None:  # all below this node are numbered
            v[1] = count
            count += 1
            continue
        if isinstance(v, dict):
            node = [count, -1, path, v]
            count += 1
            nodes.append(node)
            stack.append((None, node))
            for k in reversed(v):
                if isinstance(v[k], (dict, list)):
                    stack.append((f"{path}.{k}", v[k]))
        else:
            for i in range(len(v) - 1, -1, -1):
                if isinstance(v[i], (dict, list)):
                    stack.append((f"{path}[{i}]", v[i]))
    return nodes


def containment(nodes: list[list]) -> list[int]:
    """For each node in pre-order the index of the narrowest interval around its own, -1 for none."""
    parents: list[int] = []
    open_: list[int] = []
    for i, (pre, post, *_) in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] < post:
            open_.pop()
        parents.append(open_[-1] if open_ else -1)
        open_.append(i)
    return parents


def holds_object(items: list) -> bool:
    stack = [items]
    while stack:
        for x in stack.pop():
            if isinstance(x, dict):
                return True
            if isinstance(x, list):
                stack.append(x)
    return False


def fields_of(obj: dict) -> list[tuple[str, str | None]]:
    """(field, value as text) of all in the object that is in no object below it."""
    out: list[tuple[str, str | None]] = []
    for key, value in obj.items():
        if not isinstance(value, list) or not holds_object(value):
            if not isinstance(value, dict):
                out.append((key, dump(value)))
            continue
        stack: list = [(key, value)]
        while stack:
            at, v = stack.pop()
            if isinstance(v, list) and v:
                stack += [(f"{at}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1) if not isinstance(v[i], dict)]
            else:
                out.append((at, dump(v)))
    return out


def _label_batches(with_fields: bool, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, source, line in zip(batch["record_id"].to_pylist(), batch["source"].to_pylist(), batch["line"].to_pylist()):
                rtype, cells, rec = cells_of(line, source)
                name = BODY.get(source)
                if rec is None or not name or not isinstance(rec.get(name), dict) or fail_reason(source, rtype, cells):
                    continue
                nodes = label(rec[name], name)
                parents = containment(nodes)
                depth: list[int] = []
                seen: set[str] = set()
                for (pre, post, path, obj), p in zip(nodes, parents):
                    depth.append(depth[p] + 1 if p >= 0 else 0)
                    if path in seen and not every:
                        continue
                    seen.add(path)
                    t = obj.get("type")
                    fields = fields_of(obj) if with_fields else []
                    out.append((rid, source, pre, post, depth[-1], path, nodes[p][2] if p >= 0 else "", nodes[p][0] if p >= 0 else None, t if isinstance(t, str) else "", fields))
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out) if out else [[]] * len(_NODES), _NODES)], schema=_NODES)

    return run


def node_table(raw: DataFrame, with_fields: bool = True, every: bool = False) -> DataFrame:
    """One row per object (or per path, unless every): interval label, path, link to the enclosing object, own type and fields."""
    lines = raw.where(~is_blank(F.col("line"))).select("record_id", F.coalesce("source", F.lit("")).alias("source"), "line")
    return lines.mapInArrow(_label_batches(with_fields, every), NODES_DDL)


def node_tables(raw: DataFrame, folder: str) -> DataFrame:
    """One flat table per node type below folder (``node_type=...``), all written in one pass, linked by (record_id, parent_pre)."""
    node_table(raw, every=True).write.mode("error").partitionBy("node_type").parquet(folder)
    return raw.sparkSession.read.schema(NODES_DDL).parquet(folder)


def enclosed(nodes: DataFrame, outer: Column) -> DataFrame:
    """(record_id, pre, node_path, node_type, outer_pre, outer_path, outer_type): every node inside of an outer one's interval.

    Pairs are made within a record, and only with its outer nodes.
    """
    o = nodes.where(outer).select("record_id", F.col("pre").alias("outer_pre"), F.col("post").alias("_post"), F.col("node_path").alias("outer_path"), F.col("node_type").alias("outer_type"))
    i = nodes.select("record_id", "pre", "post", "node_path", "node_type")
    return i.join(o, "record_id").where("pre > outer_pre and post < _post").drop("post", "_post")


def find_nodes(raw: DataFrame) -> DataFrame:
    """Rows of p4_found: record_id, node_path, parent_path, node_type."""
    return node_table(raw, with_fields=False).select("record_id", "node_path", "parent_path", "node_type")
