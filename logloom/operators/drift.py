"""Schemas that drift between files: changes per file, and one consistent table.

1. Every record that loads is profiled where it is parsed: per object that the
   expected schema knows, each field's presence, JSON types and a sketch of its
   whole values (lengths, digits, smallest hashes of the distinct values; of an
   object its keys count as value, of an array its length). They are added up
   within the Arrow batch, then per file and record type by a hash aggregate.
   Profiles are as wide as the schema, not as the data.
2. Per object of a file the missing required fields and the unlisted ones are
   the two sides of a bipartite graph; an edge joins two if the unlisted field
   is in all objects with only listed types of the missing one. Its weight is
   the likeness of names, types and values (of the missing field: in all other
   files). ``assign`` solves the matching: as many pairs as possible, of these
   the heaviest.
3. A pair of the matching is a rename only where it is forced: one field is
   missing and one can take its place. Other pairs stay ``removed`` and
   ``added``; ``find_matches`` gives them with their weights.
4. ``unify`` reads all lines into one table under the listed names, renamed
   fields included.

The expected fields are a fixed, small table; its size is checked before it is
sent to the parser.

Nulls: a key with the value null is present and of any type. A null jsonl_path
is the file ''. Blank lines and lines that don't load don't count. Records of
a type that isn't listed give one ``added`` row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..runtime import materialize
from ..sources.strict_json import cells_of, dump, fail_reason, kind_of, record_type

MAX_EXPECTED = 100_000
REGISTERS = 16  # of the distinct values' hashes the smallest per register
KINDS = ["string", "number", "boolean", "object", "array", "null"]
_PROFILE = pa.schema([
    ("source", pa.string()), ("jsonl_path", pa.string()), ("record_type", pa.string()), ("object_path", pa.string()), ("field", pa.string()),
    ("present", pa.int64()), ("kinds", pa.int32()), ("digits", pa.int64()), ("chars", pa.int64()), ("texts", pa.int64()), ("mins", pa.list_(pa.int64())),
])
PROFILE_DDL = "source string, jsonl_path string, record_type string, object_path string, field string, present bigint, kinds int, digits bigint, chars bigint, texts bigint, mins array<bigint>"


def expected_schema(expected: DataFrame) -> dict:
    """{(source, record_type): {object path: {field: (types, required)}}} of the fixed table."""
    rows = expected.select("source", "record_type", "field_path", "json_types", "is_required").limit(MAX_EXPECTED + 1).collect()
    if len(rows) > MAX_EXPECTED:
        raise ValueError(f"expected_fields has more than {MAX_EXPECTED} rows")
    out: dict = defaultdict(lambda: defaultdict(dict))
    for r in rows:
        obj, _, field = (r.field_path or "").rpartition(".")
        out[(r.source, r.record_type)][obj][field] = (tuple((r.json_types or "").split("|")), bool(r.is_required))
    return {k: dict(v) for k, v in out.items()}


def places_at(rec: dict, path: str) -> list[tuple[str, dict]]:
    """(place, object) of the objects at a field path; a place is the path with each array's own index.

    '' is the record; x[] enters arrays of objects only.
    """
    level = [("", rec)]
    for step in path.split(".") if path else []:
        name, many = (step[:-2], True) if step.endswith("[]") else (step, False)
        nxt = []
        for at, o in level:
            v = o.get(name)
            here = f"{at}.{name}" if at else name
            if many:
                if isinstance(v, list) and all(isinstance(x, dict) for x in v):
                    nxt += [(f"{here}[{i}]", x) for i, x in enumerate(v)]
            elif isinstance(v, dict):
                nxt.append((here, v))
        level = nxt
    return level


def objects_at(rec: dict, path: str) -> list[dict]:
    return [o for _, o in places_at(rec, path)]


def _value_sketch(value: str) -> tuple[int, int, int]:
    import xxhash

    return sum(map(value.count, "0123456789")), len(value), xxhash.xxh3_64_intdigest(value.encode("utf-8", "replace"))


def _sketch(a: list, v: object, cache: dict[str, tuple[int, int, int]]) -> None:
    """Adds one value to [.., digits, chars, texts, mins]."""
    value = v if isinstance(v, str) else ",".join(sorted(v)) if isinstance(v, dict) else str(len(v)) if isinstance(v, list) else dump(v)
    got = cache.get(value)
    if got is None:
        got = _value_sketch(value)
        if len(value) < 64 and len(cache) < 100_000:
            cache[value] = got
    a[2] += got[0]
    a[3] += got[1]
    a[4] += 1
    i, h = got[2] % REGISTERS, got[2] // REGISTERS
    if a[5] is None:
        a[5] = [None] * REGISTERS
    if a[5][i] is None or h < a[5][i]:
        a[5][i] = h


def _profiler(schema: dict):
    bit = {k: 1 << i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, int, int]] = {}
        for batch in batches:
            acc: dict[tuple, list] = {}
            for source, path, line in zip(batch["source"].to_pylist(), batch["jsonl_path"].to_pylist(), batch["line"].to_pylist()):
                rtype, cells, rec = cells_of(line, source)
                if rec is None or fail_reason(source, rtype, cells):
                    continue
                rt = record_type(source, rec)
                listed = schema.get((source, rt))
                for obj in listed or [None]:
                    if obj is None:
                        acc.setdefault((source, path, rt, None, None), [1, 0, 0, 0, 0, None])
                        continue
                    own = listed[obj]
                    for o in objects_at(rec, obj):
                        acc.setdefault((source, path, rt, obj, ""), [0, 0, 0, 0, 0, None])[0] += 1
                        for k, v in o.items():
                            a = acc.setdefault((source, path, rt, obj, "." + k), [0, 0, 0, 0, 0, None])
                            a[0] += 1
                            a[1] |= bit[kind_of(v)]
                            if v is not None and (k not in own or own[k][1]):  # a listed field that may be absent has no edge
                                _sketch(a, v, cache)
            cols = list(zip(*[(*k, *v) for k, v in acc.items()])) or [[]] * len(_PROFILE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PROFILE)], schema=_PROFILE)

    return run


def profile(raw: DataFrame, schema: dict) -> DataFrame:
    """Per file and record type one row; ``fields`` holds, per object and field, the objects that have it, its types and its values' sketch.

    field is '' for the entry that counts the objects, else '.' and the name;
    object_path is null for a record type that isn't listed. One shuffle of
    the batches' sums serves both aggregates.
    """
    lines = raw.where(~is_blank(F.col("line"))).select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("jsonl_path", F.lit("")).alias("jsonl_path"), "line")
    part = lines.mapInArrow(_profiler(schema), PROFILE_DDL).repartition("source", "jsonl_path", "record_type")
    sums = [F.sum("present").alias("present"), F.bit_or("kinds").alias("kinds"), *_sketch_sums()]
    per_field = part.groupBy("source", "jsonl_path", "record_type", "object_path", "field").agg(*sums)
    # As many entries as the file's records have different fields.
    return per_field.groupBy("source", "jsonl_path", "record_type").agg(F.collect_list(F.struct("object_path", "field", "present", "kinds", "digits", "chars", "texts", "mins")).alias("fields"))


def _sketch_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("digits", "chars", "texts")] + [F.array(*[F.min(F.col("mins")[i]) for i in range(REGISTERS)]).alias("mins")]


def sketch_likeness(a: tuple, b: tuple) -> float:
    """Of two (digits, chars, texts, mins): the mean of the likeness of lengths, of digit shares and of the distinct values, 0 to 1."""
    la, lb = a[1] / a[2], b[1] / b[2]
    lengths = min(la, lb) / max(la, lb) if max(la, lb) else 1.0
    digits = 1 - abs(a[0] / max(1, a[1]) - b[0] / max(1, b[1]))
    used = [(x, y) for x, y in zip(a[3], b[3]) if x is not None or y is not None]
    return (lengths + digits + sum(x == y for x, y in used) / len(used)) / 3


def similarity(name: str, types: tuple[str, ...], new: str, kinds: set[str], old: tuple | None = None, sketch: tuple | None = None) -> float:
    """Weight of an edge: half the names' likeness, half the types'; with sketches of both fields' values a third each."""
    t = len(kinds & set(types)) / max(1, len(kinds | set(types)))
    parts = [SequenceMatcher(None, name.lower(), new.lower()).ratio(), t]
    if old and sketch:
        parts.append(sketch_likeness(old, sketch))
    return sum(parts) / len(parts)


def candidates(fields: dict[str, tuple], total: int, listed: dict[str, tuple[tuple[str, ...], bool]], usual: dict[str, tuple] | None = None) -> tuple[list[str], list[str], dict[str, list[tuple[float, str]]]]:
    """(removed, added, edges by removed field, the heaviest first); fields: {name: (present, kinds, sketch, what gives it, or None)}, usual: sketches of listed fields elsewhere."""
    removed = [f for f, (_, must) in listed.items() if must and f not in fields]
    added = [f for f in fields if f not in listed]
    edges = {}
    for r in removed:
        types, old = listed[r][0], (usual or {}).get(r)
        edges[r] = sorted(
            ((similarity(r, types, a, fields[a][1], old, fields[a][2]() if callable(fields[a][2]) else fields[a][2]), a) for a in added if fields[a][0] == total and fields[a][1] - {"null"} <= set(types)), reverse=True
        )
    return removed, added, edges


def assign(edges: dict[str, list[tuple[float, str]]]) -> dict[str, tuple[str, float]]:
    """A matching {left: (right, weight)} of as many pairs as possible and of these the greatest weight.

    Shortest augmenting paths with potentials; each left node may stay alone at a cost that no set of edges reaches.
    """
    left = sorted(edges)
    right = sorted({a for e in edges.values() for _, a in e})
    weight = {(r, a): w for r, e in edges.items() for w, a in e}
    n, m = len(left), len(right) + len(left)
    alone = float(n + 1)
    cost = [[1 - weight[r, a] if (r, a) in weight else 4 * alone for a in right] + [alone] * n for r in left]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j0]:
            used[j0] = True
            i0, step, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = {left[owner[j] - 1]: right[j - 1] for j in range(1, len(right) + 1) if owner[j]}
    return {r: (a, weight[r, a]) for r, a in pairs.items() if (r, a) in weight}


@dataclass
class ObjectMatch:
    removed: list[str]
    added: list[str]
    edges: dict[str, list[tuple[float, str]]]
    pairs: dict[str, tuple[str, float]]

    @property
    def renamed(self) -> list[tuple[str, str, float]]:
        """The pairs that are forced: one field is missing, and one can take its place."""
        if len(self.removed) > 1 or any(len(e) > 1 for e in self.edges.values()):
            return []
        return [(r, a, w) for r, (a, w) in self.pairs.items()]


def match_object(fields: dict[str, tuple], total: int, listed: dict[str, tuple[tuple[str, ...], bool]], usual: dict[str, tuple] | None = None) -> ObjectMatch:
    """The matching of one object group; fields: {name: (present, kinds, sketch or nothing)}, usual: sketches of listed fields elsewhere."""
    removed, added, edges = candidates(fields, total, listed, usual)
    return ObjectMatch(removed, added, edges, assign(edges))


def by_object(fields: Iterable[tuple]) -> tuple[dict[str, int], dict[str, dict[str, tuple]]]:
    """(objects, {name: (present, kinds, sketch)}) by object path of a file's (object path, field, present, kinds, sketch)."""
    totals: dict[str, int] = {}
    by: dict[str, dict[str, tuple]] = defaultdict(dict)
    for obj, field, present, bits, sketch in fields:
        if field:
            by[obj][field[1:]] = (present, _KIND_SETS[bits], sketch)
        else:
            totals[obj] = present
    return totals, by


_KIND_SETS = [{k for i, k in enumerate(KINDS) if bits >> i & 1} for bits in range(1 << len(KINDS))]


def profile_entries(files: pa.ListArray) -> Iterator[list[tuple]]:
    """by_object()'s entries of each file. Sketches, which hardly any entry needs, are read when asked for."""
    flat, at = files.values, files.offsets.to_pylist()
    names = [flat.field(c).to_pylist() for c in ("object_path", "field", "present", "kinds")]
    nums = [flat.field(c) for c in ("digits", "chars", "texts", "mins")]
    sketch = lambda i: tuple(c[i].as_py() for c in nums) if nums[2][i].as_py() else None
    for lo, hi in zip(at, at[1:]):
        yield [(*(c[i] for c in names), lambda i=i: sketch(i)) for i in range(lo, hi)]


ROWS_DDL = "source string, jsonl_path string, record_type string, change_kind string, field_path string, new_path string, weight double, is_matched boolean, is_rename boolean"


def compare(source: str, record_type: str, fields: list[tuple], schema: dict, usual: dict) -> list[tuple]:
    """(change kind, field path, new path, weight, is matched, is rename) of one file's records of one type: its changes, and every edge as kind 'edge'."""
    listed = schema.get((source, record_type))
    if listed is None:
        return [("added", "payload.type" if source == "codex" and record_type.startswith("response_item:") else "type", "", None, None, None)]
    totals, by = by_object(fields)
    out: list[tuple] = []
    for obj, total in totals.items():
        own, seen = listed[obj], by[obj]
        full = lambda f, obj=obj: f"{obj}.{f}" if obj else f
        m = match_object(seen, total, own, usual.get((source, record_type, obj)))
        old, new = {r for r, _, _ in m.renamed}, {a for _, a, _ in m.renamed}
        none = (None, None, None)
        out += [("retyped", full(f), "", *none) for f, (_, kinds, _) in seen.items() if f in own and kinds - {"null"} - set(own[f][0])]
        out += [("removed", full(f), "", *none) for f in m.removed if f not in old] + [("added", full(f), "", *none) for f in m.added if f not in new]
        out += [("renamed", full(r), full(a), w, True, True) for r, a, w in m.renamed]
        out += [("edge", full(r), full(a), w, m.pairs.get(r, ("",))[0] == a, r in old) for r, e in m.edges.items() for w, a in e]
    return out


def match_files(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """compare() of every file and record type, with the listed fields' sketches over all files."""
    schema = expected_schema(expected)
    files = materialize(profile(raw, schema), "profiles")
    listed = [(source, rt, obj, "." + f) for (source, rt), objs in schema.items() for obj, fs in objs.items() for f in fs]
    key = ["source", "record_type", "object_path", "field"]
    fields = files.select("source", "record_type", F.explode("fields").alias("f")).select("source", "record_type", "f.*").where("texts > 0")
    one = fields.join(raw.sparkSession.createDataFrame(listed, ", ".join(f"{c} string" for c in key)), key, "left_semi")
    usual: dict = defaultdict(dict)
    for r in one.groupBy(*key).agg(*_sketch_sums()).collect():  # at most MAX_EXPECTED
        usual[(r.source, r.record_type, r.object_path)][r.field[1:]] = (r.digits, r.chars, r.texts, r.mins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.float64(), pa.bool_(), pa.bool_()]
        names = ["source", "jsonl_path", "record_type", "change_kind", "field_path", "new_path", "weight", "is_matched", "is_rename"]
        for b in batches:
            out = [
                (source, path, rt, *c)
                for source, path, rt, fields in zip(*(b[c].to_pylist() for c in ("source", "jsonl_path", "record_type")), profile_entries(b["fields"]))
                for c in compare(source, rt, fields, schema, usual)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 9, types)], names=names)

    return files.mapInArrow(run, ROWS_DDL)


def find_changes(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of p2_found: jsonl_path, record_type, change_kind, field_path, new_path."""
    return match_files(raw, expected).where("change_kind <> 'edge'").select("jsonl_path", "record_type", "change_kind", "field_path", "new_path").distinct()


def find_matches(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """Every edge between a missing and a possible new field of a file's objects: its weight, whether the matching has it, and whether p2_found takes it."""
    return match_files(raw, expected).where("change_kind = 'edge'").drop("change_kind")


UNIFIED_DDL = "record_id bigint, source string, jsonl_path string, line_number int, record_type string, fields map<string,string>, other map<string,string>, retyped map<string,string>"


def unify(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """All records that load as one table: ``fields`` by listed path (renamed ones under the listed name), ``other`` the unlisted rest.

    The renames of a file and record type are joined as a small map; values are
    text (strings as they are, the rest JSON). Objects and arrays of objects
    whose fields are listed come out by their fields, or whole if they have none.
    ``retyped`` has the JSON type of each listed field whose value has none of
    the listed types.
    """
    schema = expected_schema(expected)
    renames = (
        find_changes(raw, expected)
        .where("change_kind = 'renamed'")
        .groupBy("jsonl_path", "record_type")
        .agg(F.map_from_entries(F.collect_list(F.struct("new_path", "field_path"))).alias("renames"))
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mp = pa.map_(pa.string(), pa.string())
        for b in batches:
            out = []
            for rid, source, path, num, line in zip(*(b[c].to_pylist() for c in ("record_id", "source", "jsonl_path", "line_number", "line"))):
                rtype, cells, rec = cells_of(line, source)
                if rec is None or fail_reason(source, rtype, cells):
                    continue
                rt = record_type(source, rec)
                objs = {"": {}} | schema.get((source, rt), {})
                known, other, odd = {}, {}, {}
                for obj, own in objs.items():
                    for place, o in places_at(rec, obj):
                        for k, v in o.items():
                            p = f"{obj}.{k}" if obj else k
                            if isinstance(v, dict) and v and p in objs or isinstance(v, list) and v and p + "[]" in objs and all(isinstance(x, dict) and x for x in v):
                                continue
                            at = f"{place}.{k}" if place else k
                            (known if k in own else other)[at] = dump(v)
                            if k in own and v is not None and kind_of(v) not in own[k][0]:
                                odd[at] = kind_of(v)
                out.append((rid, source, path, num, rt, *(list(x.items()) for x in (known, other, odd))))
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), mp, mp, mp]
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["record_id", "source", "jsonl_path", "line_number", "record_type", "fields", "other", "retyped"])

    lines = raw.where(~is_blank(F.col("line"))).select(
        "record_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("jsonl_path", F.lit("")).alias("jsonl_path"), "line_number", "line"
    )
    flat = lines.mapInArrow(run, UNIFIED_DDL)
    general = lambda k: F.regexp_replace(k, r"\[[0-9]+\]", "[]")
    j = flat.join(renames, ["jsonl_path", "record_type"], "left")
    moved = F.map_filter("other", lambda k, v: F.coalesce(F.map_contains_key("renames", general(k)), F.lit(False)))
    kept = F.map_filter("other", lambda k, v: ~F.coalesce(F.map_contains_key("renames", general(k)), F.lit(False)))
    # Only the name changes: the object, and its place in an array, stay.
    target = F.transform_keys(moved, lambda k, v: F.concat(F.regexp_extract(k, r"^(.*\.)?", 0), F.substring_index(F.element_at("renames", general(k)), ".", -1)))
    return j.select(
        "record_id", "source", "jsonl_path", "line_number", "record_type", F.map_concat("fields", target).alias("fields"), kept.alias("other"), "retyped"
    )
