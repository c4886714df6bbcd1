"""Parent-child links of unknown depth to roots, depths, paths and descendants.

Frontier joins from the roots, with levels that double in span: round k joins
every unresolved node with its ancestor pair at distance 2^k, so the nodes of
depths 2^k to 2^(k+1)-1 reach a root in that round. A tree of depth d takes
log2(d)+1 joins of (bigint, bigint) rows instead of d. A round that reaches no
node ends the search (depths have no gaps); what is left hangs on circles.
There the pairs are doubled further until the set of ancestors stops
shrinking: those ancestors are the circles, the rest hangs on them.

The uuids are strings only when links are resolved and when results are named;
in between nodes are their seq. Every round's table is written to the shared
folder and the one before it is deleted.

Nulls: a null or blank parent is a root, so is one whose parent is no node. Of
repeated uuids the first (lowest seq) counts; a null seq gets a hash of the
uuid as its number. Ties can't arise: after that step uuids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_id
from ..runtime import materialize, release
from ..sources.tables import first_by_uuid


def _round_counts() -> dict[str, Column]:
    """What a round's write counts on its way."""
    return {"new": F.count_if(F.col("done")), "rest": F.count_if(~F.col("done"))}


def node_table(rows: DataFrame) -> DataFrame:
    """(v, uuid, a): node number, uuid, parent's number or null for a root."""
    nodes = materialize(
        first_by_uuid(rows, F.nullif(norm_id(F.col("parent_uuid")), F.lit("")).alias("p")).select(F.coalesce("seq", -F.abs(F.xxhash64("uuid"))).alias("v"), "uuid", "p"),
        "messages",
    )
    parents = nodes.select(F.col("uuid").alias("p"), F.col("v").alias("a"))
    linked = nodes.where("p is not null").join(parents, "p", "left").select("v", "uuid", "a")
    return linked.unionByName(nodes.where("p is null").select("v", "uuid", F.lit(None).cast("bigint").alias("a")))


def resolve(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (v, a): reached (v, root, depth) of all nodes below roots, left (v, anc) of all others."""
    todo = materialize(nodes.where("a is not null").select("v", F.col("a").alias("anc"), F.lit(1).cast("bigint").alias("dist")), "links")
    reached: list[DataFrame] = []
    while True:
        known = todo.select(F.col("v").alias("k"), F.col("anc").alias("k_anc"), F.col("dist").alias("k_dist"), F.lit(False).alias("k_done"))
        for r in reached:
            known = known.unionByName(r.select(F.col("v").alias("k"), F.col("root").alias("k_anc"), F.col("depth").alias("k_dist"), F.lit(True).alias("k_done")))
        step = todo.join(known, todo["anc"] == known["k"], "left").select(
            "v",
            F.coalesce("k_anc", "anc").alias("anc"),
            (F.col("dist") + F.coalesce("k_dist", F.lit(0))).alias("dist"),
            F.coalesce("k_done", F.lit(True)).alias("done"),  # the ancestor is no child: a root
        )
        out = materialize(step, "frontier", partition_by=["done"], counts=_round_counts())
        found, open_ = out._logloom_counts["new"], out._logloom_counts["rest"]
        new = out.where("done").select("v", F.col("anc").alias("root"), F.col("dist").alias("depth"))
        rest = out.where("not done").select("v", "anc", "dist")
        if not found:
            release(out)
            return _union(reached, todo), todo.select("v", "anc")
        if not reached:
            release(todo)
        reached.append(new)
        todo = rest
        if not open_:
            return _union(reached, todo), todo.select("v", "anc")


def _union(reached: list[DataFrame], todo: DataFrame) -> DataFrame:
    if not reached:
        return todo.where("false").select("v", F.col("anc").alias("root"), F.col("dist").alias("depth"))
    out = reached[0]
    for r in reached[1:]:
        out = out.unionByName(r)
    return out


def split_cycles(left: DataFrame) -> DataFrame:
    """(v, on_cycle) of nodes whose links never reach a root."""
    if left.isEmpty():
        return left.select("v", F.lit(False).alias("on_cycle"))
    pairs, count = left, left.select("anc").distinct().count()
    owned = None
    while True:
        nxt = materialize(pairs.join(pairs.select(F.col("v").alias("anc"), F.col("anc").alias("far")), "anc").select("v", F.col("far").alias("anc")), "circles")
        if owned is not None:
            release(owned)
        n = nxt.select("anc").distinct().count()
        pairs, owned = nxt, nxt
        if n == count:
            break
        count = n
    on = pairs.select(F.col("anc").alias("v")).distinct().withColumn("on_cycle", F.lit(True))
    return left.select("v").join(on, "v", "left").select("v", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def find_hierarchy(rows: DataFrame) -> DataFrame:
    """Rows of p3_found: uuid, root_uuid, node_depth, link_state of every node but the roots."""
    nodes = materialize(node_table(rows), "nodes")
    reached, left = resolve(nodes)
    names = nodes.select("v", "uuid")
    tree = (
        reached.join(names, "v")
        .join(names.select(F.col("v").alias("root"), F.col("uuid").alias("root_uuid")), "root")
        .select("uuid", "root_uuid", F.col("depth").alias("node_depth"), F.lit("tree").alias("link_state"))
    )
    loose = (
        split_cycles(left)
        .join(names, "v")
        .select("uuid", F.lit("").alias("root_uuid"), F.lit(-1).cast("bigint").alias("node_depth"), F.when(F.col("on_cycle"), "cycle").otherwise("hung").alias("link_state"))
    )
    return tree.unionByName(loose)


def path_table(nodes: DataFrame, label: str) -> DataFrame:
    """(v, path) of every node that ends at a root, roots included; path has the labels from the root to the node.

    Each round glues the path of a node's ancestor pair before its own, so
    paths double in length per round. nodes: v, a and the label.
    """
    todo = materialize(nodes.where("a is not null").select("v", F.col("a").alias("anc"), F.array(label).alias("path")), "paths")
    done = [materialize(nodes.where("a is null").select("v", F.lit(None).cast("bigint").alias("anc"), F.array(label).alias("path")), "paths")]
    while True:
        known = todo.select(F.col("v").alias("k"), F.col("anc").alias("k_anc"), F.col("path").alias("k_path"))
        for d in done:
            known = known.unionByName(d.select(F.col("v").alias("k"), F.col("anc").alias("k_anc"), F.col("path").alias("k_path")))
        step = todo.join(known, todo["anc"] == known["k"]).select("v", F.col("k_anc").alias("anc"), F.concat("k_path", "path").alias("path"), F.col("k_anc").isNull().alias("done"))
        out = materialize(step, "paths", partition_by=["done"], counts=_round_counts())
        if not out._logloom_counts["new"]:
            release(out)
            break
        done.append(out.where("done").select("v", "anc", "path"))
        if len(done) == 2:
            release(todo)
        todo = out.where("not done").select("v", "anc", "path")
    every = done[0].select("v", "path")
    for d in done[1:]:
        every = every.unionByName(d.select("v", "path"))
    return every


def find_paths(rows: DataFrame) -> DataFrame:
    """(uuid, root_uuid, node_depth, path) of every node that ends at a root; path holds uuids."""
    p = path_table(materialize(node_table(rows), "nodes"), "uuid")
    return p.select(F.element_at("path", -1).alias("uuid"), F.col("path")[0].alias("root_uuid"), (F.size("path") - 1).cast("bigint").alias("node_depth"), "path")


def ancestor_pairs(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every node and each node above it, ancestors as node numbers. paths: v, path of v in node numbers."""
    depth = F.size("path") - 1
    up = paths.select(F.col("v").alias("descendant"), depth.alias("_depth"), F.posexplode("path").alias("pos", "ancestor"))
    return up.where("pos < _depth").select("ancestor", "descendant", (F.col("_depth") - F.col("pos")).alias("distance"))


def descendant_pairs(rows: DataFrame) -> DataFrame:
    """(uuid, descendant_uuid, distance) for every node and each node below it.

    Paths are of node numbers. A path gets its node's uuid before it is
    exploded, so the pairs, many times more than nodes, are shuffled once.
    """
    nodes = materialize(node_table(rows), "nodes")
    names = nodes.select("v", "uuid")
    named = path_table(nodes, "v").where(F.size("path") > 1).join(names, "v").select(F.col("uuid").alias("v"), "path")
    return (
        ancestor_pairs(named)
        .join(names.withColumnRenamed("v", "ancestor"), "ancestor")
        .select("uuid", F.col("descendant").alias("descendant_uuid"), F.col("distance").cast("bigint").alias("distance"))
    )


def descendants(rows: DataFrame) -> DataFrame:
    """(uuid, n_children, n_descendants, height) of every node on a tree, without its pairs.

    Round k knows of each node what lies less than 2^k below it (size, itself
    included, and height) and its ancestor at distance 2^k; the nodes that have
    it as that ancestor bring what lies up to twice as deep. So a tree of depth
    d takes log2(d)+2 rounds of one row per node. The search ends when no node
    runs out of ancestors any more: the others hang on circles, and nothing of
    a circle is below a node of a tree.
    """
    nodes = materialize(node_table(rows), "nodes")
    one, open_ = F.lit(1).cast("bigint"), {"rest": F.count("anc")}
    state = materialize(nodes.select("v", F.col("a").alias("anc"), one.alias("size"), F.lit(0).cast("bigint").alias("height"), F.lit(0).cast("bigint").alias("kids")), "below", counts=open_)
    step = 1
    while True:
        up = state.where("anc is not null").groupBy(F.col("anc").alias("v")).agg(F.sum("size").alias("more"), (F.max("height") + step).alias("far"), F.count("*").alias("n"))
        known = state.select(F.col("v").alias("anc"), F.col("anc").alias("above"))
        grown = state.join(up, "v", "left").join(known, "anc", "left").select(
            "v", F.col("above").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.greatest("height", "far").alias("height"), (F.coalesce("n", F.lit(0)) if step == 1 else F.col("kids")).alias("kids")
        )
        nxt = materialize(grown, "below", counts=open_)
        done = nxt._logloom_counts["rest"] == state._logloom_counts["rest"]
        if done:
            release(nxt)
            # A tree with links has at least one round before this one; without links nothing has children.
            return state.where("anc is null").join(nodes.select("v", "uuid"), "v").select("uuid", F.col("kids").alias("n_children"), (F.col("size") - 1).alias("n_descendants"), "height")
        release(state)
        state, step = nxt, 2 * step
