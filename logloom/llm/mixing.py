"""Mixing sources to target weights, with soft membership.

1. A multinomial logistic regression on hashed words, line starts and the
   text's shape (length, lines, sentences, lists, code) is fitted on a bounded
   sample of the labelled documents (SAMPLE, those of the lowest hashes) and
   gives every document without a usable label its domain posteriors. A
   labelled document belongs to its source alone.
2. Each document gets a rate between 0 and its repeat limit. The rates minimise
   the squared distance between the expected domain token totals and the
   targets, by projected gradient steps scaled with the domains' tokens.
   Documents with equal membership and limit have equal rates, so they are
   summed to one row first; each step is one distributed pass over those rows,
   and what comes back is one total per domain.
3. The size of the mixture is the largest at which no domain with documents
   falls short of its share within its limits.
4. Rates become whole numbers of uses by systematic rounding over documents
   sorted by size within (domain, rate): cumulative fractions in millionths,
   so the rounding error of a group is about one document.

Sources compare ignoring case and spaces around them. Null and empty texts
have no tokens and aren't used; a null doc_id counts like any other. A target
without documents is reported with an actual share of 0, the others share its
weight. Ties in size are ordered by id hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_source
from ..operators.running import running_sum
from ..runtime import materialize
from .tokens import VOCAB_PATH, encoding, read_vocab

FEATURES = 1 << 13
MAX_DOMAINS = 200
SAMPLE, EPOCHS, RATE = 12_000, 3, 0.1  # labelled documents that the classifier is fitted on
STEPS, TOLERANCE = 40, 1e-5
UNIT = 1_000_000
SENTENCE = re.compile("[.!?。！？]")
TOLERATED = 0.001  # of an actual share, besides the share of one document


def read_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(domain, share, max repeats), shares summing to 1; the fixed table, size checked."""
    rows = targets.select(norm_source(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").groupBy("s").agg(
        F.max("target_share").alias("w"), F.max("max_repeats").alias("r")
    ).orderBy("s").limit(MAX_DOMAINS + 1).collect()
    if len(rows) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} targets")
    total = sum(max(0.0, r.w or 0.0) for r in rows) or 1.0
    return [(r.s, max(0.0, r.w or 0.0) / total, max(0, r.r or 0)) for r in rows]


def shape_of(text: str) -> list[str]:
    """What a text looks like, in classes: sizes in half powers of two, counts up to a few."""
    lines = text.split("\n")
    return [
        f"size {int(np.log2(len(text) + 1) * 2)}", f"lines {min(9, len(lines))}", f"sentences {min(12, len(SENTENCE.findall(text)))}", f"paragraphs {min(6, text.count(chr(10) * 2))}",
        f"items {min(4, sum(x[:2] in ('- ', '* ') for x in lines))}", f"fences {min(6, text.count('```'))}", f"end {text.rstrip()[-1:]}", f"start {text[:2]}",
        f"lower {text[:1].islower()}", f"asks {min(3, text.count('?'))}", f"calls {min(3, text.count('!'))}",
    ]


def word_ids(text: str) -> np.ndarray:
    """Hashed words, line starts and shape of a text: stable in every process."""
    import xxhash

    out = {xxhash.xxh32_intdigest(w) % FEATURES for w in text.lower().split()}
    out |= {xxhash.xxh32_intdigest("\x00" + line[:3]) % FEATURES for line in text.split("\n")}
    out |= {xxhash.xxh32_intdigest("\x01" + s) % FEATURES for s in shape_of(text)}
    return np.fromiter(sorted(out), dtype=np.int64)


def fit(labelled: DataFrame, domains: list[str]) -> np.ndarray:
    """Weights (features + 1, domains) of a logistic regression on at most SAMPLE labelled documents; the last row is the bias.

    The sample is the documents of the lowest hashes of their text, so it is the same on every run. Only features, at
    most FEATURES numbers a document, reach the driver.
    """
    place = {d: i for i, d in enumerate(domains)}
    rows = labelled.select("domain", "text", F.pmod(F.xxhash64("text", "domain"), F.lit(1 << 31)).alias("h"))
    # A tenth and some more than the sample, so that chance leaves it full.
    share = 1.1 * SAMPLE / max(1, labelled.count()) + 1e-3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [word_ids(t).astype(np.int32) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["h"], pa.array([place[d] for d in b["domain"].to_pylist()], pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["h", "d", "ids"])

    sample = rows.where(F.col("h") < int(min(1.0, share) * (1 << 31))).mapInArrow(run, "h bigint, d int, ids array<int>").orderBy("h", "d", "ids").limit(SAMPLE).toArrow()
    ids, y = [np.array(x, dtype=np.int64) for x in sample["ids"].to_pylist()], sample["d"].to_pylist()
    seen = np.bincount(y, minlength=len(domains)) if y else np.zeros(len(domains))
    w, g = np.zeros((FEATURES + 1, len(domains))), np.full((FEATURES + 1, len(domains)), 1e-8)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):  # one document at a time, steps by the root of the gradients' squares
        for i in order.permutation(len(y)):
            x = np.append(ids[i], FEATURES)
            z = w[x].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g[x] += p * p
            w[x] -= RATE * p / np.sqrt(g[x])
    # A domain without documents has no members.
    w[-1, seen == 0] = -np.inf
    return w


def posteriors(weights: np.ndarray, text: str) -> np.ndarray:
    x = word_ids(text)
    z = weights[x].sum(axis=0) + weights[-1]
    if not np.isfinite(z.max()):
        return np.full(len(z), 1.0 / len(z))
    p = np.exp(z - z.max())
    return p / p.sum()


def member_table(docs: DataFrame, targets: list[tuple[str, float, int]], vocab_path: str = VOCAB_PATH) -> DataFrame:
    """(doc_id, domain, labelled, n_tokens, cap, p array<double>) of all documents with tokens."""
    domains = [d for d, _, _ in targets]
    caps = np.array([c for _, _, c in targets])
    named = docs.select("doc_id", "text", norm_source(F.col("source")).alias("domain")).where(F.char_length("text") > 0)
    weights = docs.sparkSession.sparkContext.broadcast(fit(named.where(F.col("domain").isin(*domains)).select("domain", "text"), domains))  # features x domains, fixed
    raw = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))
    place = {d: i for i, d in enumerate(domains)}
    own = np.eye(len(domains)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value)
        for b in batches:
            names, labelled, sizes, cap, ps = [], [], [], [], []
            for domain, text in zip(b["domain"].to_pylist(), b["text"].to_pylist()):
                j = place.get(domain)
                labelled.append(j is not None)
                if j is None:
                    p = np.round(posteriors(weights.value, text), 6)
                    j = int(p.argmax())
                    ps.append((p / p.sum()).tolist())
                else:
                    ps.append(own[j])
                sizes.append(len(enc.encode_ordinary(text)))
                names.append(domains[j])
                cap.append(int(caps[j]))
            cols = [b["doc_id"], pa.array(names, pa.string()), pa.array(labelled, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(cap, pa.int32()), pa.array(ps, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "domain", "labelled", "n_tokens", "cap", "p"])

    return named.mapInArrow(run, "doc_id bigint, domain string, labelled boolean, n_tokens bigint, cap int, p array<double>").where("n_tokens > 0")


def rates_of(p: np.ndarray, cap: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps so far, from zero."""
    r = np.zeros(len(p))
    for g in history:
        r = np.clip(r + p @ g, 0.0, cap)
    return r


def fit_rates(groups: DataFrame, targets: list[tuple[str, float, int]]) -> list[np.ndarray]:
    """The step vectors whose replay gives every document's rate. groups: p, cap, tokens."""
    k = len(targets)

    def totals(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Domain tokens at the present rates (before the first step: at the limits), in all, and between free members."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, k + 2))
            for b in batches:
                if not b.num_rows:
                    continue
                p = np.array(b["p"].to_pylist())
                cap = np.array(b["cap"].to_pylist(), dtype=float)
                t = np.array(b["tokens"].to_pylist(), dtype=float)
                r = rates_of(p, cap, history) if history else cap
                free = t * ((r > 0) & (r < cap)) if history else t
                out += np.column_stack([(r * t) @ p, t @ p, (p * free[:, None]).T @ p])
            i, j = out.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(out[i, j])], names=["i", "j", "v"])

        out = np.zeros((k, k + 2))
        for r in groups.mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # k x (k + 2)
            out[r.i, r.j] = r.v
        return out[:, 0], out[:, 1], out[:, 2:]

    most, size, gram = totals([])
    share = np.array([w for _, w, _ in targets]) * (most > 0)
    share = share / share.sum() if share.sum() else share
    wanted = share * min((most[i] / share[i] for i in range(k) if share[i] > 0), default=0.0)
    history: list[np.ndarray] = []
    used, before = np.zeros(k), np.inf
    for _ in range(STEPS):
        gap = wanted - used
        left = np.abs(gap).sum()
        if left <= TOLERANCE * max(1.0, wanted.sum()) or left > 0.99 * before:  # there, or as near as limits allow
            break
        before = left
        # The gradient, scaled by what a step moves: the tokens that free members share between domains.
        # Where hardly any member is free, the domain's size stands in for them and limits do the rest.
        ridge = np.where(np.diag(gram) > 0.01 * size, 1e-8, 0.01) * size + 1e-9
        step = np.linalg.solve(gram + np.diag(ridge), gap)
        history.append(np.where(size > 0, step, 0.0))
        used, _, gram = totals(history)
    return history


def mix(docs: DataFrame, targets: DataFrame, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """(doc_id, domain, labelled, n_tokens, uses, p) of all documents with tokens; uses may be 0."""
    want = read_targets(targets)
    members = materialize(member_table(docs, want, vocab_path), "members")
    groups = materialize(members.groupBy("p", "cap").agg(F.sum("n_tokens").alias("tokens")), "mix-groups")
    history = fit_rates(groups, want)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r = rates_of(np.array(b["p"].to_pylist()), np.array(b["cap"].to_pylist(), dtype=float), history)
            r = np.round(r, 6)  # in millionths
            whole = np.floor(r)
            part = np.round((r - whole) * UNIT).clip(0).astype(np.int64)
            cols = [b["doc_id"], b["domain"], b["labelled"], b["n_tokens"], pa.array(whole.astype(np.int32)), pa.array(part), b["p"]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "domain", "labelled", "n_tokens", "whole", "part", "p"])

    rated = members.mapInArrow(rate, "doc_id bigint, domain string, labelled boolean, n_tokens bigint, whole int, part bigint, p array<double>")
    placed = rated.withColumn("h", F.xxhash64("doc_id", "n_tokens"))
    # Segments follow the order (size, hash), so no domain's documents meet in one task.
    seg = F.col("n_tokens") * 64 + F.shiftright(F.col("h"), 58) + 32
    summed = running_sum(placed, ["domain", "labelled"], seg, ["n_tokens", "h", "doc_id"], F.col("part"), "upto")
    extra = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("part")) / UNIT)
    return summed.select("doc_id", "domain", "labelled", "n_tokens", (F.col("whole") + extra).cast("int").alias("uses"), "p")


def chosen(mixed: DataFrame) -> DataFrame:
    return mixed.where("uses > 0").select("doc_id", F.col("domain").alias("source"), "labelled", "n_tokens", "uses")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: target and actual share of tokens, documents and uses; shares of soft members are expected ones."""
    want = read_targets(targets)
    names = F.array(*[F.lit(d) for d, _, _ in want])
    split = mixed.where("uses > 0").select("uses", "n_tokens", F.explode(F.arrays_zip(names.alias("domain"), F.col("p").alias("p"))).alias("x")).where("x.p > 0")
    got = split.groupBy(F.col("x.domain").alias("source")).agg(F.sum(F.col("x.p") * F.col("uses") * F.col("n_tokens")).alias("tokens"), F.sum(F.col("x.p")).alias("n_docs"))
    got = got.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row per target
    t = mixed.sparkSession.createDataFrame([(d, w, c) for d, w, c in want], "source string, target_share double, max_repeats int")
    return (
        t.join(got, "source", "left")
        .select(
            "source", "target_share", "max_repeats",
            F.round(F.coalesce("n_docs", F.lit(0.0)), 3).alias("n_docs"),
            F.round(F.coalesce("tokens", F.lit(0.0)), 3).alias("n_tokens"),
            F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        )
    )


def check_mix(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share among those with documents, whether all uses of its labelled documents are within its limit, and whether the actual share is as near to it as whole documents allow: TOLERATED and the share of the largest one."""
    got = shares(mixed, targets)
    want = F.col("target_share") / F.sum(F.when(F.col("n_docs") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # a row per target
    caps = mixed.where("labelled").groupBy(F.col("domain").alias("source")).agg(F.max("uses").alias("most"))
    kept = got.join(caps, "source", "left").select(
        "source", F.round(F.when(F.col("n_docs") > 0, want).otherwise(0.0), 6).alias("share"), "actual_share", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_limit")
    )
    one = mixed.where("uses > 0").agg((F.max("n_tokens") / F.sum(F.col("uses") * F.col("n_tokens"))).alias("one")).first().one
    near = F.abs(F.col("actual_share") - F.col("share")) <= (one or 0.0) + TOLERATED
    return kept.select("source", "share", "within_limit", near.alias("within_tolerance"))
