"""References to records that do not exist, by bitmaps over dictionary-encoded keys.

1. Keys of references and parents are gathered (references pre-aggregated to
   one row per key and period, so that a hot key is a handful of rows) and
   dictionary-encoded: a hash picks the key range, the rank of the key in its
   range is the bit. Ids are a pure function of the rows, so a recomputed task
   gives the same ones.
2. Per key range and period one bitmap of the keys referenced and one of the
   keys whose parent arrived are built with Spark's bitmap aggregates.
3. Per key range ``reference AND-NOT parent`` is evaluated (a few KB per period)
   and the surviving bits are decoded to candidates:
   ``absent`` (no parent at all), ``early`` (the parent arrived in this period
   or a later one), ``unused`` (a parent that no bitmap refers to).
4. Only candidates go back to the rows; ``early`` ones are checked row by row.

Nulls: a null or blank key refers to nothing and names no parent. A null
loaded_at is the period '' and sorts before all times, so it is never late and
a parent with it makes nothing late. A null source compares equal to ''.
Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_id
from ..runtime import materialize, shuffle_partitions
from ..sources.tables import first_by_uuid

BITS = 32768  # of one of Spark's bitmaps


def month_of(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit(""))


def encode_keys(events: DataFrame, ranges: int) -> DataFrame:
    """Add ``id``: (key range << 32) + rank of (source, skey) in its range, from 1."""
    b = events.withColumn("_range", F.pmod(F.xxhash64("source", "skey"), F.lit(ranges)))
    w = Window.partitionBy("_range").orderBy("source", "skey")
    return b.withColumn("id", F.shiftleft(F.col("_range"), 32) + F.dense_rank().over(w)).drop("_range")


def _bits(bitmap: bytes | None) -> np.ndarray:
    if bitmap is None:
        return np.zeros(BITS // 8, dtype=np.uint8)
    return np.frombuffer(bitmap, dtype=np.uint8)


def and_not(pdf: pd.DataFrame) -> pd.DataFrame:
    """All periods of one key range: reference AND-NOT parent, decoded to ids."""
    pdf = pdf.sort_values("period")
    base = (int(pdf["key_range"].iloc[0]) - 1) * BITS + 1
    refs, pars = [_bits(x) for x in pdf["refs"]], [_bits(x) for x in pdf["parents"]]
    every_par = np.bitwise_or.reduce(pars)
    every_ref = np.bitwise_or.reduce(refs)
    before = np.zeros_like(every_par)
    ids, periods, kinds = [], [], []
    for period, ref, par in zip(pdf["period"], refs, pars):
        for kind, bits in (
            ("absent", ref & ~every_par),
            ("early", ref & every_par & ~before),
            ("unused", par & ~every_ref),
        ):
            at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            if len(at):
                ids.append(at.astype(np.int64) + base)
                periods += [period] * len(at)
                kinds += [kind] * len(at)
        before = before | par
    return pd.DataFrame({"id": np.concatenate(ids) if ids else np.array([], dtype=np.int64), "period": periods, "kind": kinds})


def find_orphans(messages: DataFrame, sessions: DataFrame, deleted: DataFrame, key_ranges: int | None = None) -> DataFrame:
    """Rows of p1_found: from_table, source, ref_key, orphan_kind, loaded_month."""
    spark = messages.sparkSession
    key = lambda: F.coalesce(norm_id(F.col("session_id")), F.lit("")).alias("skey")
    src = lambda: F.coalesce(F.col("source"), F.lit("")).alias("source")
    # Written once: keys are counted from it, and rows looked up in it.
    refs = materialize(
        first_by_uuid(messages, src(), key(), F.col("loaded_at"))
        .where("skey <> ''")
        .select("uuid", "source", "skey", "loaded_at", month_of(F.col("loaded_at")).alias("period")),
        "references",
    )
    by_month = refs.groupBy("source", "skey", "period").agg(F.min("loaded_at").alias("at")).withColumn("kind", F.lit("ref"))
    parents = (
        sessions.select(src(), key(), "loaded_at")
        .where("skey <> ''")
        .groupBy("source", "skey")
        .agg(F.min("loaded_at").alias("at"))
        .select("source", "skey", month_of(F.col("at")).alias("period"), "at", F.lit("parent").alias("kind"))
    )
    gone = (
        deleted.select(src(), key())
        .where("skey <> ''")
        .distinct()
        .select("source", "skey", F.lit("").alias("period"), F.lit(None).cast("timestamp").alias("at"), F.lit("deleted").alias("kind"))
    )
    events = by_month.unionByName(parents).unionByName(gone)
    coded = materialize(encode_keys(events, key_ranges or 4 * shuffle_partitions(spark)), "orphan-keys")

    bit = F.bitmap_construct_agg(F.bitmap_bit_position("id"))
    live = coded.where("kind <> 'deleted'").select(
        F.bitmap_bucket_number("id").alias("key_range"), "period", "kind", "id"
    )
    maps = live.groupBy("key_range", "period", "kind").agg(bit.alias("bits"))
    wide = maps.groupBy("key_range", "period").agg(
        F.bitmap_or_agg(F.when(F.col("kind") == "ref", F.col("bits")).otherwise(F.lit(b""))).alias("refs"),
        F.bitmap_or_agg(F.when(F.col("kind") == "parent", F.col("bits")).otherwise(F.lit(b""))).alias("parents"),
    )
    found = wide.groupBy("key_range").applyInPandas(and_not, "id bigint, period string, kind string")

    # Decode: ids back to keys, all at the size of the dictionary, not of the rows.
    arrival = coded.groupBy("id").agg(
        F.max(F.when(F.col("kind") == "parent", F.col("at"))).alias("arrival"),
        F.max(F.col("kind") == "deleted").alias("is_deleted"),
        F.first("source").alias("source"),
        F.first("skey").alias("skey"),
    )
    cand = found.withColumnRenamed("kind", "cand").join(arrival, "id")
    unused = cand.where("cand = 'unused'").select(
        F.lit("sessions").alias("from_table"), "source", F.col("skey").alias("ref_key"), F.lit("unused").alias("orphan_kind"), F.col("period").alias("loaded_month")
    )
    first_use = coded.where("kind = 'ref'").select("id", "period", F.col("at").alias("first_use"))
    hits = (
        cand.where("cand <> 'unused'")
        .join(first_use, ["id", "period"])
        .where("cand = 'absent' or first_use < arrival")
        .select("source", "skey", "period", "arrival", F.when(F.col("cand") == "early", "late").when(F.col("is_deleted"), "deleted").otherwise("missing").alias("orphan_kind"))
    )
    rows = (
        refs.join(hits, ["source", "skey", "period"])
        .where("orphan_kind <> 'late' or loaded_at < arrival")
        .select(F.lit("messages").alias("from_table"), "source", F.col("uuid").alias("ref_key"), "orphan_kind", F.col("period").alias("loaded_month"))
    )
    return rows.unionByName(unused)


def orphan_rates(found: DataFrame) -> DataFrame:
    """Orphans per table, source, kind and period."""
    return found.groupBy("from_table", "source", "orphan_kind", "loaded_month").agg(F.count("*").alias("orphans"))


__all__ = ["find_orphans", "orphan_rates", "encode_keys", "and_not"]
