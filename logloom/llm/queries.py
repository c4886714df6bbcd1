"""The queries pN_ of the problems on language-model text, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import conversations, mixing, tokens, truncation


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.find_dropped(table(spark, d, "messages"))


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "messages"))


def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_sizes(table(spark, d, "messages"))


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    return conversations.versions(table(spark, d, "messages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p8_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text's ids are those of its chunks of 48 characters, in its task and (texts over 192) spread over tasks."""
    docs = table(spark, d, "documents")
    whole = tokens.encode_documents(docs, chunk=tokens.SPREAD)
    small = tokens.encode_documents(docs, chunk=48, overlap=24, spread=192)
    return whole.join(small.withColumnRenamed("ids", "by_chunks"), "doc_id").select("doc_id", (F.col("ids") == F.col("by_chunks")).alias("is_same"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids: the round trip of the corpus."""
    return tokens.decode_ids(p8_ids(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.chosen(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), t), t)


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mix_targets")
    return mixing.check_mix(mixing.mix(table(spark, d, "documents"), t), t)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cut(table(spark, d, "documents"))


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(table(spark, d, "documents")).where(F.col("reason").isNotNull())


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(table(spark, d, "documents"))


QUERIES = {
    "p5_found": p5_found,
    "p5_conversations": p5_conversations,
    "p5_sizes": p5_sizes,
    "p5_versions": p5_versions,
    "p8_ids": p8_ids,
    "p8_chunked": p8_chunked,
    "p8_decoded": p8_decoded,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_reasons": p10_reasons,
    "p10_rates": p10_rates,
}
