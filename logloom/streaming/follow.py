"""Following logs as they grow: the import's parsing and first-wins rule on a stream of lines.

Lines arrive as rows (source, jsonl_path, line_number, line), e.g. from a
shipper that writes Parquet. Dialect A needs no state beyond the uuid; repeated
uuids within the watermark are dropped by the stream, older ones by the store,
which every batch joins. Each batch is one publish, and a batch that runs again
after a failure finds its rows stored, so rows are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.running import arrival_numbers
from ..runtime import materialize
from ..sources.dialects import A, parse_lines
from ..sources.store import Store
from ..sources.tables import first_of

GROUPS = 1024  # of files, whose messages are numbered together
LINES_DDL = "source string, jsonl_path string, line_number int, line string, loaded_at timestamp"


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(LINES_DDL).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_messages(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Messages of dialect-A lines, the first of each uuid within the watermark."""
    parsed = parse_lines(lines.where(F.col("source") == A)).where("kind = 'body' and trim(content) <> ''")
    return (
        parsed.withWatermark("loaded_at", delay)
        .dropDuplicatesWithinWatermark(["uuid"])
        .select("uuid", "source", "session_id", "parent_uuid", "role", "content", "timestamp", "is_sidechain", "jsonl_path", "line_number", "loaded_at")
    )


def append_batch(store: Store, batch: DataFrame) -> int:
    """Append a batch's new messages; their number."""
    known = batch.fillna({"jsonl_path": "", "line_number": 0})
    fresh = first_of(known, ["uuid"], "jsonl_path", "line_number", "loaded_at").join(store.read("messages").select("uuid"), "uuid", "left_anti")
    base = store.manifest()["next_seq"]
    n = materialize(arrival_numbers(fresh, F.pmod(F.xxhash64("jsonl_path"), F.lit(GROUPS)), F.col("jsonl_path"), ["jsonl_path", "line_number", "uuid"], "_n"), "stream-batch")
    count = n.count()
    if count:
        rows = n.select((F.col("_n") + (base - 1)).alias("seq"), "uuid", "source", "session_id", "parent_uuid", "role", "content", "timestamp", "is_sidechain")
        store.publish(append={"messages": rows}, next_seq=base + count)
    return count


def follow(store: Store, lines: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    w = stream_messages(lines).writeStream.foreachBatch(lambda b, _: append_batch(store, b) and None).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
