"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

A text longer than a chunk is cut into overlapping chunks, which are
pre-tokenised. The pre-tokenizer's matches depend on where it starts, but from
any boundary two runs share they agree; so neighbouring chunks are stitched at
the first boundary that both find in their overlap, and the pieces between the
stitches are encoded and concatenated. A text in which two chunks share no
boundary (one pre-token longer than the overlap) is encoded whole. Texts of up
to SPREAD characters are chunked inside their task; chunks of longer ones are
pre-tokenised, and their pieces encoded, in parallel.

The vocabulary file is read on the driver (its size is checked; it is under
1 MB) and sent to the workers, so executors need no copy of it.

Nulls and odd texts: a null and an empty text both give no ids. Strings that
look like special tokens are ordinary text. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

VOCAB_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCAB_BYTES = 64 << 20
#: Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, OVERLAP = 1 << 10, 1 << 7
SPREAD = 1 << 20  # characters of a text from which on its chunks, then of a quarter of this, are spread over tasks

_encodings: dict[str, object] = {}


def read_vocab(path: str = VOCAB_PATH) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCAB_BYTES + 1)
    if len(raw) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return raw


def encoding(raw: bytes):
    """The tokenizer of a vocabulary file's bytes, built once per process."""
    key = hashlib.md5(raw).hexdigest()
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding(f"bpe-{key[:8]}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pretoken_starts(text: str) -> list[int]:
    import regex

    return [m.start() for m in regex.finditer(PATTERN, text)]


def edges_of(piece: str, lo: int, step: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries at both ends of a chunk that starts at lo, at which a text may be cut.

    Not after white space: where a text ends, it makes other tokens than before a word. The last two boundaries in a
    chunk may be an effect of its end.
    """
    at = pretoken_starts(piece)
    heads = [lo + s for s in at if s < overlap and not (s and piece[s - 1].isspace())]
    return heads, [lo + s for s in at[:-2] if s >= step and not piece[s - 1].isspace()]


def stitches(chunks: Iterable[tuple[list[int], list[int]]]) -> list[int]:
    """Starts of the pieces from (heads, tails) of a text's chunks in order; only 0 if two share no boundary."""
    starts, before = [0], None
    for heads, tails in chunks:
        if before is not None:
            shared = set(before).intersection(heads)
            if not shared:
                return [0]
            starts.append(min(shared))
        before = tails
    return starts


def encode_text(enc, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    if not text:
        return []
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    los = range(0, len(text), chunk)
    starts = stitches(edges_of(text[lo : lo + chunk + overlap], lo, chunk, overlap) for lo in los)
    return [i for a, b in zip(starts, [*starts[1:], len(text)]) for i in enc.encode_ordinary(text[a:b])]


def encode_documents(docs: DataFrame, vocab_path: str = VOCAB_PATH, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(read_vocab(vocab_path))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text")
    # Rows of long texts get a number that holds wherever they are read again.
    long = materialize(rows.where(size > spread).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    return _encode_here(rows.where(size <= spread), raw, chunk, overlap).unionByName(_encode_spread(long, raw, max(chunk, spread // 4), max(overlap, min(1 << 12, spread // 8))))


def _encode_here(rows: DataFrame, raw, chunk: int, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value)
        for b in batches:
            ids = [encode_text(enc, t, chunk, overlap) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def _encode_spread(rows: DataFrame, raw, chunk: int, overlap: int) -> DataFrame:
    """rows: doc_id, text, row (unique)."""
    # At most 256 chunks a text, so that cutting stays linear in its length.
    step = F.greatest(F.lit(chunk), F.ceil(F.char_length("text") / F.lit(256)).cast("int"))
    numbered = rows.withColumn("step", step).withColumn("size", F.char_length("text"))
    chunks = numbered.select("row", "step", "text", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / F.col("step")).cast("int"))).alias("part"))
    cut = chunks.select("row", "part", (F.col("part") * F.col("step")).cast("bigint").alias("lo"), "step", F.expr("substring(text, part * step + 1, step + %d)" % overlap).alias("piece"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [edges_of(piece, lo, step_, overlap) for lo, step_, piece in zip(b["lo"].to_pylist(), b["step"].to_pylist(), b["piece"].to_pylist())]
            heads, tails = list(zip(*found)) or ([], [])
            yield pa.RecordBatch.from_arrays([b["row"], b["part"], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["row", "part", "heads", "tails"])

    found = cut.repartition("row", "part").mapInArrow(edges, "row bigint, part int, heads array<bigint>, tails array<bigint>")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = [stitches((e["heads"], e["tails"]) for e in edges) for edges in b["edges"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(starts, pa.list_(pa.int64()))], names=["row", "starts"])

    # One row per text, of at most 256 chunks with two short lists each.
    gathered = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "heads", "tails"))).alias("edges"))
    plan = gathered.mapInArrow(stitch, "row bigint, starts array<bigint>")
    pieces = numbered.join(plan, "row").select("doc_id", "row", "text", "size", "starts", F.posexplode("starts").alias("part", "a")).select(
        "doc_id", "row", "part", F.expr("substring(text, int(a + 1), int(coalesce(get(starts, part + 1), size) - a))").alias("piece")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value)
        for b in batches:
            ids = [enc.encode_ordinary(t) for t in b["piece"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], b["part"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "part", "ids"])

    parts = pieces.repartition("row", "part").mapInArrow(encode, "doc_id bigint, row bigint, part int, ids array<int>")
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids"))


def count_tokens(docs: DataFrame, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """docs' columns and n_tokens."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def n(text):
        import pandas as pd

        enc = encoding(raw.value)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in text], dtype="int32")

    return docs.withColumn("n_tokens", n("text"))


def decode_ids(encoded: DataFrame, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """(doc_id, text): raw bytes of the ids, concatenated."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([enc.decode_bytes(x).decode("utf-8") for x in b["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id bigint, text string")
