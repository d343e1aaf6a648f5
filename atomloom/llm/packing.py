"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of binary lengths: as many of the longest as fit, then one for each bit of the rest, longest
first. Every piece is a sequence of its own and sequences of one length make a bucket, so no sequence crosses documents and
none has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.llm.common import materialize, sliced, table
from atomloom.llm.wavelet import encoder

LONGEST = 2048
END_ID = 1
#: Tokens after which a task hands on what it has cut.
FLUSH_TOKENS = 1 << 20


def piece_lengths(n: int, longest: int = LONGEST) -> np.ndarray:
    """The lengths that ``n`` ids are cut into: powers of two of at most ``longest``, none shorter twice."""
    rest = n % longest
    bits = 1 << np.flatnonzero([rest >> b & 1 for b in range(longest.bit_length())])[::-1]
    return np.concatenate([np.full(n // longest, longest, dtype=np.int64), bits.astype(np.int64)])


def cut_pieces(docs: DataFrame, path: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, part, place) of every piece of every document.

    ``ids`` has the piece's ids as little-endian unsigned 32-bit numbers; each document's end with ``end_id``, so a null or empty
    text is one piece of one id. ``place`` counts a task's pieces of a length, ``part`` is the task. Rows that share a
    doc_id, or have none, are documents of their own. Other columns are not looked at.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, placed = encoder(path), TaskContext.get().partitionId(), np.zeros(longest.bit_length(), dtype=np.int64)

        def flush(rows: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
            each = [piece_lengths(len(ids), longest) for ids in held]
            lengths = np.concatenate(each)
            ends = np.cumsum(lengths)
            owner = np.repeat(np.arange(len(held)), [len(x) for x in each])
            sizes = np.array([len(ids) for ids in held], dtype=np.int64)
            starts = ends - lengths - (np.cumsum(sizes) - sizes)[owner]
            level = np.round(np.log2(lengths)).astype(np.int64)
            place = np.empty(len(lengths), dtype=np.int64)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                place[at] = placed[k] + np.arange(len(at))
                placed[k] += len(at)
            offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(held))])
            columns = [rows.take(pa.array(owner)), pa.array(starts), pa.array(lengths), pa.array(sizes[owner]), ids, pa.array(np.full(len(lengths), part, dtype=np.int32)), pa.array(place)]
            return pa.record_batch(columns, names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"])

        for batch in sliced(batches, 500):
            held, tokens, first = [], 0, 0
            for k, raw in enumerate(words.encode_many(batch.column("text"))):
                ids = np.frombuffer(raw, dtype=words.kind).astype("<u4")
                ids[-1] = end_id  # in the place of the encoder's own end
                held.append(ids)
                tokens += len(ids)
                if tokens >= FLUSH_TOKENS or k + 1 == batch.num_rows:
                    yield flush(batch.column("doc_id").slice(first, len(held)), held)
                    held, tokens, first = [], 0, k + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, part int, place long")


def number_sequences(pieces: DataFrame) -> DataFrame:
    """``pieces``, of which part and place do not change when they are read again, with ``bucket_row`` and ``sequence_id``.

    Both are gapless from 0: rows in the bucket of a length, sequences over all buckets, longest first. Only counts by
    (length, part) are put in order, so no task sorts a bucket.
    """
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    # One row a length: log2(longest) + 1 of them at most.
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))
    placed = pieces.join(starts, ["length", "part"]).join(F.broadcast(buckets), "length")
    row = (F.col("first") + F.col("place")).cast("long")
    return placed.withColumn("bucket_row", row).withColumn("sequence_id", (F.col("base") + row).cast("long")).drop("part", "place", "first", "base")


def pack(docs: DataFrame, path: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, bucket_row, sequence_id): every sequence of every document, each of a length that
    is a power of two. Pieces are written once, so that their numbers survive lost executors."""
    return number_sequences(materialize(cut_pieces(docs, path, longest, end_id), "packing-pieces"))


def write_buckets(packed: DataFrame, folder: str, rows_per_file: int = 1 << 18) -> None:
    """Write sequences as arrays of ids, a folder ``length=...`` for each bucket.

    Rows are dealt by bucket and blocks of ``rows_per_file``, so a bucket has many files and a file one length.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = np.frombuffer(b"".join(ids.to_pylist()), dtype="<i4")
            ends = np.concatenate([[0], np.cumsum(batch.column("length").to_numpy())]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.record_batch([*(batch.column(c) for c in ("sequence_id", "doc_id", "start", "length")), arrays], names=["sequence_id", "doc_id", "start", "length", "token_ids"])

    kind = packed.schema["doc_id"].dataType.simpleString()
    dealt = packed.repartition("length", F.floor(F.col("bucket_row") / rows_per_file))
    dealt.mapInArrow(listed, f"sequence_id long, doc_id {kind}, start long, length long, token_ids array<int>").write.partitionBy("length").parquet(folder)


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` in sequences of binary lengths; a sequence has one piece, at offset 0."""
    pieces = materialize(cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "packing-pieces")
    checked = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")  # ids stay where they are written
    return number_sequences(checked).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
