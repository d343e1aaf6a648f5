"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.llm.common import table

#: Rows that one slot-numbering block holds on average; a block is the largest group that one task sorts.
BLOCK_ROWS = 200_000


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..len(weights)-1 of the highest weighted score ``-w / ln(u(key, shard))``.

    Each shard's score depends on the key and that shard alone, so one more shard takes rows only into itself and a
    removed shard gives up only its own. A null key is hashed as the text ``null``; a weight of 0 gets nothing.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative and one of them positive")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11)
            unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
            scores.append(F.struct((F.lit(-float(weight)) / F.log(unit)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def shard_rows(
    rows: DataFrame, key: str, payload: Column, weights: Sequence[float], grown: Sequence[float] | None = None, n_rows: int | None = None
) -> DataFrame:
    """Every row of ``rows`` with its size, checksum, shard and slot.

    * ``size``: UTF-8 bytes of ``payload`` plus 1 (null: 1); ``text_crc32``: unsigned CRC-32 of those bytes (null: 0).
    * ``shard``: rendezvous shard of ``key``; ``grown_shard``: the same with ``grown`` weights (null if not given).
    * ``slot``: gapless from 0 in each shard. Rows of a shard are dealt by a hash of the key to blocks of about
      BLOCK_ROWS rows; slots follow (block, key, checksum, size), so no task ever sorts a whole shard. Repeated rows
      are alike and take neighbouring slots in any order.

    Rows that share a key share a block, whatever their number; a null key counts as the text ``null``.
    An empty input gives an empty result. Other columns of ``rows`` are not looked at.
    """
    keyed = rows.select(F.col(key).alias("key"), payload.cast("string").alias("payload"))
    n_rows = rows.count() if n_rows is None else n_rows
    blocks = max(1, -(-n_rows // (BLOCK_ROWS * len(weights))), 16)
    placed = keyed.withColumns(
        {
            "shard": rendezvous_shard(F.col("key"), weights),
            "grown_shard": rendezvous_shard(F.col("key"), grown) if grown else F.lit(None).cast("int"),
            "block": F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit("block")), F.lit(blocks)).cast("int"),
        }
    )
    # Counts need only the key column of the scan. Their number is shards x blocks, never the number of rows.
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    sized = placed.select(
        "key",
        (F.coalesce(F.octet_length("payload"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("payload"), F.lit("")).cast("binary")).alias("text_crc32"),
        "shard",
        "grown_shard",
        "block",
    )
    in_block = Window.partitionBy("shard", "block").orderBy("key", "text_crc32", "size")
    numbered = sized.withColumn("rank", F.row_number().over(in_block) - 1)
    return numbered.join(starts, ["shard", "block"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("rank")).cast("long").alias("slot"),
        "grown_shard",
    )


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7 of equal weight, and where a ninth shard would move them."""
    docs = table(spark, sf_dir, "documents")
    return shard_rows(docs, "doc_id", F.col("text"), [1.0] * 8, [1.0] * 9)
