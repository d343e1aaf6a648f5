"""Libraries of tokenised structures: incremental writes, shuffles, splits, shards, batches and run statistics."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def arithmetic_key(number: Column, seed: int) -> Column:
    """A pseudo-random order of integer ids that other engines can compute too."""
    return F.pmod(F.pmod(number, F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))


def ranked(rows: DataFrame, key: Column, tie: str, buckets: int = 1024) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of (key, tie), without one task that sorts them all.

    ``key`` is an integer in [0, 2**32). Rows are ranked inside equal ranges of it and each range is shifted by the number
    of rows in the ranges before, of which there are ``buckets``.
    """
    cut = rows.withColumn("_key", key).withColumn("_range", F.floor(F.col("_key") * F.lit(buckets) / F.lit(4294967296)).cast("int"))
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key", tie)) - 1
    return cut.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn("rank", (F.col("_inside") + F.col("_before")).cast("long")).drop("_key", "_range", "_inside", "_before")


def split_sizes(n: int, validation: float, test: float) -> tuple[int, int]:
    """Rows of the validation and test parts: at least one for a positive share; they must leave some for training."""
    sizes = tuple(max(1, round(f * n)) if f > 0 else 0 for f in (validation, test))
    if sum(sizes) >= n:
        raise ValueError(f"{n} rows cannot be split into {sizes[0]} and {sizes[1]} with some left")
    return sizes


def split(rows: DataFrame, key: Column, tie: str, validation: float, test: float) -> DataFrame:
    """``rows`` with ``split``: the first by shuffled rank are val, the next test, the rest train; sizes are exact."""
    n_val, n_test = split_sizes(rows.count(), validation, test)
    part = F.when(F.col("rank") < n_val, "val").when(F.col("rank") < n_val + n_test, "test").otherwise("train")
    return ranked(rows, key, tie).withColumn("split", part).drop("rank")


def shard(rows: DataFrame, key: Column, tie: str, n_shards: int) -> DataFrame:
    """``rows`` with ``shard``: position in the order modulo ``n_shards``."""
    if n_shards < 1:
        raise ValueError("there must be a shard")
    return ranked(rows, key, tie).withColumn("shard", F.pmod("rank", F.lit(n_shards)).cast("int")).drop("rank")


def batches(rows: DataFrame, key: Column, tie: str, size: int) -> DataFrame:
    """``rows`` with ``batch_id``: runs of ``size`` in shuffled order; the last may be short."""
    return ranked(rows, key, tie).withColumn("batch_id", F.floor(F.col("rank") / size).cast("long")).drop("rank")


def new_rows(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key the library does not have yet."""
    return rows.join(present.select(key).distinct(), key, "left_anti")


def append_library(tokens: DataFrame, path: str, limit: int | None = None) -> dict[str, int]:
    """Append structures that the library at ``path`` lacks, at most ``limit`` new ones (by id); returns counts.

    A second call with the same tokens writes nothing.
    """
    spark = tokens.sparkSession
    ids = tokens.select("structure_id").distinct()
    try:
        present = spark.read.parquet(path).select("structure_id").distinct()
    except Exception as e:  # no library yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        present = ids.limit(0)
    # One scan of both sides; the counts and the write read what is kept of it.
    state = ids.join(present.withColumn("_known", F.lit(True)), "structure_id", "left").persist()
    fresh = state.filter(F.col("_known").isNull()).select("structure_id")
    if limit is not None:
        fresh = fresh.orderBy("structure_id").limit(limit)
    already, total = state.agg(F.count("_known"), F.count(F.lit(1))).first()
    written = min(total - already, total if limit is None else limit)
    tokens.join(fresh, "structure_id", "left_semi").write.mode("append").parquet(path)
    state.unpersist()
    return {"written": written, "present": already, "left": total - written - already}


def within_size(library: DataFrame, max_atoms: int) -> DataFrame:
    """Tokens of the structures of at most ``max_atoms`` atoms."""
    sizes = library.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms")).filter(F.col("n_atoms") <= max_atoms)
    return library.join(sizes.select("structure_id"), "structure_id", "left_semi")


def load_targets(library: DataFrame, n_targets: int, max_atoms: int | None, seed: int, key: Column | None = None) -> DataFrame:
    """Tokens of ``n_targets`` structures of at most ``max_atoms`` atoms in a seeded order (or that of ``key``); the limit
    counts what passes."""
    fit = library if max_atoms is None else within_size(library, max_atoms)
    chosen = fit.select("structure_id").distinct().orderBy(F.xxhash64("structure_id", F.lit(seed)) if key is None else key, "structure_id").limit(n_targets)
    return library.join(chosen, "structure_id", "left_semi")


def cached(spark: SparkSession, path: str, key: Mapping[str, object], build) -> DataFrame:
    """The table below ``path`` that was built with ``key``; else ``build()`` written there. The seed is no part of a key.

    Each key has a folder of its own, so a write that is cut short never leaves data under another key.
    """
    folder = f"{path}/{hashlib.sha256(json.dumps(dict(key), sort_keys=True).encode()).hexdigest()[:32]}"
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def size_statistics(tokens: DataFrame) -> DataFrame:
    """(n_structures, least, mean, most) atoms of a structure."""
    sizes = tokens.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_structures"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def epoch_statistics(losses: DataFrame) -> DataFrame:
    """(epoch, phase, mean, least, most) of (epoch, phase, batch_id, loss); batches weigh alike."""
    return losses.groupBy("epoch", "phase").agg(F.avg("loss").alias("mean"), F.min("loss").alias("least"), F.max("loss").alias("most"))
