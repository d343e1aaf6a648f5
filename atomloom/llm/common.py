"""Shared storage and join helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds more than one row in HOT_SHARE; there are at most HOT_SHARE such keys.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs on one machine a temporary folder is used; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "atomloom-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def materialize_counting(df: DataFrame, name: str, counted: Column) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows for which ``counted`` holds, from the same job.

    A stage that is run again may count rows twice, so the number is only good to tell none from some.
    """
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(counted).alias("n")), name)
    return out, int(seen.get.get("n") or 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_on_key(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left-join ``left`` to ``right``, which has one row a key and in ``count`` the key's rows in ``left``.

    Keys with more than ``total / HOT_SHARE`` rows number at most HOT_SHARE, so that part of ``right`` is broadcast
    with a proven bound and its rows never meet in one task; all others are joined by a shuffle on the key.
    ``left`` rows whose key is null keep nulls. ``count`` is dropped from the result.
    """
    hot_from = max(2, total // HOT_SHARE)
    hot = right.filter(F.col(count) > hot_from)
    cold = right.filter(F.col(count) <= hot_from)
    mark = hot.select(F.col(key).alias("_hot_key"), F.struct(*[c for c in right.columns if c not in (key, count)]).alias("_hot"))
    marked = left.join(F.broadcast(mark), left[key] == mark["_hot_key"], "left").drop("_hot_key")
    rest = [c for c in right.columns if c not in (key, count)]
    cold = cold.select(F.col(key).alias("_cold_key"), F.struct(*rest).alias("_cold"))
    hot_rows = marked.filter(F.col("_hot").isNotNull()).withColumn("_got", F.col("_hot")).drop("_hot")
    cold_rows = marked.filter(F.col("_hot").isNull()).drop("_hot")
    cold_rows = cold_rows.join(cold, cold_rows[key] == cold["_cold_key"], "left").drop("_cold_key").withColumnRenamed("_cold", "_got")
    both = hot_rows.unionByName(cold_rows)
    return both.select(*[c for c in left.columns], *[F.col(f"_got.{c}").alias(c) for c in rest])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so that what is made of one is small on both sides of the pipe. After the last, what Arrow
    keeps for reuse goes back to the machine: the worker waits for its next task without it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
