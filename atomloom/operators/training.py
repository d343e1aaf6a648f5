"""State of training runs as tables: parameters, metrics and the structures that a run is checked on."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts in the order in which they serve as check pool.
PRECEDENCE = ("test", "val", "train")


def save_checkpoint(spark: SparkSession, path: str, epoch: int, params: Mapping[str, np.ndarray]) -> None:
    """Write named parameters and the number of epochs done; an earlier checkpoint at ``path`` is replaced."""
    rows = [(epoch, name, list(v.shape), np.asarray(v, dtype=float).ravel().tolist()) for name, v in sorted(params.items())]
    spark.createDataFrame(rows, "epoch int, name string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_checkpoint(spark: SparkSession, path: str) -> tuple[int, dict[str, np.ndarray]]:
    """(epoch, parameters) of a checkpoint. Optimiser state is no part of it."""
    rows = spark.read.parquet(path).collect()
    if not rows:
        raise ValueError(f"{path} holds no parameters")
    return rows[0]["epoch"], {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in rows}


def log_metrics(losses: DataFrame, path: str, run: str) -> None:
    """Append (epoch, phase, batch_id, loss) rows of a run to the log at ``path``."""
    losses.select(F.lit(run).alias("run"), "epoch", "phase", "batch_id", "loss").write.mode("append").parquet(path)


def check_pool(parts: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` keys of the first part of PRECEDENCE that has rows; ``parts`` has ``key`` and ``split``."""
    place = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("split"))
    known = parts.select(key, place.alias("_place")).filter(F.col("_place") > 0)
    first = known.agg(F.min("_place").alias("_first"))  # one row
    return known.join(F.broadcast(first), F.col("_place") == F.col("_first")).select(key).orderBy(key).limit(n)
