"""Bounded samples of labelled documents, and the calibration that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expected number of labelled documents of each class that a classifier is fitted on (or all, if there are fewer).
ROWS_PER_CLASS = 4000


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, text, y) of about ``per_class`` documents of each class 0/1, drawn by a hash of the id.

    ``usable`` is a condition on doc_id; rows outside it are never read as labels. A doc_id that is labelled twice
    counts with its largest label; null ids and labels are left out. The drawn labels number about 2 x per_class at
    any input size, so broadcasting them is bounded and the documents are not shuffled.
    """
    clean = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    rate = F.lit(1.0)
    for y, n in sizes.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(rate)
    drawn = clean.filter(unit_hash(F.col("doc_id"), f"sample-{label}") < rate)
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, intercept last, of a ridge-penalised logistic regression of a few features (Newton steps).

    Without rows of both classes the slope is 0 and the intercept is the smoothed log-odds of the classes.
    """
    a = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, x.shape[1] + 1))
    w = np.zeros(a.shape[1])
    positives = float(np.sum(y))
    if positives in (0.0, float(len(y))):
        w[-1] = np.log((positives + 0.5) / (len(y) - positives + 0.5))
        return w
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(50):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        w -= step * min(1.0, 5.0 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
