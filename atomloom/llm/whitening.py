"""Whitening of embeddings by a covariance from two passes.

Vectors are put on an integer grid. The first pass sums them exactly, which gives the mean; the second sums outer products of
centred vectors, one matrix product a batch; a tree of merges brings both to the driver, whose size depends on the dimension
alone. The eigenvectors are broadcast and every vector is projected.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import sliced, table

#: The grid: c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: A larger entry would leave the whole numbers that a double holds exactly; it counts as one that is not finite.
LARGEST = float(1 << 40)
COMPONENTS = 8
#: Rows that are worked on at a time.
ROWS = 1000


def grid_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows of an Arrow list column whose vector is whole, and their points on the grid.

    A null or empty vector, and one with a null or non-finite entry, is left out. Vectors of unlike lengths are an error.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(invalid="ignore"):
        good = np.isfinite(flat) & (np.abs(flat) <= LARGEST)
    kept = lengths > 0
    kept[owner[~good]] = False
    rows = np.flatnonzero(kept)
    dims = np.unique(lengths[rows])
    if len(dims) > 1:
        raise ValueError(f"vectors have unlike lengths: {dims.tolist()}")
    points = flat[kept[owner]].reshape(len(rows), int(dims[0]) if len(dims) else 0)
    return rows, np.floor(SCALE * points).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Moments:
    """``n`` vectors and their exact sums."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: whole numbers of 64 bits, or of any size where those would not do."""
        base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = [s % self.n for s in self.sums]
        away = x - base
        if self.n * (int(np.abs(away).max(initial=0)) + 1) < 1 << 62:
            return self.n * away - np.array(rest, dtype=np.int64)
        return self.n * away.astype(object) - np.array(rest, dtype=object)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles, from the exact difference."""
        return (self.centred(x) / self.n).astype(np.float64)


def square_sums(exact: np.ndarray) -> pa.Array:
    """Exact sums of squares of each row, as decimals; null beyond 38 digits."""
    if exact.dtype != object and int(np.abs(exact).max(initial=0)) ** 2 * max(1, exact.shape[1]) < 1 << 63:
        return pa.array((exact * exact).sum(axis=1)).cast(pa.decimal128(38, 0))
    totals = (sum(int(v) * int(v) for v in row) for row in exact)
    return pa.array([t if t < 10**38 else None for t in totals], pa.decimal128(38, 0))


def gathered(df: DataFrame, vector: str, of_batch: Callable[[np.ndarray], list[np.ndarray]], merge: Callable[[list, list], list]) -> list | None:
    """What ``of_batch`` makes of the grid points of each batch, merged in each task and then over all tasks by a tree. None
    without vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in sliced(batches, ROWS):
            rows, x = grid_vectors(batch.column(vector))
            if len(rows):
                found = of_batch(x)
                total = found if total is None else merge(total, found)
        if total is not None:
            yield pa.record_batch([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    def opened(row) -> list:
        return pickle.loads(bytes(row["part"]))

    either = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return df.select(vector).mapInArrow(partial, "part binary").rdd.map(opened).treeAggregate(None, either, either)


def added(a: list, b: list) -> list:
    """Sums of like parts; vectors of unlike lengths are an error."""
    if np.shape(a[-1]) != np.shape(b[-1]):
        raise ValueError(f"vectors have unlike lengths: {len(a[-1])} and {len(b[-1])}")
    return [p + q for p, q in zip(a, b, strict=True)]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``axes`` has a column for each component, divided by the root of its eigenvalue."""

    moments: Moments
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def fit(df: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all whole vectors of ``df``; None without any. Matrices of (dimension, dimension) reach the driver.

    Components without variance, up to rounding, are left out. The sign of a component is that of its largest entry.
    """
    first = gathered(df, vector, lambda x: [len(x), x.sum(axis=0).astype(object)], added)
    if first is None:
        return None
    moments = Moments(int(first[0]), [int(s) for s in first[1]])

    def scatter(x: np.ndarray) -> list[np.ndarray]:
        off = moments.offsets(x)
        return [off.T @ off]

    covariance = gathered(df, vector, scatter, added)[0] / moments.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.flatnonzero(values[:components] > len(values) * np.finfo(float).eps * max(values[0], 0.0))
    largest = np.abs(vectors[:, top]).argmax(axis=0)
    signs = np.where(vectors[largest, top] < 0, -1.0, 1.0)
    fitted = Whitening(moments, vectors[:, top] * signs / np.sqrt(values[top]), values[top] / values.sum() if len(top) else values[:0])
    if not len(top):
        return fitted

    def projected(x: np.ndarray) -> list[np.ndarray]:
        white = moments.offsets(x) @ fitted.axes  # their mean is zero, as that of the offsets
        return [white.T @ white]

    error = np.abs(gathered(df, vector, projected, added)[0] / moments.n - np.eye(len(top))).max()
    return Whitening(moments, fitted.axes, fitted.explained, float(error))


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every whole vector and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry are dropped; keys may repeat or be null. A
    deviation beyond 38 digits is null. Without vectors, or where all are alike, there are no rows. Other columns are not
    looked at.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = fit(df, vector, components)
    if fitted is None or not len(fitted.explained):
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(fitted)  # (dimension, components) numbers

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.explained)
        for batch in sliced(batches, ROWS):
            rows, x = grid_vectors(batch.column(vector))
            if not len(rows):
                continue
            each = np.repeat(np.arange(len(rows)), k)
            white = model.moments.offsets(x) @ model.axes
            columns = [
                batch.column(key).take(pa.array(rows[each])),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(each), model.moments.n, dtype=np.int64)),
                square_sums(model.moments.centred(x)).take(pa.array(each)),
                pa.array(white.ravel()),
                pa.array(np.tile(model.explained, len(rows))),
                pa.array(np.full(len(each), model.identity_error)),
            ]
            yield pa.record_batch(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(key, vector).mapInArrow(projected, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of all ``embeddings``; a deviation that a long cannot hold is null."""
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
