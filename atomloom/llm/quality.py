"""Quality rules: base counts by rule, then hashed n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import materialize, sliced, table
from atomloom.llm.labelled import fold, labelled_sample, logistic_fit, sigmoid
from atomloom.llm.words import BASE, IS_WORD, Texts, groups, mix, span_hashes, windows

#: Hashed features: words and word pairs share one half of the table, character n-grams have the other.
BITS = 17
CHAR_GRAMS = (2, 4)
ROWS_PER_CLASS = 3000
#: Partitions of the fit: each step of it sums one gradient of the whole feature table a partition.
FIT_PARTITIONS = 4
CALIBRATION_FOLD, FOLDS = 0, 5
#: Documents with a smaller probability of quality 1 are dropped.
MIN_PROBABILITY = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(texts: Texts, starts: np.ndarray, ends: np.ndarray, word_offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A row of BASE_COUNTS for each text."""
    n = texts.hi - texts.lo
    lead = (texts.data & 0xC0) != 0x80
    out = np.zeros((n, 5), dtype=np.int64)
    out[:, 0] = np.diff(word_offsets)
    out[:, 1] = sums(lead & IS_WORD[texts.data], texts.offsets)
    out[:, 2] = sums(SYMBOLS[texts.data], texts.offsets)
    breaks = np.flatnonzero(texts.data == 10)
    line_starts = np.unique(np.concatenate([texts.offsets[:-1], breaks + 1]))
    owner = np.searchsorted(texts.offsets, line_starts, "right") - 1
    keep = line_starts < len(texts.data)
    line_starts, owner = line_starts[keep], owner[keep]
    line_ends = np.minimum(np.concatenate([line_starts[1:], [len(texts.data)]]), texts.offsets[owner + 1])
    line_ends = line_ends - ((line_ends > line_starts) & (texts.data[line_ends - 1] == 10))
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, owner = line_starts[with_word], line_ends[with_word], owner[with_word]
    line_hash = span_hashes(texts.data, line_starts, line_ends)
    line_cut = np.searchsorted(owner, np.arange(n + 1))
    runs, place = windows(hashes, word_offsets, REPEAT_WINDOW)
    run_cut = np.searchsorted(place, word_offsets)
    for i in range(n):
        lines = line_hash[line_cut[i] : line_cut[i + 1]]
        if len(lines) > 1:
            out[i, 3] = len(lines) - len(np.unique(lines))
        own = runs[run_cut[i] : run_cut[i + 1]]
        if len(own) > 1:
            again = np.flatnonzero(repeated(own))
            if len(again):
                step = np.zeros(word_offsets[i + 1] - word_offsets[i] + 1, dtype=np.int64)
                first = place[run_cut[i] : run_cut[i + 1]][again] - word_offsets[i]
                np.add.at(step, first, 1)
                np.add.at(step, first + REPEAT_WINDOW, -1)
                out[i, 4] = np.count_nonzero(np.cumsum(step)[:-1])
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, places of their first bytes) of UTF-8 bytes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.uint32)
    length = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    value = np.where(length == 1, first, first & (0x7F >> length).astype(np.uint32))
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    for k in (1, 2, 3):
        value = np.where(length > k, value << np.uint32(6) | padded[lead + k] & np.uint32(0x3F), value)
    return value, lead


def features(texts: Texts, hashes: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram: words, word pairs, and n-grams of CHAR_GRAMS characters (code points), spaces included."""
    half = np.uint64(1 << (BITS - 1))
    n = texts.hi - texts.lo
    pairs, place = windows(hashes, word_offsets, 2)
    word_owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(word_offsets))
    buckets = [(hashes & (half - np.uint64(1))).astype(np.int32), (pairs & (half - np.uint64(1))).astype(np.int32)]
    owners = [word_owner, word_owner[place]]
    points, lead = code_points(texts.data)
    wide = points.astype(np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.searchsorted(lead, texts.offsets)))
    for width in CHAR_GRAMS:
        m = len(wide) - width + 1
        if m <= 0:
            continue
        gram = np.full(m, width, dtype=np.uint64)
        for k in range(width):  # four code points are 84 bits: the sum is taken modulo 2**64
            gram = gram * BASE + wide[k : m + k]
        inside = owner[:m] == owner[width - 1 :]
        buckets.append(((mix(gram[inside]) & (half - np.uint64(1))) | half).astype(np.int32))
        owners.append(owner[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class QualityModel:
    weights: bytes  # float32, one a bucket
    intercept: float
    calibration: tuple[float, float]

    def probabilities(self, buckets: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """Calibrated probability of quality 1: features are counts divided by their number in the text."""
        w = np.frombuffer(self.weights, dtype=np.float32)
        total = np.bincount(owners, weights=w[buckets], minlength=n)
        raw = total / np.maximum(np.bincount(owners, minlength=n), 1) * SCALE + self.intercept
        return sigmoid(self.calibration[0] * raw + self.calibration[1])


#: Shares of n-grams are multiplied by this, so that the penalty of the regression acts on weights of usual size.
SCALE = 100.0


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, fold, indices, values) of labelled rows."""
    for batch in batches:
        indices, values = [], []
        for texts in groups(batch.column("text")):
            starts, ends, word_offsets = texts.words()
            buckets, owners = features(texts, span_hashes(texts.data, starts, ends), word_offsets)
            order = np.argsort(owners, kind="stable")
            cut = np.searchsorted(owners[order], np.arange(texts.hi - texts.lo + 1))
            for i in range(texts.hi - texts.lo):
                index, count = np.unique(buckets[order[cut[i] : cut[i + 1]]], return_counts=True)
                indices.append(index.astype(np.int32))
                values.append(count / max(1, count.sum()) * SCALE)
        yield pa.record_batch(
            [batch.column("y").cast(pa.int32()), batch.column("fold").cast(pa.int32()), pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
            names=["y", "fold", "indices", "values"],
        )


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> QualityModel:
    """Fit on a bounded sample (ROWS_PER_CLASS a class) of labelled rows and calibrate on a fold left out of the fit.

    ``usable`` narrows the labels that may be read, by a condition on doc_id. A document labelled twice counts with its
    larger label. Without labels of both classes all texts get one probability, the share of label 1 (1 without labels).
    """
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, ROWS_PER_CLASS).withColumn("fold", fold(F.col("doc_id"), FOLDS))
    rows = materialize(sample.select("text", "y", "fold").mapInArrow(vectors, "y int, fold int, indices array<int>, values array<double>"), "quality-vectors")
    size = 1 << BITS
    as_vector = F.udf(lambda i, v: SparseVector(size, i, v), VectorUDT())
    fitted = rows.filter(F.col("fold") != CALIBRATION_FOLD).select(F.col("y").cast("double").alias("label"), as_vector("indices", "values").alias("features"))
    # The sample is bounded: its vectors are made once, in a few files, and each step of the fit reads only these.
    fitted = materialize(fitted.coalesce(FIT_PARTITIONS), "quality-fit")
    if fitted.select("label").distinct().count() < 2:
        share = rows.agg(F.coalesce(F.avg("y"), F.lit(1.0))).first()[0]
        return QualityModel(np.zeros(size, np.float32).tobytes(), 0.0, (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    model = LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(fitted)
    weights = model.coefficients.toArray().astype(np.float32)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [float(weights[np.array(i.as_py(), dtype=np.int64)] @ np.array(v.as_py())) for i, v in zip(batch.column("indices"), batch.column("values"), strict=True)]
            yield pa.record_batch([batch.column("y"), pa.array(z, pa.float64())], names=["y", "z"])

    held = rows.filter(F.col("fold") == CALIBRATION_FOLD).mapInArrow(raw, "y int, z double").toPandas()
    a, b = logistic_fit(held[["z"]].to_numpy(dtype=float) + model.intercept, held["y"].to_numpy(dtype=float), ridge=1e-3)
    return QualityModel(weights.tobytes(), float(model.intercept), (float(a), float(b)))


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Counts, base verdict, probability and verdict of every document.

    A null or empty text has no words and fails the base rules; so does every text under MIN_WORDS words or with more
    than MAX_REPEAT_PERCENT percent of its words in repeated windows. Only doc_id and text are read.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, probability = [np.zeros((0, 5), np.int64)], [np.zeros(0)]
            for texts in groups(batch.column("text")):
                starts, ends, word_offsets = texts.words()
                hashes = span_hashes(texts.data, starts, ends)
                counts.append(base_counts(texts, starts, ends, word_offsets, hashes))
                probability.append(model.probabilities(*features(texts, hashes, word_offsets), texts.hi - texts.lo))
            c, p = np.concatenate(counts), np.concatenate(probability)
            failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
            kept = ~failed & (p >= MIN_PROBABILITY)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c[:, k]) for k in range(5)], pa.array(failed), pa.array(kept), pa.array(p)], names=["doc_id", *BASE_COUNTS, "base_failed", "kept", "probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE_COUNTS) + ", base_failed boolean, kept boolean, probability double"
    return docs.select("doc_id", "text").mapInArrow(judged, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
