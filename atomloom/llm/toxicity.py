"""Toxicity by compression distance: zstandard dictionaries trained on windows of toxic and of ordinary text.

A text is lower-cased, runs of anything but letters and digits become one space, and its UTF-8 bytes are cut into
overlapping windows, several words each, whatever the script. One dictionary is trained (zstandard's cover algorithm) on
windows of ordinary text. Another is trained on windows of toxic text, in two rounds: half of the toxic documents train a
dictionary, and those windows of the other half that it compresses better than windows of ordinary text that no
dictionary has seen train the next one, so that strings stay which toxic documents share and ordinary ones lack.

The toxic side compresses with the toxic dictionary before the ordinary one, the ordinary side with the ordinary one alone;
the margin of a window is the difference of its compressed lengths. A document's evidence is the share of its windows whose
margin reaches each of a few thresholds; their weights are calibrated by logistic regression on labelled documents that no
dictionary was trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import materialize, sliced, table
from atomloom.llm.labelled import fold, labelled_sample, logistic_fit, sigmoid, unit_hash

#: Bytes of a window and of the step to the next: a string of up to WINDOW - STEP bytes is whole in one of them.
WINDOW, STEP = 48, 24
#: Bytes of the dictionaries: ordinary text, toxic text of the first round and of the last.
ORDINARY_BYTES, FIRST_BYTES, TOXIC_BYTES = 1 << 19, 1 << 17, 1 << 13
#: Expected windows of each class that dictionaries are trained on (or all, if there are fewer).
WINDOWS_PER_CLASS = 300_000
#: Lengths of the substrings that training counts, and of the segments it takes into a dictionary.
SUBSTRING, ORDINARY_SEGMENT, TOXIC_SEGMENT = 6, 64, 16
ROUNDS = 2
#: A toxic window goes on to the next round if its margin is above this quantile of unseen ordinary windows.
QUANTILE = 0.98
#: Ordinary windows of this share, by a hash, train nothing and stand for unseen ordinary text.
CONTROL = 0.2
MARGINS = (1, 2, 3, 4, 5, 6, 8)
HELD_OUT_FOLD, FOLDS, CALIBRATION_FOLD = 0, 5, 1
_GAP = re.compile(r"[\W_]+")


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows over the whole text; none if it has no letter or digit."""
    plain = _GAP.sub(" ", (text or "").lower()).strip()
    data = f" {plain} ".encode("utf-8", "surrogatepass")
    return [data[at : at + WINDOW] for at in range(0, max(1, len(data) - WINDOW + STEP), STEP)] if plain else []


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on windows, of at most ``size`` bytes and a quarter of their text; empty if they are too few
    or too much alike to train on. The order of the windows does not matter."""
    samples = sorted(samples, key=lambda w: (zlib.crc32(w), w))
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples, k=segment, d=SUBSTRING).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class Margins:
    """Compressed length with the ordinary dictionary less that with the toxic one before it."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        # The ordinary part stands next to the window on both sides, so only what the toxic part adds makes a difference.
        self.compressors = [self._compressor(content) for content in (ordinary, toxic + ordinary)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        parameters = zstandard.ZstdCompressionParameters(
            window_log=20, hash_log=20, chain_log=20, search_log=4, min_match=4, target_length=0, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        known = zstandard.ZstdCompressionDict(content or bytes(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters)

    def of(self, found: Sequence[bytes]) -> np.ndarray:
        ordinary, toxic = (c.compress for c in self.compressors)
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in found), np.int64, len(found))


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def evidence(margins: np.ndarray) -> list[float]:
    """For each threshold the log share of windows that reach it, then the mean margin. No windows: as of one without margin."""
    n = max(1, len(margins))
    return [*(float(np.log(np.count_nonzero(margins >= at) / n + 5e-4)) for at in MARGINS), float(margins.sum() / n)]


def drawn_windows(sample: DataFrame) -> DataFrame:
    """(y, half, part, window) of about WINDOWS_PER_CLASS windows of each class of (doc_id, text, y) rows, drawn by a hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            lists = pa.array([windows(t.as_py()) for t in batch.column("text")], pa.list_(pa.binary()))
            yield pa.record_batch([batch.column("key"), batch.column("y"), lists], names=["key", "y", "windows"])

    keyed = sample.select(F.col("doc_id").cast("string").alias("key"), "y", "text").mapInArrow(cut, "key string, y int, windows array<binary>")
    every = materialize(keyed, "toxicity-cut")
    sizes = {r["y"]: r["n"] for r in every.groupBy("y").agg(F.sum(F.size("windows")).alias("n")).collect()}
    rate = F.lit(1.0)
    for y, n in sizes.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, WINDOWS_PER_CLASS / max(1, n)))).otherwise(rate)
    flat = every.select("key", "y", F.posexplode("windows").alias("at", "window"))
    place = F.concat_ws(":", "key", F.col("at").cast("string"))
    half = F.pmod(F.shiftright(F.crc32(F.col("key").cast("binary")), 8), F.lit(2)).cast("int")
    return flat.filter(unit_hash(place, "toxicity-window") < rate).select("y", half.alias("half"), unit_hash(place, "toxicity-part").alias("part"), "window")


def dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries from the (doc_id, text, y) rows of a bounded labelled sample.

    Tasks cut and measure the windows; the driver gets a bounded number of them and trains.
    """
    drawn = materialize(drawn_windows(sample), "toxicity-windows")
    control = F.col("part") < CONTROL
    gathered = lambda rows: rows.select("window").toArrow().column("window").to_pylist()
    ordinary = trained(gathered(drawn.filter((F.col("y") == 0) & ~control)), ORDINARY_BYTES, ORDINARY_SEGMENT)
    toxic = drawn.filter(F.col("y") == 1)
    # A toxic window is measured by the other half's dictionary, an unseen ordinary one by both.
    measured = toxic.select("y", (1 - F.col("half")).alias("by"), "window").unionByName(drawn.filter((F.col("y") == 0) & control).select("y", F.explode(F.array(F.lit(0), F.lit(1))).alias("by"), "window"))
    halves = [gathered(toxic.filter(F.col("half") == h)) for h in (0, 1)]
    for step in range(ROUNDS):
        pair = [trained(h, TOXIC_BYTES if step else FIRST_BYTES, TOXIC_SEGMENT) for h in halves]

        def measure(batches: Iterator[pa.RecordBatch], pair: list[bytes] = pair) -> Iterator[pa.RecordBatch]:
            sides = [Margins(p, ordinary) for p in pair]
            for batch in batches:
                by, found = batch.column("by").to_numpy(), batch.column("window").to_pylist()
                margin = np.zeros(len(found), np.int64)
                for k, side in enumerate(sides):
                    own = np.flatnonzero(by == k)
                    margin[own] = side.of([found[i] for i in own])
                yield pa.record_batch([batch.column("y"), batch.column("by"), batch.column("window"), pa.array(margin)], names=["y", "by", "window", "margin"])

        margins = materialize(measured.mapInArrow(measure, "y int, by int, window binary, margin long"), f"toxicity-margins-{step}")
        tally = margins.filter(F.col("y") == 0).groupBy("by", "margin").count().collect()  # margins are a few small numbers
        for h in (0, 1):
            values, times = (np.array([r[c] for r in tally if r["by"] == 1 - h], dtype=np.int64) for c in ("margin", "count"))
            least = max(0.0, float(np.quantile(np.repeat(values, times), QUANTILE))) if len(values) else 0.0
            halves[h] = gathered(margins.filter((F.col("y") == 1) & (F.col("by") == 1 - h) & (F.col("margin") > least)))
    return trained(halves[0] + halves[1], TOXIC_BYTES, TOXIC_SEGMENT), ordinary


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from a bounded sample (labelled.ROWS_PER_CLASS a class) of labels outside the held-out fold.

    Without labels of both classes, or with too little text, margins are 0 and every text gets the classes' smoothed odds.
    """
    usable = fold(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD
    sample = labelled_sample(docs, labels, "toxic", usable)
    sample = materialize(sample.withColumn("fold", fold(F.col("doc_id"), FOLDS)), "toxicity-sample")
    toxic, ordinary = dictionaries(sample.filter(F.col("fold") != CALIBRATION_FOLD))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Margins(toxic, ordinary)
        for batch in batches:
            x = [evidence(side.of(windows(t.as_py()))) for t in batch.column("text")]
            yield pa.record_batch([batch.column("y").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    measured = sample.filter(F.col("fold") == CALIBRATION_FOLD).select("text", "y").mapInArrow(measure, "y int, x array<double>").collect()
    x = np.array([r["x"] for r in measured], dtype=float).reshape(-1, len(MARGINS) + 1)
    y = np.array([r["y"] for r in measured], dtype=float)
    weights = logistic_fit(x, y, ridge=0.3)
    # The sample has more of the rarer class than the labels have: probabilities are calibrated to the odds of the labels.
    known = {r["toxic"]: r["count"] for r in labels.filter(usable & F.col("doc_id").isNotNull()).groupBy("toxic").count().collect()}
    n1, n0 = known.get(1, 0), known.get(0, 0)
    if n1 and n0 and 0 < y.sum() < len(y):
        weights[-1] += np.log(n1 / n0) - np.log(y.sum() / (len(y) - y.sum()))
    return ToxicityModel(toxic, ordinary, tuple(weights))


def score(docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns ``keep`` of every document, its ``score`` and ``predicted`` (with ``prefix`` before these two names).

    Whole texts are read; a null or empty one has no windows and gets the score of a text without toxic windows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Margins(model.toxic, model.ordinary)
        for batch in sliced(batches):
            x = np.array([evidence(side.of(windows(t.as_py()))) for t in batch.column("text")]).reshape(-1, len(MARGINS) + 1)
            p = sigmoid(np.column_stack([x, np.ones(len(x))]) @ np.array(model.weights))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, f"{prefix}score", f"{prefix}predicted"])

    schema = T.StructType([docs.schema[c] for c in keep]).add(f"{prefix}score", T.DoubleType()).add(f"{prefix}predicted", T.IntegerType())
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scored, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``; rows of fold 0 of 5 are never learnt from (``held_out``; null without an id)."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"), "score", "predicted")
