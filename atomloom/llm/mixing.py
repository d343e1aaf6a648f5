"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells (source, language, topic). Expected sampled tokens of the cells are raked to the marginal targets
of each dimension in turn, never above what a cell has, until nothing moves; the rate is the largest, up to the one asked
for, at which the targets are met. A document is then sampled with its cell's probability by a hash of its id.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import materialize, sliced, table
from atomloom.llm.labelled import unit_hash
from atomloom.llm.words import groups, span_hashes

TOPICS = 8
#: Words of fewer bytes say nothing about the topic.
TOPIC_WORD_BYTES = 5
ROUNDS, TOLERANCE = 2000, 1e-10
#: Targets count as met if no share of a category, and not the rate, is further off; halvings of the rate's interval.
SHARE_TOLERANCE, HALVINGS = 1e-3, 12
OTHER, NO_TOPIC = "other", "none"
#: Production targets: shares of tokens. Categories that are not named keep their own share together, as OTHER.
SOURCE_TARGETS = {f"src{k}": 1 / 20 for k in range(20)}
LANGUAGE_TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
TOPIC_TARGETS = {f"t{k}": 1 / TOPICS for k in range(TOPICS)}
#: The most that is sampled; less if the targets ask for more tokens than a category has.
RATE = 0.5
DIMENSIONS = ("source", "lang", "topic")


def with_topics(docs: DataFrame, keep: Sequence[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of every document, its words as ``n_tokens`` and its ``topic``.

    The topic of a text is the hash bucket (t0..t7) that most of its longer words fall in, the lowest if several tie;
    a text without such words, or a null one, has topic ``none``.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, topics = [], []
            for texts in groups(batch.column("text"), lower=True):
                starts, ends, offsets = texts.words()
                longer = ends - starts >= TOPIC_WORD_BYTES
                bucket = (span_hashes(texts.data, starts, ends) >> np.uint64(61)).astype(np.int64)
                owner = np.repeat(np.arange(texts.hi - texts.lo), np.diff(offsets))
                tally = np.bincount((owner * TOPICS + bucket)[longer], minlength=(texts.hi - texts.lo) * TOPICS).reshape(-1, TOPICS)
                n += np.diff(offsets).tolist()
                topics += [f"t{k}" if some else NO_TOPIC for k, some in zip(tally.argmax(axis=1).tolist(), tally.any(axis=1).tolist(), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(topics, pa.string())], names=[*keep, f"{prefix}n_tokens", f"{prefix}topic"])

    schema = T.StructType([docs.schema[c] for c in keep]).add(f"{prefix}n_tokens", T.LongType()).add(f"{prefix}topic", T.StringType())
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(found, schema)


def category(column: Column, targets: Mapping[str, float]) -> Column:
    return F.when(column.isin(*targets), column).otherwise(F.lit(OTHER)) if targets else F.lit(OTHER)


@dataclass(frozen=True)
class Mixture:
    """Sampling probability of each cell; cells number at most the product of the named categories plus one."""

    probabilities: dict[tuple[str, str, str], float]
    achieved: dict[str, dict[str, float]]
    #: Shares asked for, and the share of all tokens that was asked for and that is got.
    wanted: dict[str, dict[str, float]]
    rate: float
    got: float

    def gap(self) -> float:
        """The furthest that a share, or the rate as a share of itself, is off."""
        shares = (abs(share - self.achieved[d][name]) for d, wanted in self.wanted.items() for name, share in wanted.items())
        return max(shares, default=0.0) if not self.rate else max(abs(self.got / self.rate - 1), *shares, 0.0)


def rake(cells: Mapping[tuple[str, str, str], float], targets: Mapping[str, Mapping[str, float]], rate: float) -> Mixture:
    """Expected tokens of each cell, raked to ``targets`` and at most the cell's tokens, for ``rate`` of all tokens.

    Categories without tokens get none, and their share goes to the others in proportion. Targets that the cells cannot
    meet (empty combinations, too few tokens) are met as nearly as the rounds come.
    """
    names = [sorted({k[d] for k in cells}) for d in range(3)]
    have = np.zeros([len(n) for n in names])
    for key, tokens in cells.items():
        have[tuple(names[d].index(key[d]) for d in range(3))] = tokens
    total = have.sum()
    if total == 0:
        return Mixture({k: rate for k in cells}, {}, {}, rate, rate)
    wanted, asked = [], {}
    for d, dimension in enumerate(DIMENSIONS):
        own = have.sum(axis=tuple(x for x in range(3) if x != d))
        named = np.array([targets[dimension].get(n, 0.0) if o > 0 else 0.0 for n, o in zip(names[d], own, strict=True)])
        free = np.array([n not in targets[dimension] for n in names[d]])
        rest = own[free].sum() / total
        share = np.where(free, own / total, named / named.sum() * (1 - rest) if named.sum() else 0.0)
        asked[dimension] = dict(zip(names[d], share.tolist(), strict=True))
        wanted.append(share * rate * total)
    fitted = have * rate
    for _ in range(ROUNDS):
        before = fitted.copy()
        for d in range(3):
            now = fitted.sum(axis=tuple(x for x in range(3) if x != d))
            factor = np.divide(wanted[d], now, out=np.zeros_like(now), where=now > 0)
            fitted = np.minimum(fitted * np.expand_dims(factor, tuple(x for x in range(3) if x != d)), have)
        if np.abs(fitted - before).max() <= TOLERANCE * total:
            break
    chance = np.divide(fitted, have, out=np.zeros_like(have), where=have > 0)
    achieved = {dim: dict(zip(names[d], (fitted.sum(axis=tuple(x for x in range(3) if x != d)) / max(fitted.sum(), 1e-300)).tolist(), strict=True)) for d, dim in enumerate(DIMENSIONS)}
    return Mixture({k: float(chance[tuple(names[d].index(k[d]) for d in range(3))]) for k in cells}, achieved, asked, rate, float(fitted.sum() / total))


def largest_feasible(cells: Mapping[tuple[str, str, str], float], targets: Mapping[str, Mapping[str, float]], rate: float) -> Mixture:
    """The raking of the largest rate, up to ``rate``, that meets the targets within SHARE_TOLERANCE.

    If none does (combinations without tokens), the raking at ``rate`` comes back with a warning that names its gap.
    """
    whole = rake(cells, targets, rate)
    if whole.gap() <= SHARE_TOLERANCE:
        return whole
    best, low, high = None, 0.0, rate
    for _ in range(HALVINGS):
        tried = rake(cells, targets, (low + high) / 2)
        if tried.gap() <= SHARE_TOLERANCE:
            best, low = tried, tried.rate
        else:
            high = tried.rate
    if best is None:
        warnings.warn(f"no rate meets the mixing targets; at {rate} a share is off by {whole.gap():.3f}", stacklevel=2)
    return best or whole


def fit(rows: DataFrame, targets: Mapping[str, Mapping[str, float]], rate: float) -> Mixture:
    """Rake the cells of (source, lang, topic, n_tokens) rows at the largest feasible rate up to ``rate``. Only cell sums, bounded by the targets, reach the driver."""
    cells = rows.groupBy(*(category(F.col(d), targets[d]).alias(d) for d in DIMENSIONS)).agg(F.sum("n_tokens").alias("tokens")).collect()
    return largest_feasible({(r["source"], r["lang"], r["topic"]): float(r["tokens"]) for r in cells}, targets, rate)


def sampling(mixture: Mixture, targets: Mapping[str, Mapping[str, float]], doc_id: Column, source: Column, lang: Column, topic: Column) -> tuple[Column, Column]:
    """(probability, kept) of a row. Rows that share an id, or have none, share one draw."""
    pairs = [x for k, p in sorted(mixture.probabilities.items()) for x in (F.lit("\x1f".join(k)), F.lit(p))]
    if not pairs:
        return F.lit(0.0), F.lit(False)
    cell = F.concat_ws("\x1f", category(source, targets["source"]), category(lang, targets["lang"]), category(topic, targets["topic"]))
    chance = F.coalesce(F.element_at(F.create_map(*pairs), cell), F.lit(0.0))
    return chance, unit_hash(F.coalesce(doc_id.cast("string"), F.lit("null")), "mixing") < chance


PRODUCTION = {"source": SOURCE_TARGETS, "lang": LANGUAGE_TARGETS, "topic": TOPIC_TARGETS}


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and draw of every document of ``documents`` for the production targets."""
    rows = materialize(with_topics(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"]), "mixing-rows")
    mixture = fit(rows, PRODUCTION, RATE)
    chance, kept = sampling(mixture, PRODUCTION, F.col("doc_id"), F.col("source"), F.col("lang"), F.col("topic"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", (chance / mixture.rate).alias("weight"), chance.alias("probability"), kept.alias("kept"))
