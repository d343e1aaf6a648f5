"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum, over all ways
to cut it into pieces, of the product of their probabilities (forward algorithm); that of a text is the product over its
words. Piece probabilities are fitted by expectation-maximisation: expected piece counts over all segmentations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import materialize, sliced, table
from atomloom.llm.labelled import fold, unit_hash

#: Expected number of training documents of a language (or all, if there are fewer).
DOCS_PER_LANGUAGE = 1500
EM_STEPS = 3
SMOOTHING = 0.05
FOLDS, HELD_OUT_FOLD = 3, 1
#: Longer runs of letters are summed by logarithms place by place; products of piece probabilities stay in range for others.
LONG = 32
CACHE = 250_000
GROUP_WORDS = 200_000
LETTERS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"
MARK = "▁"


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that may cover a word (with a mark for its start); the number after the last is any other character."""

    ids: dict[str, int]
    prefixes: frozenset[str]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.prefixes), default=1)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = sorted({p.lower() for p in usable if regex.fullmatch(r"▁?\p{L}*", p)})
        return cls({p: k for k, p in enumerate(pieces)}, frozenset(p[:k] for p in pieces for k in range(1, len(p) + 1)))

    def ending(self, marked: str, end: int) -> Iterator[tuple[int, int]]:
        """(begin, piece) of the pieces of a marked word that end at a place."""
        for begin in range(max(0, end - self.longest), end):
            piece = self.ids.get(marked[begin:end], len(self.ids) if begin == end - 1 else None)
            if piece is not None:
                yield begin, piece

    def edges(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, begin, end, piece) of every piece occurrence, by end, and the lengths; places count the start mark."""
        other = len(self.ids)
        out: list[tuple[int, int, int, int]] = []
        ids, prefixes = self.ids, self.prefixes
        for k, word in enumerate(words):
            marked = MARK + word
            n = len(marked)
            for i in range(n):
                single = ids.get(marked[i])
                out.append((k, i, i + 1, other if single is None else single))
                for j in range(i + 2, n + 1):
                    part = marked[i:j]
                    if part not in prefixes:
                        break
                    piece = ids.get(part)
                    if piece is not None:
                        out.append((k, i, j, piece))
        a = np.array(out, dtype=np.int64).reshape(-1, 4)
        a = a[np.argsort(a[:, 2], kind="stable")]
        return a[:, 0], a[:, 1], a[:, 2], a[:, 3], np.array([len(w) + 1 for w in words], dtype=np.int64)


def forward(edges: tuple, probabilities: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums [word, place, language], word probability [word, language]) over all segmentations."""
    word, begin, end, piece, lengths = edges
    width = int(lengths.max(initial=0)) + 1
    alpha = np.zeros((len(lengths), width, probabilities.shape[1]))
    alpha[:, 0] = 1.0
    cut = np.searchsorted(end, np.arange(width + 1))
    for j in range(1, width):
        s = slice(cut[j], cut[j + 1])
        if s.start == s.stop:
            continue
        w = word[s]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        alpha[w[first], j] = np.add.reduceat(alpha[w, begin[s]] * probabilities[piece[s]], first, axis=0)
    return alpha, alpha[np.arange(len(lengths)), lengths]


def expected_counts(vocabulary: Vocabulary, words: Sequence[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in ``words`` (each so many times) under piece probabilities ``p``."""
    edges = vocabulary.edges(words)
    word, begin, end, piece, lengths = edges
    alpha, total = forward(edges, p[:, None])
    beta = np.zeros(alpha.shape[:2])
    beta[np.arange(len(lengths)), lengths] = 1.0
    order = np.argsort(-begin, kind="stable")
    at = np.searchsorted(-begin[order], -np.arange(beta.shape[1]), "left")
    stop = np.searchsorted(-begin[order], -np.arange(beta.shape[1]), "right")
    for i in range(beta.shape[1] - 1, -1, -1):
        e = order[at[i] : stop[i]]
        if len(e):
            beta[:, i] += np.bincount(word[e], weights=p[piece[e]] * beta[word[e], end[e]], minlength=len(lengths))
    share = alpha[word, begin, 0] * p[piece] * beta[word, end] / np.maximum(total[word, 0], 1e-300)
    return np.bincount(piece, weights=share * times[word], minlength=len(p))


def long_word_logs(vocabulary: Vocabulary, word: str, logs: np.ndarray) -> np.ndarray:
    """Log probability [language] of a word of any length over all segmentations; ``logs`` are those of the pieces.

    The sums of the last places are kept, as far back as a piece reaches.
    """
    marked, reach = MARK + word, vocabulary.longest
    sums = {0: np.zeros(logs.shape[1])}
    for end in range(1, len(marked) + 1):
        sums[end] = np.logaddexp.reduce([sums[begin] + logs[piece] for begin, piece in vocabulary.ending(marked, end)])
        sums.pop(end - reach, None)
    return sums[len(marked)]


def long_word_counts(vocabulary: Vocabulary, word: str, logs: np.ndarray) -> dict[int, float]:
    """Expected number of uses of each piece in one word of any length, from the log probabilities of one language."""
    marked = MARK + word
    edges = [list(vocabulary.ending(marked, end)) for end in range(1, len(marked) + 1)]
    ahead = np.full(len(marked) + 1, -np.inf)
    back = ahead.copy()
    ahead[0] = back[-1] = 0.0
    for end, found in enumerate(edges, 1):
        ahead[end] = np.logaddexp.reduce([ahead[begin] + logs[piece] for begin, piece in found])
    counts: dict[int, float] = {}
    for end in range(len(marked), 0, -1):
        for begin, piece in edges[end - 1]:
            back[begin] = np.logaddexp(back[begin], logs[piece] + back[end])
            counts[piece] = counts.get(piece, 0.0) + float(np.exp(ahead[begin] + logs[piece] + back[end] - ahead[-1]))
    return counts


@dataclass(frozen=True)
class LanguageModel:
    vocabulary: Vocabulary
    languages: tuple[str, ...]
    probabilities: np.ndarray  # [piece, language]


def train(docs: DataFrame, path: str) -> LanguageModel:
    """Piece probabilities from a bounded sample of documents with a language outside the held-out fold.

    Words of the sample are counted by Spark; each expectation step is a Spark job over the counted words that returns
    expected counts by (language, piece), which the size of the vocabulary bounds.
    """
    vocabulary = Vocabulary.load(path)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(HELD_OUT_FOLD)) != HELD_OUT_FOLD))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel(vocabulary, (), np.zeros((len(vocabulary.ids) + 1, 0)))
    rate = F.lit(1.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, DOCS_PER_LANGUAGE / n))).otherwise(rate)
    sample = usable.filter(unit_hash(F.col("doc_id"), "sample-lang") < rate).select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                if words:
                    yield pa.record_batch([pa.array([lang.as_py()] * len(words)), pa.array(words)], names=["lang", "word"])

    counted = materialize(sample.mapInArrow(split, "lang string, word string").groupBy("lang", "word").count(), "langid-words")
    n_pieces = len(vocabulary.ids) + 1
    p = np.full((n_pieces, len(languages)), 1.0 / n_pieces)
    column = {lang: k for k, lang in enumerate(languages)}
    for _ in range(EM_STEPS):
        current = p

        def expect(batches: Iterator[pa.RecordBatch], current: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            gathered = np.zeros_like(current)
            for batch in batches:
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                words, times = batch.column("word").to_pylist(), batch.column("count").to_numpy().astype(float)
                for lang in set(langs):
                    own, k = np.flatnonzero(langs == lang), column[lang]
                    short = [i for i in own if len(words[i]) <= LONG]
                    gathered[:, k] += expected_counts(vocabulary, [words[i] for i in short], times[short], current[:, k])
                    for i in own:
                        if len(words[i]) > LONG:
                            for piece, n in long_word_counts(vocabulary, words[i], np.log(current[:, k])).items():
                                gathered[piece, k] += n * times[i]
            piece, k = np.nonzero(gathered)
            yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(gathered[piece, k])], names=["k", "piece", "n"])

        sums = counted.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(p)
        counts[sums["piece"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy()
        p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)
    return LanguageModel(vocabulary, languages, p)


class Scorer:
    """Log probabilities of words under every language, with a bounded memory of those already seen."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows: dict[str, int] = {}
        self.piece_logs = np.log(model.probabilities)
        self.logs = np.zeros((CACHE, len(model.languages)), dtype=np.float32)

    def learn(self, words: list[str]) -> np.ndarray:
        """Log probabilities [word, language]."""
        out = np.zeros((len(words), self.logs.shape[1]), dtype=np.float32)
        short = next((i for i, w in enumerate(words) if len(w) > LONG), len(words))  # words come by length
        for at in range(0, short, 5000):
            stop = min(short, at + 5000)
            _, total = forward(self.model.vocabulary.edges(words[at:stop]), self.model.probabilities)
            out[at:stop] = np.log(np.maximum(total, 1e-300))
        for i in range(short, len(words)):
            out[i] = long_word_logs(self.model.vocabulary, words[i], self.piece_logs)
        return out

    def totals(self, texts: Iterator[str | None]) -> Iterator[np.ndarray | None]:
        """Log probability of each text under every language; None where it has no letter."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(words_of(text))
            size += len(group[-1])
            if size >= GROUP_WORDS:
                yield from self.of(group)
                group, size = [], 0
        yield from self.of(group)

    def of(self, group: list[list[str]]) -> Iterator[np.ndarray | None]:
        words = set(chain.from_iterable(group))
        fresh = sorted(words.difference(self.rows), key=len)
        learnt, known, logs, start = self.learn(fresh), self.rows, self.logs, len(self.rows)
        if start + len(fresh) <= CACHE:
            logs[start : start + len(fresh)] = learnt
            known.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        else:  # full: what is known stays, the rest serves this group only
            logs = np.concatenate([logs[:start], learnt])
            new = dict(zip(fresh, range(start, start + len(fresh)), strict=True))
            known = {w: new[w] if w in new else self.rows[w] for w in words}
        for text in group:
            yield logs[np.fromiter(map(known.__getitem__, text), np.int64, len(text))].sum(axis=0, dtype=np.float64) if text else None


def predict(docs: DataFrame, model: LanguageModel, keep: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns ``keep`` of every document, the likeliest language ``lang_pred`` of its whole text and as ``score`` its
    posterior under equal priors (with ``prefix`` before these two names).

    Null texts, texts without a letter, and all texts if no language was learnt get ``und`` with score 0.
    Ties go to the language that comes first in alphabetical order.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in sliced(batches):
            langs, scores = [], []
            for z in scorer.totals(t.as_py() for t in batch.column("text")):
                if z is None or not len(z):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    best = int(z.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(1.0 / np.exp(z - z[best]).sum()))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, f"{prefix}lang_pred", f"{prefix}score"])

    schema = T.StructType([docs.schema[c] for c in keep]).add(f"{prefix}lang_pred", T.StringType()).add(f"{prefix}score", T.DoubleType())
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(predicted, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``; fold 1 of 3 is never learnt from (``held_out``; null without an id)."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"), "lang_pred", "score")
