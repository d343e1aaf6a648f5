"""Phrase collocations from sorted n-gram keys.

1. Texts become chunks: words as numbers of a dictionary of the chunk, with a 0 wherever a piece ends.
2. Words that are frequent in their language get numbers of one dictionary. Chunks list their words, equal ones meet and are
   numbered, and every chunk gets the numbers of its own words back, so that no task holds the dictionary; pieces are broken
   at all other words.
3. Pairs of numbers are counted; every chunk gets those of its pairs that are frequent, and is broken at the others.
4. Each place that begins three words or more gives one fixed-width binary key: its number and the next ones, in big-endian order.
   Chunks merge equal keys; keys are range-partitioned and sorted, and one pass over the runs of equal prefixes counts the phrases of every
   length. A run that may go on in the next partition is handed on whatever its count, and such parts are summed.
5. Phrases are scored at their cuts by joins on parts of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.llm.common import materialize, sliced, table
from atomloom.llm.words import LOWER

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
UNKNOWN = "und"
SCALE = 1000
#: Words after which a task ends its chunks; a longer text makes a longer chunk. Bytes of text that are worked on at a time.
CHUNK_WORDS, TEXT_BYTES = 1 << 21, 1 << 22
#: Blocks in which words are numbered, and in which the first phrases of a language are found.
WORD_BLOCKS, TOP_BLOCKS = 1 << 16, 256
#: Bytes of a word's number in a key.
WIDTH = 4

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~IS_BREAK
IN_WORD[[0x20, 0x09]] = False


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, opens): the lower-cased words of texts in order, and whether a piece opens at each. A null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends - ends[0]] = True  # words do not cross texts
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    breaks = np.cumsum(IS_BREAK[data] | edge[:-1])[starts] if len(data) else np.zeros(0, np.int64)
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = breaks[1:] != breaks[:-1]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(LOWER[data[inside]]))])
    return words, opens


class Chunk:
    """Words of one language as numbers from 1 of the chunk's own dictionary, with a 0 before every piece."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.counts = np.zeros(0, dtype=np.int64)
        self.codes: list[np.ndarray] = []
        self.n_words = 0

    def add(self, texts: pa.Array) -> int:
        words, opens = split_words(texts)
        numbered = words.dictionary_encode()
        own = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in numbered.dictionary.to_pylist()], dtype=np.int32)
        codes = own[numbered.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)
        counts = np.bincount(codes, minlength=len(self.numbers) + 1)[1:]
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        self.codes.append(np.insert(codes, np.flatnonzero(opens), 0))
        self.n_words += len(words)
        return len(words)


CHUNK_SCHEMA = "chunk long, lang string, words array<string>, counts array<long>, codes binary"


def chunks(docs: DataFrame, text: str = "text", lang: str = "lang", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(chunk, lang, words, counts, codes) of all texts; a chunk has texts of one language, a null language is UNKNOWN.

    The chunks of a task end together, whatever the number of languages. A chunk's words are listed with their counts; its codes
    are their places in that list from 1, as 32-bit numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            for name, c in held.items():
                if c.n_words:
                    codes = np.concatenate(c.codes).astype("<i4").tobytes()
                    yield pa.record_batch([pa.array([part << 32 | number]), pa.array([name]), pa.array([list(c.numbers)]), pa.array([c.counts]), pa.array([codes], pa.binary())], names=["chunk", "lang", "words", "counts", "codes"])
                    number += 1
            held.clear()
            size = 0

        for batch in sliced(batches):
            texts, langs = batch.column(0), batch.column(1).cast(pa.string()).fill_null(UNKNOWN)
            named = langs.dictionary_encode()
            for k, name in enumerate(named.dictionary.to_pylist()):
                own = texts.take(pa.array(np.flatnonzero(named.indices.to_numpy() == k)))
                at = 0
                weights = np.cumsum(pc.binary_length(own).fill_null(0).to_numpy())
                while at < len(own):  # some megabytes at a time
                    to = max(at + 1, int(np.searchsorted(weights, (weights[at - 1] if at else 0) + TEXT_BYTES, "right")))
                    size += held.setdefault(name, Chunk()).add(own.slice(at, to - at))
                    at = to
                    if size >= chunk_words:
                        yield from flush()
        yield from flush()

    return docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(cut, CHUNK_SCHEMA)


def known_words(listed: DataFrame, min_count: int) -> DataFrame:
    """(chunk, place, id, f, lang, word) of a chunk's words that occur ``min_count`` times in their language.

    ``listed`` has (chunk, lang, place, word, count) rows. A word has one id over all chunks, made of its block and its rank there;
    lang and word are null in all but one of its rows. One exchange by block serves the sums and the ranks.
    """
    block = F.pmod(F.xxhash64("lang", "word"), F.lit(WORD_BLOCKS))
    own = Window.partitionBy("block", "lang", "word").orderBy("chunk")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = listed.withColumn("block", block).repartition("block")
    summed = dealt.withColumns({"f": F.sum("count").over(whole), "first": F.row_number().over(own) == 1}).filter(F.col("f") >= min_count)
    rank = F.dense_rank().over(Window.partitionBy("block").orderBy("lang", "word")).cast("long")
    number = (rank - 1) * WORD_BLOCKS + F.col("block") + 1
    fits = F.when(number < 1 << 31, number).otherwise(F.raise_error(F.lit("more frequent words than numbers")).cast("long"))
    return summed.select("chunk", "place", fits.alias("id"), "f", *(F.when(F.col("first"), F.col(c)).alias(c) for c in ("lang", "word")))


def pair_codes(codes: np.ndarray) -> np.ndarray:
    """The number of each place and that of the next, in one; 0 where either is missing."""
    left = codes.astype(np.int64)
    both = np.zeros(len(codes), dtype=np.int64)
    both[:-1] = np.where((left[:-1] > 0) & (left[1:] > 0), left[:-1] << 32 | left[1:], 0)
    return both


def with_numbers(found: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk, codes) with the ids of known words, 0 at breaks and at all other words."""
    own = known.groupBy("chunk").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))

    def renumbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            codes = np.frombuffer(batch.column("codes")[0].as_py(), dtype="<i4")
            places, ids = (batch.column(c)[0].values.to_numpy() for c in ("places", "ids"))
            table_ = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.uint32)
            table_[places] = ids
            yield pa.record_batch([batch.column("chunk"), pa.array([table_[codes].tobytes()], pa.binary())], names=["chunk", "codes"])

    return found.select("chunk", "codes").join(own, "chunk").mapInArrow(renumbered, "chunk long, codes binary")


def pair_counts(numbered: DataFrame) -> DataFrame:
    """(chunk, pair, n): how often each pair of numbers occurs in each chunk."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            pairs = pair_codes(np.frombuffer(batch.column("codes")[0].as_py(), dtype=np.uint32))
            values, n = np.unique(pairs[pairs > 0], return_counts=True)
            for at in range(0, len(values), 1 << 16):
                part = values[at : at + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(part), batch.column("chunk")[0].as_py())), pa.array(part), pa.array(n[at : at + (1 << 16)])], names=["chunk", "pair", "n"])

    return numbered.mapInArrow(counted, "chunk long, pair long, n long")


def run_keys(codes: np.ndarray, frequent: np.ndarray, longest: int) -> np.ndarray:
    """(places, longest) numbers: each place that begins two frequent pairs, with the numbers after it up to the first pair that
    is not frequent; zeros beyond. ``frequent`` is sorted."""
    pairs = pair_codes(codes)
    at = np.minimum(np.searchsorted(frequent, pairs), max(0, len(frequent) - 1))
    joined = (pairs > 0) & (frequent[at] == pairs) if len(frequent) else np.zeros(len(pairs), dtype=bool)
    padded, links = np.concatenate([codes, np.zeros(longest, codes.dtype)]), np.concatenate([joined, np.zeros(longest, dtype=bool)])
    places = np.flatnonzero(joined & links[1 : len(joined) + 1])
    out = np.zeros((len(places), longest), dtype=np.uint32)
    out[:, 0], live = padded[places], np.ones(len(places), dtype=bool)
    for k in range(1, longest):
        live &= links[places + k - 1]
        out[:, k] = np.where(live, padded[places + k], 0)
    return out


def frequent_pairs(pairs: DataFrame, min_count: int) -> DataFrame:
    """(chunk, pairs, totals): the pairs of each chunk that occur ``min_count`` times in all, and, at one chunk for each pair, how
    often."""
    own = Window.partitionBy("pair").orderBy("chunk")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = pairs.withColumns({"total": F.sum("n").over(whole), "first": F.row_number().over(own) == 1}).filter(F.col("total") >= min_count)
    return summed.groupBy("chunk").agg(F.collect_list("pair").alias("pairs"), F.collect_list(F.when(F.col("first"), F.struct("pair", "total"))).alias("totals"))


def pair_phrases(frequent: DataFrame) -> DataFrame:
    """(key, a) of the frequent pairs."""
    each = frequent.select(F.inline("totals"))
    return each.select(F.unhex(F.lpad(F.hex("pair"), 4 * WIDTH, "0")).alias("key"), F.col("total").alias("a"))


def key_counts(numbered: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """(key, n): fixed-width keys of the places that are left in each chunk, equal ones merged."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            codes = np.frombuffer(batch.column("codes")[0].as_py(), dtype=np.uint32)
            keys = run_keys(codes, np.sort(batch.column("pairs")[0].values.to_numpy()), longest)
            keys = keys[np.lexsort(keys.T[::-1])]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([first, [len(keys)]]))
            packed = keys[first].astype(">u4").tobytes()
            width, step = WIDTH * longest, 1 << 16
            for lo in range(0, len(first), step):
                rows = min(step, len(first) - lo)
                offsets = (np.arange(rows + 1) * width).astype(np.int32)
                data = pa.py_buffer(packed[lo * width : (lo + rows) * width])
                yield pa.record_batch([pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), data]), pa.array(n[lo : lo + rows])], names=["key", "n"])

    return numbered.join(frequent.select("chunk", "pairs"), "chunk").mapInArrow(keyed, "key binary, n long")


class Runs:
    """Run-length counts of the prefixes of one length over sorted keys that come in batches."""

    def __init__(self, length: int, min_count: int):
        self.length, self.min_count = length, min_count
        self.open: bytes | None = None
        self.count, self.first = 0, True

    def closed(self) -> list[tuple[bytes, int]]:
        """The run that ends: frequent, or at either end of the partition, where it may be a part of a longer one."""
        keep = self.open is not None and (self.first or self.count >= self.min_count)
        out = [(self.open, self.count)] if keep else []
        self.first = self.first and self.open is None
        return out

    def add(self, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[bytes, int]]:
        prefix = keys[:, : self.length]
        starts = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(axis=1)]))
        sums = np.add.reduceat(n, starts)
        spell = lambda row: prefix[row].astype(">u4").tobytes()
        if spell(starts[0]) == self.open:
            self.count += int(sums[0])
            starts, sums = starts[1:], sums[1:]
        if not len(starts):
            return
        yield from self.closed()
        if self.first and len(starts) > 1:  # the partition's first run
            yield spell(starts[0]), int(sums[0])
            self.first, starts, sums = False, starts[1:], sums[1:]
        for k in np.flatnonzero(sums[:-1] >= self.min_count):
            yield spell(starts[k]), int(sums[k])
        self.open, self.count = spell(starts[-1]), int(sums[-1])

    def end(self) -> list[tuple[bytes, int]]:
        return [] if self.open is None else [(self.open, self.count)]


def phrase_counts(keys: DataFrame, min_count: int, longest: int) -> DataFrame:
    """(key, a): phrases of 3 to ``longest`` words that occur ``min_count`` times; a key has WIDTH bytes for each word.

    ``keys`` is range-partitioned, so it should be cheap to read twice.
    """

    def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [Runs(m, min_count) for m in range(3, longest + 1)]

        def rows(found: list[tuple[bytes, int]]) -> pa.RecordBatch:
            whole = [(k, a) for k, a in found if any(k[-WIDTH:])]  # a 0 in the last place: the piece was shorter
            return pa.record_batch([pa.array([k for k, _ in whole], pa.binary()), pa.array([a for _, a in whole], pa.int64())], names=["key", "a"])

        for batch in batches:
            if batch.num_rows:
                column = batch.column("key")
                offset = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
                flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offset : offset + batch.num_rows * WIDTH * longest]
                words = flat.view(">u4").reshape(-1, longest).astype(np.uint32)
                yield rows([x for r in runs for x in r.add(words, batch.column("n").to_numpy())])
        yield rows([x for r in runs for x in r.end()])

    parts = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run_lengths, "key binary, a long")
    return parts.groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)


def word_id(key: Column, place: Column) -> Column:
    """The number of the word at ``place`` (from 0) of a key."""
    return F.conv(F.hex(F.substring(key, place * WIDTH + 1, F.lit(WIDTH))), 16, 10).cast("long")


def scored(phrases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(key, a, l, r, n, score) of every phrase at its lowest-scoring cut.

    ``phrases`` has all frequent phrases, so both sides of every cut are among them or in the dictionary. Scores are floors of
    exact quotients: products are decimals of 38 digits.
    """
    number = F.unhex(F.lpad(F.hex("id"), 2 * WIDTH, "0"))
    parts = phrases.select("key", F.col("a").alias("f")).unionByName(dictionary.select(number.alias("key"), "f"))
    n_words = F.floor(F.octet_length("key") / WIDTH).cast("int")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), n_words - 1)))
    sides = cuts.select("key", "a", "k", F.substring("key", F.lit(1), F.col("k") * WIDTH).alias("left"), F.substring("key", F.col("k") * WIDTH + 1, F.octet_length("key")).alias("right"))
    both = sides.join(parts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    first = dictionary.select(number.alias("first"), "n")
    sized = both.join(first, F.substring("key", 1, WIDTH) == F.col("first"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(5,0)") * (exact("a") * exact("n")).cast("decimal(33,0)"), exact("l") * exact("r"))
    lowest = F.min(F.struct(quotient.alias("score"), "k", "l", "r", "n")).alias("low")
    return sized.groupBy("key", "a").agg(lowest).select("key", "a", "low.l", "low.r", "low.n", "low.score")


def maximal(phrases: DataFrame) -> DataFrame:
    """Keys of phrases (key, a) that no longer phrase contains as often as they occur themselves.

    Counts fall from a phrase to a longer one, so it is enough to look at phrases of one more word.
    """
    size = F.octet_length("key")
    inner = F.explode(F.array(F.substring("key", F.lit(1), size - WIDTH), F.substring("key", F.lit(WIDTH + 1), size))).alias("key")
    longer = phrases.filter(size > 2 * WIDTH).select(inner, "a").groupBy("key").agg(F.max("a").alias("longer"))
    return phrases.join(longer, "key", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("key")


def spelled(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``rows`` of distinct keys with ``lang`` and the space-joined ``phrase``."""
    n_words = F.floor(F.octet_length("key") / WIDTH).cast("int")
    each = rows.select("key", F.explode(F.sequence(F.lit(0), n_words - 1)).alias("place")).withColumn("id", word_id(F.col("key"), F.col("place")))
    named = each.join(dictionary.select("id", "lang", "word"), "id").groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    return rows.join(named, "key")


def first_of_each(rows: DataFrame, by: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each ``by`` with their ``rank``; those of each block are found before all of one value meet."""
    block = F.pmod(F.xxhash64("key"), F.lit(TOP_BLOCKS))
    near = rows.withColumn("block", block).withColumn("rank", F.row_number().over(Window.partitionBy(by, "block").orderBy(*order))).filter(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= top).drop("block")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A-Z are lowered; texts are cut at ``.,;:!?`` and line ends into pieces and these at spaces and tabs into words. Null texts have
    no words, null languages count as UNKNOWN; repeated rows count each time; other columns are not looked at. A phrase of 2
    to ``longest`` words that occurs ``min_count`` times scores floor(1000 a n / (l r)) at its lowest-scoring cut, and is left out
    if a longer one contains it just as often.
    """
    found = materialize(chunks(docs, chunk_words=chunk_words), "phrase-chunks")
    listed = found.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    listed = listed.select("chunk", "lang", (F.col("at") + 1).alias("place"), F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    sizes = found.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, c: x + c)).alias("n"))
    known = materialize(known_words(listed, min_count), "phrase-words")
    dictionary = materialize(known.filter(F.col("word").isNotNull()).select("lang", "word", "f", "id").join(sizes, "lang"), "phrase-dictionary")
    numbered = materialize(with_numbers(found, known), "phrase-numbers")
    frequent = materialize(frequent_pairs(pair_counts(numbered), min_count), "phrase-pairs")
    phrases = pair_phrases(frequent)
    if longest > 2:
        keys = materialize(key_counts(numbered, frequent, longest), "phrase-keys")
        phrases = phrases.unionByName(phrase_counts(keys, min_count, longest))
    phrases = materialize(phrases, "phrase-counts")
    left = spelled(scored(phrases, dictionary).join(maximal(phrases), "key", "left_semi"), dictionary)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    longs = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return first_of_each(left, "lang", order, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *longs)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))
