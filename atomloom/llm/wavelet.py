"""Token ids in one compressed wavelet-matrix file a shard.

A wavelet matrix keeps one bit-plane a bit of the ids; each plane is ordered by the bits above it, zeros before ones. With
counts of ones before each 64-bit word, a plane answers rank and select, and the planes together answer what token stands
at a place, how often a token occurs before a place, and where its k-th occurrence is.

A file keeps its planes in blocks that are compressed one by one. Its directory has each block's place in the file and the
ones before it (rank, and by binary search select); each block begins with the ones before every fourth of its words. So a
single answer reads the directory and one or two blocks a plane, by their byte ranges.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.bpe import byte_alphabet
from atomloom.llm.common import materialize, shared_dir, sliced, table
from atomloom.llm.files import put, read_files

MAGIC = b"WMTX0002"
#: Words of 64 bits in a block of a plane, and words from one stored count of ones to the next.
BLOCK_WORDS, SAMPLE_WORDS = 1024, 4
END_ID = 2
#: Tokens after which a task begins the next file; a longer document has a file of its own.
SHARD_TOKENS = 1 << 20
#: Odd pieces of text, and parts of pieces, whose ids one worker remembers; texts that are encoded at once, parts that are.
PIECES, PARTS, TEXTS, TOGETHER = 100_000, 1_000_000, 2000, 200
#: Letters up to U+00FF are one part of the pattern, and so are ASCII marks after them (no apostrophe, which begins parts of its own).
WORD_AND_MARKS = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
SIMPLE = re.compile(r"[!-~\xa1-\u02ff]*").fullmatch


class WaveletMatrix:
    """Rank, select and access over a sequence of ``n`` numbers.

    ``zeros`` has the zeros of each plane, ``above`` the ones before each of its blocks and in all. ``load(level, block)``
    gives a block's words and the ones of the block before every SAMPLE_WORDS-th of them; blocks are loaded when needed.
    """

    def __init__(self, n: int, zeros: list[int], above: np.ndarray, load: Callable[[int, int], tuple[np.ndarray, np.ndarray]]):
        self.n, self.zeros, self.above, self.load = n, zeros, above, load
        levels, self.blocks = len(zeros), above.shape[1] - 1
        self.words = np.zeros((levels, self.blocks * BLOCK_WORDS + 1), np.uint64)
        self.before = np.zeros((levels, self.blocks * BLOCK_WORDS + 1), np.int64)
        self.before[:, -1] = above[:, -1]
        self.loaded = np.zeros((levels, self.blocks), bool)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        blocks = -(-len(ids) // (64 * BLOCK_WORDS))
        planes, zeros, now = np.zeros((bits, blocks, BLOCK_WORDS), np.uint64), [], ids
        for level in range(bits):
            ones = ((now >> (bits - 1 - level)) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            planes[level].reshape(-1).view(np.uint8)[: len(packed)] = packed
            low = now[~ones]
            zeros.append(len(low))
            now = np.concatenate([low, now[ones]])
        counts = np.bitwise_count(planes).astype(np.int64)
        above = np.concatenate([np.zeros((bits, 1), np.int64), counts.sum(axis=2).cumsum(axis=1)], axis=1)
        samples = (counts.cumsum(axis=2) - counts)[:, :, ::SAMPLE_WORDS].astype(np.uint16)
        return cls(len(ids), zeros, above, lambda level, block: (planes[level, block], samples[level, block]))

    def _need(self, level: int, word: np.ndarray) -> None:
        wanted = np.zeros(self.blocks + 1, bool)
        wanted[word // BLOCK_WORDS] = True
        for block in np.flatnonzero(wanted[:-1] & ~self.loaded[level]).tolist():
            words, samples = self.load(level, block)
            inside = np.bitwise_count(words).reshape(-1, SAMPLE_WORDS).astype(np.int64)
            span = slice(block * BLOCK_WORDS, (block + 1) * BLOCK_WORDS)
            self.words[level, span] = words
            self.before[level, span] = (self.above[level, block] + samples.astype(np.int64)[:, None] + inside.cumsum(axis=1) - inside).reshape(-1)
            self.loaded[level, block] = True

    def _look(self, level: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit at each place, ones of the plane before it)."""
        word, at = place >> 6, (place & 63).astype(np.uint64)
        self._need(level, word)
        held = self.words[level][word]
        ones = self.before[level][word] + np.bitwise_count(held & ((np.uint64(1) << at) - np.uint64(1)))
        return (held >> at) & np.uint64(1), ones

    def access(self, place: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        place = np.asarray(place, dtype=np.int64)
        value = np.zeros(len(place), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._look(level, place)
            place = np.where(bit, zeros + ones, place - ones)
            value = value << 1 | bit.astype(np.int64)
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        lo, hi = 0, stop
        for level, zeros in enumerate(self.zeros):
            _, o = self._look(level, np.array([lo, hi], dtype=np.int64))
            one = value >> (len(self.zeros) - 1 - level) & 1
            lo, hi = (int(zeros + x) for x in o) if one else (int(p - x) for p, x in zip((lo, hi), o, strict=True))
        return lo, hi

    def rank(self, value: int, stop: int) -> int:
        """How often ``value`` occurs before place ``stop``."""
        lo, hi = self._range(value, stop)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``value``."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        place = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = value >> (len(self.zeros) - 1 - level) & 1
            place = self._nth(level, one, place - self.zeros[level] if one else place)
        return place

    def _nth(self, level: int, one: int, k: int) -> int:
        """The place of the k-th one or zero of a plane: block by the directory, word by the block's counts, then the bit."""
        count = lambda ones, bits: ones if one else bits - ones
        block = int(np.searchsorted(count(self.above[level], np.arange(self.blocks + 1) * 64 * BLOCK_WORDS), k, "right")) - 1
        span = np.arange(block * BLOCK_WORDS, (block + 1) * BLOCK_WORDS)
        self._need(level, span[:1])
        before = count(self.before[level][span], span * 64)
        word = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.words[level][span[word : word + 1]].view(np.uint8), bitorder="little")
        return int(span[word]) * 64 + int(np.flatnonzero(bits == one)[k - int(before[word])])

    def decode(self) -> np.ndarray:
        """All numbers in order, each block read once.

        What ``access`` follows down the planes for one place goes up for all: from the last plane to the first, the numbers of a
        plane's zeros and of its ones, as the plane below has them one after the other, go to the places of these bits.
        """
        levels = len(self.zeros)
        value = np.zeros(self.n, np.min_scalar_type((1 << levels) - 1))
        for level in range(levels - 1, -1, -1):
            words = [self.load(level, block)[0] for block in range(self.blocks)]
            ones = np.array([np.bitwise_count(w).sum(dtype=np.int64) for w in words], np.int64)
            if (ones != np.diff(self.above[level])).any() or self.n - ones.sum() != self.zeros[level]:
                raise ValueError("a plane does not have the ones that its directory counts")
            packed = np.concatenate([np.zeros(0, np.uint64), *words]).view(np.uint8)
            bits = np.unpackbits(packed, bitorder="little", count=self.n).view(bool)
            above, low = np.empty_like(value), self.zeros[level]
            above[~bits] = value[:low]
            above[bits] = value[low:] | value.dtype.type(1 << (levels - 1 - level))
            value = above
        return value.astype(np.int64)


@dataclass(frozen=True)
class Shard:
    """One file: documents in order (ids may be null), their token counts, and the wavelet matrix of all their tokens."""

    part: int
    start: int
    doc_ids: list[int | None]
    lengths: np.ndarray
    matrix: WaveletMatrix

    def to_bytes(self) -> bytes:
        m, squeeze = self.matrix, zstandard.ZstdCompressor(level=3)
        head = {"part": self.part, "start": self.start, "n": m.n, "zeros": m.zeros, "blocks": m.blocks, "nulls": [i for i, d in enumerate(self.doc_ids) if d is None]}
        held = [m.load(level, block) for level in range(len(m.zeros)) for block in range(m.blocks)]
        blocks = [squeeze.compress(samples.astype("<u2").tobytes() + words.astype("<u8").tobytes()) for words, samples in held]
        sections = [json.dumps(head).encode(), np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes(), self.lengths.astype("<i8").tobytes()]
        sections += [m.above.astype("<i8").tobytes(), np.array([len(b) for b in blocks], dtype="<i8").tobytes()]
        packed = [squeeze.compress(x) for x in sections]
        return b"".join([MAGIC, struct.pack("<5Q", *map(len, packed)), *packed, *blocks])

    @classmethod
    def open(cls, read: Callable[[int, int], bytes]) -> Shard:
        """A shard over ``read(offset, length)`` of its file; only the head and the directory are read at once."""
        if read(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        at, sections, expand = 48, [], zstandard.ZstdDecompressor()
        for size in struct.unpack("<5Q", read(8, 40)):
            sections.append(expand.decompress(read(at, size)))
            at += size
        head = json.loads(sections[0])
        doc_ids: list[int | None] = np.frombuffer(sections[1], dtype="<i8").tolist()
        for i in head["nulls"]:
            doc_ids[i] = None
        ends = at + np.concatenate([[0], np.cumsum(np.frombuffer(sections[4], dtype="<i8"))]).astype(np.int64)

        def load(level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
            k = level * head["blocks"] + block
            raw = expand.decompress(read(int(ends[k]), int(ends[k + 1] - ends[k])))
            size = 2 * (BLOCK_WORDS // SAMPLE_WORDS)
            return np.frombuffer(raw, dtype="<u8", offset=size).astype(np.uint64), np.frombuffer(raw[:size], dtype="<u2")

        above = np.frombuffer(sections[3], dtype="<i8").reshape(len(head["zeros"]), head["blocks"] + 1).astype(np.int64)
        return cls(head["part"], head["start"], doc_ids, np.frombuffer(sections[2], dtype="<i8"), WaveletMatrix(head["n"], head["zeros"], above, load))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        return cls.open(lambda at, size: raw[at : at + size])


class WordEncoder:
    """Ids of texts with a word-end vocabulary of the tokenizers library.

    Its pattern never crosses white space and its normalizer never joins characters across it, so texts are cut at
    ASCII white space. A piece of printable characters below U+0300 has no combining marks, so normalizing it is
    lower-casing it; it is cut by the vocabulary's pattern and each distinct part goes through the library's model once.
    Arrow cuts the usual piece, a word and marks after it. Any other piece goes through the whole library. What is known
    stays known; once the memory is full, further words are encoded but not kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.bare = Tokenizer(self.model)  # the model alone, for many parts at once
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.alphabet = byte_alphabet()
        self.bits = max(2, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind, self.code = (np.dtype("<u2"), "H") if self.bits <= 16 else (np.dtype("<u4"), "I")
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.end = self.packed([END_ID])

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def spelled(self, text: str) -> str:
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)

    def part(self, text: str) -> bytes:
        known = self.parts.get(text)
        if known is None:
            known = self.packed([t.id for t in self.model.tokenize(self.spelled(text))])
            if len(self.parts) < PARTS:
                self.parts[text] = known
        return known

    def many_parts(self, texts: pa.Array) -> pa.Array:
        """Ids of distinct parts."""
        names = texts.to_pylist()
        found = list(map(self.parts.get, names))
        fresh = [k for k, f in enumerate(found) if f is None]
        size = self.kind.itemsize
        for at in range(0, len(fresh), TOGETHER * 100):
            own = fresh[at : at + TOGETHER * 100]
            groups = [own[k : k + TOGETHER] for k in range(0, len(own), TOGETHER)]
            for group, done in zip(groups, self.bare.encode_batch([[self.spelled(names[k]) for k in g] for g in groups], is_pretokenized=True, add_special_tokens=False), strict=True):
                ids = self.packed(done.ids)
                cut = (np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(group) + 1)) * size).tolist()
                for k, start, stop in zip(group, cut[:-1], cut[1:], strict=True):
                    found[k] = ids[start:stop]
        room = PARTS - len(self.parts)
        self.parts.update((names[k], found[k]) for k in fresh[: max(0, room)])
        return pa.array(found, pa.large_binary())

    def piece(self, text: str) -> bytes:
        known = self.pieces.get(text)
        if known is None:
            if SIMPLE(text) and not any(s in text for s in self.specials):
                known = b"".join(map(self.part, self.pattern.findall(text.lower())))
            else:
                known = self.packed(self.library.encode(text, add_special_tokens=False).ids)
            if len(self.pieces) < PIECES:
                self.pieces[text] = known
        return known

    def many_pieces(self, texts: pa.Array) -> pa.Array:
        """Ids of distinct pieces: of words with marks after them by their two parts, of others one by one."""
        cut = pc.extract_regex(texts, WORD_AND_MARKS)
        usual = pc.is_valid(cut)
        matched = cut.filter(usual)
        sides = [pc.utf8_lower(matched.field("word")).dictionary_encode(), matched.field("marks").dictionary_encode()]
        both = [self.many_parts(sides[0].dictionary), pa.array([self.part(m) if m else b"" for m in sides[1].dictionary.to_pylist()], pa.large_binary())]
        ids = pc.binary_join_element_wise(*(known.take(side.indices) for known, side in zip(both, sides, strict=True)), pa.scalar(b"", pa.large_binary()))
        odd = pc.invert(usual)
        if not pc.any(odd).as_py():
            return ids
        return pc.replace_with_mask(pc.replace_with_mask(pa.nulls(len(texts), pa.large_binary()), usual, ids), odd, pa.array(map(self.piece, texts.filter(odd).to_pylist()), pa.large_binary()))

    def encode_many(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null: none) and the end id, as bytes of ``kind``.

        Arrow splits the texts and numbers their distinct pieces and those pieces' parts; only distinct parts become Python strings.
        """
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        numbered = lists.flatten().dictionary_encode()
        laid = self.many_pieces(numbered.dictionary).take(numbered.indices)
        ends = np.frombuffer(laid.buffers()[1], dtype=np.int64)[laid.offset :][: len(laid) + 1] if len(laid) else np.zeros(1, np.int64)
        data = laid.buffers()[2].to_pybytes() if len(laid) and laid.buffers()[2] is not None else b""
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        cut = ends[first].tolist()
        for at, to in zip(cut[:-1], cut[1:], strict=True):
            yield data[at:to] + self.end


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document: ids with the end id, as bytes. A ``doc_id`` is a whole number or null; texts that are no
    numbers are an error."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in sliced(batches, TEXTS):
            ids = list(words.encode_many(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids binary")


def write_shards(encoded: DataFrame, path: str, folder: str) -> DataFrame:
    """Write (doc_id, ids) to wavelet files in ascending doc_id order and return (part, file, tokens) of each.

    Documents are dealt to partitions by ranges of doc_id and sorted there (repeated ids by their tokens, null ids
    first), so a repeated task writes the same files. A file's ``start`` counts the tokens of its part before it.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, number, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=words.kind)
            lengths = np.array([len(h) // words.kind.itemsize for h in held], dtype=np.int64)
            name = f"part-{part:06d}-{number:05d}.wm"
            put(folder, name, Shard(part, start, doc_ids, lengths, WaveletMatrix.build(ids, words.bits)).to_bytes())
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64())], names=["part", "file", "tokens"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                doc_ids.append(doc_id.as_py())
                held.append(ids.as_py())
                size += len(held[-1]) // words.kind.itemsize
                if size >= SHARD_TOKENS:
                    yield flush()
                    number, start, doc_ids, held, size = number + 1, start + size, [], [], 0
        if held:
            yield flush()

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(written, "part int, file string, tokens long")


def read_shards(files: DataFrame, starts: dict[int, int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in (path, content) files, its tokens looked up in the wavelet
    matrix; ``starts`` has the first place of each part."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard.from_bytes(content.as_py())
                raw = shard.matrix.decode().astype("<u4").tobytes()
                cut = np.concatenate([[0], np.cumsum(shard.lengths)])
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(cut[:-1] + shard.start + starts[shard.part]), pa.array(shard.lengths), pa.array(checks, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(parsed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents`` written to wavelet files and read back from them."""
    path, folder = public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "tokens")
    # Ranges are found by sampling; the encoding is written first, so that it happens once.
    encoded = materialize(tokens(table(spark, sf_dir, "documents"), path), "token-ids")
    sizes = write_shards(encoded, path, folder).groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()
    if not sizes:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    starts, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):  # one row a partition
        starts[r["part"]] = total
        total += r["tokens"]
    return read_shards(read_files(spark, folder, ".wm"), starts)
