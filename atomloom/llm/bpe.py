"""Byte-level BPE by a segment tree over adjacent pair ranks.

Each pre-token is a row of a matrix. A row's segment tree holds, for each adjacent pair of symbols, the pair's merge rank
and place in one number; its root is the leftmost pair of lowest rank. A merge updates three leaves and their paths to
the root, until no root holds a mergeable pair. Rows of like length are merged together, one numpy step a merge.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from atomloom.llm.common import sliced, table

#: The published pattern of the byte-level vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens whose ids one worker remembers.
CACHE = 200_000
#: Pre-tokens of texts that are looked up together.
GROUP = 200_000
NONE = np.int64(1) << 62


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 bytes stand for themselves, the rest for characters from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SegmentTreeBpe:
    """Encoder and decoder of one tokenizer file (byte-level BPE without a normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.arange(len(keys), dtype=np.int64)[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        alphabet = byte_alphabet()
        self.byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], dtype=np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in alphabet.items()}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.token_bytes = [b"".join(bytes([back[c]]) if c in back else c.encode() for c in tokens.get(i, "")) for i in range(max(tokens) + 1)]
        self.ids = list(range(len(self.token_bytes)))  # one object an id, shared by all that is remembered
        self.id_text = [str(i) for i in range(len(self.token_bytes))]
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.seen: dict[str, tuple[int, ...]] = {}
        self.forget()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; NONE where the pair does not merge or an id is missing (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge each row of ids (padded by -1 at the end) as far as it goes; merged-away places become -1."""
        n_rows, width = symbols.shape
        leaves = 1 << max(1, (width - 1).bit_length())
        tok = np.full((n_rows, leaves + 1), -1, dtype=np.int64)
        tok[:, :width] = symbols
        rest = np.arange(leaves + 1)
        nxt = np.broadcast_to(rest + 1, tok.shape).copy()
        prv = np.broadcast_to(rest - 1, tok.shape).copy()
        place = rest[:leaves]
        first = self.rank(tok[:, :leaves], tok[:, 1:])
        tree = np.full((n_rows, 2 * leaves), NONE, dtype=np.int64)
        tree[:, leaves:] = np.where(first < NONE, first * leaves + place, NONE)
        size = leaves // 2
        while size >= 1:
            tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])
            size //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            left = root % leaves
            right = nxt[live, left]
            after, before = nxt[live, right], prv[live, left]
            tok[live, left] = self.merged[root // leaves]
            tok[live, right] = -1
            nxt[live, left] = after
            inside = after <= leaves
            prv[live[inside], after[inside]] = left[inside]
            has_after = (after < leaves) & (tok[live, np.minimum(after, leaves)] >= 0)
            with_after = np.where(has_after, self.rank(tok[live, left], tok[live, np.minimum(after, leaves)]), NONE)
            has_before = before >= 0
            with_before = np.where(has_before, self.rank(tok[live, np.maximum(before, 0)], tok[live, left]), NONE)
            self._update(tree, leaves, live, right, np.full(len(live), NONE))
            self._update(tree, leaves, live, left, np.where(with_after < NONE, with_after * leaves + left, NONE))
            some = np.flatnonzero(has_before)
            value = np.where(with_before < NONE, with_before * leaves + before, NONE)
            self._update(tree, leaves, live[some], before[some], value[some])
            live = live[tree[live, 1] < NONE]
        return tok[:, :width]

    @staticmethod
    def _update(tree: np.ndarray, leaves: int, rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        """Point update: set a leaf of each row and recompute the nodes above it."""
        node = place + leaves
        tree[rows, node] = value
        while leaves > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            leaves >>= 1

    def forget(self) -> None:
        """Only special tokens stay known."""
        self.seen = {s: (i,) for s, i in self.specials.items()}

    def learn(self, pretokens: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokens, merged in groups of like length."""
        learnt: dict[str, tuple[int, ...]] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for p in pretokens:
            raw = p.encode("utf-8", "surrogatepass")
            groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
        for width, members in groups.items():
            step = max(1, (1 << 19) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                lengths = np.array([len(raw) for _, raw in part])
                flat = np.frombuffer(b"".join(raw for _, raw in part), dtype=np.uint8)
                symbols = np.full((len(part), width), -1, dtype=np.int64)
                symbols[np.arange(width) < lengths[:, None]] = self.byte_ids[flat]
                done = self.merge_rows(symbols)
                kept = done >= 0
                ends = np.cumsum(kept.sum(axis=1)).tolist()
                ids, start = list(map(self.ids.__getitem__, done[kept].tolist())), 0
                for (p, _), end in zip(part, ends, strict=True):
                    learnt[p] = tuple(ids[start:end])
                    start = end
        return learnt

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token in the text stays whole."""
        if self.split is None or not self.split.search(text):
            return PRETOKEN.findall(text)
        parts, at = [], 0
        for found in self.split.finditer(text):
            parts += PRETOKEN.findall(text[at : found.start()])
            parts.append(found.group())
            at = found.end()
        return parts + PRETOKEN.findall(text[at:])

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text (null: none), in order; the unknown pre-tokens of many texts are merged together."""
        group, size = [], 0
        for text in texts:
            group.append(self.pretokens(text or ""))
            size += len(group[-1])
            if size >= GROUP:
                yield from self.encoded(group)
                group, size = [], 0
        yield from self.encoded(group)

    def encoded(self, group: list[list[str]]) -> Iterator[list[int]]:
        words = set(chain.from_iterable(group))
        fresh = self.learn(words.difference(self.seen))
        if len(self.seen) + len(fresh) <= CACHE:
            self.seen.update(fresh)
            known = self.seen
        else:  # full: what is known stays, the rest serves this group only
            known = {w: fresh[w] if w in fresh else self.seen[w] for w in words}
        for words_of_text in group:
            yield list(chain.from_iterable(map(known.__getitem__, words_of_text)))

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_many([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of the tokens, read as UTF-8; what is not UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def id_list(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.id_text.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> SegmentTreeBpe:
    """One encoder a worker and file, so what it remembers serves all tasks of the worker."""
    return SegmentTreeBpe(path)


def encode_documents(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every document, its ``token_ids``, ``n_tokens`` and the ``decoded_sha256`` of the ids' text.

    A null text is encoded as the empty one (no tokens). Texts of any length are encoded whole.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in sliced(batches):
            ids = list(bpe.encode_many(t.as_py() for t in batch.column("text")))
            digests = [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids]
            yield pa.record_batch(
                [*(batch.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(digests, pa.string())],
                names=[*keep, "token_ids", "n_tokens", "decoded_sha256"],
            )
        bpe.forget()  # the worker may serve other operators next

    schema = T.StructType([docs.schema[c] for c in keep]).add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("decoded_sha256", T.StringType())
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(encoded, schema)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the encoding and its decoded text by their digests only."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in sliced(batches):
            counts, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_many(t.as_py() for t in batch.column("text")):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.id_list(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digested, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded with the 50k byte-level vocabulary and decoded again."""
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
