"""BPE and token files against the library, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atomloom.llm import bpe, wavelet
from atomloom.llm.common import shared_dir
from atomloom.llm.files import read_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_library(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    lib = Tokenizer.from_file(BYTE) if not hasattr(test_bpe_equals_library, "lib") else test_bpe_equals_library.lib
    test_bpe_equals_library.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    own = bpe.tokenizer(BYTE)
    assert own.encode(text) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_merges_long_runs(library):
    own = bpe.tokenizer(BYTE)
    for text in ("a" * 3000, "ab" * 2000, "é" * 900, "-" * 700 + "x", "<|endoftext|>" * 3 + " x<|endoftext|>"):
        assert own.encode(text) == library[0].encode(text, add_special_tokens=False).ids


def test_bpe_query_on_odd_rows(odd_documents, no_documents, library):
    for row, text in [(r, r["text"]) for r in odd_documents.collect()]:
        ids = library[0].encode(text or "", add_special_tokens=False).ids
        found = bpe.digest_documents(odd_documents.filter(F.col("doc_id").eqNullSafe(F.lit(row["doc_id"]))), BYTE).first()
        assert found.n_tokens == len(ids) and found.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digest_documents(no_documents, BYTE).count() == 0


def test_word_encoder_equals_library(library):
    rnd = random.Random(3)
    ranges = [(32, 127), (0, 0x250), (0x300, 0x370), (0x370, 0x3000), (0xAC00, 0xD7FF), (0x10000, 0x1FFFF), (32, 33), (10, 11)]
    texts = ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(1, 40))) for _ in range(600)]
    texts += ["", "a<|endoftext|>b", "<|STARTOFTEXT|> x.", "J̌ ǰ", "word. word, 'Tis don't... x²."]
    own = wavelet.encoder(WORD)
    got = [np.frombuffer(b, own.kind).tolist() for b in own.encode_many(pa.array(texts))]
    assert got == [e.ids + [2] for e in library[1].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=300))
def test_wavelet_matrix(values):
    m = wavelet.WaveletMatrix.build(np.array(values, dtype="<u2"), 9)
    assert m.decode().tolist() == values
    assert m.access(np.arange(len(values))).tolist() == values
    for v in set(values[:5]):
        places = [i for i, x in enumerate(values) if x == v]
        assert m.rank(v, len(values)) == len(places)
        assert [m.select(v, k) for k in range(len(places))] == places
        with pytest.raises(IndexError):
            m.select(v, len(places))


def test_one_token_reads_few_blocks():
    """Access, rank and select on a file of many blocks, by byte ranges: some two blocks a plane, not the planes."""
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 1_000_000).clip(1, 40_000).astype("<u2")
    raw = wavelet.Shard(3, 70, [1, None], np.array([400_000, 600_000]), wavelet.WaveletMatrix.build(ids, 16)).to_bytes()
    reads = []

    def read(at, size):
        reads.append((at, size))
        return raw[at : at + size]

    shard = wavelet.Shard.open(read)
    assert shard.doc_ids == [1, None] and shard.lengths.tolist() == [400_000, 600_000] and (shard.part, shard.start) == (3, 70)
    opened = len(reads)
    assert shard.matrix.access(np.array([654_321])).tolist() == [ids[654_321]] and len(reads) - opened == 16
    assert sum(size for _, size in reads) < 0.15 * len(raw)
    value = int(ids[700_001])
    places = np.flatnonzero(ids == value)
    fresh = wavelet.Shard.open(read).matrix
    before = len(reads)
    assert fresh.rank(value, 700_001) == np.searchsorted(places, 700_001) and len(reads) - before <= 32
    fresh = wavelet.Shard.open(read).matrix
    before = len(reads)
    assert fresh.select(value, len(places) // 2) == places[len(places) // 2] and len(reads) - before <= 48
    assert (wavelet.Shard.from_bytes(raw).matrix.decode() == ids).all()


def test_token_files(spark, odd_documents, no_documents, library, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 50)
    folder = shared_dir(spark, "test-tokens")
    sizes = wavelet.write_shards(wavelet.tokens(odd_documents, WORD), WORD, folder).groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()
    starts, total = {}, 0
    for r in sizes:
        starts[r["part"]] = total
        total += r["tokens"]
    rows = wavelet.read_shards(read_files(spark, folder, ".wm"), starts).orderBy("start").collect()
    expected = sorted(((r["doc_id"], library[1].encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in odd_documents.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in expected]
    assert [r.start for r in rows] == np.cumsum([0, *(len(i) for _, i in expected)])[:-1].tolist()
    assert sorted(r.ids_crc32 for r in rows) == sorted(zlib.crc32(np.array(i, "<u4").tobytes()) for _, i in expected)
    assert wavelet.write_shards(wavelet.tokens(no_documents, WORD), WORD, shared_dir(spark, "none")).count() == 0
