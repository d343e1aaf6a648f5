"""Whole token files are read plane by plane, and the usual words of texts are encoded many at once."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from atomloom.llm import wavelet

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_decode_reads_each_block_once(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 49_408, 200_000).astype("<u2")
    m = wavelet.Shard.from_bytes(wavelet.Shard(0, 0, [1], np.array([len(ids)]), wavelet.WaveletMatrix.build(ids, 16)).to_bytes()).matrix
    reads, load = [], m.load
    m.load = lambda level, block: reads.append((level, block)) or load(level, block)
    monkeypatch.setattr(wavelet.WaveletMatrix, "_look", lambda *a: pytest.fail("a place was looked up"))
    assert (m.decode() == ids).all()
    assert sorted(reads) == [(level, block) for level in range(16) for block in range(m.blocks)]
    m.above = m.above + np.arange(m.blocks + 1)
    with pytest.raises(ValueError):
        m.decode()


def test_usual_words_are_encoded_together(monkeypatch):
    usual = ["Straße", "ÉCOLE,", "word.", "a", "***", "naïve!?", "x_y", "don't", "2nd", "µm", "ﬁn", "İx", "<|endoftext|>", "end<|endoftext|>", "a\u0301b", "×", "ÿÞ..."]
    texts = [" ".join(usual[i:] + usual[:i]) for i in range(len(usual))] + [None, "", " \n"]
    own = wavelet.WordEncoder(WORD)
    expected = [[*(own.library.encode(t or "", add_special_tokens=False).ids), wavelet.END_ID] for t in texts]
    assert [np.frombuffer(b, own.kind).tolist() for b in own.encode_many(pa.array(texts))] == expected
    own = wavelet.WordEncoder(WORD)
    monkeypatch.setattr(own, "piece", lambda text: pytest.fail(f"{text} was encoded alone"))
    monkeypatch.setattr(wavelet, "PARTS", 1)
    words = ["Straße", "école,", "Word.", "a", "naïve!?"] * 2
    assert [np.frombuffer(b, own.kind).tolist() for b in own.encode_many(pa.array([" ".join(words)]))] == [[*own.library.encode(" ".join(words), add_special_tokens=False).ids, wavelet.END_ID]]
