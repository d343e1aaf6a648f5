"""Packing, whitening and phrases against plain versions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atomloom.llm import packing, phrases, whitening
from atomloom.llm.common import shared_dir, table
from atomloom.llm.queries import queries

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = public_tokenizers.path("word_bpe_49k.json")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def check_packing(rows, texts, library):
    """``texts``: (doc_id, text) of every document."""
    whole = Counter()
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at, lengths = 0, []
        while at < len(ids):
            lengths.append(min(2048, 1 << (len(ids) - at).bit_length() - 1))
            whole[(doc_id, at, lengths[-1], zlib.crc32(np.array(ids[at : at + lengths[-1]], "<u4").tobytes()), len(ids))] += 1
            at += lengths[-1]
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == whole
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert all(a.length >= b.length for a, b in zip(by_id[:-1], by_id[1:], strict=True))


def test_packing_query(spark, library):
    rows = queries()["op11_pack_sequences"](spark, TINY).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in table(spark, TINY, "documents").collect()], library)
    assert {r.offset for r in rows} == {0}


def test_packing_of_odd_documents(spark, odd_documents, no_documents, library):
    packed = packing.pack(odd_documents.repartition(3), WORD)
    rows = packed.withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd_documents.collect()], library)
    for length in {r.length for r in rows}:
        assert sorted(r.bucket_row for r in rows if r.length == length) == list(range(sum(r.length == length for r in rows)))
    assert packing.pack(no_documents, WORD).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.cut_pieces(odd_documents, WORD, 1000)


def test_buckets_hold_equal_lengths(spark, odd_documents, library):
    folder = shared_dir(spark, "buckets")
    packing.write_buckets(packing.pack(odd_documents, WORD, 64), folder, 100)
    rows = spark.read.parquet(folder).collect()
    assert all(len(r.token_ids) == r.length <= 64 for r in rows)
    longest = [x for r in sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.start) for x in r.token_ids]
    text = odd_documents.filter("doc_id = 4").first().text
    assert longest == [*library.encode(text, add_special_tokens=False).ids, 1]


def plain_whitening(vectors):
    """(n, S, deviations, covariance) of lists of floats, in whole numbers and fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[k] for v in x) for k in range(d)]
    centred = [[n * v[k] - s[k] for k in range(d)] for v in x]
    covariance = [[Fraction(sum(v[i] * v[j] for v in centred), n**3) for j in range(d)] for i in range(d)]
    return n, s, [sum(c * c for c in v) for v in centred], np.array([[float(c) for c in row] for row in covariance]), np.array([[float(Fraction(c, n)) for c in v] for v in centred])


def test_whitening_query(spark):
    rows = queries()["op12_whitening"](spark, TINY).collect()
    source = {r.vec_id: r.embedding for r in table(spark, TINY, "embeddings").collect()}
    ids = sorted(k for k, v in source.items() if v is not None and all(c is not None and math.isfinite(c) for c in v))
    n, _, deviations, covariance, centred = plain_whitening([source[k] for k in ids])
    values, vectors = np.linalg.eigh(covariance)
    top = np.argsort(-values)[:8]
    expected = centred @ vectors[:, top] / np.sqrt(values[top])
    got = np.zeros((len(ids), 8))
    place = {k: i for i, k in enumerate(ids)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviations[place[r.vec_id]]
        assert abs(r.explained / (values[top][r.component - 1] / values.sum()) - 1) < 1e-10
    assert len(rows) == 8 * len(ids)
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got * signs - expected).max() < 1e-7
    error = np.abs(got.T @ got / n - np.eye(8)).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and abs(rows[0].identity_error - error) < 1e-12


def test_whitening_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, n long, component string"
    good = [(k, [float(math.sin(k * j + j)) for j in range(1, 5)], 1, "x") for k in range(40)]
    odd = [(100, None, 1, "x"), (101, [1.0, None, 2.0, 3.0], 1, "x"), (102, [1.0, float("nan"), 2.0, 3.0], 1, None), (103, [float("inf"), 0.0, 0.0, 0.0], 1, "x"), (104, [], 1, "x"), (105, [0.0, 0.0, None], 1, "x"), (106, [1e300, 0.0, 0.0, 0.0], 1, "x")]
    again = [(None, good[0][1], 1, "x"), good[1]]
    rows = whitening.whiten(spark.createDataFrame(good + odd + again, schema).repartition(5), "vec_id", "embedding").collect()
    assert Counter(r.vec_id for r in rows) == Counter({**{k: 4 for k in range(40)}, None: 4, 1: 8})
    _, _, deviations, covariance, _ = plain_whitening([v for _, v, *_ in good + again])
    assert {(r.vec_id, int(r.deviation)) for r in rows} == {(k, d) for (k, *_), d in zip(good + again, deviations, strict=True)}
    assert abs(sum(r.explained for r in rows if r.vec_id == 0) - 1) < 1e-12 and rows[0].identity_error < 1e-12
    empty = spark.createDataFrame(odd, schema)
    assert whitening.whiten(empty, "vec_id", "embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame(good[:1] * 3, schema), "vec_id", "embedding").count() == 0  # no variance
    with pytest.raises(Exception, match="unlike lengths"):
        whitening.whiten(spark.createDataFrame([*good, (9, [1.0, 2.0], 1, "x")], schema), "vec_id", "embedding").count()


def test_whitening_is_exact_beyond_64_bits():
    x = np.array([[1 << 50, 5], [-(1 << 50), 7], [3, 1 << 49]], dtype=np.int64)
    moments = whitening.Moments(10**7, [int(s) for s in x.sum(axis=0)])
    exact = moments.centred(x)
    assert exact.tolist() == [[10**7 * int(v) - s for v, s in zip(row, moments.sums, strict=True)] for row in x]
    totals = [sum(v * v for v in row) for row in exact.tolist()]
    assert [None if v is None else int(v) for v in whitening.square_sums(exact).to_pylist()] == [t if t < 10**38 else None for t in totals]


def plain_collocations(rows, min_count, longest, top):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in counts.items() if a >= min_count and len(k[1]) > 1}
    repeated = {(lang, w[i:j]) for (lang, w), b in candidates.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) and candidates.get((lang, w[i:j])) == b}
    found = {lang: [] for lang in sizes}
    for (lang, words), a in candidates.items():
        if (lang, words) not in repeated:
            score, k = min((1000 * a * sizes[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words)))
            found[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    out = [(lang, i + 1, p.decode(), -a, x, y, sizes[lang], -s) for lang, own in found.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top])]
    return sorted(out)


def test_collocations_equal_a_plain_version(spark):
    docs = table(spark, TINY, "documents")
    rows = phrases.collocations(docs.repartition(6), min_count=8, top=300, chunk_words=3000).collect()
    assert len(rows) > 100
    assert sorted(map(tuple, rows)) == plain_collocations([(r.text, r.lang) for r in docs.collect()], 8, 5, 300)


def test_collocations_of_odd_documents(spark, odd_documents, no_documents):
    rows = phrases.collocations(odd_documents, min_count=2, top=50).collect()
    assert sorted(map(tuple, rows)) == plain_collocations([(r.text, r.lang) for r in odd_documents.collect()], 2, 5, 50)
    assert phrases.collocations(no_documents).count() == 0
    pairs = phrases.collocations(odd_documents, min_count=2, longest=2, top=50).collect()
    assert sorted(map(tuple, pairs)) == plain_collocations([(r.text, r.lang) for r in odd_documents.collect()], 2, 2, 50)
    wordless = odd_documents.filter("doc_id in (1, 2, 3)")
    assert phrases.collocations(wordless, min_count=1).count() == 0


def test_runs_that_cross_partitions(spark):
    """One pair holds most places, so that its runs go over many partitions."""
    texts = [(f"alpha beta w{i % 7} w{i % 3} alpha beta gamma. alpha beta; beta beta beta beta beta beta", "en") for i in range(900)]
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(9)
    rows = phrases.collocations(docs, min_count=5, top=500, chunk_words=200).collect()
    assert sorted(map(tuple, rows)) == plain_collocations(texts, 5, 5, 500)


def test_runs_of_sorted_batches():
    keys = np.array(sorted([[1, 2, 3], [1, 2, 3], [1, 2, 0], [1, 5, 5], [2, 2, 2], [2, 2, 2], [2, 2, 4], [7, 1, 0]]), dtype=np.uint32)
    for m in (2, 3):
        for at in range(1, len(keys)):
            runs = phrases.Runs(m, 3)
            ones = np.ones(len(keys), dtype=np.int64)
            found = [*runs.add(keys[:at], ones[:at]), *runs.add(keys[at:], ones[at:]), *runs.end()]
            whole = Counter(tuple(k[:m].tolist()) for k in keys)
            got = {tuple(np.frombuffer(k, ">u4").tolist()): n for k, n in found}
            assert len(got) == len(found) and all(whole[k] == n for k, n in got.items())
            ends = {tuple(keys[0][:m].tolist()), tuple(keys[-1][:m].tolist())}
            assert set(got) == {k for k, n in whole.items() if n >= 3} | ends
