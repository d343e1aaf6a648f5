"""The registered queries against SQL, or against brute force where SQL cannot state them."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atomloom.llm import langid, mixing, quality, sharding
from atomloom.llm.common import table
from atomloom.llm.labelled import fold
from atomloom.llm.queries import oracle_sql, queries

TINY, SMALL, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def documents(spark, sf):
    return {r.doc_id: r for r in table(spark, sf, "documents").collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = queries()[name](spark, SMALL)
    theirs = con.execute(f"SELECT {', '.join(found.columns)} FROM ({oracle_sql()[name]})").fetchall()
    mine = [tuple(r) for r in found.collect()]
    assert len(mine) > 0 and sorted(map(repr, mine)) == sorted(map(repr, theirs))


def brute_shard(key, weights):
    first = xxhash.xxh64_intdigest(str(key).encode(), seed=42)
    scores = {}
    for shard, weight in enumerate(weights):
        bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=first) >> 11
        if weight > 0:
            scores[shard] = -weight / math.log((bits + 0.5) / 2**53)
    return max(scores, key=lambda s: (scores[s], -s))


def test_sharding_query(spark):
    docs = documents(spark, TINY)
    rows = queries()["op1_rendezvous_sharding"](spark, TINY).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "key", brute_shard(r.doc_id, [1.0] * 8), brute_shard(r.doc_id, [1.0] * 9))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    weights = [0.5, 3.0, 0.0, 1.0]
    weighted = spark.range(2000).select("id", sharding.rendezvous_shard(F.col("id"), weights).alias("s")).collect()
    assert all(r.s == brute_shard(r.id, weights) for r in weighted)


def test_language_query(spark):
    """Every prediction against sums over all segmentations, spelled out by recursion; accuracy on rows not learnt from."""
    docs = documents(spark, TINY)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.train(table(spark, TINY, "documents"), path)
    ids, other = model.vocabulary.ids, len(model.vocabulary.ids)

    def word_logs(word):
        marked, sums = "▁" + word, {0: np.ones(len(model.languages))}
        for end in range(1, len(marked) + 1):
            sums[end] = sum(sums[b] * model.probabilities[ids.get(marked[b:end], other)] for b in range(end) if b == end - 1 or marked[b:end] in ids)
        return np.log(sums[len(marked)])

    known = {}
    checked = 0
    for r in queries()["op2_language_id"](spark, TINY).collect():
        words = langid.words_of(docs[r.doc_id].text)
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(words) < 400:
            z = sum(known.setdefault(w, word_logs(w)) for w in words)
            assert r.lang_pred == model.languages[int(z.argmax())] and r.score == pytest.approx(1 / np.exp(z - z.max()).sum(), abs=1e-3)
            checked += 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert checked > 100
    docs = documents(spark, SMALL)
    held = [r for r in queries()["op2_language_id"](spark, SMALL).collect() if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert len(held) > 250 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_quality_held_out(spark):
    """A model that never reads labels of one fold, on that fold."""
    docs, labels = (table(spark, LARGE, t) for t in ("documents", "labels"))
    model = quality.train(docs, labels, fold(F.col("doc_id"), 4) != 3)
    held = docs.filter(fold(F.col("doc_id"), 4) == 3)
    rows = quality.judge(held, model).join(labels.select("doc_id", "quality"), "doc_id").filter("not base_failed").toPandas()
    assert len(rows) > 500 and (rows.kept == (rows.quality == 1)).mean() > 0.95


def test_mixing_query_against_cells(spark):
    """Weights of the query against raking of cells that are summed here, and its draws against the targets."""
    rows = queries()["op4_mix_sources"](spark, LARGE).toPandas()
    assert sorted(rows.doc_id) == sorted(documents(spark, LARGE))
    named = rows[["source", "lang", "topic"]].copy()
    for c, targets in mixing.PRODUCTION.items():
        named[c] = named[c].where(named[c].isin(list(targets)), mixing.OTHER)
    cells = rows.n_tokens.groupby([named[c] for c in named]).sum().to_dict()
    mixture = mixing.largest_feasible({k: float(v) for k, v in cells.items()}, mixing.PRODUCTION, mixing.RATE)
    expected = [mixture.probabilities[k] for k in named.itertuples(index=False, name=None)]
    assert np.allclose(rows.probability, expected, atol=1e-9)
    for c, targets in mixing.PRODUCTION.items():
        share = (rows.n_tokens * rows.probability).groupby(rows[c]).sum() / (rows.n_tokens * rows.probability).sum()
        drawn = rows[rows.kept].groupby(c).n_tokens.sum() / rows[rows.kept].n_tokens.sum()
        for name in targets:
            spread = math.sqrt((rows[rows[c] == name].n_tokens ** 2 * rows[rows[c] == name].probability).sum()) / (rows.n_tokens * rows.probability).sum()
            assert share[name] == pytest.approx(mixture.wanted[c][name], abs=0.002) and abs(drawn[name] - share[name]) < 5 * spread


def test_bpe_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark, TINY)
    rows = queries()["op5_bpe"](spark, TINY).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_file_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, TINY)
    start = 0
    rows = sorted(queries()["op8_token_files"](spark, TINY).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        ids = [*library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_queries_of_empty_tables(spark, tmp_path):
    """Empty tables of the same columns give no rows and no error."""
    for name in ("documents", "pages", "labels", "embeddings"):
        table(spark, TINY, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
