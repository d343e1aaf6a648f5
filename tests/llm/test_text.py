"""Words, quality, toxicity, language and mixing on fixtures and held-out rows."""

from __future__ import annotations

import collections
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atomloom.llm import langid, mixing, quality, toxicity, words
from atomloom.llm.common import table
from atomloom.llm.queries import queries

RUNS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = RUNS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if RUNS.search(line):
            dup += line in seen
            seen.add(line)
    times = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_words_and_groups(monkeypatch):
    monkeypatch.setattr(words, "GROUP_BYTES", 16)
    monkeypatch.setattr(words, "BLOCK", 8)
    texts = ["one two", None, "", "  é x\ty\n", "averyveryverylongwordindeed two", "one two"]
    got, hashes = [], []
    for g in words.groups(pa.array(texts)):
        s, e, o = g.words()
        h = words.span_hashes(g.data, s, e)
        for i in range(g.hi - g.lo):
            got.append([bytes(g.data[a:b]).decode() for a, b in zip(s[o[i] : o[i + 1]], e[o[i] : o[i + 1]], strict=True)])
            hashes.append(h[o[i] : o[i + 1]].tolist())
    assert got == [RUNS.findall(t or "") for t in texts]
    assert hashes[0] == hashes[5] and hashes[0][1] == hashes[4][1]
    assert list(words.groups(pa.array([], pa.string()))) == []


def test_base_counts_equal_brute_force(spark, odd_documents, no_documents, sf):
    model = quality.QualityModel(np.zeros(1 << quality.BITS, np.float32).tobytes(), 0.0, (0.0, 9.0))
    extra = spark.createDataFrame([(100, "a b c d e f g h\na b c d e f g h\n\n a\n a\nx# <b>|"), (101, "x " * 50)], "doc_id long, text string")
    for docs in (odd_documents.select("doc_id", "text"), extra, table(spark, sf, "documents").select("doc_id", "text").limit(60)):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in quality.judge(docs, model).collect():
            expected = brute_counts(texts[r.doc_id])
            assert tuple(r[c] for c in quality.BASE_COUNTS) == expected
            assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0]) and r.kept == (not r.base_failed)
    assert quality.judge(no_documents, model).count() == 0


def test_quality_learns(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    found = queries()["op3_quality"](spark, sf).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert (found.kept == (found.quality == 1)).mean() > 0.95
    empty = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels").limit(0))
    assert quality.judge(table(spark, sf, "documents").limit(5), empty).count() == 5


def test_toxicity_windows_and_margins():
    text = "Ünï code, -- 漢字" + "語" * 100 + " end." + "x" * 200
    cut = toxicity.windows(text)
    plain = " ünï code 漢字" + "語" * 100 + " end " + "x" * 200 + " "
    data = plain.encode()
    assert all(w == data[k * toxicity.STEP : k * toxicity.STEP + toxicity.WINDOW] for k, w in enumerate(cut))
    assert (len(cut) - 1) * toxicity.STEP + toxicity.WINDOW >= len(data) and toxicity.windows(None) == toxicity.windows(" ,. ") == []
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    ordinary = [" ".join(word() for _ in range(8)).encode() for _ in range(4000)]
    marked = [w[:20] + b" grobian lump " + w[20:] for w in ordinary[:600]]
    o = toxicity.trained(ordinary[600:], 1 << 14, toxicity.ORDINARY_SEGMENT)
    t = toxicity.trained(marked, 1 << 12, toxicity.TOXIC_SEGMENT)
    assert b" grob" in t and b" grob" not in o and toxicity.trained(marked[::-1], 1 << 12, toxicity.TOXIC_SEGMENT) == t
    side = toxicity.Margins(t, o)
    fresh = [" ".join(word() for _ in range(6)).encode() for _ in range(300)]
    plain_margin, whole, part = (side.of([f[:16] + x + f[16:] for f in fresh]).mean() for x in (b" wxyzvut qsvw ", b" grobian lump ", b" grobian qsvw "))
    assert whole > part > plain_margin  # graded by how much of the string is known
    assert toxicity.trained([], 100, 16) == b"" and (toxicity.Margins(b"", b"").of(fresh) == 0).all()


def test_toxicity_held_out(spark, odd_documents, no_documents):
    """Rows of the held-out fold alone: nearly all toxic English texts are found, clean texts are left alone."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = docs.filter(toxicity.fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT_FOLD)
    rows = toxicity.score(held, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    english = rows[(rows.toxic == 1) & (rows.lang == "en")]
    assert len(rows) > 700 and english.predicted.mean() > 0.8 and rows[rows.toxic == 0].predicted.mean() < 0.02
    odd = toxicity.score(odd_documents, model, odd_documents.columns, "_toxicity_")
    assert odd.count() == 11 and odd.filter("_toxicity_predicted = 1").count() == 0
    assert toxicity.score(no_documents, model).count() == 0
    nobody = toxicity.train(docs, labels.filter("toxic = 0"))
    assert nobody.toxic == b"" and toxicity.score(odd_documents, nobody).filter("predicted = 1").count() == 0
    assert toxicity.train(no_documents, labels).toxic == b""


def test_forward_sums_all_segmentations():
    vocabulary = langid.Vocabulary({"▁a": 0, "b": 1, "▁ab": 2, "▁": 3, "a": 4, "ab": 5}, frozenset(p[:k] for p in ("▁a", "b", "▁ab", "a", "ab") for k in range(1, len(p) + 1)))
    p = np.array([0.1, 0.2, 0.05, 0.3, 0.15, 0.12, 0.08])
    _, total = langid.forward(vocabulary.edges(["ab", "bc"]), p[:, None])
    # ▁ab | ▁a b | ▁ a b | ▁ ab ; ▁ b c(other)
    assert total[0, 0] == pytest.approx(0.05 + 0.1 * 0.2 + 0.3 * 0.15 * 0.2 + 0.3 * 0.12)
    assert total[1, 0] == pytest.approx(0.3 * 0.2 * 0.08)
    counts = langid.expected_counts(vocabulary, ["ab"], np.array([2.0]), p)
    assert counts[2] == pytest.approx(2 * 0.05 / total[0, 0]) and counts[1] == pytest.approx(2 * (0.1 * 0.2 + 0.3 * 0.15 * 0.2) / total[0, 0])


def test_long_words_are_summed_whole():
    """Runs of letters beyond LONG: the same sums and counts as the tables of short words, and no cut."""
    rng = np.random.default_rng(2)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bab", "c"]
    vocabulary = langid.Vocabulary({p: i for i, p in enumerate(pieces)}, frozenset(p[:k] for p in pieces for k in range(1, len(p) + 1)))
    p = rng.dirichlet(np.ones(len(pieces) + 1), 3).T
    word = "".join(rng.choice(list("abcd"), 60))
    assert langid.words_of(f"{word} x") == [word, "x"]
    _, total = langid.forward(vocabulary.edges([word]), p)
    assert langid.long_word_logs(vocabulary, word, np.log(p)) == pytest.approx(np.log(total[0]))
    counts = langid.expected_counts(vocabulary, [word], np.array([1.0]), p[:, 0])
    found = langid.long_word_counts(vocabulary, word, np.log(p[:, 0]))
    assert [found.get(k, 0.0) for k in range(len(p))] == pytest.approx(counts.tolist())
    scorer = langid.Scorer(langid.LanguageModel(vocabulary, ("x", "y", "z"), p))
    long = word * 50
    (z,) = scorer.totals([long])
    assert np.isfinite(z).all() and z == pytest.approx(langid.long_word_logs(vocabulary, long, np.log(p)), rel=1e-4) and (z < 40 * np.log(total[0])).all()


def test_code_points():
    text = "aé漢\U0001f600z\u0000ß"
    points, lead = quality.code_points(np.frombuffer(text.encode(), np.uint8))
    assert points.tolist() == list(map(ord, text)) and lead.tolist() == [len(text[:i].encode()) for i in range(len(text))]
    assert quality.code_points(np.zeros(0, np.uint8))[0].tolist() == []


def test_language_held_out(spark, sf, odd_documents, no_documents):
    docs = table(spark, sf, "documents")
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97 and rows.score.between(0, 1).all()
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd_documents, model).collect()}
    assert all(odd[k] == ("und", 0.0) for k in (1, 2, 3, 9))
    assert langid.predict(no_documents, model).count() == 0
    blank = langid.train(no_documents, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in langid.predict(odd_documents, blank).collect()} == {"und"}


def test_raking_meets_marginals():
    rng = np.random.default_rng(1)
    cells = {(f"s{i}", f"l{j}", f"t{k}"): float(rng.integers(100, 1000)) for i in range(3) for j in range(3) for k in range(2)}
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"l0": 0.6, "l1": 0.4}, "topic": {"t0": 0.5, "t1": 0.5}}
    m = mixing.rake(cells, targets, 0.3)
    kept = {k: cells[k] * p for k, p in m.probabilities.items()}
    total = sum(kept.values())
    assert total == pytest.approx(0.3 * sum(cells.values()), rel=1e-6) and all(0 <= p <= 1 for p in m.probabilities.values())
    assert sum(v for k, v in kept.items() if k[0] == "s0") / total == pytest.approx(0.5, abs=1e-6)
    own = sum(v for k, v in cells.items() if k[1] == "l2") / sum(cells.values())
    assert sum(v for k, v in kept.items() if k[1] == "l2") / total == pytest.approx(own, abs=1e-6)
    assert mixing.rake({}, targets, 0.3).probabilities == {}


def test_mixing_query(spark, sf, odd_documents, no_documents):
    rows = queries()["op4_mix_sources"](spark, sf).toPandas()
    expected = (rows.n_tokens * rows.probability).sum()
    assert abs(rows[rows.kept].n_tokens.sum() - expected) < 0.35 * expected
    topics = {r["doc_id"]: (r["n_tokens"], r["topic"]) for r in mixing.with_topics(odd_documents, ["doc_id"]).collect()}
    assert topics[1] == (0, "none") and topics[8] == (2, "none") and topics[4][0] == 120_000
    assert mixing.with_topics(no_documents, ["doc_id"]).count() == 0
    assert mixing.fit(mixing.with_topics(no_documents, ["source", "lang"]), mixing.PRODUCTION, 0.5).probabilities == {}


@pytest.mark.parametrize("rate", [mixing.RATE, 0.7])
def test_mixing_meets_targets_on_tables(spark, rate):
    """Expected and drawn token shares of the given tables against the targets, at the rates of op4 and the pipeline."""
    rows = mixing.with_topics(table(spark, "/root/testdata/sf0.1", "documents"), ["doc_id", "source", "lang"]).cache()
    mixture = mixing.fit(rows, mixing.PRODUCTION, rate)
    chance, kept = mixing.sampling(mixture, mixing.PRODUCTION, F.col("doc_id"), F.col("source"), F.col("lang"), F.col("topic"))
    drawn = rows.select("source", "lang", "topic", "n_tokens", chance.alias("p"), kept.alias("kept")).toPandas()
    assert 0 < mixture.rate <= rate
    for dimension, targets in mixing.PRODUCTION.items():
        for tokens, off in ((drawn.n_tokens * drawn.p, 0.002), (drawn.n_tokens * drawn.kept, 0.03)):
            shares = tokens.groupby(drawn[dimension]).sum() / tokens.sum()
            for name, share in mixture.wanted[dimension].items():
                if name in targets:
                    assert shares.get(name, 0.0) == pytest.approx(share, abs=off), (dimension, name, off)
