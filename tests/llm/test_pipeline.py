"""The whole pipeline against its stages spelled out in plain Python, and what the near-duplicate stage can catch."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from atomloom.llm import langid, mixing, toxicity
from atomloom.llm.common import table
from atomloom.llm.labelled import sigmoid

TINY = "/root/testdata/sf0.001"


def components(texts):
    """Smallest reachable id of each text by full shingle sets and all pairs."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    return label


def test_pipeline_against_brute_force(spark):
    docs = table(spark, TINY, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, table(spark, TINY, "labels"))
    side = toxicity.Margins(model.toxic, model.ordinary)
    chance = lambda text: sigmoid(np.array([*toxicity.evidence(side.of(toxicity.windows(text))), 1.0]) @ np.array(model.weights))
    left = {d for d, r in rows.items() if chance(r.text) < 0.5}

    only = lambda: docs.filter(F.col("doc_id").isin(left))
    speech = langid.train(only(), public_tokenizers.path("piece_bpe_32k.model"))
    logs, known = np.log(speech.probabilities), {}
    sure = {}
    for d in left:
        z = np.zeros(len(speech.languages))
        words = langid.words_of(rows[d].text)
        for w in words:
            if w not in known:
                known[w] = langid.long_word_logs(speech.vocabulary, w, logs)
            z = z + known[w]
        if words and 1 / np.exp(z - z.max()).sum() >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            sure[d] = rows[d].lang or speech.languages[int(z.argmax())]
    left = set(sure)

    label = components({d: rows[d].text for d in left})
    left = {d for d in left if label[d] == d}

    found = {r.doc_id: r for r in mixing.with_topics(only(), ["doc_id", "source"]).collect()}
    place = {d: tuple(n if n in mixing.PRODUCTION[c] else mixing.OTHER for c, n in (("source", r.source), ("lang", sure[d]), ("topic", r.topic))) for d, r in found.items()}
    cells = {}
    for d, r in found.items():
        cells[place[d]] = cells.get(place[d], 0.0) + r.n_tokens
    mixture = mixing.largest_feasible(cells, mixing.PRODUCTION, corpus_pipeline.RATE)
    draw = lambda d: (xxhash.xxh64_intdigest(b"mixing", seed=xxhash.xxh64_intdigest(str(d).encode(), seed=42)) >> 11) / 2**53
    left = {d for d in left if draw(d) < mixture.probabilities[place[d]]}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: list(r.token_ids) for r in corpus_pipeline.run(spark, TINY).collect()}
    assert 0 < len(got) < len(rows)
    assert got == {d: library.encode(rows[d].text, add_special_tokens=False).ids for d in left}
