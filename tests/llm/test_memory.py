"""What pipeline stages hold between and within tasks."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from atomloom.llm import bpe


def test_stages_take_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(session, docs, sf_dir):
        return docs.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"]) for b in batches), "n long")

    try:
        spark.conf.set(key, "10000")
        found = corpus_pipeline.in_small_batches(sizes)(spark, spark.range(0, 5000, 1, 1), "")
        assert found.agg(F.max("n"), F.sum("n")).first() == (corpus_pipeline.BATCH_ROWS, 5000)
        spark.conf.set(key, "7")
        assert corpus_pipeline.in_small_batches(sizes)(spark, spark.range(0, 50, 1, 1), "").agg(F.max("n")).first()[0] == 7
    finally:
        spark.conf.set(key, before)


def test_forgotten_words_keep_special_tokens():
    own = bpe.SegmentTreeBpe(public_tokenizers.path("byte_bpe_50k.json"))
    text = f"some words {next(iter(own.specials), '')} and more"
    ids = own.encode(text)
    assert len(own.seen) > len(own.specials)
    own.forget()
    assert len(own.seen) == len(own.specials) and own.encode(text) == ids
