"""A corpus pipeline of five stages over ``documents``: toxicity, language, near duplicates, mixture, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm import bpe, langid, mixing, neardup, toxicity
from atomloom.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document stays if its language is determined and at least so likely.
MIN_LANGUAGE_SCORE = 0.5
#: The most of the tokens that the mixture keeps; less if the targets ask for more than a category has.
RATE = 0.7
#: Documents that go to a Python worker at once. Each of its batches is held on both sides of the pipe, and whole texts are long.
BATCH_ROWS = 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on labels of ``docs``, does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, "_toxicity_").filter(F.col("_toxicity_predicted") == 0).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with some certainty; texts without letters go. A missing ``lang`` is filled in,
    so that the mixture can weigh unlabelled documents."""
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.predict(docs, model, docs.columns, "_language_")
    sure = (F.col("_language_lang_pred") != langid.UNDETERMINED) & (F.col("_language_score") >= MIN_LANGUAGE_SCORE)
    return found.filter(sure).withColumn("lang", F.coalesce("lang", "_language_lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest id; of rows that share an id, the least by all
    columns. Rows without an id stay."""
    members = neardup.near_duplicates(docs).members
    gone = materialize(members.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone_id")), "pipeline-gone")
    left = docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter(F.col("count") > 1)
    repeated = materialize(ids.select(F.col("doc_id").alias("_repeated_id")), "pipeline-repeated")
    if not repeated.limit(1).count():
        return left
    own = left.join(repeated, left["doc_id"] == repeated["_repeated_id"], "left_semi")
    least = own.groupBy("doc_id").agg(F.min(F.struct(*(F.col(c) for c in docs.columns if c != "doc_id"))).alias("_least"))
    one = least.select(*(F.col(c) if c == "doc_id" else F.col(f"_least.{c}").alias(c) for c in docs.columns))
    return left.join(repeated, left["doc_id"] == repeated["_repeated_id"], "left_anti").unionByName(one)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest sample of the documents, up to RATE, with the production targets as token shares."""
    rows = materialize(mixing.with_topics(docs, ["source", "lang"]), "pipeline-mixing")
    mixture = mixing.fit(rows, mixing.PRODUCTION, RATE)
    found = mixing.with_topics(docs, docs.columns, "_mixing_")
    _, kept = mixing.sampling(mixture, mixing.PRODUCTION, F.col("doc_id"), F.col("source"), F.col("lang"), F.col("_mixing_topic"))
    return found.filter(kept).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, token_ids, n_tokens, decoded_sha256) of every document that is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "source", "lang"])


def in_small_batches(stage: Stage) -> Stage:
    """The stage under BATCH_ROWS, or what the session has if that is less. The setting stays, as the stage's result is read later."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(key))
        if now <= 0 or now > BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("language_id", in_small_batches(keep_languages)),
    ("minhash_near_dedup", in_small_batches(drop_near_duplicates)),
    ("mixing", in_small_batches(mix)),
    ("bpe", in_small_batches(encode)),
]

#: Trained and hashed stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
