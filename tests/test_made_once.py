"""Candidates that are costly to rank are ranked once, however many waves read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.operators import library


def counted(spark):
    """A string column function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(v):
        calls.add(1)
        return v

    return F.udf(same, "string").asNondeterministic(), calls


def test_candidates_are_ranked_once_for_all_waves(spark):
    same, calls = counted(spark)
    candidates = spark.range(200).select(same(F.col("id").cast("string")).alias("structure_id"), F.col("id").alias("rank"))
    load = lambda part: part.filter(F.col("structure_id").cast("int") % 40 == 39).select("structure_id", F.lit(1).alias("atom_idx"))
    found = library.load_in_waves(candidates, load, 3)
    assert {r[0] for r in found.tokens.select("structure_id").collect()} == {"39", "79", "119"}
    assert calls.value == 200
