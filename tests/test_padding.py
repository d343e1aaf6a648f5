"""Batches are padded from one shuffle, and tensors of positions take little room."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from atomloom.operators import tokens
from atomloom.plans.queries import padded
from atomloom.sources.tensors import write_tensors

SCHEMA = "structure_id string, atom_idx int, element_idx int, modality_idx int, polymer_atom_idx int, chain_idx int, res_index int, is_virtual boolean, x double"


def test_gaps_are_padding_and_batches_may_share_structures(spark):
    features = spark.createDataFrame([("a", 2, 7, 7, 7, 7, 7, False, 1.5), ("a", 4, 8, 8, 8, 8, 8, True, 2.5), ("b", 1, 9, 9, 9, 9, 9, False, 3.5), ("c", 9, 6, 6, 6, 6, 6, False, 0.5)], SCHEMA)
    batches = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "structure_id string, batch_id long")
    got = {(r.batch_id, r.structure_id, r.atom_idx): (r.element_idx, r.res_index, r.is_virtual, r.pad_mask, r.x) for r in tokens.pad_batches(features, batches, ["x"]).collect()}
    none = (1, 0, True, False, 0.0)
    first = {(1, "a", 1): none, (1, "a", 2): (7, 7, False, True, 1.5), (1, "a", 3): none, (1, "a", 4): (8, 8, True, True, 2.5)}
    assert got == first | {(1, "b", k): none for k in (2, 3, 4)} | {(k, "b", 1): (9, 9, False, True, 3.5) for k in (1, 2)}


def test_tensors_take_two_shuffles_and_little_disk(spark, sf, tmp_path):
    def shuffled() -> int:
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    lines, before = spark.read.parquet(f"{sf}/lineitem.parquet").count(), shuffled()
    write_tensors(padded(spark, sf, "xyz"), str(tmp_path / "t"), {"coordinates": ("x", "y", "z")}, window=32)
    assert shuffled() - before < 2.1 * lines
    pairs = padded(spark, sf).groupBy("structure_id").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    size = sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(tmp_path) for n in names if n.endswith(".arrow"))
    assert size < 2 * pairs / 2
