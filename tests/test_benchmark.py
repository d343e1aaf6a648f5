"""Samples of a flow against sums of steps, and composed examples of a tiny structure."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.operators import benchmark

SCHEMA = "structure_id string, atom_idx int, x double, y double, z double"


@pytest.mark.parametrize("n_steps", [1, 3, 9])
def test_flow_sample_is_the_sum_of_its_steps(spark, n_steps):
    start = spark.createDataFrame([("a", 1, 0.0, 1.0, 2.0), ("a", 2, 3.0, -1.0, 0.5), ("b", 1, 5.0, 5.0, 5.0)], SCHEMA)
    velocity = lambda atoms, t: atoms.filter("structure_id = 'a'").select("structure_id", "atom_idx", *((F.col(a) * -0.5 + t).alias(f"v{a}") for a in "xyz"))
    lower = lambda atoms: atoms.withColumn("z", F.col("z") - 0.25)
    found = {(r.structure_id, r.atom_idx): (r.x, r.y, r.z) for r in benchmark.flow_sample(start, velocity, n_steps, lower).collect()}
    for r in start.collect():
        p = np.array([r.x, r.y, r.z])
        for k in range(n_steps):
            p = p + (p * -0.5 + k / n_steps) / n_steps * (r.structure_id == "a")
            p[2] -= 0.25
        assert np.allclose(found[r.structure_id, r.atom_idx], p, atol=1e-12)
    with pytest.raises(ValueError, match="a step"):
        benchmark.flow_sample(start, velocity, 0)
