"""Walks in blocks against a walk in order."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.operators import flow

SCHEMA = "structure_id int, atom_idx long, chain_id string, e0 double, e1 double, e2 double, e3 double"


def plain_walk(rows):
    """{(structure, atom): place} of rows in order."""
    out, before, at = {}, {}, {}
    for s, i, chain, *e in sorted(rows, key=lambda r: r[:2]):
        d, length = np.array(e[:3]), np.linalg.norm(e[:3])
        if s not in before or before[s] != chain:
            at[s] = 10.0 * d
        else:
            at[s] = at[s] + ((3.8 + e[3]) * d / length if length > 0 else 0.0)
        before[s], out[s, i] = chain, at[s]
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 7, 50, 1000])
def test_blocks_walk_like_one_run(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(6):
        chains = np.repeat(rng.choice(["A", "B", None], 30), rng.integers(1, 9, 30))
        places = np.cumsum(rng.integers(1, 4, len(chains)))  # numbers with gaps
        rows += [(s, int(i), c, *map(float, rng.normal(size=4) * (rng.random() > 0.05))) for i, c in zip(places, chains, strict=True)]
    rows += [(7, 1, "A", 1.0, 2.0, 3.0, 0.5), (8, 5, None, 1.0, 0.0, 0.0, 0.0)]
    expected = plain_walk(rows)
    found = flow.prior_walk(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert len(found) == len(rows)
    for r in found:
        assert np.allclose([r.x0, r.y0, r.z0], expected[r.structure_id, r.atom_idx], atol=1e-9)


def test_a_giant_structure_walks_in_many_tasks(spark):
    n = 400_000
    atoms = spark.range(1, n + 1).select(F.lit(0).alias("structure_id"), F.col("id").alias("atom_idx"), F.when(F.col("id") <= 250_000, "A").otherwise("B").alias("chain_id"), F.lit(1.0).alias("e0"), *(F.lit(0.0).alias(f"e{k}") for k in (1, 2, 3)))
    walked = flow.prior_walk(atoms, block=4096)
    ends = {r.atom_idx: r.x0 for r in walked.filter(F.col("atom_idx").isin(1, 250_000, 250_001, n)).collect()}
    assert ends == pytest.approx({1: 10.0, 250_000: 10 + 3.8 * 249_999, 250_001: 10.0, n: 10 + 3.8 * 149_999})
