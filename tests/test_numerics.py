"""Hand-computed geometry, superposition, gradients, sampling and dataset operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atomloom.operators import dataset, flow, geometry

SCHEMA = "structure_id string, atom_idx int, chain_id string, res_index int, atom_name string, element string, x double, y double, z double"


def line(spark, xs, chains, residues, sid="s"):
    rows = [(sid, i + 1, c, r, "X", "C", float(x), 0.0, 0.0) for i, (x, c, r) in enumerate(zip(xs, chains, residues, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    ("xs", "chains", "residues", "energy"),
    [((0, 2), "AB", (1, 1), 1.0), ((0, 5), "AB", (1, 1), None), ((0, 2), "AA", (1, 2), None), ((0, 2), "AA", (1, 3), 1.0), ((0, 2, 100), "ABC", (1, 1, 1), 1.0)],
)
def test_clashes(spark, xs, chains, residues, energy):
    found = geometry.clashes(line(spark, xs, chains, residues)).first()
    assert (found is None) if energy is None else (found.clash_energy == pytest.approx(energy) and found.clashes == 1)


def test_bond_summary(spark):
    a = line(spark, (0, 1, 3), "AAA", (1, 1, 1))
    bonds = spark.createDataFrame([("s", 1, 2, 1.5), ("s", 2, 3, 1.5)], "structure_id string, i int, j int, ideal double")
    s = geometry.bond_summary(geometry.bond_deviations(a, bonds)).first()
    assert (s.bond_energy, s.bond_rmsd) == (0.5, 0.5)


def test_chirality(spark):
    def center(c, cb, scale=1.0):
        names = [("N", (1, 0, 0)), ("CA", (0, 0, 0)), ("C", c), ("CB", cb)]
        return spark.createDataFrame([("s", i + 1, "A", 1, n, n[0], *(scale * float(v) for v in p)) for i, (n, p) in enumerate(names)], SCHEMA)

    good = geometry.chirality_summary(geometry.chiral_centers(center((0, 1, 0), (0, 0, 1), 2.0))).first()
    assert good.chirality_energy == 0 and good.chirality_violations == 0
    bad = geometry.chirality_summary(geometry.chiral_centers(center((0, 0, 1), (0, 1, 0)))).first()
    assert bad.chirality_energy == pytest.approx(1.69, abs=1e-4) and bad.chirality_violations == 1


@pytest.mark.parametrize(("far", "score"), [(1.3, 1.0), (1.7, 0.75), (11.0, 0.0)])
def test_lddt(spark, far, score):
    ref, model = line(spark, (0, 1, 1000), "AAA", (1, 1, 1)), line(spark, (0, far, 1000), "AAA", (1, 1, 1))
    got = {r.atom_idx: r.lddt for r in geometry.lddt(model, ref).collect()}
    assert got == {1: score, 2: score, 3: 1.0}


def test_superposition(spark):
    p = np.array([[0, 0, 0], [3, 0, 0], [0, 2, 0], [0, 0, 1.0]])
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    frame = lambda q: spark.createDataFrame([("s", i + 1, *map(float, r)) for i, r in enumerate(q)], "structure_id string, atom_idx int, x double, y double, z double")
    ref, copy = frame(p), frame(p @ turn.T + [100, -50, 7])
    back = geometry.kabsch_align(copy, ref).orderBy("atom_idx").toPandas()[["x", "y", "z"]].to_numpy()
    assert np.abs(back - p).max() < 1e-8
    assert geometry.aligned_rmsd(copy, ref).first().rmsd < 1e-3
    q = p.copy()
    q[1, 0] += 2
    u, _, vt = np.linalg.svd((q - q.mean(axis=0)).T @ (p - p.mean(axis=0)))
    best = (q - q.mean(axis=0)) @ (vt.T @ np.diag([1, 1, np.linalg.det(vt.T @ u.T)]) @ u.T).T + p.mean(axis=0)
    brute = np.sqrt(((best - p) ** 2).sum() / 4)
    mirrored = geometry.kabsch_align(frame(p * [1, 1, -1]), ref).orderBy("atom_idx").toPandas()[["x", "y", "z"]].to_numpy()
    assert np.linalg.det((mirrored - mirrored[0])[1:]) == pytest.approx(-np.linalg.det((p - p[0])[1:]))  # turned, not reflected
    assert brute > 0.5 and geometry.aligned_rmsd(frame(q @ turn.T), ref).first().rmsd == pytest.approx(brute, abs=1e-6)


def test_guidance_lowers_energy(spark, sf):
    from atomloom.plans.projections import mol

    a = mol(spark, sf).select("structure_id", "atom_idx", "chain_id", "res_index", "atom_name", "element", "x", "y", "z").filter("structure_id < 4").cache()
    before = {r.structure_id: r.validity_energy for r in geometry.validity_energy(a).collect()}
    after = {r.structure_id: r.validity_energy for r in geometry.validity_energy(flow.validity_step(a, 1e-3)).collect()}
    assert all(after[k] < before[k] for k in before)
    g = flow.validity_gradient(a.filter("structure_id = 0")).filter("atom_idx = 10003").first()
    h, total = 1e-5, lambda d: geometry.validity_energy(d).filter("structure_id = 0").first().validity_energy
    shifted = lambda s: a.withColumn("x", F.when((F.col("structure_id") == 0) & (F.col("atom_idx") == 10003), F.col("x") + s).otherwise(F.col("x")))
    assert g.gx == pytest.approx((total(shifted(h)) - total(shifted(-h))) / (2 * h), rel=1e-4)


def test_chain_guidance(spark):
    a = line(spark, (0, 20), "AB", (1, 1)).withColumn("chain_idx", F.col("atom_idx"))
    out = {r.atom_idx: r.x for r in flow.chain_guidance(a, [flow.ChainConstraint(2, 1, (5.0, 0.0, 0.0), 1.0)], 1.0).collect()}
    assert out == {1: 0.0, 2: 5.0}


def test_training_examples(spark):
    a = line(spark, (0, 1, 3), "AAA", (1, 1, 2)).withColumn("is_virtual", F.lit(False))
    fixed = a.select("structure_id", "atom_idx", F.lit(True).alias("is_fixed"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("z").alias("fz"))
    rows = flow.training_examples(a, fixed, 3).collect()
    assert not any(r["mask"] for r in rows) and all(abs(r[f"v{c}"]) < 1e-12 for r in rows for c in "xyz")
    free = flow.training_examples(a, fixed.limit(0), 3).toPandas()
    x1 = free[["xt", "yt", "zt"]].to_numpy() + (1 - free[["t"]].to_numpy()) * free[["vx", "vy", "vz"]].to_numpy()
    gap = lambda p, i, j: np.linalg.norm(p[i] - p[j])
    order = np.argsort(free.atom_idx.to_numpy())
    x1 = x1[order]
    assert gap(x1, 0, 1) == pytest.approx(1.0) and gap(x1, 0, 2) == pytest.approx(3.0) and np.abs(x1.mean(axis=0)).max() < 1e-9


def test_splits_are_exact(spark):
    rows = spark.range(37).withColumnRenamed("id", "id")
    parts = {r["split"]: r["count"] for r in dataset.split(rows, dataset.arithmetic_key(F.col("id"), 3), "id", 0.1, 0.1).groupBy("split").count().collect()}
    assert parts == {"val": 4, "test": 4, "train": 29}
    with pytest.raises(ValueError):
        dataset.split_sizes(2, 0.5, 0.5)
    batches = sorted(r["count"] for r in dataset.batches(rows, dataset.arithmetic_key(F.col("id"), 3), "id", 10).groupBy("batch_id").count().collect())
    assert batches == [7, 10, 10, 10]


def test_library_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "library")
    tokens = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "structure_id string, atom_idx int")
    assert dataset.append_library(tokens, path, limit=2) == {"written": 2, "present": 0, "left": 1}
    assert dataset.append_library(tokens, path) == {"written": 1, "present": 2, "left": 0}
    assert dataset.append_library(tokens, path)["written"] == 0
    assert spark.read.parquet(path).count() == 4
    assert dataset.load_targets(spark.read.parquet(path), 5, 1, 0).count() == 2
    built = []
    make = lambda: built.append(1) or tokens
    for key in ({"n": 1}, {"n": 1}, {"n": 2}):
        assert dataset.cached(spark, str(tmp_path / "cache"), key, make).count() == 4
    assert len(built) == 2
