"""Superposition in column expressions against singular values, and pair sums against pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.operators import geometry, tokens


def plain_rmsd(p, q):
    """Least root mean square distance over turns and shifts, by singular values."""
    a, b = p - p.mean(0), q - q.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    if np.linalg.det(u @ vt) < 0:
        s[2] = -s[2]
        u[:, 2] = -u[:, 2]
    return np.sqrt(max(0.0, ((a * a).sum() + (b * b).sum() - 2 * s.sum()) / len(p))), (a @ u @ vt) + q.mean(0)


def shapes():
    rng = np.random.default_rng(7)
    cloud = rng.normal(size=(40, 3))
    noise = 0.3 * rng.normal(size=(40, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    mirrored = np.array([1.0, 1.0, -1.0])
    corners = np.array([[i, j, k] for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)], dtype=float)
    yield "cloud", cloud, cloud @ turn + noise + 5
    yield "elongated", cloud * [100, 1, 1], (cloud * [100, 1, 1]) @ turn + noise
    yield "very elongated", cloud * [1000, 1, 0.1], (cloud * [1000, 1, 0.1]) @ turn + noise
    yield "planar", cloud * [3, 2, 0], (cloud * [3, 2, 0]) @ turn + noise * [1, 1, 0]
    yield "mirrored", cloud, (cloud * mirrored) @ turn + noise
    yield "mirrored cube", corners, corners * mirrored @ turn
    yield "straight", cloud * [10, 0, 0], (cloud * [10, 0, 0]) @ turn + noise
    yield "one place", np.zeros((4, 3)), corners[:4]
    yield "one atom", cloud[:1], cloud[:1] + 3
    yield "two atoms", cloud[:2], cloud[5:7]


@pytest.fixture(scope="module")
def pairs(spark):
    cases = {name: (p, q) for name, p, q in shapes()}
    side = lambda k: spark.createDataFrame([(name, i, *map(float, row)) for name, both in cases.items() for i, row in enumerate(both[k])], "structure_id string, atom_idx long, x double, y double, z double")
    return cases, side(0), side(1)


def test_rmsd_equals_singular_values(pairs):
    cases, model, reference = pairs
    found = geometry.aligned_rmsd(model, reference)
    assert "Python" not in (plan := found._jdf.queryExecution().toString()) and "Pandas" not in plan and "Arrow" not in plan
    rows = {r.structure_id: r.rmsd for r in found.collect()}
    assert set(rows) == set(cases)
    for name, (p, q) in cases.items():
        # a distance of nothing is the root of what rounding leaves of the spread
        assert rows[name] == pytest.approx(plain_rmsd(p, q)[0], abs=1e-9 if plain_rmsd(p, q)[0] > 1e-3 else 1e-7), name


def test_aligned_atoms_equal_singular_values(pairs):
    cases, model, reference = pairs
    found = geometry.kabsch_align(model, reference)
    assert "Python" not in (plan := found._jdf.queryExecution().toString()) and "Pandas" not in plan
    placed = {}
    for r in found.collect():
        placed.setdefault(r.structure_id, {})[r.atom_idx] = (r.x, r.y, r.z)
    for name, (p, q) in cases.items():
        mine = np.array([placed[name][i] for i in range(len(p))])
        least, theirs = plain_rmsd(p, q)
        assert np.sqrt(((mine - q) ** 2).sum(1).mean()) == pytest.approx(least, abs=1e-7), name
        inner = lambda x: (x[:, None] - x[None]) ** 2
        assert np.abs(inner(mine).sum(2) - inner(p).sum(2)).max() <= 1e-7 * max(1, inner(p).sum(2).max())  # rigid
        if name in ("cloud", "elongated", "planar", "mirrored"):  # the turn is unique
            assert np.abs(mine - theirs).max() < 1e-7, name


def test_atoms_without_coordinates_do_not_count(spark, pairs):
    _, model, reference = pairs
    holes = model.withColumn("x", F.when(F.col("atom_idx") != 3, F.col("x")))
    some = {r.structure_id: r.rmsd for r in geometry.aligned_rmsd(holes, reference).collect()}
    rest = {r.structure_id: r.rmsd for r in geometry.aligned_rmsd(model.filter("atom_idx <> 3"), reference).collect()}
    assert some == pytest.approx(rest) and "one atom" in some
    assert geometry.aligned_rmsd(model.withColumn("y", F.lit(None).cast("double")), reference).count() == 0


def features(spark, rows):
    return spark.createDataFrame(rows, "structure_id long, atom_idx long, chain_idx int, res_index long")


def test_pair_sums_equal_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(i), int(rng.integers(1, 4)), int(rng.integers(-30, 90))) for s in range(4) for i in range(1, 120)] + [(9, 1, 1, 5)]
    atoms = features(spark, rows)
    for window in (1, 5, 32):
        pairs = tokens.relative_positions(atoms, window).groupBy("structure_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i") * F.col("j")).alias("weight"))
        sums = tokens.relative_position_sums(atoms, window)
        assert sorted((r.structure_id, r.bucket, r.n, int(r.weight)) for r in sums.collect()) == sorted((r.structure_id, r.bucket, r.n, r.weight) for r in pairs.collect())


def test_padded_sums_equal_padded_pairs(spark):
    rows = [(s, i, 1 + i % 2, i // 3) for s, n in enumerate((4, 9, 30, 2)) for i in range(1, n + 1)]
    listed = features(spark, rows).withColumns({c: F.lit(2) for c in ("element_idx", "modality_idx", "polymer_atom_idx")}).withColumn("is_virtual", F.lit(False))
    groups = listed.select("structure_id").distinct().withColumn("batch_id", F.floor(F.col("structure_id") / 2).cast("long"))
    frame = tokens.pad_batches(listed, groups)
    real = frame.filter("pad_mask")
    pairs = tokens.pad_pairs(tokens.relative_positions(real, 4), frame).groupBy("structure_id", "bucket").count()
    assert sorted(map(tuple, tokens.pad_position_counts(real, frame, 4).collect())) == sorted(map(tuple, pairs.collect()))
    bias = tokens.pad_bias(frame).groupBy("batch_id", "structure_id").agg(F.count(F.lit(1)), F.sum("bias"))
    assert sorted(map(tuple, tokens.pad_bias_sums(frame).collect())) == sorted(map(tuple, bias.collect()))


def test_pair_sums_of_a_giant_structure(spark):
    """100,000 atoms have 10^10 pairs; their sums come from 20,000 residues."""
    n = 100_000
    atoms = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("structure_id"), F.col("id").alias("atom_idx"), F.when(F.col("id") <= 60_000, 1).otherwise(2).alias("chain_idx"), F.floor((F.col("id") - 1) / 5).alias("res_index"))
    found = {r.bucket: (r.n, int(r.weight)) for r in tokens.relative_position_sums(atoms).collect()}
    sums = np.arange(1, n + 1).reshape(-1, 5).sum(1).astype(object)
    for d in range(-31, 32):
        inside = [(5 * 5 * (c - abs(d)), sum(int(x) for x in part[abs(d) :] * part[: c - abs(d)])) for part, c in ((sums[:12_000], 12_000), (sums[12_000:], 8_000))]
        assert found[d + 33] == tuple(map(sum, zip(*inside, strict=True)))
    assert sum(k for k, _ in found.values()) == n * n and sum(w for _, w in found.values()) == int(sums.sum()) ** 2
    assert found[66][0] == 2 * 60_000 * 40_000 and found[1] == found[65]
