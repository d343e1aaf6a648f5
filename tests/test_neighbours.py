"""Pairs of near atoms: every one once, from rows that are shuffled once and in few copies."""

from __future__ import annotations

import random

import pytest

from atomloom.operators.geometry import CUBE, neighbour_pairs


def placed(spark, points):
    return spark.createDataFrame([(s, i, *p) for s, i, p in points], "structure_id long, atom_idx long, x double, y double, z double")


@pytest.mark.parametrize("inclusive", [True, False])
def test_pairs_equal_brute_force(spark, inclusive):
    """Atoms at random, on the faces and corners of cubes, and at distances of the radius itself."""
    draw, radius = random.Random(3), 1.5
    side = CUBE * radius
    points = [(s, i, tuple(draw.uniform(-1.6 * side, 1.6 * side) for _ in "xyz")) for s in (1, 2) for i in range(500)]
    corners = [-1.5 * side, -side / 2, side / 2, 1.5 * side]
    points += [(3, i, p) for i, p in enumerate((x + d, y, z) for x in corners for y in corners[:2] for z in corners[1:3] for d in (-radius, 0.0, radius))]
    want = set()
    for n, (s, i, p) in enumerate(points):
        for t, j, q in points[:n]:
            d = sum((a - b) * (a - b) for a, b in zip(p, q, strict=True)) ** 0.5
            if s == t and (d < radius or (inclusive and d == radius)):
                want.add((s, min(i, j), max(i, j)))
    rows = [(r["structure_id"], r["i"], r["j"]) for r in neighbour_pairs(placed(spark, points), radius, inclusive=inclusive).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 200


def test_atoms_are_shuffled_once_in_few_copies(spark):
    """The join's two sides are one shuffle, of less than two rows an atom on a long chain."""
    atoms = placed(spark, [(s, i, (1.1 * i, float(i % 3), float(i % 2))) for s in range(20) for i in range(100)]).repartition(3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = neighbour_pairs(atoms, 3.0)
        assert pairs.count() > 2000
        text = pairs._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in text
        side = pairs._jdf.queryExecution().optimizedPlan().children().head().children().head()
        assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, side).count() < 2 * 2000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
