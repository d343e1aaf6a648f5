"""Tokens are numbered and made into examples without sorts or joins of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.operators import flow, tokens
from atomloom.plans.queries import QUERIES, mol_features, serine_atoms


def test_tokens_are_never_sorted_and_examples_need_no_join(spark, sf):
    """Only rows of residues are put in order, and features, targets and constraints are columns of the same tokens."""
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    assert "slot_ord" not in "".join(line for line in plan(tokens.tokenize(serine_atoms(spark, sf))).splitlines() if "Sort [" in line or "Window [" in line)
    assert "Join" not in plan(flow.examples(serine_atoms(spark, sf)))


def test_tokens_count_through_their_structure(spark):
    """Numbers run through residues of every kind; of equal names in a slot the last counts, a ligand keeps both."""
    rows = [("a", 2, "A", 5, "HEM", "LIGAND", 7, "X1", "C", 1.0), ("a", 2, "A", 5, "HEM", "LIGAND", 6, "X1", "N", 2.0), ("a", 1, "A", 4, "GLY", "PROTEIN", 1, "CA", "C", 3.0), ("a", 1, "A", 4, "GLY", "PROTEIN", 2, "CA", "C", 4.0), ("b", 1, "A", 1, "XXX", "PROTEIN", 1, "CA", "C", 5.0)]
    atoms = spark.createDataFrame([(*r, r[-1], r[-1]) for r in rows], "structure_id string, residue_ord int, chain_id string, res_index int, res_name string, modality string, atom_ord int, atom_name string, element string, x double, y double, z double")
    got = [(r["structure_id"], r["atom_idx"], r["atom_name"], r["element"], r["is_virtual"], r["x"]) for r in tokens.tokenize(atoms).orderBy("structure_id", "atom_idx").collect()]
    assert got == [("a", 1, "N", "N", True, None), ("a", 2, "CA", "C", False, 4.0), ("a", 3, "C", "C", True, None), ("a", 4, "O", "O", True, None), ("a", 5, "X1", "N", False, 2.0), ("a", 6, "X1", "C", False, 1.0)]


def test_examples_of_training_join_constraints_once(spark, sf):
    """Centres come from the tokens: constraints are joined to them once."""
    plan = QUERIES["training_examples"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 1


def test_padded_columns_keep_what_the_frame_has(spark):
    """Values are put beside all columns of a padded frame, without joining the frame to itself."""
    frame = spark.createDataFrame([(0, 1, 1, 7), (0, 1, 2, 1)], "batch_id long, structure_id long, atom_idx int, element_idx int")
    values = spark.createDataFrame([(1, 1, 2.5)], "structure_id long, atom_idx int, x double")
    rows = tokens.pad_columns(values, frame, ["x"], keep=frame.columns).orderBy("atom_idx").collect()
    assert [tuple(r[c] for c in (*frame.columns, "x")) for r in rows] == [(0, 1, 1, 7, 2.5), (0, 1, 2, 1, 0.0)]


def test_residue_pairs_are_not_put_into_one_task(spark, sf):
    """Adaptive execution joins small shuffles to one task; residues, whose pairs are many, keep their parts."""
    sums = tokens.relative_position_sums(mol_features(spark, sf))
    rows = sums.select(F.spark_partition_id().alias("part")).distinct().count()
    assert rows > 4
