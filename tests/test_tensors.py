"""Dense tensors of padded batches: values, the commit protocol and errors."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.operators import tokens
from atomloom.plans import queries
from atomloom.sources import tensors

SCHEMA = "batch_id long, structure_id string, atom_idx int, chain_idx int, res_index int, pad_mask boolean, x double, y double"


def rows(batch, name, n, n_max, chains=2):
    """A structure of n atoms padded to n_max; residues of two atoms, far apart in the second chain."""
    own = [(batch, name, k + 1, 1 + k % chains, 40 * (k // 2) * (k % chains) + k // 2, True, 0.5 * k, -float(k)) for k in range(n)]
    return own + [(batch, name, k + 1, 1, 0, False, 0.0, 0.0) for k in range(n, n_max)]


def files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if f.endswith(".arrow"))


def test_tensors_equal_padded_rows(spark, sf, tmp_path):
    path = str(tmp_path / "t")
    padded = queries.padded(spark, sf)
    dense = queries.mol(spark, sf).withColumn("atom_idx", F.row_number().over(queries.Window.partitionBy("structure_id").orderBy("atom_idx")))
    both = padded.join(tokens.pad_columns(dense, padded, "xyz").drop("batch_id"), ["structure_id", "atom_idx"])
    tensors.write_tensors(both, path, {"coordinates": ("x", "y", "z")}, window=32)
    expected = both.toPandas().sort_values(["batch_id", "structure_id", "atom_idx"])
    pairs = tokens.pad_pairs(tokens.relative_positions(padded.filter("pad_mask")), padded).toPandas()
    seen = 0
    for batch_id, ids, found in tensors.stacked(path):
        own = expected[expected.batch_id == batch_id]
        shape = (len(ids), own.atom_idx.max())
        assert ids == sorted(own.structure_id.unique())
        for c in ("element_idx", "polymer_atom_idx", "chain_idx", "res_index", "is_virtual", "pad_mask"):
            assert np.array_equal(found[c], own[c].to_numpy().reshape(shape)), c
        assert np.allclose(found["coordinates"], own[["x", "y", "z"]].to_numpy().reshape(*shape, 3), rtol=1e-6)
        if seen < 3:
            near = pairs[pairs.structure_id.isin(ids)].sort_values(["structure_id", "i", "j"]).bucket.to_numpy()
            assert np.array_equal(found["relative_position"], near.reshape(*shape, shape[1]))
        seen += 1
    assert seen == expected.batch_id.nunique() > 3
    back = tensors.read_tensors(spark, path)
    assert back.schema.simpleString() == both.schema.simpleString()
    same = [c for c in both.columns if c not in "xyz"]
    assert back.select(same).exceptAll(both.select(same)).count() == 0 and back.count() == len(expected)


def test_jobs_add_and_replace(spark, tmp_path):
    path = "file://" + str(tmp_path / "t")
    frame = lambda *parts: spark.createDataFrame(sum(parts, []), SCHEMA)
    held = lambda: {(b, tuple(ids)) for b, ids, _ in tensors.stacked(path)}
    tensors.write_tensors(frame(rows(1, "a", 3, 4), rows(1, "b", 4, 4)), path)
    tensors.write_tensors(frame(rows(2, "c", 1, 1)), path)
    assert held() == {(1, ("a", "b")), (2, ("c",))}
    tensors.write_tensors(frame(rows(7, "d", 2, 2), rows(8, "e", 5, 5)), path, mode="overwrite")
    assert held() == {(7, ("d",)), (8, ("e",))} and len(files(tmp_path)) == 2
    tensors.write_tensors(frame([]), path, mode="overwrite")
    assert held() == set() and files(tmp_path) == [] and tensors.read_tensors(spark, path).count() == 0
    with pytest.raises(Exception, match="holds no tensors"):
        tensors.read_tensors(spark, str(tmp_path / "none"))


BROKEN = {
    "not padded": (rows(3, "a", 2, 2) + rows(3, "b", 3, 3), "pad it first"),
    "an atom missing": (rows(3, "a", 4, 4)[1:], "missing or twice"),
    "an atom twice": (rows(3, "a", 4, 4) + rows(3, "a", 1, 1), "missing or twice"),
    "a null": ([(3, "a", 1, 1, None, True, 0.0, 0.0)], "nulls"),
    "no structure": ([(3, None, 1, 1, 1, True, 0.0, 0.0)], "nulls"),
}


@pytest.mark.parametrize("name", BROKEN)
def test_a_failed_task_leaves_no_file(spark, tmp_path, name):
    path = str(tmp_path / "t")
    tensors.write_tensors(spark.createDataFrame(rows(1, "kept", 3, 3), SCHEMA), path)
    bad, reason = BROKEN[name]
    good = [r for k in range(10, 30) for r in rows(k, "fine", 3, 3)]
    with pytest.raises(Exception, match=reason):
        tensors.write_tensors(spark.createDataFrame(good + bad, SCHEMA), path, mode="overwrite")
    assert [(b, ids) for b, ids, _ in tensors.stacked(path)] == [(1, ["kept"])] and len(files(tmp_path)) == 1


def test_files_of_lost_attempts_go(spark, tmp_path):
    system, base = tensors.opened(str(tmp_path / "t"))
    schema = spark.createDataFrame([], SCHEMA).schema
    writer = tensors.TensorWriter(base, tensors.Layout({}, 32), schema, False)
    records = spark.createDataFrame(rows(1, "a", 3, 3), SCHEMA).toArrow().to_batches()
    writer.write(iter(records))  # its executor is lost before it reports
    kept = writer.write(iter(records))
    assert len(files(tmp_path)) == 2 and list(tensors.stacked(base)) == []
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([kept, kept])
    writer.commit([kept, None])
    assert len(files(tmp_path)) == 1 and [b for b, *_ in tensors.stacked(base)] == [1]
