from __future__ import annotations

import numpy as np
import pytest

from atomloom.operators import training
from atomloom.operators.library import manifest, read_library
from atomloom.sources.structures import read_structures
from atomloom.streaming.library import library_stream

LINE = "ATOM  {n:5d} {name:<4s} ALA A{res:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           {element:>2s}\n"


def test_checkpoint_round_trip(spark, tmp_path):
    params = {"w": np.arange(6.0).reshape(2, 3), "b": np.zeros(3)}
    for epoch in (1, 2):
        training.save_checkpoint(spark, str(tmp_path / "c"), epoch, params)
    epoch, back = training.load_checkpoint(spark, str(tmp_path / "c"))
    assert epoch == 2 and all((back[k] == v).all() and back[k].shape == v.shape for k, v in params.items())


def test_metrics_append(spark, tmp_path):
    rows = spark.createDataFrame([(0, "train", 1, 0.5)], "epoch int, phase string, batch_id long, loss double")
    for run in ("a", "b"):
        training.log_metrics(rows, str(tmp_path / "log"), run)
    assert {r.run for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {"a", "b"}


@pytest.mark.parametrize(("parts", "expected"), [("train val test train", [3]), ("val train val", [1, 3]), ("train train", [1, 2]), ("", [])])
def test_check_pool_precedence(spark, parts, expected):
    rows = spark.createDataFrame([(i + 1, p) for i, p in enumerate(parts.split())], "id long, split string")
    assert [r.id for r in training.check_pool(rows, "id").collect()] == expected


def test_library_stream_takes_each_file_once(spark, tmp_path):
    source, library = tmp_path / "files", str(tmp_path / "library")
    source.mkdir()
    for expected, name in enumerate(("a.pdb", "b.ent"), start=1):
        (source / name).write_text("".join(LINE.format(n=k, name=f" {e}", res=1, x=k, y=0.0, z=0.0, element=e[0]) for k, e in enumerate(("N", "CA"), start=1)))
        (source / "notes.txt").write_text("no structure")
        (source / f"empty{expected}.pdb").write_text("HEADER")
        for _ in range(2):
            library_stream(spark, str(source), library, str(tmp_path / "checkpoint")).awaitTermination()
        rows = read_library(spark, library)
        assert rows.select("structure_id").distinct().count() == expected and rows.count() == 5 * expected
    assert [b["counts"] for b in manifest(spark, library).batches] == 2 * [{"written": 1, "present": 0, "failed": 1}]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.pdb", "deep/b.CIF", "notes.txt"):
        (tmp_path / name).write_text("x")
    flat, deep = (read_structures(spark, str(tmp_path), recursive).collect() for recursive in (False, True))
    assert [r.format for r in flat] == ["pdb"] and sorted(r.format for r in deep) == ["cif", "pdb"] and flat[0].content == "x"
