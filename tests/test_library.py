"""Commits of a library, loading in waves and the mirror source."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from atomloom.operators import library
from atomloom.sources import mirror, storage

LINE = "ATOM  {n:5d}  CA  ALA A{n:4d}    {x:8.3f}   0.000   0.000  1.00  0.00           C\n"


def pdb(n):
    return "".join(LINE.format(n=k, x=k) for k in range(1, n + 1))


def texts(spark, sizes):
    """PDB texts of so many residues; none is a failure."""
    return spark.createDataFrame([(k, "pdb", pdb(n) or "HEADER") for k, n in sizes.items()], "structure_id string, format string, content string")


def held(spark, path):
    return {r.structure_id: r.n for r in library.read_library(spark, path).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_a_batch_that_is_cut_short_shows_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "library")
    assert held(spark, path) == {} and library.library_index(spark, path).count() == 0
    assert library.add_batch(spark, path, texts(spark, {"a": 2, "b": 0}), "1") == {"written": 1, "present": 0, "failed": 1}
    for step in ("tokenize", "put_new"):
        with monkeypatch.context() as broken:
            def stop(*_):
                raise RuntimeError("killed")

            broken.setattr(library, step, stop)
            with pytest.raises(RuntimeError, match="killed"):
                library.add_batch(spark, path, texts(spark, {"a": 2, "c": 3}), "2")
        assert held(spark, path) == {"a": 10}
    assert library.add_batch(spark, path, texts(spark, {"a": 2, "c": 3, "b": 0}), "2") == {"written": 1, "present": 1, "failed": 1}
    assert library.add_batch(spark, path, texts(spark, {"z": 9}), "2") == {"written": 1, "present": 1, "failed": 1}  # done already
    assert held(spark, path) == {"a": 10, "c": 15}
    assert sorted((r.structure_id, r.status) for r in library.library_outcomes(spark, path).collect()) == [("a", "ok"), ("b", "failed"), ("b", "failed"), ("c", "ok")]


def test_of_two_writers_one_starts_over(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "library"), library.put_new
    raced = []

    def slower(*args):
        if not raced:
            raced.append(True)
            library.add_batch(spark, path, texts(spark, {"a": 1, "b": 1}), "other")
        return real(*args)

    monkeypatch.setattr(library, "put_new", slower)
    assert library.add_batch(spark, path, texts(spark, {"a": 1, "c": 1}), "own") == {"written": 1, "present": 1, "failed": 0}
    assert held(spark, path) == {"a": 5, "b": 5, "c": 5}
    assert [b["batch"] for b in library.manifest(spark, path).batches] == ["other", "own"]


def test_only_the_index_tells_what_is_present(spark, tmp_path):
    path = str(tmp_path / "library")
    library.add_batch(spark, path, texts(spark, {"a": 1}), "1")
    files = library.library_index(spark, path).inputFiles()
    assert files and all("/ids/" in f for f in files)


def test_a_small_file_is_put_once(spark, tmp_path):
    path = str(tmp_path / "folder" / "x.json")
    assert storage.put_new(spark, path, "é") and not storage.put_new(spark, path, "other")
    assert storage.read_small(spark, path) == "é" and storage.names_in(spark, str(tmp_path / "folder")) == ["x.json"]


def numbered(part):
    """A loader of numbers: those divisible by 3 fail, others have one to ten atoms."""
    n = F.col("structure_id").cast("long")
    return part.filter(n % 3 != 0).select("structure_id", F.explode(F.sequence(F.lit(1).cast("long"), n % 10 + 1)).alias("atom_idx"))


@pytest.mark.parametrize("n", [1, 7, 40, 5000])
def test_waves_equal_loading_all(spark, n):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("structure_id"))
    candidates = library.shuffled(ids, 3).persist()
    found = library.load_in_waves(candidates, numbered, n, 6)
    order = [r.structure_id for r in candidates.orderBy("rank").collect()]
    fit = [s for s in order if int(s) % 3 and int(s) % 10 + 1 <= 6][:n]
    assert sorted(r.structure_id for r in found.tokens.select("structure_id").distinct().collect()) == sorted(fit)
    assert found.examined <= (100 if n <= 7 else 3000)
    assert library.load_in_waves(candidates.limit(0), numbered, n).tokens.count() == 0


def test_sources_in_their_order(spark, tmp_path):
    folder, path = tmp_path / "files", str(tmp_path / "library")
    folder.mkdir()
    for k in range(12):
        (folder / f"s{k:02d}.pdb").write_text(pdb(k % 4))
    library.add_batch(spark, path, texts(spark, {"in the library": 1}), "1")
    ids = lambda found: {r[0] for r in found.tokens.select("structure_id").distinct().collect()}
    assert ids(library.training_targets(spark, 5, library=path, directory=str(folder))) == {"in the library"}
    some = library.training_targets(spark, 3, 10, 1, directory=str(folder))
    assert len(ids(some)) == 3 and some.tokens.groupBy("structure_id").count().agg(F.max("count")).first()[0] <= 10
    listed = spark.createDataFrame([(f"file:{folder}/s{k:02d}.pdb", k) for k in range(12)], "structure_id string, rank long")
    assert {s.rsplit("/", 1)[1] for s in ids(library.training_targets(spark, 4, listed=listed))} == {"s01.pdb", "s02.pdb", "s03.pdb", "s05.pdb"}
    for empty in ({"library": str(tmp_path / "none")}, {"listed": listed.limit(0)}, {}):
        with pytest.raises(ValueError):
            library.training_targets(spark, 1, **empty)


def test_mirror_opens_only_what_filters_leave(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"s{k}.{'cif' if k % 2 else 'pdb'}").write_text(f"text {k}")
    (tmp_path / "bad.pdb").write_bytes(b"\xff\xfe")  # reading it is an error
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "t.ent").write_text("deep")
    rows = mirror.read_mirror(spark, str(tmp_path))
    with pytest.raises(Exception, match="utf-8"):
        rows.collect()
    some = rows.filter(F.col("structure_id").isin("s1", "s4", "none"))
    assert sorted((r.structure_id, r.format, r.content) for r in some.collect()) == [("s1", "cif", "text 1"), ("s4", "pdb", "text 4")]
    assert sorted(r.structure_id for r in rows.filter("format = 'cif'").collect()) == ["s1", "s3", "s5"]
    assert [r.content for r in rows.filter("structure_id = 's2' and bytes > 3").collect()] == ["text 2"]
    assert rows.filter("structure_id = 'none'").count() == 0
    assert mirror.read_mirror(spark, str(tmp_path), True).filter("structure_id like 't%'").first().content == "deep"
    assert mirror.read_mirror(spark, str(tmp_path), partition_bytes=7).filter("structure_id like 's%'").rdd.getNumPartitions() == 6


def test_planned_partitions():
    files = [mirror.MirrorFile(str(k), f"/m/{k}", "pdb", size) for k, size in enumerate((5, 5, 50, 1, 9, 3))]
    assert [[f.size for f in p.files] for p in mirror.planned(files, 10)] == [[5, 5], [50], [1, 9], [3]]
    assert mirror.planned([], 10) == []
