"""Files read in splits give the rows of whole texts."""

from __future__ import annotations

import random

import pytest

from atomloom.sources import splits, structures

NAMES = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]


def cif_text(n, rng, models=1, end=True):
    """A loop whose rows break over lines, with quotes, text fields, alternative locations and a second loop after it."""
    lines = ["data_x", "_entry.id X", ";", "a text; _atom_site.no", ";", "loop_", *(f"_atom_site.{c}" for c in NAMES)]
    for k in range(n):
        name = rng.choice(['"C1\'"', "CA", "'O 1'", "N"])
        cells = [rng.choice(["ATOM", "HETATM"]), str(k), rng.choice(["C", "."]), name, rng.choice([".", "A", "B"]), rng.choice(["ALA", "HOH", "G"]), "A", str(k // 4), f"{k}.5", rng.choice(["2.25", "?"]), "-1.0", str(1 + k * models // max(1, n))]
        if rng.random() < 0.2:
            at = rng.randrange(len(cells))
            lines += [" ".join(cells[:at]), " ".join(cells[at:])]
        elif rng.random() < 0.15:
            lines += [" ".join(cells[:3]), ";" + "CB", "" if rng.random() < 0.5 else " ", "; " + " ".join(cells[4:])]
        else:
            lines.append(" ".join(cells))
    return "\n".join(lines + (["#", "loop_", "_other.a", "1 2 3", "_atom_site.late"] if end else ["ATOM 9999 C"]))


def pdb_text(n, models=1):
    each = n // models
    lines = [f"HEADER {n}"]
    for k in range(n):
        lines.append(f"{'ATOM':<6}{k:>5} {'CA':<4} {'ALA':>3} A{k // 3:>4}    {k * 0.5:8.3f}{1.0:8.3f}{2.0:8.3f}  1.00  0.00           C")
        if models > 1 and (k + 1) % each == 0:
            lines.append("ENDMDL")
    return "\n".join(lines)


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("size,chunk", [(300, 100), (1000, 170), (1 << 20, 90)])
def test_splits_give_the_rows_of_whole_texts(spark, tmp_path, small_splits, size, chunk):
    rng = random.Random(size)
    files = {"a.cif": cif_text(60, rng), "b.CIF": cif_text(25, rng, models=3), "c.mmcif": cif_text(7, rng, end=False), "d.cif": "data_x\n#\n", "e.cif": "", "f.pdb": pdb_text(40), "g.ent": pdb_text(45, models=3), "h.pdb": "", "i.pdb": "ENDMDL\n" + pdb_text(5), "notes.txt": pdb_text(9)}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    whole = structures.raw_atoms(structures.read_structures(spark, str(tmp_path)))
    expected = rows_of(whole)
    small_splits(size)
    found = splits.split_atoms(spark, str(tmp_path), chunk_bytes=chunk)
    assert rows_of(found) == expected and len(expected) > 60
    assert splits.structure_chunks(spark, str(tmp_path), chunk_bytes=chunk).count() > 20
    assert rows_of(splits.read_structures_in_splits(spark, str(tmp_path), chunk_bytes=chunk)) == rows_of(structures.residues_of(whole))


def test_every_boundary_of_a_loop():
    """States of chunks cut at any line agree with reading on."""
    lines = cif_text(12, random.Random(1), models=2).split("\n")
    whole, _ = splits.read_loop(lines, splits.LoopState())
    for at in range(len(lines) + 1):
        begun, _ = splits.read_loop(lines[:at], splits.LoopState())
        assert splits.after(splits.LoopState(), splits.notes_of(lines[:at], True)) == begun
        assert splits.after(begun, splits.notes_of(lines[at:], True)) == whole
