"""Hand-made structures: parsing, tokens, features and graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from atomloom.functions.vocab import MAX_SLOTS, N_ELEMENTS, N_POLYMER_ATOMS, SLOTS, classify_residue, infer_element, normalize_element
from atomloom.operators import geometry, tokens
from atomloom.sources import structures


def pdb_line(kind, serial, name, res, chain, number, x, y, z, element=""):
    return f"{kind:<6}{serial:>5} {name:<4} {res:>3} {chain}{number:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00          {element:>2}"


PDB = "\n".join(
    [pdb_line("ATOM", i + 1, n, "ALA", "A", 1, *p) for i, (n, p) in enumerate([("N", (0, 0, 0)), ("CA", (1, 0, 0)), ("C", (2, 0, 0)), ("O", (3, 0, 0)), ("CB", (1, 1, 0))])]
    + [pdb_line("ATOM", 6 + i, n, "GLY", "A", 2, 4 + i, 0, 0) for i, n in enumerate(["N", "CA", "C", "O"])]
    + [
        pdb_line("HETATM", 10, "ZN", "ZN", "B", 1, 10, 10, 10, "ZN"),
        pdb_line("HETATM", 11, "FE", "HEM", "C", 1, 12, 12, 12, "FE"),
        pdb_line("HETATM", 12, "N1", "HEM", "C", 1, 13, 12, 12, "N"),
        pdb_line("HETATM", 13, "O", "HOH", "D", 1, 20, 20, 20, "O"),
    ]
)
CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM 1 C "C1'" . G A 1 1.0 2.0 3.0
ATOM 2 P P . G A 1 0.0 0.0 0.0
HETATM 3 O O . HOH B 1 9.0 9.0 9.0
#
"""


@pytest.fixture(scope="module")
def atoms(spark):
    texts = spark.createDataFrame([("p", "pdb", PDB), ("c", "cif", CIF)], "structure_id string, format string, content string")
    return structures.parse_structures(texts).cache()


def test_pdb_and_cif_residues(atoms):
    rows = {(r.structure_id, r.res_name): r.modality for r in atoms.select("structure_id", "res_name", "modality").distinct().collect()}
    assert rows == {("p", "ALA"): "PROTEIN", ("p", "GLY"): "PROTEIN", ("p", "ZN"): "ION", ("p", "HEM"): "LIGAND", ("c", "G"): "RNA"}
    assert {r.element for r in atoms.filter("res_name in ('ZN', 'HEM')").collect()} == {"Zn", "Fe", "N"}
    largest = {r.structure_id: r.chain_id for r in structures.largest_chain(atoms).collect()}
    assert largest == {"p": "A", "c": "A"}


def test_tokens_and_virtual_slots(atoms):
    t = tokens.tokenize(atoms).toPandas()
    assert len(t[t.structure_id == "c"]) == MAX_SLOTS == 23
    assert set(t[(t.structure_id == "c") & ~t.is_virtual].atom_name) == {"P", "C1'"}
    p = t[t.structure_id == "p"].sort_values("atom_idx")
    assert list(p.atom_name) == ["N", "CA", "C", "O", "CB", "N", "CA", "C", "O", "ZN", "FE", "N1"]
    assert list(p.atom_idx) == list(range(1, 13)) and not p.is_virtual.any()
    f = tokens.featurize(tokens.tokenize(atoms)).filter("structure_id = 'p'").orderBy("atom_idx").toPandas()
    assert list(f.chain_idx) == [1] * 9 + [2, 3, 3]
    assert f.polymer_atom_idx.iloc[-1] == N_POLYMER_ATOMS == 335 and N_ELEMENTS == 17


def test_unknown_polymer_is_set_aside(spark):
    rows = spark.createDataFrame([("s", 1, "A", 1, "XXX", "N", "N", 0.0, 0.0, 0.0, False)], "structure_id string, atom_ord int, chain_id string, res_id int, res_name string, atom_name string, element string, x double, y double, z double, hetero boolean")
    found = structures.from_atom_array(rows)
    assert tokens.tokenize(found).count() == 0
    assert tokens.quarantined(found).first().reason == "unknown polymer residue: XXX"
    with pytest.raises(ValueError):
        structures.from_atom_array(rows.drop("x"))


def test_every_text_has_a_status(spark):
    """Rows over several lines, text values, a row that ends early and unreadable numbers: nothing vanishes without a reason."""
    broken = CIF.replace('ATOM 1 C "C1\'" . G A 1 1.0 2.0 3.0', "ATOM 1 C\n;C1'\n; . G\nA 1 1.0 oops\n3.0").replace("HETATM 3 O O . HOH B 1 9.0 9.0 9.0", "ATOM 3 C C8 . G A")
    texts = [("p", "pdb", PDB), ("c", "cif", CIF), ("broken", "cif", broken), ("none", "pdb", "HEADER"), ("empty", "cif", None), ("water", "pdb", PDB.splitlines()[-1])]
    texts.append(("odd", "pdb", pdb_line("ATOM", 1, "N", "XXX", "A", 1, 0, 0, 0)))
    rows = {r.structure_id: (r.n_atoms, r.status, r.reason) for r in structures.parse_status(spark.createDataFrame(texts, "structure_id string, format string, content string")).collect()}
    assert rows == {
        "p": (12, "ok", None),
        "c": (2, "ok", None),
        "broken": (3, "damaged", "atom rows with unreadable numbers: 2"),
        "none": (0, "failed", "no atom records"),
        "empty": (0, "failed", "no atom records"),
        "water": (0, "failed", "waters only"),
        "odd": (1, "failed", "unknown polymer residue: XXX"),
    }
    got = structures.parse_structures(spark.createDataFrame(texts[2:3], "structure_id string, format string, content string")).orderBy("atom_ord").collect()
    assert [(r.atom_name, r.x, r.y, r.z) for r in got] == [("C1'", 1.0, None, 3.0), ("P", 0.0, 0.0, 0.0), ("C8", None, None, None)]


def test_strangers_do_not_bond(spark):
    """A calcium ion and a ligand nitrogen in a protein residue's chain and number: no bonds, no centres, but clashes."""
    rows = [("s", i + 1, c, r, n, n[0], "PROTEIN", float(x), float(y), float(z)) for i, (c, r, n, x, y, z) in enumerate(TWO)]
    rows += [("s", 50, "A", 1, "CA", "Ca", "ION", 9.0, 9.0, 9.0), ("s", 51, "A", 2, "N", "N", "LIGAND", 9.0, 0.0, 0.0), ("s", 52, "B", 9, "O", "O", "LIGAND", 9.0, 9.5, 9.0)]
    a = spark.createDataFrame(rows, "structure_id string, atom_idx int, chain_id string, res_index int, atom_name string, element string, modality string, x double, y double, z double")
    protein = a.filter("modality = 'PROTEIN'")
    same = lambda f: sorted(map(tuple, f(a).collect())) == sorted(map(tuple, f(protein).collect()))
    assert same(geometry.backbone_bonds) and same(geometry.chiral_centers)
    whole, own = geometry.validity_parts(a).first(), geometry.validity_parts(protein).first()
    assert (whole.n_atoms, whole.clashes, own.clashes) == (12, 1, 0)
    assert (whole.bond_energy, whole.n_bonds, whole.chirality_energy) == (own.bond_energy, own.n_bonds, own.chirality_energy)
    with pytest.raises(Exception, match="larger than"):
        geometry.clash_pairs(a, largest=1.7).count()


def test_scalar_functions(spark):
    assert SLOTS["GLY"] == ["N", "CA", "C", "O"]
    row = spark.range(1).select(normalize_element(F.lit("")).alias("a"), normalize_element(F.lit("zn")).alias("b"), infer_element(F.lit("1hb")).alias("c"), classify_residue(F.lit("SEP"), F.lit(True), F.lit(1)).alias("d"), classify_residue(F.lit("SEP"), F.lit(True), F.lit(9)).alias("e")).first()
    assert tuple(row) == ("X", "Zn", "H", "ION", "PTM")


def test_relative_positions(spark):
    f = spark.createDataFrame([("s", 1, 1, 1), ("s", 2, 1, 3), ("s", 3, 2, 1)], "structure_id string, atom_idx int, chain_idx int, res_index int")
    got = {(r.i, r.j): r.bucket for r in tokens.relative_positions(f).collect()}
    assert [got[i, j] for i in (1, 2, 3) for j in (1, 2, 3)] == [33, 31, 66, 35, 33, 66, 66, 66, 33]


def test_file_listing(spark, tmp_path):
    for name in ("a.pdb", "b.CIF", "notes.txt", "subdir/c.pdb"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(PDB)
    assert structures.list_structure_files(spark, str(tmp_path)).count() == 2
    assert structures.list_structure_files(spark, str(tmp_path), recursive=True).count() == 3
    assert structures.read_structures(spark, str(tmp_path)).filter("format = 'cif'").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        structures.list_structure_files(spark, str(tmp_path / "none")).count()


TWO = [("A", 1, "N", 0, 0, 0), ("A", 1, "CA", 1.5, 0, 0), ("A", 1, "C", 2.9, 0.4, 0), ("A", 1, "O", 3.4, 1.5, 0), ("A", 1, "CB", 1.9, -0.7, 1.2), ("A", 2, "N", 3.6, -0.6, -0.3), ("A", 2, "CA", 5.0, -0.5, -0.2), ("A", 2, "C", 5.6, -1.9, -0.4), ("A", 2, "O", 5.0, -2.9, -0.1)]


def test_bonds_and_centers(spark):
    rows = [("s", i + 1, c, r, n, n[0], float(x), float(y), float(z)) for i, (c, r, n, x, y, z) in enumerate(TWO)]
    a = spark.createDataFrame(rows, "structure_id string, atom_idx int, chain_id string, res_index int, atom_name string, element string, x double, y double, z double")
    bonds = {(b.i, b.j, b.ideal) for b in geometry.backbone_bonds(a).collect()}
    assert bonds == {(1, 2, 1.458), (2, 3, 1.525), (3, 4, 1.231), (2, 5, 1.530), (6, 7, 1.458), (7, 8, 1.525), (8, 9, 1.231), (3, 6, 1.329)}
    c = geometry.chiral_centers(a).collect()
    assert [(x.ca, x.n, x.c, x.cb) for x in c] == [(2, 1, 3, 5)]
    apart = a.withColumn("chain_id", F.when(F.col("res_index") == 2, "B").otherwise("A"))
    assert geometry.backbone_bonds(apart).count() == 7
