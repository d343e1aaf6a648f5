"""Columns of a plain loop equal those that the row parser gives."""

from __future__ import annotations

import random
import time

import pytest

from atomloom.sources.structures import _cif_columns, _cif_rows

NAMES = ["group_PDB", "id", "type_symbol", "label_atom_id", "auth_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "auth_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
CELLS = ["ATOM", "HETATM", ".", "?", "'.'", "A", "B", "1", "2", "x'y", "O5'", '"O5\'"', "'a b'", "''", "'open", '"', "1.5", "-2e3", "nan", "1_0", " ", "é", "loop", "a#b", ";x"]
BREAKS = [" ", " ", " ", "\t", "\n", "\n", "\r\n", " \n ", "\n\n"]


def by_rows(text):
    return [list(c) for c in zip(*_cif_rows(text), strict=True)]


@pytest.mark.parametrize("seed", range(400))
def test_columns_are_those_of_the_rows(seed):
    draw = random.Random(seed)
    names = draw.sample(NAMES, draw.randint(1, len(NAMES))) + draw.choice([[], ["id"]])
    cells = draw.choice([CELLS, CELLS[:4] + ["A", "1", "1.5", "CA"]])
    breaks = BREAKS + draw.choice([[], [], ["\x0b"], ["\r"], [" "], ["\n;t\nu v\n;\n"]])
    body = "".join(draw.choice(cells) + draw.choice(breaks) for _ in range(draw.randint(0, 60)))
    tail = draw.choice(["", "\n#\n", "\n  #\nrest 1 2", "\nloop_\n_b.c\n1", "\ndata_y\n", "\n_q 5\n"])
    text = draw.choice(["data_x\nloop_\n", "loop_\r\n", "#\n_a.b 1\nloop_\n"]) + "".join(f"{draw.choice(['', ' '])}_atom_site.{n}{draw.choice(['', ' '])}\n" for n in names) + body + tail
    assert repr(_cif_columns(text)) == repr(by_rows(text)), text


def test_no_loop_has_no_columns():
    assert _cif_columns("") == _cif_columns("data_x\nloop_\n") == _cif_columns("_atom_site.id") == []


def test_columns_take_a_third_of_the_time_of_rows():
    head = "loop_\n" + "".join(f"_atom_site.{n}\n" for n in NAMES)
    text = head + "".join(f"ATOM {i} C CA 'CA' . ALA A\nA {i // 5} {i / 7:.3f} {i / 9:.3f} 0.5 1\n" for i in range(20000)) + "#\n"
    took = []
    for f in (_cif_columns, by_rows):
        began = time.process_time()
        assert len(f(text)[0]) == 20000
        took.append(time.process_time() - began)
    assert took[0] < took[1] / 3, took
