"""Residue, atom and element vocabularies, and the column functions that look them up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Atom names of each residue beyond its backbone, in slot order.
PROTEIN_BACKBONE = ["N", "CA", "C", "O"]
PROTEIN_SIDE_CHAINS = {
    "ALA": ["CB"],
    "ARG": ["CB", "CG", "CD", "NE", "CZ", "NH1", "NH2"],
    "ASN": ["CB", "CG", "OD1", "ND2"],
    "ASP": ["CB", "CG", "OD1", "OD2"],
    "CYS": ["CB", "SG"],
    "GLN": ["CB", "CG", "CD", "OE1", "NE2"],
    "GLU": ["CB", "CG", "CD", "OE1", "OE2"],
    "GLY": [],
    "HIS": ["CB", "CG", "ND1", "CD2", "CE1", "NE2"],
    "ILE": ["CB", "CG1", "CG2", "CD1"],
    "LEU": ["CB", "CG", "CD1", "CD2"],
    "LYS": ["CB", "CG", "CD", "CE", "NZ"],
    "MET": ["CB", "CG", "SD", "CE"],
    "PHE": ["CB", "CG", "CD1", "CD2", "CE1", "CE2", "CZ"],
    "PRO": ["CB", "CG", "CD"],
    "SER": ["CB", "OG"],
    "THR": ["CB", "OG1", "CG2"],
    "TRP": ["CB", "CG", "CD1", "CD2", "NE1", "CE2", "CE3", "CZ2", "CZ3", "CH2"],
    "TYR": ["CB", "CG", "CD1", "CD2", "CE1", "CE2", "CZ", "OH"],
    "VAL": ["CB", "CG1", "CG2"],
}
NUCLEOTIDE_BACKBONE = ["P", "OP1", "OP2", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "C1'"]
PURINE_A = ["N9", "C8", "N7", "C5", "C6", "N6", "N1", "C2", "N3", "C4"]
PURINE_G = ["N9", "C8", "N7", "C5", "C6", "O6", "N1", "C2", "N2", "N3", "C4"]
PYRIMIDINE_C = ["N1", "C2", "O2", "N3", "C4", "N4", "C5", "C6"]
RNA_BASES = {"A": ["O2'", *PURINE_A], "C": ["O2'", *PYRIMIDINE_C], "G": ["O2'", *PURINE_G], "U": ["O2'", "N1", "C2", "O2", "N3", "C4", "O4", "C5", "C6"]}
DNA_BASES = {"DA": PURINE_A, "DC": PYRIMIDINE_C, "DG": PURINE_G, "DT": ["N1", "C2", "O2", "N3", "C4", "O4", "C5", "C7", "C6"]}
# Modalities and elements by index from 1, van der Waals radii (Å), modified residues, water, file suffixes.
MODALITIES = ["PROTEIN", "RNA", "DNA", "LIGAND", "ION", "PTM"]
ELEMENTS = ["C", "N", "O", "S", "P", "H", "Fe", "Zn", "Mg", "Ca", "Na", "Cl", "Mn", "Cu", "K", "Se"]
VDW_RADII = {
    "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "H": 1.10, "Fe": 1.94, "Zn": 1.39,
    "Mg": 1.73, "Ca": 2.31, "Na": 2.27, "Cl": 1.75, "Mn": 1.97, "Cu": 1.96, "K": 2.75, "Se": 1.90,
}
DEFAULT_VDW_RADIUS = 1.70
MODIFIED_RESIDUES = ["SEP", "TPO", "PTR", "MSE", "MLY", "M3L", "MLZ", "ALY", "CSO", "CSD", "HYP", "PCA"]
WATERS = ["HOH", "WAT", "DOD"]
STRUCTURE_SUFFIXES = ["pdb", "ent", "cif", "mmcif"]

SLOTS: dict[str, list[str]] = (
    {name: PROTEIN_BACKBONE + rest for name, rest in PROTEIN_SIDE_CHAINS.items()}
    | {name: NUCLEOTIDE_BACKBONE + rest for name, rest in RNA_BASES.items()}
    | {name: NUCLEOTIDE_BACKBONE + rest for name, rest in DNA_BASES.items()}
)
MAX_SLOTS = max(map(len, SLOTS.values()))
RESIDUE_MODALITY = dict.fromkeys(PROTEIN_SIDE_CHAINS, "PROTEIN") | dict.fromkeys(RNA_BASES, "RNA") | dict.fromkeys(DNA_BASES, "DNA")
N_ELEMENTS = len(ELEMENTS) + 1
N_POLYMER_ATOMS = sum(map(len, SLOTS.values())) + 1
LARGEST_CLASH = 2 * max(VDW_RADII.values())


def _literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*(F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x) for pair in values.items() for x in pair))


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """The value of a small fixed table, null for other keys."""
    return F.try_element_at(_literal_map(values), key)


def atom_slots(res_name: Column) -> Column:
    """Ordered slot names of a polymer residue; null if the name is unknown."""
    return lookup(SLOTS, res_name)


def residue_modality(res_name: Column) -> Column:
    """Modality of a polymer residue name; other names are an error."""
    return F.coalesce(lookup(RESIDUE_MODALITY, res_name), F.raise_error(F.concat(F.lit("unknown polymer residue: "), res_name)))


def classify_residue(res_name: Column, hetero: Column, n_atoms: Column) -> Column:
    """Modality of any residue: by name; else protein if not hetero, ion if one atom, PTM if listed, else ligand."""
    return (
        F.when(res_name.isin(*RESIDUE_MODALITY), lookup(RESIDUE_MODALITY, res_name))
        .when(~hetero, F.lit("PROTEIN"))
        .when(n_atoms == 1, F.lit("ION"))
        .when(res_name.isin(MODIFIED_RESIDUES), F.lit("PTM"))
        .otherwise(F.lit("LIGAND"))
    )


def normalize_element(symbol: Column) -> Column:
    """'' → X; else the first letter upper and the rest lower."""
    return F.when(symbol == "", F.lit("X")).otherwise(F.concat(F.upper(F.substring(symbol, 1, 1)), F.lower(F.substring(symbol, 2, 2**31 - 1))))


def infer_element(atom_name: Column) -> Column:
    """First letter of an atom name, upper case; a name without a letter is an error."""
    letter = F.regexp_extract(atom_name, "([A-Za-z])", 1)
    return F.when(letter != "", F.upper(letter)).otherwise(F.raise_error(F.concat(F.lit("no element in atom name: "), atom_name)).cast("string"))


def element_index(element: Column) -> Column:
    return F.coalesce(lookup({e: k + 1 for k, e in enumerate(ELEMENTS)}, element), F.lit(N_ELEMENTS))


def modality_index(modality: Column) -> Column:
    return lookup({m: k + 1 for k, m in enumerate(MODALITIES)}, modality)


def polymer_atom_index(res_name: Column, atom_name: Column) -> Column:
    """1.. over (residue in table order, slot); the last number is for all else."""
    first, at = {}, 0
    for name, slots in SLOTS.items():
        first[name] = at
        at += len(slots)
    slot = F.array_position(atom_slots(res_name), atom_name)
    return F.when(slot > 0, lookup(first, res_name) + slot).otherwise(F.lit(N_POLYMER_ATOMS)).cast("int")


def polymer_start(res_name: str) -> int:
    """The index of the first slot of a polymer residue."""
    names = list(SLOTS)
    return 1 + sum(len(SLOTS[n]) for n in names[: names.index(res_name)])


def vdw_radius(element: Column) -> Column:
    return F.coalesce(lookup(VDW_RADII, element), F.lit(DEFAULT_VDW_RADIUS))
