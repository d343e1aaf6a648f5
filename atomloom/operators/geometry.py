"""Geometric validity: clashes, bonds, chirality, local distance agreement and superposition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.functions.geometry import distance, normalized_chiral_volume, quaternion_rotation, rotate, xyz
from atomloom.functions.vocab import LARGEST_CLASH, vdw_radius

# Ideal backbone bond lengths (Å).
INTRA_BONDS = {("N", "CA"): 1.458, ("CA", "C"): 1.525, ("C", "O"): 1.231, ("CA", "CB"): 1.530}
PEPTIDE_BOND = 1.329
TOLERANCE = 0.4
LDDT_CUTOFF = 15.0
LDDT_THRESHOLDS = (0.5, 1.0, 2.0, 4.0)
#: Side of the cubes that ``neighbour_pairs`` deals atoms to, in radii.
CUBE = 4


def neighbour_pairs(atoms: DataFrame, radius: float, carry: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """Unordered pairs of atoms of a structure within ``radius``: (structure_id, i, j, d, l_<c>, r_<c> ...) with i < j.

    Space is cut in cubes of ``CUBE`` radii. An atom goes to its own cube and to those before it (in the order of their numbers)
    that it is near enough to, which in a small structure are few; a pair meets once, in the first of its two cubes. Both sides of
    the join on (structure, cube) are the same rows, so they are shuffled once. Work grows with the atoms times those of a cube,
    not with all pairs. Atoms with a null coordinate pair with nothing.
    """
    side, reach = CUBE * radius, radius * (1 + 1e-6)
    at = lambda c: F.floor(c / F.lit(side) + 0.5)
    cube = {f"c{a}": at(F.col(a)) for a in "xyz"}
    base = atoms.select("structure_id", "atom_idx", "x", "y", "z", *carry).filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).withColumns(cube)
    # A cube is so wide that an atom is near to one side of it at most, so it has at most one step along each axis.
    below, above = ({a: at(F.col(a) + F.lit(sign * reach)) == F.col(f"c{a}") + sign for a in "xyz"} for sign in (-1, 1))
    either = lambda a, earlier: F.explode(F.when(below[a], F.array(F.lit(0), F.lit(-1))).when(above[a] & earlier, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    stepped = base.withColumn("dx", either("x", F.lit(False))).withColumn("dy", either("y", F.col("dx") < 0)).withColumn("dz", either("z", (F.col("dx") < 0) | (F.col("dy") < 0)))
    own = (F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0)
    dealt = stepped.withColumn("own", own).withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"d{a}") for a in "xyz"}).drop("dx", "dy", "dz")
    left, right = dealt.alias("l"), dealt.alias("r")
    keys = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("structure_id", "cx", "cy", "cz")]
    first = F.col("l.atom_idx") < F.col("r.atom_idx")
    # One condition on both sides: a filter of either alone would make their shuffles differ.
    met = F.when(F.col("r.own"), F.col("l.own") & first).otherwise(F.col("l.own")) & (F.abs(F.col("l.x") - F.col("r.x")) <= reach)
    d = distance(xyz("l."), xyz("r."))
    within = d <= radius if inclusive else d < radius
    joined = left.join(right, keys[0] & keys[1] & keys[2] & keys[3] & met & within)
    side_of = lambda s, c: F.when(first, F.col(f"{s}.{c}")).otherwise(F.col(f"{'r' if s == 'l' else 'l'}.{c}"))
    extra = [side_of(s, c).alias(f"{s}_{c}") for s in "lr" for c in carry]
    return joined.select(F.col("l.structure_id").alias("structure_id"), side_of("l", "atom_idx").alias("i"), side_of("r", "atom_idx").alias("j"), d.alias("d"), *extra)


def is_protein(atoms: DataFrame) -> Column:
    """Whether an atom is a protein's; atoms without a ``modality`` column all are."""
    return F.col("modality") == "PROTEIN" if "modality" in atoms.columns else F.lit(True)


def clash_pairs(atoms: DataFrame, tolerance: float = TOLERANCE, tie_eps: float = 0.0, carry: Sequence[str] = (), largest: float = LARGEST_CLASH / 2) -> DataFrame:
    """(structure_id, i, j, overlap, l_<c>, r_<c> ...) of atom pairs nearer than their radii allow, ions and ligands included.

    ``largest`` is the largest radius among the atoms; the smaller it is, the fewer pairs are looked at. A larger one in
    the data is an error.

    Pairs of one chain whose residues are the same or adjacent are no clashes. ``atoms`` needs chain_id, res_index and
    element. An overlap counts above ``tie_eps``.
    """
    radius = vdw_radius(F.col("element"))
    sized = atoms.withColumn("vdw", F.when(radius <= largest, radius).otherwise(F.raise_error(F.lit(f"an atom is larger than {largest}")).cast("double")))
    pairs = neighbour_pairs(sized, 2 * largest - tolerance, ("chain_id", "res_index", "vdw", *carry))
    apart = (F.col("l_chain_id") != F.col("r_chain_id")) | (F.abs(F.col("l_res_index") - F.col("r_res_index")) > 1)
    overlap = F.col("l_vdw") + F.col("r_vdw") - F.lit(tolerance) - F.col("d")
    return pairs.filter(apart & (overlap > tie_eps)).select("structure_id", "i", "j", overlap.alias("overlap"), *(f"{s}_{c}" for s in "lr" for c in carry))


def clashes(atoms: DataFrame, tolerance: float = TOLERANCE, tie_eps: float = 0.0, largest: float = LARGEST_CLASH / 2) -> DataFrame:
    """(structure_id, clash_energy, clashes) of structures with a clash."""
    return clash_pairs(atoms, tolerance, tie_eps, largest=largest).groupBy("structure_id").agg(F.sum(F.col("overlap") * F.col("overlap")).alias("clash_energy"), F.count(F.lit(1)).alias("clashes"))


def residue_atoms(atoms: DataFrame, names: Sequence[str], carry: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """One row a residue with a struct column for each name (null if absent); of equal names the last counts.

    Only protein atoms are picked: a calcium ion, a ligand or a nucleotide in the same chain and number fills no place.
    ``n_atoms`` counts all atoms.
    """
    fields = F.struct("atom_idx", *carry)
    picked = [F.max(F.when((F.col("atom_name") == n) & is_protein(atoms), fields)).alias(n) for n in names]
    return atoms.groupBy("structure_id", "chain_id", "res_index").agg(*picked, F.count(F.lit(1)).alias("n_atoms"))


def backbone_bonds(atoms: DataFrame) -> DataFrame:
    """(structure_id, i, j, ideal): backbone bonds inside residues, and peptide bonds to residue + 1 of the chain.

    Virtual atoms bond like real ones. A gap in the numbering has no bond. Only protein atoms bond.
    """
    residues = residue_atoms(atoms, ("N", "CA", "C", "O", "CB"), ())
    bond = lambda a, b, ideal: F.struct(F.col(f"{a}.atom_idx").alias("i"), F.col(f"{b}.atom_idx").alias("j"), F.lit(ideal).alias("ideal"))
    inside = residues.select("structure_id", F.explode(F.array(*(bond(a, b, d) for (a, b), d in INTRA_BONDS.items()))).alias("b")).select("structure_id", "b.*").filter(F.col("i").isNotNull() & F.col("j").isNotNull())
    carbon = residues.select("structure_id", "chain_id", (F.col("res_index") + 1).alias("res_index"), F.col("C.atom_idx").alias("i"))
    nitrogen = residues.select("structure_id", "chain_id", "res_index", F.col("N.atom_idx").alias("j"))
    peptide = carbon.join(nitrogen, ["structure_id", "chain_id", "res_index"]).filter(F.col("i").isNotNull() & F.col("j").isNotNull())
    return inside.unionByName(peptide.select("structure_id", "i", "j", F.lit(PEPTIDE_BOND).alias("ideal")))


def bond_deviations(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, i, j, ideal, d) of bonds with the coordinates of their atoms."""
    side = atoms.select("structure_id", "atom_idx", "x", "y", "z")
    b, p, q = bonds.alias("b"), side.alias("p"), side.alias("q")
    joined = b.join(p, (F.col("b.structure_id") == F.col("p.structure_id")) & (F.col("b.i") == F.col("p.atom_idx"))).join(q, (F.col("b.structure_id") == F.col("q.structure_id")) & (F.col("b.j") == F.col("q.atom_idx")))
    return joined.select("b.structure_id", "b.i", "b.j", "b.ideal", distance(xyz("p."), xyz("q.")).alias("d"))


def bond_summary(deviations: DataFrame) -> DataFrame:
    """(structure_id, bond_energy, bond_rmsd, n_bonds)."""
    square = (F.col("d") - F.col("ideal")) * (F.col("d") - F.col("ideal"))
    return deviations.groupBy("structure_id").agg(F.sum(square).alias("bond_energy"), F.sqrt(F.avg(square)).alias("bond_rmsd"), F.count(F.lit(1)).alias("n_bonds"))


def chiral_centers(atoms: DataFrame) -> DataFrame:
    """(structure_id, ca, n, c, cb, volume): residues with all four atoms, and their normalised chiral volume."""
    r = residue_atoms(atoms, ("CA", "N", "C", "CB"))
    full = r.filter(F.col("CA").isNotNull() & F.col("N").isNotNull() & F.col("C").isNotNull() & F.col("CB").isNotNull())
    volume = normalized_chiral_volume(*(xyz(f"{n}.") for n in ("CA", "N", "C", "CB")))
    return full.select("structure_id", *(F.col(f"{n}.atom_idx").alias(n.lower()) for n in ("CA", "N", "C", "CB")), volume.alias("volume"))


def chirality_summary(centers: DataFrame, energy_margin: float = 0.3, count_margin: float = 0.0, tie_eps: float = 0.0) -> DataFrame:
    """(structure_id, chirality_energy, chirality_violations, n_chiral_centers)."""
    short = F.greatest(F.lit(energy_margin) - F.col("volume"), F.lit(0.0))
    return centers.groupBy("structure_id").agg(F.sum(short * short).alias("chirality_energy"), F.count_if(F.col("volume") <= count_margin + tie_eps).alias("chirality_violations"), F.count(F.lit(1)).alias("n_chiral_centers"))


def backbone_residues(atoms: DataFrame) -> DataFrame:
    """``residue_atoms`` of the backbone and CB with coordinates, and ``next``: the N of the residue numbered one higher.

    Atoms are dealt by structure once; residues and their links follow in place.
    """
    residues = residue_atoms(atoms.repartition("structure_id"), ("N", "CA", "C", "O", "CB"), ("x", "y", "z"))
    ahead = Window.partitionBy("structure_id", "chain_id").orderBy("res_index")
    return residues.withColumn("next", F.when(F.lead("res_index").over(ahead) == F.col("res_index") + 1, F.lead("N").over(ahead)))


#: Ends and ideal lengths of the bonds of a row of ``backbone_residues``.
ROW_BONDS = [(p, q, ideal) for (p, q), ideal in INTRA_BONDS.items()] + [("C", "next", PEPTIDE_BOND)]


def has_center() -> Column:
    return F.col("CA").isNotNull() & F.col("N").isNotNull() & F.col("C").isNotNull() & F.col("CB").isNotNull()


def backbone_summary(atoms: DataFrame, energy_margin: float = 0.3, count_margin: float = 0.0, tie_eps: float = 0.0) -> DataFrame:
    """Sizes, bond and chirality sums of every structure from one shuffle by structure.

    The same numbers come from the graph operators above.
    """
    # Columns in turn, none of them long: Java does not compile a method beyond 8 KB. A missing atom makes its terms null.
    residues = backbone_residues(atoms)
    bonds = range(len(ROW_BONDS))
    lengths = [distance(xyz(f"{p}."), xyz(f"{q}.")).alias(f"d{k}") for k, (p, q, _) in enumerate(ROW_BONDS)]
    measured = residues.select("structure_id", "n_atoms", "CA", "N", "C", "CB", *lengths)
    volume = normalized_chiral_volume(*(xyz(f"{n}.") for n in ("CA", "N", "C", "CB")))
    squares = [((F.col(f"d{k}") - F.lit(ideal)) * (F.col(f"d{k}") - F.lit(ideal))).alias(f"q{k}") for k, (_, _, ideal) in enumerate(ROW_BONDS)]
    measured = measured.select("structure_id", "n_atoms", *squares, volume.alias("volume"))
    total = sum((F.coalesce(f"q{k}", F.lit(0.0)) for k in bonds), F.lit(0.0))
    terms = measured.select("structure_id", "n_atoms", total.alias("total"), sum((F.col(f"q{k}").isNotNull().cast("int") for k in bonds), F.lit(0)).alias("n"), "volume")
    short = F.greatest(F.lit(energy_margin) - F.col("volume"), F.lit(0.0))
    total, n_bonds = F.coalesce(F.sum("total"), F.lit(0.0)), F.sum("n")
    return terms.groupBy("structure_id").agg(
        F.sum("n_atoms").alias("n_atoms"),
        total.alias("bond_energy"),
        F.when(n_bonds > 0, F.sqrt(total / n_bonds)).otherwise(0.0).alias("bond_rmsd"),
        n_bonds.cast("long").alias("n_bonds"),
        F.coalesce(F.sum(F.when(F.col("volume").isNotNull(), short * short)), F.lit(0.0)).alias("chirality_energy"),
        F.count_if(F.col("volume") <= count_margin + tie_eps).alias("chirality_violations"),
        F.count("volume").alias("n_chiral_centers"),
    )


def validity_parts(atoms: DataFrame, tie_eps: float = 0.0, largest: float = LARGEST_CLASH / 2) -> DataFrame:
    """One row a structure with all energies and counts; parts that a structure lacks are 0. ``largest`` as in ``clash_pairs``."""
    parts = backbone_summary(atoms, tie_eps=tie_eps).join(clashes(atoms, tie_eps=tie_eps, largest=largest), "structure_id", "left")
    return parts.fillna(0, ["clash_energy", "clashes"])


def validity_energy(atoms: DataFrame, w_clash: float = 1.0, w_bond: float = 1.0, w_chirality: float = 1.0, largest: float = LARGEST_CLASH / 2) -> DataFrame:
    total = F.lit(w_clash) * F.col("clash_energy") + F.lit(w_bond) * F.col("bond_energy") + F.lit(w_chirality) * F.col("chirality_energy")
    return validity_parts(atoms, largest=largest).select("structure_id", total.alias("validity_energy"))


def validity_reports(samples: Mapping[str, DataFrame], tie_eps: float = 0.0, largest: float = LARGEST_CLASH / 2) -> DataFrame:
    """The reports of several samples of the same structures (native, prior, guided ...) in one table, told apart by label.

    Atoms of all samples go through the shuffles together, as structures of their own.
    """
    together = None
    for label, atoms in samples.items():
        rows = atoms.withColumn("structure_id", F.struct(F.lit(label).alias("label"), F.col("structure_id").alias("id")))
        together = rows if together is None else together.unionByName(rows)
    if together is None:
        raise ValueError("there must be a sample")
    found = validity_report(together, "", tie_eps, largest)
    return found.select(F.col("structure_id.label").alias("label"), F.col("structure_id.id").alias("structure_id"), *found.columns[2:])


def guidance_means(unguided: DataFrame, guided: DataFrame) -> DataFrame:
    """One row: structures checked, and the means of rmsd, clashes and bond_rmsd of (structure_id, rmsd, clashes, bond_rmsd)
    rows of unguided and of guided samples; only structures in both count."""
    names = ("rmsd", "clashes", "bond_rmsd")
    both = unguided.select("structure_id", *names).join(guided.select("structure_id", *(F.col(n).alias(f"g_{n}") for n in names)), "structure_id")
    return both.agg(F.count(F.lit(1)).alias("n_checked"), *(F.avg(n).alias(f"mean_{n}") for n in names), *(F.avg(f"g_{n}").alias(f"guided_mean_{n}") for n in names))


def validity_report(atoms: DataFrame, label: str, tie_eps: float = 0.0, largest: float = LARGEST_CLASH / 2) -> DataFrame:
    """One report row a structure: clashes, clashes a hundred atoms, bond RMSD, chirality violations and centres."""
    return validity_parts(atoms, tie_eps, largest).select(
        F.lit(label).alias("label"),
        "structure_id",
        "n_atoms",
        "clashes",
        F.bround(100 * F.col("clashes") / F.col("n_atoms"), 2).alias("clashes_per_100_atoms"),
        F.bround("bond_rmsd", 3).alias("bond_rmsd_angstrom"),
        "chirality_violations",
        "n_chiral_centers",
    )


def lddt(model: DataFrame, reference: DataFrame, cutoff: float = LDDT_CUTOFF, thresholds: Sequence[float] = LDDT_THRESHOLDS) -> DataFrame:
    """(structure_id, atom_idx, lddt): mean share of thresholds that hold over reference neighbours; 1 without any."""
    moved = model.select("structure_id", "atom_idx", *(F.col(a).alias(f"m{a}") for a in "xyz"))
    both = reference.select("structure_id", "atom_idx", "x", "y", "z").join(moved, ["structure_id", "atom_idx"])
    pairs = neighbour_pairs(both, cutoff, ("mx", "my", "mz"))
    now = distance(tuple(F.col(f"l_m{a}") for a in "xyz"), tuple(F.col(f"r_m{a}") for a in "xyz"))
    off = F.abs(now - F.col("d"))
    share: Column = sum(((off <= t).cast("double") for t in thresholds), F.lit(0.0)) / len(thresholds)
    ends = pairs.select("structure_id", share.alias("share"), F.explode(F.array("i", "j")).alias("atom_idx"))
    scores = ends.groupBy("structure_id", "atom_idx").agg(F.avg("share").alias("lddt"))
    return both.select("structure_id", "atom_idx").join(scores, ["structure_id", "atom_idx"], "left").withColumn("lddt", F.coalesce("lddt", F.lit(1.0)))


def paired(model: DataFrame, reference: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, x, y, z, rx, ry, rz): atoms of model and reference side by side."""
    return model.select("structure_id", "atom_idx", "x", "y", "z").join(reference.select("structure_id", "atom_idx", *(F.col(a).alias(f"r{a}") for a in "xyz")), ["structure_id", "atom_idx"])


def superposition_moments(both: DataFrame) -> DataFrame:
    """Count, sums and products of paired coordinates a structure: all that a superposition needs, summed on the map side.

    Pairs with a missing coordinate do not count; a structure without others has no row.
    """
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(c).alias(f"s{c}") for c in ("x", "y", "z", "rx", "ry", "rz")]
    sums += [F.sum(F.col(a) * F.col(f"r{b}")).alias(f"m{a}{b}") for a in "xyz" for b in "xyz"]
    sums += [F.sum(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))).alias(name) for name, cols in (("pp", ("x", "y", "z")), ("qq", ("rx", "ry", "rz")))]
    return both.dropna(subset=["x", "y", "z", "rx", "ry", "rz"]).groupBy("structure_id").agg(*sums)


#: Upper triangle of a symmetric matrix of four, in the order in which the columns below keep it.
TRIANGLE = [(i, j) for i in range(4) for j in range(i, 4)]
#: After each step the places move so, that three steps meet every pair once.
TURN = (0, 2, 3, 1)
JACOBI_STEPS = 18


def largest_eigen(entries: Sequence[Column]) -> Column:
    """(value, vector) of the largest eigenvalue of a symmetric matrix of four, given as its upper triangle by rows.

    Jacobi rotations of two pairs of places at a time, as one column expression. They keep to rounding whether eigenvalues
    are far apart or equal, where the roots of the characteristic polynomial lose half of their digits (straight and mirrored
    structures); of equal ones some vector comes back.
    """
    place = {p: k for k, p in enumerate(TRIANGLE)}
    at = lambda m, i, j: m.getItem(place[min(i, j), max(i, j)])

    def angle(m: Column, p: int, q: int) -> Column:
        """(c, s) of the rotation that clears entry (p, q)."""
        off = at(m, p, q)
        ratio = (at(m, q, q) - at(m, p, p)) / (2 * off)
        t = F.when(off == 0, 0.0).otherwise(F.when(ratio < 0, -1.0).otherwise(1.0) / (F.abs(ratio) + F.sqrt(1 + ratio * ratio)))
        return F.transform(F.array(t), lambda t: F.struct((1 / F.sqrt(1 + t * t)).alias("c"), (t / F.sqrt(1 + t * t)).alias("s"))).getItem(0)

    def turned(m: Column, v: Column, first: Column, second: Column) -> Column:
        side = lambda i: (first, 0) if i < 2 else (second, 2)

        def mixed(i: int) -> list[tuple[Column, int]]:
            """The old places that make up a new one, with their shares."""
            r, base = side(i)
            return [(r["c"], base), (-r["s"], base + 1)] if i == base else [(r["s"], base), (r["c"], base + 1)]

        total = lambda terms: sum(terms[1:], terms[0])
        cleared = {(0, 1), (2, 3)}
        matrix = {(i, j): F.lit(0.0) if (i, j) in cleared else total([a * b * at(m, p, q) for a, p in mixed(i) for b, q in mixed(j)]) for i, j in TRIANGLE}
        vectors = {(r, i): total([a * v.getItem(4 * r + p) for a, p in mixed(i)]) for r in range(4) for i in range(4)}
        moved = [matrix[min(TURN[i], TURN[j]), max(TURN[i], TURN[j])] for i, j in TRIANGLE]
        return F.struct(F.array(*moved).alias("m"), F.array(*(vectors[r, TURN[i]] for r in range(4) for i in range(4))).alias("v"))

    def step(state: Column, _: Column) -> Column:
        bound = F.array(F.struct(angle(state["m"], 0, 1).alias("a"), angle(state["m"], 2, 3).alias("b")))
        return F.transform(bound, lambda r: turned(state["m"], state["v"], r["a"], r["b"])).getItem(0)

    start = F.struct(F.array(*entries).alias("m"), F.array(*(F.lit(float(r == i)) for r in range(4) for i in range(4))).alias("v"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(JACOBI_STEPS)), start, step)
    pick = lambda d: F.array_max(F.array(*(F.struct(at(d["m"], i, i).alias("value"), F.array(*(d["v"].getItem(4 * r + i) for r in range(4))).alias("vector")) for i in range(4))))
    return F.transform(F.array(done), pick).getItem(0)


def superpositions(both: DataFrame) -> DataFrame:
    """(structure_id, n, c<x>, cr<x>, spread, value, vector): centres of model and reference, their summed squared distances from
    them, and the largest eigenvalue and eigenvector of the quaternion matrix of their products.

    The eigenvector is the quaternion of the turn that brings the model onto the reference; the left-over squared distance is
    spread - 2 value. Mirror images are not allowed for, so a mirrored model keeps its distance.
    """
    m = superposition_moments(both)
    n = F.col("n").cast("double")
    centers = {f"c{c}": F.col(f"s{c}") / n for c in ("x", "y", "z", "rx", "ry", "rz")}
    m = m.withColumns(centers)
    m = m.withColumns({f"h{a}{b}": F.col(f"m{a}{b}") - n * F.col(f"c{a}") * F.col(f"cr{b}") for a in "xyz" for b in "xyz"})
    h = lambda a, b: F.col(f"h{a}{b}")
    entries = [
        h("x", "x") + h("y", "y") + h("z", "z"), h("y", "z") - h("z", "y"), h("z", "x") - h("x", "z"), h("x", "y") - h("y", "x"),
        h("x", "x") - h("y", "y") - h("z", "z"), h("x", "y") + h("y", "x"), h("z", "x") + h("x", "z"),
        h("y", "y") - h("x", "x") - h("z", "z"), h("y", "z") + h("z", "y"),
        h("z", "z") - h("x", "x") - h("y", "y"),
    ]
    spread = F.col("pp") + F.col("qq") - n * sum((F.col(c) * F.col(c) for c in centers), F.lit(0.0))
    return m.select("structure_id", "n", *centers, spread.alias("spread"), largest_eigen(entries).alias("top")).select("structure_id", "n", *centers, "spread", "top.*")


def kabsch_align(model: DataFrame, reference: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, x, y, z): the model turned and shifted onto the reference with least squared distance.

    The turn of each structure comes from its moments; atoms are moved by column expressions, so the size of a structure
    bounds nothing.
    """
    both = paired(model, reference)
    matrix = quaternion_rotation(*(F.col("vector").getItem(k) for k in range(4)))
    turns = superpositions(both).select("structure_id", "cx", "cy", "cz", "crx", "cry", "crz", *(matrix[i][j].alias(f"r{i + 1}{j + 1}") for i in range(3) for j in range(3)))
    moved = both.drop("rx", "ry", "rz").join(turns, "structure_id")
    rows = [[F.col(f"r{i}{j}") for j in (1, 2, 3)] for i in (1, 2, 3)]
    place = [p + F.col(f"cr{a}") for p, a in zip(rotate(rows, xyz(), (F.col("cx"), F.col("cy"), F.col("cz"))), "xyz", strict=True)]
    return moved.select("structure_id", "atom_idx", *(p.alias(a) for p, a in zip(place, "xyz", strict=True)))


def aligned_rmsd(model: DataFrame, reference: DataFrame) -> DataFrame:
    """(structure_id, rmsd) after superposition, from moments that Spark sums on the map side."""
    left = F.greatest(F.col("spread") - 2 * F.col("value"), F.lit(0.0))
    return superpositions(paired(model, reference)).select("structure_id", F.sqrt(left / F.col("n")).alias("rmsd"))
