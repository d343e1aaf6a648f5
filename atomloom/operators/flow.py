"""Prior walks, rigid augmentation, flow-matching examples, losses, constraints and guidance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.functions.geometry import constraint_features, cross, dot, interpolant, minus, norm, quaternion_rotation, rotate, xyz
from atomloom.functions.vocab import LARGEST_CLASH
from atomloom.operators.geometry import ROW_BONDS, TOLERANCE, backbone_residues, clash_pairs, has_center
from atomloom.operators.tokens import feature_columns, target_coordinates, tokenize, with_chain_index


@dataclass(frozen=True)
class PriorConfig:
    bond_length: float = 3.8
    bond_std: float = 1.0
    free_std: float = 10.0


@dataclass(frozen=True)
class ChainConstraint:
    """Pull of ``moving`` chain's centre towards ``reference`` chain's centre plus ``offset``."""

    moving: int
    reference: int
    offset: tuple[float, float, float]
    weight: float = 1.0


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw that depends on the keys and the seed alone (Box-Muller on hashes), so a recomputed task
    draws the same."""
    unit = lambda salt: (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed), F.lit(salt)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(F.lit(6.283185307179586) * unit(2))


def with_noise(tokens: DataFrame, seed: int) -> DataFrame:
    """Four standard normal columns e0..e3 a token."""
    return tokens.withColumns({f"e{k}": normal(seed, F.col("structure_id"), F.col("atom_idx"), F.lit(k)) for k in range(4)})


#: Places of one structure that a task walks along; atoms lie in the block of their number.
WALK_BLOCK = 1 << 16


def prior_walk(tokens: DataFrame, config: PriorConfig = PriorConfig(), chain: str = "chain_id", block: int = WALK_BLOCK) -> DataFrame:
    """(structure_id, atom_idx, x0, y0, z0) from tokens with noise columns e0..e3.

    The first atom of a run of one chain is free noise; each further atom steps from the one before it by a random
    direction of length bond_length + bond_std e3. The walk is a running sum over the run.

    Sums run inside blocks of ``block`` atom numbers. Each block tells what it adds to a run that it does not end and whether it
    begins one; running sums over these rows, one a block, give the place where each block's first run goes on. So no task
    holds the atoms of a whole structure.
    """
    in_block = Window.partitionBy("structure_id", "block").orderBy("atom_idx")
    length = norm((F.col("e0"), F.col("e1"), F.col("e2")))
    reach = F.lit(config.bond_length) + F.lit(config.bond_std) * F.col("e3")
    free = {f"f{k}": F.lit(config.free_std) * F.col(f"e{k}") for k in range(3)}
    step = {f"s{k}": F.when(length > 0, reach * F.col(f"e{k}") / length).otherwise(0.0) for k in range(3)}
    placed = tokens.select("structure_id", "atom_idx", F.col(chain).alias("chain"), F.floor(F.col("atom_idx") / block).alias("block"), *(c.alias(n) for n, c in (free | step).items()))
    rows = placed.withColumns({"first": F.row_number().over(in_block) == 1, "begins": ~F.lag("chain").over(in_block).eqNullSafe(F.col("chain"))})
    rows = rows.withColumn("begins", F.col("begins") & ~F.col("first")).withColumn("run", F.sum(F.col("begins").cast("int")).over(in_block))

    # What follows the last beginning inside a block; its first atom is counted apart, as its kind depends on the block before.
    own = F.when(F.col("begins"), F.struct(*(F.col(f"f{k}").alias(f"t{k}") for k in range(3)))).otherwise(F.struct(*(F.col(f"s{k}").alias(f"t{k}") for k in range(3))))
    by_run = rows.withColumn("own", own).groupBy("structure_id", "block", "run").agg(
        *(F.sum(F.when(~F.col("first"), F.col(f"own.t{k}"))).alias(f"t{k}") for k in range(3)),
        F.max(F.when(F.col("first"), F.struct("chain", *free, *step))).alias("head"),
        F.max_by("chain", "atom_idx").alias("last"),
    )
    ends = by_run.groupBy("structure_id", "block").agg(F.max("head").alias("head"), F.max_by(F.struct("last", "run", "t0", "t1", "t2"), "run").alias("tail"))
    along = Window.partitionBy("structure_id").orderBy("block")
    fresh = F.lag(F.lit(1)).over(along).isNull() | ~F.lag("tail.last").over(along).eqNullSafe(F.col("head.chain"))
    ends = ends.withColumn("fresh", fresh).withColumn("stretch", F.sum((F.col("fresh") | (F.col("tail.run") > 0)).cast("int")).over(along))
    adds = [(F.coalesce(F.col(f"tail.t{k}"), F.lit(0.0)) + F.when(F.col("tail.run") > 0, 0.0).when(F.col("fresh"), F.col(f"head.f{k}")).otherwise(F.col(f"head.s{k}"))).alias(f"a{k}") for k in range(3)]
    same = Window.partitionBy("structure_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = ends.select("structure_id", "block", "fresh", "stretch", *adds).withColumns({f"a{k}": F.sum(f"a{k}").over(same) for k in range(3)})
    carried = sums.select("structure_id", "block", "fresh", *(F.when(F.col("fresh"), 0.0).otherwise(F.lag(f"a{k}").over(along)).alias(f"a{k}") for k in range(3)))

    joined = rows.join(carried, ["structure_id", "block"])
    begins = F.col("begins") | (F.col("first") & F.col("fresh"))
    inside = Window.partitionBy("structure_id", "block", "run").orderBy("atom_idx").rowsBetween(Window.unboundedPreceding, 0)
    place = [F.sum(F.when(begins, F.col(f"f{k}")).otherwise(F.col(f"s{k}"))).over(inside) + F.when(F.col("run") > 0, 0.0).otherwise(F.col(f"a{k}")) for k in range(3)]
    return joined.select("structure_id", "atom_idx", *(p.alias(f"{a}0") for p, a in zip(place, "xyz", strict=True)))


def centroids(atoms: DataFrame, mask: Column) -> DataFrame:
    """(structure_id, cx, cy, cz): mean of the atoms that ``mask`` selects; null without any."""
    return atoms.groupBy("structure_id").agg(*(F.avg(F.when(mask, F.col(a))).alias(f"c{a}") for a in "xyz"))


def random_transforms(structures: DataFrame, seed: int) -> DataFrame:
    """(structure_id, r11..r33): a uniform random rotation a structure, from four normal draws of its id."""
    q = [normal(seed, F.col("structure_id"), F.lit(k)) for k in range(4)]
    drawn = structures.select("structure_id").distinct().select("structure_id", *(c.alias(f"q{k}") for k, c in enumerate(q)))
    rows = quaternion_rotation(*(F.col(f"q{k}") for k in range(4)))
    return drawn.select("structure_id", *(rows[i][j].alias(f"r{i + 1}{j + 1}") for i in range(3) for j in range(3)))


def apply_transform(atoms: DataFrame, transforms: DataFrame, center: DataFrame) -> DataFrame:
    """R . (x - c) for every atom, R from (r11..r33) and c from (cx, cy, cz) of its structure."""
    joined = atoms.join(transforms, "structure_id").join(center, "structure_id")
    matrix = [[F.col(f"r{i}{j}") for j in (1, 2, 3)] for i in (1, 2, 3)]
    moved = rotate(matrix, xyz(), (F.col("cx"), F.col("cy"), F.col("cz")))
    return joined.withColumns(dict(zip("xyz", moved, strict=True))).select(*atoms.columns)


def no_constraints(tokens: DataFrame, keep: Sequence[str] = ("structure_id", "atom_idx")) -> DataFrame:
    """The constraints of plain folding, a row a token beside the columns to ``keep``: nothing is fixed, no hotspots, no
    accessibility targets."""
    none = {"is_fixed": F.lit(False), "is_hotspot": F.lit(False), "rasa_target": F.lit(0.0), "has_rasa": F.lit(False), **{f"f{a}": F.lit(0.0) for a in "xyz"}}
    return tokens.select(*keep, *(c.alias(n) for n, c in none.items()))


def examples(residue_atoms: DataFrame) -> DataFrame:
    """From an atom relation to examples, a row a token: features, target coordinates and constraint columns.

    A structure without tokens (no atoms, waters only, unknown polymer) has no rows; ``tokens.quarantined`` and
    ``structures.parse_status`` say which and why.
    """
    listed = with_chain_index(target_coordinates(tokenize(residue_atoms)))
    none = no_constraints(listed, keep=listed.columns)
    plain = constraint_features(*(F.col(c) for c in ("is_fixed", "is_hotspot", "rasa_target", "has_rasa")))
    return none.select(*feature_columns(), "chain_id", "res_name", "atom_name", "element", "modality", "x", "y", "z", *plain)


def training_examples(tokens: DataFrame, constraints: DataFrame, seed: int, config: PriorConfig = PriorConfig(), draws: tuple[DataFrame, DataFrame, Column] | None = None) -> DataFrame:
    """One flow-matching example a structure, all as columns of its tokens.

    ``constraints`` has (structure_id, atom_idx, is_fixed, fx, fy, fz) for some atoms. Real atoms and fixed targets get
    the same random turn about the real atoms' centre; without real atoms neither moves. Fixed atoms start and end at
    their target and leave the mask; virtual ones end at the prior. ``t`` is one uniform draw a structure. ``draws`` gives
    the noise e0..e3 a token, the turns r11..r33 a structure and the time instead of the keyed draws of ``seed``.
    """
    t = F.shiftrightunsigned(F.xxhash64("structure_id", F.lit(seed), F.lit("t")), 11).cast("double") / F.lit(float(1 << 53))
    noisy, turns, t = draws or (with_noise(tokens, seed), random_transforms(tokens, seed), t)
    joined = tokens.join(constraints, ["structure_id", "atom_idx"], "left").withColumn("is_fixed", F.coalesce("is_fixed", F.lit(False)))
    center = centroids(tokens, ~F.col("is_virtual"))
    turned = joined.join(center, "structure_id").join(turns, "structure_id")
    matrix = [[F.col(f"r{i}{j}") for j in (1, 2, 3)] for i in (1, 2, 3)]
    move = lambda p: tuple(F.when(F.col("cx").isNull(), a).otherwise(b) for a, b in zip(p, rotate(matrix, p, (F.col("cx"), F.col("cy"), F.col("cz"))), strict=True))
    target, fixed = move(tuple(F.coalesce(a, F.lit(0.0)) for a in "xyz")), move((F.col("fx"), F.col("fy"), F.col("fz")))
    placed = turned.select("structure_id", "atom_idx", "is_virtual", "is_fixed", *(c.alias(f"{a}1") for c, a in zip(target, "xyz", strict=True)), *(c.alias(f"{a}f") for c, a in zip(fixed, "xyz", strict=True)))
    noise = prior_walk(noisy, config)
    both = placed.join(noise, ["structure_id", "atom_idx"]).withColumn("mask", ~F.col("is_virtual") & ~F.col("is_fixed"))
    columns = []
    for a in "xyz":
        start = F.when(F.col("is_fixed"), F.col(f"{a}f")).otherwise(F.col(f"{a}0"))
        end = F.when(F.col("mask"), F.col(f"{a}1")).otherwise(start)
        x_t, v = interpolant(start, end, t)
        columns += [x_t.alias(f"{a}t"), v.alias(f"v{a}")]
    return both.select("structure_id", "atom_idx", "mask", t.alias("t"), *columns)


def flow_loss(rows: DataFrame, by: Sequence[str] = ("structure_id",)) -> DataFrame:
    """Masked squared velocity error over 3 x max(real atoms, 1), pooled over each group of ``by``.

    ``rows`` has mask, v (target) and p (predicted) columns vx.., px...
    """
    error = sum(((F.col(f"v{a}") - F.col(f"p{a}")) * (F.col(f"v{a}") - F.col(f"p{a}")) for a in "xyz"), F.lit(0.0))
    total, real = F.coalesce(F.sum(F.when(F.col("mask"), error)), F.lit(0.0)), F.count_if("mask")
    return rows.groupBy(*by).agg((total / (3 * F.greatest(real, F.lit(1)))).alias("loss"))


def verifier_loss(rows: DataFrame, by: Sequence[str] = ("structure_id",)) -> DataFrame:
    """Mean squared confidence error plus mean stable binary cross-entropy of clash logits."""
    squared = (F.col("confidence") - F.col("quality")) * (F.col("confidence") - F.col("quality"))
    entropy = F.greatest(F.col("logit"), F.lit(0.0)) - F.col("logit") * F.col("label") + F.log1p(F.exp(-F.abs("logit")))
    return rows.groupBy(*by).agg((F.avg(squared) + F.avg(entropy)).alias("loss"))


def chain_guidance(atoms: DataFrame, constraints: Sequence[ChainConstraint], dt: float) -> DataFrame:
    """Atoms (structure_id, atom_idx, chain_idx, x, y, z) after each constraint in turn; later ones see earlier moves.

    Chains move as a whole, so their centres move by known amounts: one aggregate and one join serve all constraints. A structure
    without one of the chains is left as it is by that constraint.
    """
    if not constraints:
        return atoms
    chains, moving = sorted({k for c in constraints for k in (c.moving, c.reference)}), sorted({c.moving for c in constraints})
    centers = atoms.groupBy("structure_id").agg(*(F.avg(F.when(F.col("chain_idx") == k, F.col(a))).alias(f"_c{k}{a}") for k in chains for a in "xyz"))
    centers = centers.withColumns({f"_s{k}{a}": F.lit(0.0) for k in moving for a in "xyz"})
    for c in constraints:
        pull = {a: F.coalesce(F.lit(c.weight * dt) * (F.col(f"_c{c.reference}{a}") + F.lit(o) - F.col(f"_c{c.moving}{a}")), F.lit(0.0)) for a, o in zip("xyz", c.offset, strict=True)}
        centers = centers.withColumns({f"_{kind}{c.moving}{a}": F.col(f"_{kind}{c.moving}{a}") + p for kind in "cs" for a, p in pull.items()})
    shift = lambda a: F.coalesce(*(F.when(F.col("chain_idx") == k, F.col(f"_s{k}{a}")) for k in moving), F.lit(0.0))
    return atoms.join(centers, "structure_id").withColumns({a: F.col(a) + shift(a) for a in "xyz"}).select(*atoms.columns)


def validity_gradient(atoms: DataFrame, w_clash: float = 1.0, w_bond: float = 1.0, w_chirality: float = 1.0, margin: float = 0.3, eps: float = 1e-6, tolerance: float = TOLERANCE, largest: float = LARGEST_CLASH / 2) -> DataFrame:
    """(structure_id, atom_idx, gx, gy, gz): gradient of the validity energy, summed from closed forms of its terms.

    Clashing pairs and backbone residues carry the coordinates of their atoms, so nothing is joined back to the atoms.
    """

    def force(atom: Column | str, g: Sequence[Column]) -> Column:
        return F.struct(F.col(atom).alias("atom_idx"), *(c.alias(f"g{a}") for c, a in zip(g, "xyz", strict=True)))

    # Columns in turn, as Spark compiles no generator over a lambda and evaluates its branches one by one.
    pairs = clash_pairs(atoms, tolerance, carry=("x", "y", "z"), largest=largest)
    u = [(F.col(f"l_{a}") - F.col(f"r_{a}")).alias(f"u{a}") for a in "xyz"]
    pairs = pairs.select("structure_id", "i", "j", "overlap", *u).withColumn("d", norm(xyz("u"))).filter(F.col("d") > 0)
    pairs = pairs.withColumn("f", F.lit(-2 * w_clash) * F.col("overlap") / F.col("d"))
    clash = pairs.select("structure_id", F.explode(F.array(*(force(atom, [F.lit(sign) * F.col("f") * c for c in xyz("u")]) for sign, atom in ((1.0, "i"), (-1.0, "j"))))).alias("g"))

    residues, n_bonds = backbone_residues(atoms), range(len(ROW_BONDS))
    bonds = {f"u{k}{a}": F.col(f"{p}.{a}") - F.col(f"{q}.{a}") for k, (p, q, _) in enumerate(ROW_BONDS) for a in "xyz"}
    residues = residues.withColumns(bonds).withColumns({f"d{k}": norm(xyz(f"u{k}")) for k in n_bonds})
    scale = {f"f{k}": F.when(F.col(f"d{k}") > 0, F.lit(2 * w_bond) * (F.col(f"d{k}") - F.lit(ideal)) / F.col(f"d{k}")) for k, (_, _, ideal) in enumerate(ROW_BONDS)}
    pulled = {f"u{k}{a}": F.coalesce(F.col(f"f{k}") * F.col(f"u{k}{a}"), F.lit(0.0)) for k in n_bonds for a in "xyz"}
    arms = ("N", "C", "CB")
    residues = residues.withColumns(scale).withColumns(pulled).withColumns({f"b{k}{a}": F.col(f"{n}.{a}") - F.col(f"CA.{a}") for k, n in enumerate(arms) for a in "xyz"})
    b = [xyz(f"b{k}") for k in range(3)]
    residues = residues.withColumns({f"n{k}{a}": c for k in range(3) for a, c in zip("xyz", cross(b[(k + 1) % 3], b[(k + 2) % 3]), strict=True)} | {f"s{k}": dot(b[k], b[k]) for k in range(3)})
    residues = residues.withColumns({"V": dot(b[0], xyz("n0")), "P": F.sqrt("s0") * F.sqrt("s1") * F.sqrt("s2")}).withColumn("D", F.col("P") + F.lit(eps))
    residues = residues.withColumn("w", F.lit(margin) - F.col("V") / F.col("D"))
    usable = (F.col("s0") > 0) & (F.col("s1") > 0) & (F.col("s2") > 0) & (F.col("w") > 0)
    residues = residues.withColumns({"w": F.when(usable, F.lit(-2 * w_chirality) * F.col("w")), "r": F.when(usable, F.col("V") / (F.col("D") * F.col("D")) * F.col("P"))})
    turned = {f"b{k}{a}": F.when(F.col("w").isNotNull(), F.col("w") * (F.col(f"n{k}{a}") / F.col("D") - F.col("r") / F.col(f"s{k}") * F.col(f"b{k}{a}"))).otherwise(0.0) for k in range(3) for a in "xyz"}
    residues = residues.withColumns(turned)
    # What each atom gets from the bonds of its residue, which number (p, q) as ROW_BONDS does, and from the residue's centre.
    forces = []
    for n in ("N", "CA", "C", "O", "CB", "next"):
        ends = [(sign, k) for k, (p, q, _) in enumerate(ROW_BONDS) for sign, end in ((1.0, p), (-1.0, q)) if end == n]
        shares = [(1.0, arms.index(n))] if n in arms else [(-1.0, k) for k in range(3)] if n == "CA" else []
        terms = lambda a, ends=ends, shares=shares: [F.lit(s) * F.col(f"u{k}{a}") for s, k in ends] + [F.lit(s) * F.col(f"b{k}{a}") for s, k in shares]
        forces.append(force(f"{n}.atom_idx", [sum(terms(a)[1:], terms(a)[0]) for a in "xyz"]))
    backbone = residues.select("structure_id", F.explode(F.array(*forces)).alias("g")).filter(F.col("g.atom_idx").isNotNull())
    every = clash.unionByName(backbone).select("structure_id", "g.*")
    return every.groupBy("structure_id", "atom_idx").agg(*(F.sum(f"g{a}").alias(f"g{a}") for a in "xyz"))


def validity_step(atoms: DataFrame, step: float = 0.05, **weights: float) -> DataFrame:
    """Atoms moved by ``step`` against the gradient of their structure's validity energy."""
    gradient = validity_gradient(atoms, **weights)
    moved = atoms.join(gradient, ["structure_id", "atom_idx"], "left")
    return moved.withColumns({a: F.col(a) - F.lit(step) * F.coalesce(f"g{a}", F.lit(0.0)) for a in "xyz"}).select(*atoms.columns)
