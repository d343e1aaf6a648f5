"""The validity benchmark: composed examples, samples of a flow with and without guidance, and one report over all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.functions.geometry import normalized_chiral_volume, xyz
from atomloom.functions.vocab import LARGEST_CLASH
from atomloom.operators.flow import PriorConfig, examples, prior_walk, validity_step
from atomloom.operators.geometry import ROW_BONDS, backbone_residues, has_center, validity_report
from atomloom.sources.storage import Put, dealt_once, shared_dir, stored

#: Velocities of atoms at a time: (atoms, t) to (structure_id, atom_idx, vx, vy, vz).
Velocity = Callable[[DataFrame, float], DataFrame]
#: After so many steps a sample is written and read back, so that plans stay short.
STEPS_EACH_WRITE = 4


def benchmark_examples(residue_atoms: DataFrame) -> DataFrame:
    """``flow.examples`` with what validity is measured by: on every token the bonds that begin there and, on a CA, its centre.

    ``bonds`` is an array of (j, ideal) by j, empty where none begins; ``center`` is (n, c, cb, volume), null but on the CA of a
    residue that has all four atoms. No row holds more than one atom's bonds, however large the structure. Virtual atoms,
    at (0, 0, 0), bond and make centres like real ones. The plain examples are written once and read back; a CA with a centre
    always begins a bond (to C), so one row an atom carries both.
    """
    path, listed = shared_dir(residue_atoms.sparkSession, "examples"), examples(residue_atoms)
    listed.write.parquet(path)
    rows = residue_atoms.sparkSession.read.schema(listed.schema).parquet(path)
    residues = backbone_residues(rows)
    end = lambda p: F.col(f"{p}.atom_idx")
    bonds = [F.when(end(p).isNotNull() & end(q).isNotNull(), F.struct(end(p).alias("atom_idx"), F.struct(end(q).alias("j"), F.lit(ideal).alias("ideal")).alias("bond"))) for p, q, ideal in ROW_BONDS]
    volume = normalized_chiral_volume(*(xyz(f"{n}.") for n in ("CA", "N", "C", "CB")))
    center = F.when(has_center(), F.struct(end("N").alias("n"), end("C").alias("c"), end("CB").alias("cb"), volume.alias("volume")))
    marks = residues.select("structure_id", end("CA").alias("ca"), center.alias("center"), F.explode(F.filter(F.array(*bonds), lambda b: b.isNotNull())).alias("b"))
    own = F.when(F.col("b.atom_idx") == F.col("ca"), F.col("center"))
    begins = marks.groupBy("structure_id", F.col("b.atom_idx").alias("atom_idx")).agg(F.array_sort(F.collect_list("b.bond")).alias("bonds"), F.max(own).alias("center"))
    both = rows.join(begins, ["structure_id", "atom_idx"], "left")
    return both.withColumn("bonds", F.coalesce("bonds", F.array().cast(begins.schema["bonds"].dataType)))


def at_prior(atoms: DataFrame, noise: DataFrame, config: PriorConfig = PriorConfig()) -> DataFrame:
    """``atoms`` at the places of a prior walk; ``noise`` is (structure_id, atom_idx, chain_id, e0..e3)."""
    walk = prior_walk(noise, config)
    return atoms.join(walk, ["structure_id", "atom_idx"]).withColumns({a: F.col(f"{a}0") for a in "xyz"}).select(*atoms.columns)


def flow_sample(start: DataFrame, velocity: Velocity, n_steps: int, post_step: Callable[[DataFrame], DataFrame] | None = None, put: Put | None = None) -> DataFrame:
    """Atoms after ``n_steps`` equal Euler steps from time 0 to 1, with ``post_step`` after each. Atoms without a velocity stay.
    ``put`` writes what is written on the way, and what ``post_step`` takes, as that reads it several times; without it only
    every few steps are written, as plain Parquet."""
    if n_steps < 1:
        raise ValueError("there must be a step")
    atoms = start
    for k in range(n_steps):
        moving = velocity(atoms, k / n_steps).select("structure_id", "atom_idx", "vx", "vy", "vz")
        ahead = {a: F.col(a) + F.coalesce(f"v{a}", F.lit(0.0)) / n_steps for a in "xyz"}
        atoms = atoms.join(moving, ["structure_id", "atom_idx"], "left").withColumns(ahead).select(*start.columns)
        if post_step is not None:
            atoms = post_step(atoms if put is None else put(atoms, "ahead"))
        if (k + 1) % STEPS_EACH_WRITE == 0 and k + 1 < n_steps:
            if put is not None:
                atoms = put(atoms, "flow")
                continue
            path, schema = shared_dir(start.sparkSession, "flow"), atoms.schema
            atoms.write.parquet(path)
            atoms = start.sparkSession.read.schema(schema).parquet(path)
    return atoms


def benchmark_reports(native: DataFrame, noise: DataFrame, velocity: Velocity, n_steps: int, step: float = 0.05, tie_eps: float = 0.0, largest: float = LARGEST_CLASH / 2) -> DataFrame:
    """Validity reports of each structure under the labels native, prior, unguided and guided.

    The last two flow from the same prior by ``velocity``; guided ones move by ``step`` against the gradient of their validity
    energy after every step. Samples are dealt by structure when they are written, and each report is made from them in place.
    Atoms, noise and velocities that come from ``dealt_once`` are not shuffled either. The reports are written and read back.
    """
    spark = native.sparkSession
    with dealt_once(spark, "structure_id", "atom_idx") as put:
        prior = put(at_prior(native, noise), "prior")
        unguided = put(flow_sample(prior, velocity, n_steps, put=put), "unguided")
        guided = put(flow_sample(prior, velocity, n_steps, lambda atoms: validity_step(atoms, step, largest=largest), put), "guided")
        samples = {"native": native, "prior": prior, "unguided": unguided, "guided": guided}
        reports = reduce(DataFrame.unionByName, [validity_report(atoms, label, tie_eps, largest) for label, atoms in samples.items()])
        return stored(reports, "reports")
