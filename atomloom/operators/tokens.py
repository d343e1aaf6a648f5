"""Tokens and features: one row an atom slot, with everything a model or an analysis needs as plain columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.functions.vocab import MODALITIES, atom_slots, element_index, infer_element, modality_index, polymer_atom_index

POLYMERS = MODALITIES[:3]
#: Least tasks a core over which sums of residue pairs are dealt.
TASKS_A_CORE = 16


def tokenize(atoms: DataFrame) -> DataFrame:
    """Tokens of an atom relation.

    A polymer residue has one token for each slot of its name, in order; a slot without an atom is virtual and has null
    coordinates, and atoms outside the slots are dropped. Any other residue has one token for each atom, in file order. Of
    atoms that share a name in a residue the last counts. Structures with an unknown polymer name are left out; see
    ``quarantined``. ``atom_idx`` counts from 1 in each structure. Atoms are dealt by structure once.
    """
    residue = ["structure_id", "residue_ord", "chain_id", "res_index", "res_name", "modality"]
    present = F.array_sort(F.collect_list(F.struct("atom_ord", "atom_name", "element", "x", "y", "z")))
    rows = atoms.repartition("structure_id").groupBy(*residue).agg(present.alias("present"))
    polymer = F.col("modality").isin(POLYMERS)
    slots = F.when(polymer, atom_slots(F.col("res_name")))
    # Residues, not tokens, are put in order: a running count of their tokens says where each one's begin.
    in_order = Window.partitionBy("structure_id").orderBy("residue_ord")
    n_tokens = F.coalesce(F.size(slots), F.size("present"))
    rows = rows.withColumn("before", F.sum(n_tokens).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - n_tokens)
    unknown = F.coalesce(polymer & slots.isNull(), F.lit(False))
    rows = rows.withColumn("unknown", F.max(unknown).over(Window.partitionBy("structure_id"))).filter(~F.col("unknown"))

    found_in = lambda name: F.try_element_at(F.filter("present", lambda a: a["atom_name"] == name), F.lit(-1))
    in_slots = F.transform(slots, lambda name: F.struct(name.alias("atom_name"), found_in(name).alias("atom")))
    own = F.transform("present", lambda a: F.struct(a["atom_name"].alias("atom_name"), a.alias("atom")))
    flat = rows.select(*residue, "before", F.posexplode(F.coalesce(in_slots, own)).alias("slot_ord", "token"))
    return flat.select(
        "structure_id",
        (F.col("before") + F.col("slot_ord") + 1).cast("int").alias("atom_idx"),
        *residue[1:],
        "token.atom_name",
        F.coalesce("token.atom.element", infer_element(F.col("token.atom_name"))).alias("element"),
        F.col("token.atom").isNull().alias("is_virtual"),
        *(F.col(f"token.atom.{a}").alias(a) for a in "xyz"),
    )


def quarantined(atoms: DataFrame) -> DataFrame:
    """(structure_id, reason) of structures that cannot be tokenised."""
    unknown = atoms.filter(F.col("modality").isin(POLYMERS) & atom_slots(F.col("res_name")).isNull())
    return unknown.groupBy("structure_id").agg(F.concat(F.lit("unknown polymer residue: "), F.min("res_name")).alias("reason"))


def with_chain_index(tokens: DataFrame) -> DataFrame:
    """``chain_idx``: chains of a structure numbered from 1 in order of first appearance."""
    first = F.min("atom_idx").over(Window.partitionBy("structure_id", "chain_id"))
    return tokens.withColumn("_first", first).withColumn("chain_idx", F.dense_rank().over(Window.partitionBy("structure_id").orderBy("_first"))).drop("_first")


def featurize(tokens: DataFrame) -> DataFrame:
    """The six feature columns of every token."""
    return with_chain_index(tokens).select(*feature_columns())


def feature_columns() -> list[Column]:
    """The keys and features of tokens that have their ``chain_idx``."""
    return [
        F.col("structure_id"),
        F.col("atom_idx"),
        element_index(F.col("element")).alias("element_idx"),
        modality_index(F.col("modality")).alias("modality_idx"),
        polymer_atom_index(F.col("res_name"), F.col("atom_name")).alias("polymer_atom_idx"),
        F.col("chain_idx"),
        F.col("res_index"),
        F.col("is_virtual"),
    ]


def target_coordinates(tokens: DataFrame) -> DataFrame:
    """Tokens with (0, 0, 0) where a coordinate is missing."""
    return tokens.withColumns({axis: F.coalesce(axis, F.lit(0.0)) for axis in "xyz"})


def relative_positions(features: DataFrame, window: int = 32) -> DataFrame:
    """(structure_id, i, j, bucket) of all ordered pairs: clamped residue offset, or the last bucket across chains."""
    side = features.select("structure_id", "atom_idx", "chain_idx", "res_index")
    left, right = side.alias("l"), side.alias("r")
    offset = F.greatest(F.lit(-window), F.least(F.lit(window), F.col("l.res_index") - F.col("r.res_index"))) + window + 1
    bucket = F.when(F.col("l.chain_idx") == F.col("r.chain_idx"), offset).otherwise(2 * window + 2)
    pairs = left.join(right, F.col("l.structure_id") == F.col("r.structure_id"))
    return pairs.select(F.col("l.structure_id").alias("structure_id"), F.col("l.atom_idx").alias("i"), F.col("r.atom_idx").alias("j"), bucket.alias("bucket"))


def relative_position_sums(features: DataFrame, window: int = 32) -> DataFrame:
    """(structure_id, bucket, n, weight): the pairs of ``relative_positions`` in each bucket and the sum of i * j over them.

    No pair of atoms is made. Atoms are counted by residue; a residue meets those of its chain inside the window one by one,
    those before it by a running sum, and pairs across chains are what is left of all pairs. Buckets of d and -d mirror each
    other. Work grows with residues times the window. ``weight`` is a decimal of 38 digits.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    residues = features.groupBy("structure_id", "chain_idx", "res_index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("atom_idx").cast("long")).alias("s"))
    # Residues are small on disk and large as pairs of offsets: a given number of parts keeps them from being put into one task.
    spark = features.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    residues = residues.repartition(parts, "structure_id")
    along = Window.partitionBy("structure_id", "chain_idx").orderBy("res_index")
    near, far = along.rangeBetween(1 - window, -1), along.rangeBetween(Window.unboundedPreceding, -window)
    met = residues.withColumns({"near": F.collect_list(F.struct("res_index", "n", "s")).over(near), "far_n": F.sum("n").over(far), "far_s": F.sum("s").over(far)})
    pair = lambda d, n, s: F.struct(d.cast("int").alias("d"), (F.col("n") * n).alias("n"), (wide("s") * s.cast("decimal(19,0)")).cast("decimal(38,0)").alias("weight"))
    inside = F.transform("near", lambda r: pair(F.col("res_index") - r["res_index"], r["n"], r["s"]))
    beyond = pair(F.lit(window), F.coalesce("far_n", F.lit(0).cast("long")), F.coalesce("far_s", F.lit(0).cast("long")))
    own = pair(F.lit(0), F.col("n"), F.col("s"))
    by_offset = met.select("structure_id", F.inline(F.concat(inside, F.array(beyond, own)))).groupBy("structure_id", "d").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    both = F.when(F.col("d") == 0, F.array(F.lit(window + 1))).otherwise(F.array(window + 1 + F.col("d"), window + 1 - F.col("d")))
    same = by_offset.select("structure_id", F.explode(both).alias("bucket"), "n", "weight")
    chains = residues.groupBy("structure_id", "chain_idx").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    square = lambda c: (c * c).cast("decimal(38,0)")
    across = chains.groupBy("structure_id").agg(
        (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("n"),
        (square(F.sum("s").cast("decimal(19,0)")) - F.sum(square(wide("s")))).cast("decimal(38,0)").alias("weight"),
    )
    return same.unionByName(across.select("structure_id", F.lit(2 * window + 2).alias("bucket"), "n", "weight")).filter(F.col("n") > 0)


def pad_batches(features: DataFrame, batches: DataFrame | Column, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of (structure_id, batch_id) batches, or of batches numbered by a column, padded to the longest structure of each.

    Padding has index 1 in every vocabulary, res_index 0, is_virtual true and pad_mask false; columns to ``carry`` along
    (coordinates, constraints) have 0 there. Tokens are dealt by batch once, and each makes the padding up to the next one.
    """
    batched = features.withColumn("batch_id", batches) if isinstance(batches, Column) else features.join(batches, "structure_id")
    own = Window.partitionBy("batch_id", "structure_id").orderBy("atom_idx")
    here = batched.filter(F.col("atom_idx") >= 1).repartition("batch_id")
    here = here.withColumns({"_next": F.lead("atom_idx").over(own), "_first": F.lag("atom_idx").over(own).isNull()}).withColumn("_max", F.max("atom_idx").over(Window.partitionBy("batch_id")))
    begin = F.when(F.col("_first"), F.lit(1)).otherwise(F.col("atom_idx").cast("int"))
    end = F.greatest(F.col("atom_idx"), F.coalesce(F.col("_next") - 1, F.col("_max"))).cast("int")
    slots = here.withColumn("_slot", F.explode(F.sequence(begin, end)))
    real = lambda c: F.when(F.col("_slot") == F.col("atom_idx"), F.col(c))
    ones = [F.coalesce(real(c), F.lit(1)).alias(c) for c in ("element_idx", "modality_idx", "polymer_atom_idx", "chain_idx")]
    carried = [F.coalesce(real(c), F.lit(0.0)).alias(c) for c in carry]
    return slots.select("batch_id", "structure_id", F.col("_slot").alias("atom_idx"), *ones, F.coalesce(real("res_index"), F.lit(0)).alias("res_index"), F.coalesce(real("is_virtual"), F.lit(True)).alias("is_virtual"), real("element_idx").isNotNull().alias("pad_mask"), *carried)


def pad_bias(padded: DataFrame, masked: float = -1e9) -> DataFrame:
    """(batch_id, structure_id, i, j, bias): 0 for a real key j, else ``masked``; queries are never masked."""
    side = padded.select("batch_id", "structure_id", "atom_idx", "pad_mask")
    left, right = side.alias("l"), side.alias("r")
    pairs = left.join(right, (F.col("l.batch_id") == F.col("r.batch_id")) & (F.col("l.structure_id") == F.col("r.structure_id")))
    return pairs.select(F.col("l.batch_id"), F.col("l.structure_id"), F.col("l.atom_idx").alias("i"), F.col("r.atom_idx").alias("j"), F.when(F.col("r.pad_mask"), 0.0).otherwise(masked).alias("bias"))


def pad_columns(values: DataFrame, padded: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("batch_id", "structure_id", "atom_idx")) -> DataFrame:
    """``columns`` of (structure_id, atom_idx) rows over padded structures, beside the columns to ``keep`` of these; padding has 0
    (coordinates, constraints)."""
    frame = padded.select(*keep)
    return frame.join(values.select("structure_id", "atom_idx", *columns), ["structure_id", "atom_idx"], "left").fillna(0.0, list(columns))


def pad_pairs(pairs: DataFrame, padded: DataFrame, fill: int = 1) -> DataFrame:
    """Pair buckets over padded structures; pairs with a padded side have ``fill``."""
    frame = pad_bias(padded).drop("bias")
    return frame.join(pairs, ["structure_id", "i", "j"], "left").withColumn("bucket", F.coalesce("bucket", F.lit(fill)))


def pad_bias_sums(padded: DataFrame, masked: float = -1e9) -> DataFrame:
    """(batch_id, structure_id, n_pairs, bias): the pairs of ``pad_bias`` and their sum, from the lengths alone."""
    n, hidden = F.count(F.lit(1)), F.count_if(~F.col("pad_mask"))
    return padded.groupBy("batch_id", "structure_id").agg((n * n).alias("n_pairs"), (F.lit(masked) * n * hidden + 0.0).alias("bias"))


def pad_position_counts(features: DataFrame, padded: DataFrame, window: int = 32, fill: int = 1) -> DataFrame:
    """(structure_id, bucket, n): how many pairs of ``pad_pairs`` each bucket has, from sums by residue and from lengths."""
    real = F.count_if("pad_mask")
    n = F.count(F.lit(1))
    fills = padded.groupBy("structure_id").agg((n * n - real * real).alias("n")).filter(F.col("n") > 0).select("structure_id", F.lit(fill).alias("bucket"), "n")
    return relative_position_sums(features, window).select("structure_id", "bucket", "n").unionByName(fills).groupBy("structure_id", "bucket").agg(F.sum("n").alias("n"))
