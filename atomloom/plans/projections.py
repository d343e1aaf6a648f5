"""Molecule-shaped relations made from the general tables, for queries that run at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The same projections as SQL, to be put before a query.
MOL_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
  FROM lineitem
),
mol AS (
  SELECT CAST(l_orderkey // 25 AS BIGINT) AS structure_id, CAST((l_orderkey % 25) * 10000 + k AS BIGINT) AS atom_idx,
         CASE WHEN l_orderkey % 25 < 15 THEN 'A' ELSE 'B' END AS chain_id, CAST(l_orderkey % 25 AS BIGINT) AS res_index,
         CASE WHEN k <= 5 THEN (['N','CA','C','O','CB'])[k] ELSE 'C' || k END AS atom_name, CASE k WHEN 1 THEN 'N' WHEN 4 THEN 'O' ELSE 'C' END AS element,
         CASE k WHEN 1 THEN 1.55e0 WHEN 4 THEN 1.52e0 ELSE 1.70e0 END AS vdw,
         3.8e0 * (l_orderkey % 25) + l_quantity / 25e0 AS x, l_discount * 20e0 + 0e0 AS y, l_tax * 25e0 + 0e0 AS z,
         l_linenumber, l_partkey, l_suppkey
  FROM ranked
)"""
#: The largest radius in the projection: it has C, N and O only.
LARGEST_RADIUS = 1.70


def mol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named protein-like atoms: an order is a residue, its first five lines backbone atoms and CB, all further ones C6, C7 and
    so on; 25 orders are a structure of two chains. Every line is an atom. Lines are dealt by structure, so what goes on by
    structure needs no further shuffle."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    k = F.row_number().over(Window.partitionBy("structure_id", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    residue = F.col("l_orderkey") % 25
    return (
        item.withColumn("structure_id", F.floor(F.col("l_orderkey") / 25).cast("long"))
        .repartition("structure_id")
        .withColumn("k", k)
        .select(
            "structure_id",
            (residue * 10000 + F.col("k")).cast("long").alias("atom_idx"),
            F.when(residue < 15, "A").otherwise("B").alias("chain_id"),
            residue.cast("long").alias("res_index"),
            F.when(F.col("k") <= 5, F.try_element_at(F.array(*map(F.lit, ("N", "CA", "C", "O", "CB"))), F.col("k"))).otherwise(F.concat(F.lit("C"), F.col("k").cast("string"))).alias("atom_name"),
            F.when(F.col("k") == 1, "N").when(F.col("k") == 4, "O").otherwise("C").alias("element"),
            (F.lit(3.8) * residue + F.col("l_quantity") / 25).alias("x"),
            (F.col("l_discount") * 20 + 0.0).alias("y"),
            (F.col("l_tax") * 25 + 0.0).alias("z"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
        )
    )


def mixed(atoms: DataFrame) -> DataFrame:
    """The projection with strangers in its residues' chains and numbers: a calcium ion named CA beside every CA of each
    fifth residue, and a ligand atom named N beside each seventh residue's."""
    protein = atoms.withColumn("modality", F.lit("PROTEIN"))

    def strangers(name: str, each: int, element: str, modality: str) -> DataFrame:
        near = protein.filter((F.col("atom_name") == name) & (F.col("res_index") % each == 2))
        return near.withColumns({"atom_idx": F.col("atom_idx") + 5000, "element": F.lit(element), "modality": F.lit(modality), "x": F.col("x") + 1.5, "z": F.col("z") - 0.5})

    return protein.unionByName(strangers("CA", 5, "Ca", "ION")).unionByName(strangers("N", 7, "N", "LIGAND"))


MIXED_SQL = """
mixed AS (
  SELECT structure_id, atom_idx, chain_id, res_index, atom_name, element, vdw, x, y, z FROM mol
  UNION ALL SELECT structure_id, atom_idx + 5000, chain_id, res_index, atom_name, 'Ca', 2.31e0, x + 1.5e0, y, z - 0.5e0 FROM mol WHERE atom_name = 'CA' AND res_index % 5 = 2
  UNION ALL SELECT structure_id, atom_idx + 5000, chain_id, res_index, atom_name, 'N', 1.55e0, x + 1.5e0, y, z - 0.5e0 FROM mol WHERE atom_name = 'N' AND res_index % 7 = 2
)"""


def moved(atoms: DataFrame) -> DataFrame:
    """A second conformation: atoms shifted by amounts that depend on their part and supplier."""
    return atoms.withColumns({"x": F.col("x") + F.col("l_partkey") % 7 / 5.0, "y": F.col("y") - F.col("l_suppkey") % 5 / 4.0, "z": F.col("z") + F.col("l_linenumber") / 10.0})


MOVED_SQL = "x + (l_partkey % 7) / 5e0 AS x, y - (l_suppkey % 5) / 4e0 AS y, z + l_linenumber / 10e0 AS z"


def event_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as atom rows: a user's events in time order are one chain of residues named by their type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("structure_id"), order.alias("atom_ord"), F.col("event_type").alias("res_name"), "event_id", "value")


EVENTS_SQL = "ev AS (SELECT user_id AS structure_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS atom_ord, event_type AS res_name, event_id, value FROM events)"
