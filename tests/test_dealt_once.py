"""Rows that were dealt once are joined and reported on without another shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.plans.queries import QUERIES
from atomloom.sources.storage import dealt_once

SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def test_dealt_rows_join_in_place(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("structure_id"), F.col("id").alias("atom_idx"))
    before, names = spark.conf.get(SETTING), {t.name for t in spark.catalog.listTables()}
    with dealt_once(spark, "structure_id") as put:
        left, right = put(rows, "left"), put(rows.withColumn("v", F.col("atom_idx") * 2), "right")
        both = left.hint("merge").join(right, ["structure_id", "atom_idx"])
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.filter("v = 2 * atom_idx").count() == 1000
    assert spark.conf.get(SETTING) == before and {t.name for t in spark.catalog.listTables()} == names


def test_settings_come_back_after_a_failure(spark):
    before = spark.conf.get(SETTING)
    try:
        with dealt_once(spark, "structure_id"):
            raise ValueError("stop")
    except ValueError:
        pass
    assert spark.conf.get(SETTING) == before


def test_benchmark_reports_shuffle_each_atom_twice(spark, sf):
    def shuffled() -> int:
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    atoms, before = spark.read.parquet(f"{sf}/lineitem.parquet").count(), shuffled()
    assert QUERIES["benchmark_reports"](spark, sf).count() > 0
    assert shuffled() - before < 2.5 * atoms
