"""Validity is measured by code that Java compiles, from atoms that are shuffled once."""

from __future__ import annotations

import re

from atomloom.operators import flow, geometry
from atomloom.plans.queries import QUERIES, mol

def test_methods_of_a_report_are_short(spark, sf):
    """Java leaves methods beyond 8000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = geometry.validity_report(mol(spark, sf), "x", largest=1.7)._jdf.queryExecution()
        code = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_forces_are_not_made_by_a_lambda(spark, sf):
    """Spark interprets every generator over a lambda."""
    assert "explode(filter" not in flow.validity_gradient(mol(spark, sf), largest=1.7)._jdf.queryExecution().executedPlan().toString()


def test_reports_shuffle_each_line_once(spark, sf):
    def shuffled() -> int:
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    lines, before = spark.read.parquet(f"{sf}/lineitem.parquet").count(), shuffled()
    assert QUERIES["benchmark_reports"](spark, sf).count() > 0
    assert shuffled() - before < 1.5 * lines
