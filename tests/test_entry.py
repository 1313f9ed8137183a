import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderkey", "o_totalprice"] and df.count() > 0


def test_registry():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 80


def test_works_without_the_text_operators():
    code = "import sys; sys.modules['lodestream.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op1') for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_filters_and_columns_reach_the_scan(spark):
    plan = __spark_entry__.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F), GreaterThan(o_total" in plan  # Spark shortens the list
    assert "o_custkey" not in plan.split("ReadSchema", 1)[1].split(">", 1)[0]


def test_keep_first_preaggregates(spark):
    plan = __spark_entry__.queries()["dedup_keep_one"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
