"""Registered queries against their SQL twins, and the repository without its optional parts."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
NAMES = ("mul_join", "and_kleene", "if_else", "isblank_dense", "by_metric_sum", "by_metric_lookup", "scan_two_lags", "scan_conditional", "coalesce_override", "write_bulk", "sql_outer_join_aggs", "fpa_plan")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from gridloom.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, rows))


def test_every_query_has_a_twin():
    from gridloom.queries import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES)


def test_entry_without_the_optional_parts(tmp_path):
    """The entry module works where the optional subpackage and pipeline are gone."""
    for name in ("__spark_entry__.py", "gridloom"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "gridloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fpa_plan' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_exact_sums_are_columns(spark):
    """Sums over all magnitudes against fractions; neither Python nor a second reading of Qty in exact_cancel."""
    import math
    import random
    from fractions import Fraction

    from gridloom.functions.aggregates import exact_sum
    from gridloom.queries import QUERIES

    r = random.Random(3)
    groups = [[r.choice((1, -1)) * math.ldexp(r.choice((r.random() + 0.5, 1.0, 1 - 2**-53)), r.randint(*span)) for _ in range(6)] for span in ((-3, 3), (-1074, -1000), (60, 70), (-68, -62), (-300, 300), (-1, 60)) for _ in range(20)]
    groups += [g + [-v for v in g] + [5e-324, 1e-30] for g in groups] + [[1.0, 2**-53, 2**-106], [2.0**65], [-(2.0**65) + 2**12], [1e17, 30.0, -1e17], [-0.0]]
    got = exact_sum(spark.createDataFrame([(i, v) for i, g in enumerate(groups) for v in g], "k long, v double"), ["k"])
    assert {x.k: x.v for x in got.collect()} == {i: float(sum(map(Fraction, g))) for i, g in enumerate(groups)}
    if os.path.isdir(DATA):
        plan = QUERIES["exact_cancel"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "_combined" not in plan and plan.count("l_quantity#") and plan.count("Relation ") == 1


def test_small_tables_start_no_python(spark):
    """Members and cells given on the driver are relations of the plan, not RDDs of Python objects."""
    from gridloom.plans.model import Model

    m = Model(spark)
    m.add_dimension("Month", ["Jan", "Feb"], ordered=True)
    m.add_input("Rate", ["Month"], {("Jan",): 2})
    m.add_formula("All", ["Month"], "IFBLANK(Rate, 1)")
    df = m.cube("All")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ExternalRDD" not in plan
    assert sorted(map(tuple, df.collect())) == [(0, 2.0), (1, 1.0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_incremental_reads_kept_cells(spark, monkeypatch):
    """Plan's cells are kept ones: what reads them doesn't sum the items again."""
    from gridloom import queries
    from gridloom.plans.model import Model

    seen, recalc = [], Model.recalc
    monkeypatch.setattr(Model, "recalc", lambda m: (seen.append(m.metric_named("Plan").base.inputFiles()), recalc(m))[1])
    queries._edited(spark, DATA)
    assert seen[0] and not any("lineitem" in f for f in seen[0])
