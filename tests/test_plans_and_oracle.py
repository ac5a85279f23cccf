"""Plan-shape checks and the SQL-oracle comparison on the smallest fixture."""

import datetime as dt
import decimal
import math
import re
import tempfile

import duckdb
import pytest

import __spark_entry__ as entry_mod
from studiolake.operators import money as M
from studiolake.plans.catalog import entries
from studiolake.sources.adapter import AS_OF

SF = "/root/testdata/sf0.001"
DRIVER = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_frozen_mrr_has_no_nested_loop_join(spark, tables):
    assert "NestedLoopJoin" not in _plan(M.frozen_mrr_monthly(tables, AS_OF))


def test_no_python_udf_in_any_plan(spark):
    for e in entries():
        if e.name == "read_pages_sales":
            continue
        p = _plan(e.spark(spark, SF))
        assert "PythonUDF" not in p and "EvalPython" not in p, e.name


def test_scan_prunes_columns_and_pushes_filters(spark, tables):
    """The window's bound reaches the scan of the stored payments, and only the used columns are read."""
    from studiolake.sources.tables import write_table
    stored = write_table(tables["payments"], tempfile.mkdtemp(prefix="plan-") + "/payments")
    p = _plan(M.weekly_revenue(tables | {"payments": stored}, AS_OF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(payment_date,2001-05-09\)", p)
    assert "source_payment_id" not in re.search(r"ReadSchema: (\S+)", p)[1]


@pytest.fixture(scope="module")
def stored(spark, tables):
    """The tables in a store, so that scans show in plans as they would in use."""
    from studiolake.sources.tables import load, save_all
    store = tempfile.mkdtemp(prefix="plans-")
    save_all(tables, store)
    return load(spark, store)


def _scans(plan: str, column: str) -> int:
    return len(re.findall(rf"FileScan parquet \[[^\]]*\b{column}#", plan))


def test_monetization_reads_payments_twice_and_aggregates_by_hash(stored):
    p = _plan(M.monetization(stored, AS_OF))
    assert _scans(p, "payment_date") == 2 and "SortAggregate" not in p


def test_classes_are_grouping_sets(stored):
    from studiolake.operators.classes import classes_mart
    p = _plan(classes_mart(stored))
    assert "Expand" in p and "ObjectHashAggregate" not in p and "SortAggregate" not in p and "Generate" not in p
    assert _scans(p, "booked_date") == 1


def test_cohorts_are_one_row_a_member_within_literal_bounds(stored):
    from studiolake.operators.trends import cohort_retention
    df = cohort_retention(stored, AS_OF)
    p, logical = _plan(df), df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"booked_date#\d+ >= 2000-07-01", logical) and re.search(r"booked_date#\d+ < 2002-09-01", logical)
    assert _scans(p, "booked_date") == 1 and "distinct" not in p


def test_tenant_reads_are_pruned_by_a_literal(spark, stored):
    from studiolake.operators import dashboard as K
    from studiolake.operators.health import health_scores
    token = stored["boxes"].orderBy("id").first()["access_token"]
    p = _plan(health_scores(K.scope_inputs(stored, token), AS_OF))
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", p)
    assert len(filters) >= 4 and all(re.search(r"box_id#\d+ = \d+", f) for f in filters)
    assert "ubquery" not in p and "dynamicpruning" not in p
    assert health_scores(K.scope_inputs(stored, "no such token"), AS_OF).count() == 0


def test_references_are_checked_in_one_pass(stored):
    from studiolake.operators import quality as Q
    p = _plan(Q.dq_orphans(stored))
    assert len(re.findall(r"LeftOuter", p)) == 1 and "LeftAnti" not in p and len(re.findall("FileScan", p)) == len({c for c, *_ in Q.FOREIGN_KEYS}) + len({x for _, _, x, _ in Q.FOREIGN_KEYS})


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [e.name for e in entries()])
def test_matches_sql_oracle(spark, duck, name):
    e = {x.name: x for x in entries()}[name]
    df = e.spark(spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    sql = e.oracle()
    if sql is None:
        pytest.skip("rows-only")
    res = duck.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert _rows(s_cols, s_rows) == _rows(o_cols, o_rows)
