"""Every registered query against its DuckDB oracle on the sf0.001 driver tables,
plus cross-report properties and plan checks."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest
from conftest import ROOT, SF_SMALL, rows

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from shelfmark import registry  # noqa: E402
from check_oracle import VIEWS, canon  # noqa: E402

from shelfmark.plans import reports, views  # noqa: E402
from shelfmark.sources.fixtures import from_driver_tables  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for v in VIEWS:
        p = f"{SF_SMALL}/{v}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="module")
def model(spark):
    return from_driver_tables(spark, SF_SMALL)


# The retail queries; those of the optional subpackage have tests of their own.
def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF_SMALL)
    got = sorted(tuple(canon(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    cols = rel.columns
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["MonthYear", "TotalOrders", "TotalUnitsSold", "TotalRevenue", "AvgOrderValue"]
    assert df.count() > 0


def test_revenue_properties(model):
    (k,) = reports.kpis(model).collect()
    assert sum(r[0] for r in rows(views.product_revenue(model), "TotalRevenue")) == k.TotalRevenue
    assert sum(r[0] for r in rows(reports.revenue_by_category(model), "Revenue")) == k.TotalRevenue
    monthly = sum(r[0] for r in rows(reports.monthly_sales(model), "Revenue"))
    cancelled = sum(r[0] for r in rows(
        reports.order_list(model).where("Status = 'Cancelled'"), "OrderValue"))
    assert monthly + cancelled == k.TotalRevenue
    assert reports.reorder_alerts(model).count() == k.ReorderAlerts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_stay_jvm_side(model):
    plan = _plan(reports.product_search(model, "a", 500, 5000))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    for name, fn in registry.queries().items():
        if name == "stock_stream":
            continue
        text = fn(model.product.sparkSession, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in text and "ArrowEvalPython" not in text, name
        assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text, name


def test_monthly_demand_skips_customer_scan_and_prunes(model):
    plan = _plan(reports.monthly_demand(model))
    assert "customer.parquet" not in plan  # unused left join removed
    assert "l_returnflag" not in plan      # column pruning on lineitem
