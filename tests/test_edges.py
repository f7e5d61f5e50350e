"""Edge cases: empty change batches, subset properties, overflow, formats, display."""

from __future__ import annotations

import datetime as dt
import tempfile
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.errors import ArithmeticException
from seeds import make_tables, seed_rows

from shelfmark import schemas
from shelfmark.operators import changes
from shelfmark.plans import reports, views
from shelfmark.sources import tables as tables_io


def test_empty_change_batches_change_nothing(spark, seed):
    empty_stock = spark.createDataFrame([], "ProductID long, WarehouseID long, seq long, QuantityOnHand int")
    res = changes.update_stock(seed.stock, empty_stock, as_of=dt.date(2025, 5, 1))
    assert sorted(rows(res.table)) == sorted(rows(seed.stock)) and res.rejected.count() == 0
    empty_orders = spark.createDataFrame([], "seq long, CustomerName string")
    out = changes.append_rows(seed.sales_order, empty_orders, "OrderID", ["seq"],
                              schemas.DEFAULTS["SalesOrder"], dt.date(2025, 5, 1))
    assert sorted(rows(out)) == sorted(rows(seed.sales_order))
    none = spark.createDataFrame([], "ProductID long")
    assert changes.delete_products(seed, none).order_detail.count() == 24
    ign = changes.append_ignore(seed.supplier, seed.supplier.limit(0), [("SupplierID",), ("ContactEmail",)],
                                ["SupplierID"])
    assert ign.table.count() == 5


def test_alerts_are_a_subset_of_the_summary(seed):
    summary = set(rows(views.stock_summary(seed)))
    assert set(rows(reports.reorder_alerts(seed))) <= summary


def test_decimal_overflow_raises_under_ansi(spark):
    r = {k: [] for k in seed_rows()}
    r["SalesOrder"] = [(1, "a", dt.date(2025, 1, 1), "Shipped", None)]
    r["OrderDetail"] = [(1, 1, 1, 2_000_000_000, D("99999999.99"))]
    with pytest.raises(ArithmeticException):
        reports.monthly_demand(make_tables(spark, r)).collect()  # AvgOrderValue exceeds DECIMAL(10,2)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_load_and_save_in_any_format(spark, seed, fmt):
    root = tempfile.mkdtemp(prefix=f"shelfmark-{fmt}-")
    opts = {"header": "true"} if fmt == "csv" else {}
    if fmt == "csv":
        for name, df in seed.items():
            df.write.options(**opts).csv(f"{root}/{name}")
    else:
        tables_io.save(seed, root, fmt)
    back = tables_io.load(spark, root, fmt, opts)
    for name, df in seed.items():
        assert sorted(rows(back.by_name(name))) == sorted(rows(df)), name
    assert rows(reports.kpis(back)) == rows(reports.kpis(seed))


def test_write_version_never_overwrites(spark, seed):
    root = tempfile.mkdtemp(prefix="shelfmark-versions-")
    a = tables_io.write_version(seed.stock, root)
    b = tables_io.write_version(seed.stock, root)
    assert a != b
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 24


def test_kpi_display_and_catalogue_count(seed):
    (r,) = reports.kpi_display(seed).collect()
    assert (r.TotalProducts, r.TotalOrders, r.TotalRevenue, r.ReorderAlerts) == ("14", "10", "PKR 273,900", "3")
    assert rows(reports.catalogue_count(seed, "a", 500, 5000)) == [(3,)]


def test_checked_load_and_publish(spark, seed):
    from shelfmark.sources import loading

    root = tempfile.mkdtemp(prefix="shelfmark-load-")
    tables_io.save(seed, root)
    t, report = loading.checked_load(spark, root)
    assert {r[0] for r in rows(report, "violations")} == {0}
    per_check = {r[0]: r[1] for r in rows(report.groupBy("check_name").count())}
    assert per_check == {
        "unique": len(schemas.PRIMARY_KEYS) + sum(map(len, schemas.UNIQUE_KEYS.values())), "foreign_key": len(schemas.FOREIGN_KEYS),
        "not_null": sum(map(len, schemas.NOT_NULL.values())), "allowed_values": 1,
        "max_length": sum(map(len, schemas.MAX_LENGTHS.values())), "decimal": sum(map(len, schemas.DECIMAL_LIMITS.values()))}
    paths = loading.publish(t, tempfile.mkdtemp(prefix="shelfmark-pub-"))
    assert spark.read.parquet(paths["OrderDetail"]).count() == 24


def test_bucketed_model_joins_without_shuffle(spark, seed):
    import uuid

    db = f"shelfmark_b_{uuid.uuid4().hex[:8]}"
    tables_io.save_bucketed(seed, db, 4, tempfile.mkdtemp(prefix="shelfmark-bucketed-"))
    t = tables_io.load_tables(spark, db)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = reports.monthly_demand(t, sort=False)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        # Only the tiny month aggregate shuffles: per-order grouping and the join read matching buckets.
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert sorted(rows(df)) == sorted(rows(reports.monthly_demand(seed, sort=False)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
