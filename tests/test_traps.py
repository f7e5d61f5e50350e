"""Semantic traps with extra rows added to the seeds."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import rows
from seeds import make_tables, seed_rows

from shelfmark.plans import reports, views


@pytest.fixture(scope="module")
def extended(spark):
    r = {k: list(v) for k, v in seed_rows().items()}
    r["Supplier"].append((6, "NoCity Traders", "nocity@x.pk", None, None, None))
    r["Product"] += [
        (15, "Wireless Keyboard", 1, 6, D("2600"), 20, None),   # same name as 2 (T10), NULL lead time
        (16, "Unstocked Item", 2, 2, D("999"), 5, 7),           # no stock, no sales
        (17, "UPPER ONLY", 2, 2, D("999"), 5, 7),               # only an upper-case 'A'
        (18, "Tie Five", 5, 5, D("10"), 5, 7),                  # ties rank 5 on units (T7)
    ]
    r["InventoryStock"] += [
        (25, 15, 1, 20, dt.date(2025, 4, 2)),                   # QOH == ReorderLevel -> alert (T11)
        (26, 17, 1, 4, dt.date(2025, 4, 2)),
        (27, 18, 2, 500, dt.date(2025, 4, 2)),
    ]
    r["SalesOrder"] += [
        (11, "Khalid Cancelled", dt.date(2025, 4, 20), "Cancelled", D("1000")),   # cancelled with lines (T8)
        (12, "Latif No Lines", dt.date(2025, 4, 21), "Pending", None),            # no lines, NULL total
    ]
    r["OrderDetail"] += [
        (25, 11, 2, 2, D("2500")),
        (26, 11, 18, 20, D("10")),
    ]
    return make_tables(spark, r)


def test_t1_search_is_case_insensitive(extended):
    names = {r[0] for r in rows(reports.product_search(extended, "a", 500, 5000), "ProductName")}
    assert "UPPER ONLY" not in names  # no 'a' at all
    names = {r[0] for r in rows(reports.product_catalogue(extended, "only"), "ProductName")}
    assert names == {"UPPER ONLY"}


def test_t2_wildcards_unescaped_by_default(spark, extended):
    assert reports.product_catalogue(extended, "4K%TV").count() == 1  # % acts as a wildcard
    assert reports.product_catalogue(extended, "4K%TV", escape=True).count() == 0
    assert reports.product_catalogue(extended, "USB_C").count() == 1
    assert reports.product_catalogue(extended, "USB_C", escape=True).count() == 0


def test_t4_result_types(extended):
    pr = views.product_revenue(extended)
    types = dict(pr.dtypes)
    assert types["TotalUnitsSold"] == "bigint"
    assert types["TotalRevenue"] == "decimal(38,2)"
    assert types["AvgSellingPrice"] == "double"


def test_t7_top_k_tie_break_by_product_id(extended):
    # Product 18 sells 20 units, tying Mineral Water (6) at rank 5; the lower id wins.
    out = rows(reports.top_products(extended, 5), "ProductName", "TotalUnitsSold")
    assert out[4] == ("Mineral Water 1L x24", 20)


def test_t8_cancelled_only_out_of_monthly(extended):
    (k,) = reports.kpis(extended).collect()
    monthly = sum(r[0] for r in rows(reports.monthly_sales(extended), "Revenue"))
    cancelled = D("2") * D("2500") + D("20") * D("10")
    assert k.TotalRevenue == monthly + cancelled
    april = dict(rows(reports.monthly_demand(extended), "MonthYear", "TotalOrders"))["2025-04"]
    assert april == 3


def test_line_less_order_counted_in_kpi_not_in_list(extended):
    (k,) = reports.kpis(extended).collect()
    assert k.TotalOrders == 12
    assert 12 not in {r[0] for r in rows(reports.order_list(extended), "OrderID")}
    assert reports.order_total(extended, 12).count() == 0


def test_t9_row_alert_vs_product_alert(extended):
    alerts = {r[0] for r in rows(reports.reorder_alerts(extended), "ProductID")}
    assert {1, 10, 11, 15, 17} <= alerts
    product_alerts = {r[0] for r in rows(reports.stock_overview(extended), "ProductName", "Alert") if r[1] == "REORDER NOW"}
    assert 'Samsung 4K TV 55"' not in product_alerts


def test_t10_group_by_name_merges_same_names(extended):
    so = rows(reports.stock_overview(extended), "ProductName", "SupplierName", "TotalStock")
    kb = [r for r in so if r[0] == "Wireless Keyboard"]
    assert len(kb) == 2  # different suppliers keep them apart in Q1
    below = dict(rows(reports.below_average_stock(extended), "ProductName", "TotalStock"))
    assert "Wireless Keyboard" in below


def test_t11_equal_to_level_alerts(extended):
    st = {r[0]: r[1] for r in rows(views.stock_summary(extended), "ProductID", "StockStatus")}
    assert st[15] == "Reorder Required"


def test_inner_joins_drop_unstocked_and_unsold(extended):
    assert 16 not in {r[0] for r in rows(views.product_revenue(extended), "ProductID")}
    assert 16 not in {r[0] for r in rows(views.stock_summary(extended), "ProductID")}
    assert "Unstocked Item" in {r[0] for r in rows(reports.product_catalogue(extended), "ProductName")}


def test_null_city_is_a_distinct_city(extended):
    cities = rows(reports.supplier_cities(extended))
    assert cities[0] == (None,)  # NULLs sort first ascending (T13)


def test_empty_tables_give_zero_revenue(spark):
    empty = make_tables(spark, {k: [] for k in seed_rows()})
    (k,) = reports.kpis(empty).collect()
    assert (k.TotalProducts, k.TotalOrders, k.TotalRevenue, k.ReorderAlerts) == (0, 0, D("0.00"), 0)
    assert reports.monthly_demand(empty).count() == 0
    assert reports.below_average_stock(empty).count() == 0


def test_avg_order_value_rounds_half_up(spark):
    r = seed_rows()
    r = {k: [] for k in r}
    r["SalesOrder"] = [(1, "a", dt.date(2025, 1, 1), "Shipped", None), (2, "b", dt.date(2025, 1, 2), "Shipped", None)]
    r["OrderDetail"] = [(1, 1, 1, 1, D("0.01")), (2, 2, 1, 1, D("0.00"))]
    out = rows(reports.monthly_demand(make_tables(spark, r)), "AvgOrderValue")
    assert out == [(D("0.01"),)]  # 0.005 -> 0.01
