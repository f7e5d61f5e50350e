"""Seed goldens (hand-checkable results over the 85 seed rows)."""

from __future__ import annotations

from decimal import Decimal as D

from conftest import rows

from shelfmark.plans import reports, views


def test_kpis(seed):
    (r,) = reports.kpis(seed).collect()
    assert (r.TotalProducts, r.TotalOrders, r.TotalRevenue, r.ReorderAlerts) == (14, 10, D("273900.00"), 3)


def test_reorder_alerts(seed):
    out = rows(reports.reorder_alerts(seed), "ProductName", "WarehouseName", "QuantityOnHand", "ReorderLevel")
    assert sorted(out[:2]) == sorted([('Samsung 4K TV 55"', "North Hub", 8, 10), ("Study Table 4ft", "South Depot", 8, 10)])
    assert out[2] == ("Office Chair Executive", "North Hub", 12, 15)
    assert len(out) == 3


def test_stock_summary_status_counts(seed):
    counts = dict(rows(views.stock_summary(seed).groupBy("StockStatus").count()))
    assert counts == {"Sufficient": 21, "Reorder Required": 3}


def test_supplier_cities(seed):
    assert rows(reports.supplier_cities(seed)) == [("Faisalabad",), ("Islamabad",), ("Karachi",), ("Lahore",)]


def test_top_products(seed):
    assert rows(reports.top_products(seed, 5), "ProductName", "TotalUnitsSold", "TotalRevenue") == [
        ("Panadol CF 10s", 110, D("13200.00")),
        ("ORS Sachets x10", 80, D("6800.00")),
        ("Vitamin C 500mg x30", 25, D("8750.00")),
        ("Cooking Oil 5L", 22, D("18700.00")),
        ("Mineral Water 1L x24", 20, D("9600.00")),
    ]


def test_product_search(seed):
    out = rows(reports.product_search(seed, "a", 500, 5000), "ProductName", "UnitPrice")
    assert out == [("Men Shalwar Kameez", D("1200.00")), ("Wireless Keyboard", D("2500.00")),
                   ("Basmati Rice 25kg", D("3200.00"))]


def test_below_average_stock(seed):
    out = rows(reports.below_average_stock(seed), "ProductName", "TotalStock")
    assert out[:3] == [("Study Table 4ft", 23), ("Office Chair Executive", 32), ('Samsung 4K TV 55"', 33)]
    assert out[3] == ("Kids School Uniform", 180)
    assert sorted(out[4:6]) == [("USB-C Hub 7-Port", 200), ("Wireless Keyboard", 200)]
    assert sorted(out[6:]) == [("Men Shalwar Kameez", 450), ("Women Kurti", 450)]


def test_monthly_demand(seed):
    assert rows(reports.monthly_demand(seed)) == [
        ("2025-01", 2, 24, D("113200.00"), D("56600.00")),
        ("2025-02", 2, 117, D("56000.00"), D("28000.00")),
        ("2025-03", 3, 138, D("57500.00"), D("19166.67")),
        ("2025-04", 3, 42, D("47200.00"), D("15733.33")),
    ]


def test_monthly_sales_matches_demand(seed):
    demand = {m: rev for m, rev in rows(reports.monthly_demand(seed), "MonthYear", "TotalRevenue")}
    sales = dict(rows(reports.monthly_sales(seed)))
    assert demand == sales


def test_category_revenue(seed):
    out = rows(reports.category_revenue(seed, 10000))
    assert [r[0] for r in out] == ["Electronics", "Grocery", "Apparel", "Pharmaceuticals", "Furniture"]
    by = {r[0]: r[1:] for r in out}
    assert by["Electronics"][:3] == (3, 16, D("116900.00"))
    assert abs(by["Electronics"][3] - 18720.0) < 1e-9
    assert by["Pharmaceuticals"][:3] == (3, 215, D("28750.00"))
    assert abs(by["Pharmaceuticals"][3] - 175.714286) < 1e-6
    assert by["Furniture"][:3] == (2, 2, D("20500.00"))


def test_category_revenue_page_and_threshold(seed):
    assert reports.category_revenue_page(seed).count() == 5
    assert reports.category_revenue(seed, 28750).count() == 3  # strictly greater
    assert reports.category_revenue(seed, 28749.99).count() == 4


def test_product_revenue_and_stock_overview(seed):
    pr = {r[0]: r[1:] for r in rows(views.product_revenue(seed), "ProductID", "TotalOrderLines",
                                    "TotalUnitsSold", "TotalRevenue", "AvgSellingPrice")}
    assert pr[1] == (1, 1, D("85000.00"), 85000.0)
    assert pr[12] == (3, 110, D("13200.00"), 120.0)
    assert pr[8] == (2, 13, D("12350.00"), 950.0)
    so = rows(reports.stock_overview(seed), "ProductName", "TotalStock", "ReorderLevel", "Alert")
    assert len(so) == 14 and all(r[3] == "OK" for r in so)
    assert so[0] == ("Study Table 4ft", 23, 10, "OK")


def test_order_list(seed):
    out = rows(reports.order_list(seed), "OrderID", "Items", "OrderValue")
    assert out == [(10, 2, D("5900.00")), (9, 2, D("20500.00")), (8, 2, D("20800.00")), (7, 2, D("14350.00")),
                   (6, 3, D("34100.00")), (5, 2, D("9050.00")), (4, 3, D("13800.00")), (3, 2, D("42200.00")),
                   (2, 3, D("17100.00")), (1, 3, D("96100.00"))]


def test_order_lines_and_total_single(seed):
    lines = sorted(r[0] for r in rows(reports.order_lines(seed, 1), "LineTotal"))
    assert lines == [D("3600.00"), D("7500.00"), D("85000.00")]
    assert rows(reports.order_total(seed, 1), "OrderTotal") == [(D("96100.00"),)]


def test_order_total_setwise(spark, seed):
    ids = spark.createDataFrame([(1,), (9,), (999,)], "OrderID bigint")
    out = dict(rows(reports.order_total(seed, ids)))
    assert out == {1: D("96100.00"), 9: D("20500.00")}  # no row for an order without lines


def test_revenue_by_category_sums_to_kpi(seed):
    total = sum(r[0] for r in rows(reports.revenue_by_category(seed), "Revenue"))
    assert total == D("273900.00")


def test_alert_stock_by_warehouse(seed):
    out = sorted(rows(reports.alert_stock_by_warehouse(seed)))
    assert out == sorted([('Samsung 4K TV 55"', "North Hub", 8), ("Study Table 4ft", "South Depot", 8),
                          ("Office Chair Executive", "North Hub", 12)])


def test_product_catalogue(seed):
    out = rows(reports.product_catalogue(seed, "", 0, 100000), "ProductName")
    assert len(out) == 14 and out == sorted(out)
    assert reports.product_catalogue(seed, "KEY").count() == 1  # case-insensitive
