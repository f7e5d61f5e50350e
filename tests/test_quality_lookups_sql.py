"""Quality checks C1-C5, lookups S7-S10 and the SQL surface S2-S4."""

from __future__ import annotations

from decimal import Decimal as D

from conftest import rows

from shelfmark import schemas
from shelfmark.operators import lookups, quality
from shelfmark.plans import reports
from shelfmark.sources import sql


def test_seeds_are_clean(seed):
    assert {r[0] for r in rows(quality.unique_summary(seed), "duplicate_keys")} == {0}
    assert {r[0] for r in rows(quality.foreign_key_summary(seed), "orphan_rows")} == {0}
    assert {r[0] for r in rows(quality.not_null_summary(seed), "null_rows")} == {0}
    assert rows(quality.values_summary(seed), "violations") == [(0,)]
    assert {r[0] for r in rows(quality.length_summary(seed), "too_long")} == {0}
    assert quality.unique_summary(seed).count() == 11  # 7 primary keys + 4 unique keys


def test_check_unique_composite_and_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (None, 3)], "a long, b long")
    assert rows(quality.check_unique(df, ["a", "b"])) == [(1, 1, 2)]
    assert rows(quality.check_unique(df, ["a"])) == [(1, 3)]


def test_check_foreign_key_finds_orphans(spark, seed):
    orphan = spark.createDataFrame([(99, 77, 1, 1, D("1"))], schemas.ORDER_DETAIL)
    od = seed.order_detail.unionByName(orphan)
    assert rows(quality.check_foreign_key(od, "OrderID", seed.sales_order, "OrderID"), "DetailID") == [(99,)]


def test_check_values_length_decimal_not_null(spark):
    df = spark.createDataFrame([("Pending", "x" * 101, D("123.45")), ("Lost", "ok", D("0.5")), (None, None, None)],
                               "Status string, CustomerName string, v decimal(10,2)")
    assert rows(quality.check_values(df, "Status", schemas.ORDER_STATUSES), "Status") == [("Lost",)]
    assert quality.check_length(df, "CustomerName", 100).count() == 1
    assert rows(quality.check_decimal(df, "v", 4, 2), "v") == [(D("123.45"),)]
    out = rows(quality.check_not_null(df, ["Status", "CustomerName"]), "null_columns")
    assert out == [(["Status", "CustomerName"],)]


def test_lookups(spark, seed):
    assert rows(lookups.rows_by_key(seed.product, "ProductID", 3), "ProductName") == [("USB-C Hub 7-Port",)]
    names = [r[1] for r in rows(lookups.dimension_list(seed, "product"))]
    assert names == sorted(names) and len(names) == 14
    extra = spark.createDataFrame([(15, "Wireless Keyboard", 1, 1, D("1"), 1, 1)], schemas.PRODUCT)
    dim = seed.product.unionByName(extra)
    ch = spark.createDataFrame([("Wireless Keyboard", 5), ("Nope", 1)], "ProductName string, qty int")
    got = {r[0]: (r[1], r[2]) for r in rows(lookups.resolve_names(ch, dim, "ProductID", "ProductName"),
                                            "ProductName", "ProductID", "rows_with_name")}
    assert got == {"Wireless Keyboard": (15, 2), "Nope": (None, None)}  # highest id wins, ambiguity exposed
    named = lookups.names_for_keys(seed.stock.where("StockID = 1"), seed.warehouse, "WarehouseID", "WarehouseName")
    assert rows(named, "WarehouseName") == [("Central Warehouse",)]
    twice = seed.warehouse.unionByName(seed.warehouse)
    assert lookups.names_for_keys(seed.stock, twice, "WarehouseID", "WarehouseName").count() == seed.stock.count()


def test_sql_views_and_parameters(spark, seed):
    sql.register_views(spark, seed, prefix="t_")
    alerts = sql.query(spark, "SELECT * FROM t_vw_StockSummary WHERE StockStatus = :s ORDER BY QuantityOnHand",
                       {"s": "Reorder Required"})
    assert sorted(rows(alerts)) == sorted(rows(reports.reorder_alerts(seed)))
    top = sql.query(spark, "SELECT ProductName FROM t_vw_ProductRevenue ORDER BY TotalUnitsSold DESC, ProductID "
                           "LIMIT :n", {"n": 2})
    assert rows(top) == [("Panadol CF 10s",), ("ORS Sachets x10",)]
    # A value with quotes is bound, never spliced into the SQL text.
    hit = sql.query(spark, "SELECT ProductName FROM t_Product WHERE ProductName = :n", {"n": 'Samsung 4K TV 55"'})
    assert hit.count() == 1


def test_report_views_for_sql_users(spark, seed):
    names = sql.register_report_views(spark, seed, prefix="r_")
    assert "r_monthly_demand" in names
    got = sql.query(spark, "SELECT MonthYear, TotalOrders FROM r_monthly_demand WHERE MonthYear >= :m ORDER BY 1",
                    {"m": "2025-03"})
    assert rows(got) == [("2025-03", 3), ("2025-04", 3)]
    assert rows(sql.query(spark, "SELECT ReorderAlerts FROM r_kpis")) == [(3,)]


def test_sql_table_functions_equal_the_reports(spark, seed):
    sql.register_views(spark, seed, prefix="f_")
    names = sql.register_functions(spark, prefix="f_")
    assert names == ["f_product_search", "f_product_catalogue", "f_category_revenue", "f_top_products", "f_order_lines"]

    def ask(text, **args):
        return sorted(rows(sql.query(spark, text, args)), key=str)

    def same(df):
        return sorted(rows(df), key=str)

    search = "SELECT * FROM f_product_search(:pat, :lo, :hi)"
    assert ask(search, pat="%a%", lo=500, hi=5000) == same(reports.product_search(seed, "a", 500, 5000))
    assert ask(search, pat=None, lo=None, hi=None) == same(reports.product_search(seed))
    assert ask(search + " WHERE UnitPrice < :x", pat="%A%", lo=None, hi=None, x=900) == same(reports.product_search(seed, "a").where("UnitPrice < 900"))
    assert ask("SELECT * FROM f_product_catalogue(:pat, 0, 99999)", pat="%o%") == same(reports.product_catalogue(seed, "o", 0, 99999))
    assert ask("SELECT * FROM f_category_revenue(:n)", n=10000) == same(reports.category_revenue(seed))
    assert ask("SELECT * FROM f_top_products(3)") == same(reports.top_products(seed, 3))
    lines = reports.order_lines(seed, 2)
    assert ask("SELECT * FROM f_order_lines(:id)", id=2) == same(lines.drop("OrderID"))
    plan = sql.query(spark, search + " WHERE UnitPrice < 900", {"pat": "%a%", "lo": 500, "hi": 5000})._jdf.queryExecution().optimizedPlan().toString()
    assert "500" in plan and "900" in plan and "Project" in plan and "CartesianProduct" not in plan


def test_table_function_filter_reaches_the_scan(spark, seed, tmp_path):
    seed.product.write.parquet(str(tmp_path / "Product"))
    t = seed.replace(product=spark.read.schema(schemas.PRODUCT).parquet(str(tmp_path / "Product")))
    sql.register_views(spark, t, prefix="g_")
    sql.register_functions(spark, prefix="g_")
    found = sql.query(spark, "SELECT * FROM g_product_search(:pat, :lo, :hi) WHERE UnitPrice < 900", {"pat": "%a%", "lo": 500, "hi": 5000})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(UnitPrice,500" in pushed and "LessThan(UnitPrice,900" in pushed


def test_scale_conf_sizes_partitions():
    from shelfmark.session import scale_conf

    conf = scale_conf(100 * 1024 ** 4, 8000)  # 100 TiB on 8000 cores: capped
    assert int(conf["spark.sql.shuffle.partitions"]) == 50_000
    assert int(scale_conf(10 * 1024 ** 4, 1000)["spark.sql.shuffle.partitions"]) == 5120  # 10 TiB, 1000 cores
    assert int(scale_conf(10 * 1024 ** 4, 8000)["spark.sql.shuffle.partitions"]) == 16_000  # at least 2 per core
    assert int(scale_conf(10 ** 6, 8)["spark.sql.shuffle.partitions"]) == 16


def test_report_names_the_keys_it_cannot_check(seed):
    bare = seed.replace(order_detail=seed.order_detail.drop("DetailID"))
    skipped = rows(quality.report(bare).where("check_name = 'unique (not checked)'"), "table_name", "detail", "violations")
    assert skipped == [("OrderDetail", "DetailID", None)]
    assert quality.unchecked_keys(seed) == []
