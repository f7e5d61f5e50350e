"""Orders and lines laid out by month: changes equal the batch operators and leave other months' files alone."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from conftest import rows

from shelfmark import schemas
from shelfmark.operators import changes
from shelfmark.sources import by_month


def files(root):
    """Every data file with its time, by month folder."""
    found = {}
    for folder, _, names in os.walk(root):
        if by_month.MONTH in folder:
            table, month = folder.split("/")[-2:]
            found[table, month.split("=")[1]] = sorted((n, os.stat(f"{folder}/{n}").st_mtime_ns) for n in names if n.endswith(".parquet"))
    return found


def layout(seed):
    root = tempfile.mkdtemp(prefix="shelfmark-months-")
    by_month.save_by_month(seed, root)
    return root


def read(spark, root, t):
    return [sorted(rows(by_month.read_by_month(spark, root, name).select(*df.columns)), key=str)
            for name, df in ((by_month.ORDERS, t.sales_order), (by_month.LINES, t.order_detail))]


def expect(t):
    return [sorted(rows(t.sales_order, *schemas.SALES_ORDER.names), key=str), sorted(rows(t.order_detail, *schemas.ORDER_DETAIL.names), key=str)]


def untouched(before, after, months):
    for key, held in before.items():
        if key[1] not in months:
            assert after[key] == held, key


def test_layout_holds_every_row_and_prunes(spark, seed):
    stray = spark.createDataFrame([(900, 77_777, 1, 1, 5)], "DetailID long, OrderID long, ProductID long, Quantity int, SalePrice int")
    t = seed.replace(order_detail=seed.order_detail.unionByName(stray.withColumn("SalePrice", stray.SalePrice.cast("decimal(10,2)"))))
    root = layout(t)
    assert read(spark, root, t) == expect(t)
    assert rows(by_month.read_by_month(spark, root, by_month.LINES, [by_month.NO_MONTH]), "DetailID") == [(900,)]
    plan = by_month.read_by_month(spark, root, by_month.LINES, ["2025-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(OrderMonth" in plan or "PartitionFilters: [OrderMonth" in plan or "OrderMonth#" in plan.split("PartitionFilters")[1][:200]


def test_delete_orders_rewrites_their_months_only(spark, seed):
    root = layout(seed)
    before = files(root)
    ids = spark.createDataFrame([(1,), (1,), (404,)], "OrderID long")
    months = by_month.delete_orders(spark, root, ids)
    assert len(months) == 1 and read(spark, root, seed) == expect(changes.delete_orders(seed, ids))
    untouched(before, files(root), months)
    assert files(root)[by_month.ORDERS, months[0]] != before[by_month.ORDERS, months[0]]
    assert by_month.delete_orders(spark, root, ids) == []


def test_month_that_loses_all_rows_goes(spark, seed):
    root = layout(seed)
    (month,) = {r[0] for r in rows(by_month.read_by_month(spark, root, by_month.ORDERS).where("OrderID = 1"), by_month.MONTH)}
    ids = by_month.read_by_month(spark, root, by_month.ORDERS, [month]).select("OrderID")
    wanted = changes.delete_orders(seed, spark.createDataFrame(rows(ids), "OrderID long"))
    assert by_month.delete_orders(spark, root, ids) == [month]
    assert read(spark, root, seed) == expect(wanted)
    assert (by_month.ORDERS, month) not in files(root) and (by_month.LINES, month) not in files(root)


def test_delete_product_lines(spark, seed):
    root = layout(seed)
    before = files(root)
    ids = spark.createDataFrame([(2,)], "ProductID long")
    months = by_month.delete_product_lines(spark, root, ids)
    wanted = seed.replace(order_detail=changes.delete_products(seed, ids).order_detail)
    assert months and read(spark, root, seed) == expect(wanted)
    untouched(before, files(root), months)


def test_update_status_and_date(spark, seed):
    root = layout(seed)
    before = files(root)
    edits = spark.createDataFrame([(2, "Cancelled", 1), (2, "Shipped", 2), (999, "Pending", 1)], "OrderID long, Status string, seq int")
    months = by_month.update_orders(spark, root, edits, ["Status"], ["seq"])
    t = seed.replace(sales_order=changes.update_rows(seed.sales_order, edits, "OrderID", ["Status"], ["seq"]).table)
    assert len(months) == 1 and read(spark, root, seed) == expect(t)
    untouched(before, files(root), months)

    before = files(root)
    edits = spark.createDataFrame([(1, dt.date(2031, 7, 1)), (3, dt.date(2025, 1, 2)), (4, None)], "OrderID long, OrderDate date")
    months = by_month.update_orders(spark, root, edits, ["OrderDate"])
    t = t.replace(sales_order=changes.update_rows(t.sales_order, edits, "OrderID", ["OrderDate"]).table)
    assert "2031-07" in months and by_month.NO_MONTH in months and read(spark, root, seed) == expect(t)
    assert {r[0] for r in rows(by_month.read_by_month(spark, root, by_month.LINES, ["2031-07"]), "OrderID")} == {1}
    untouched(before, files(root), months)
