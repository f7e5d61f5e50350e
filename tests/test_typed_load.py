"""The two-phase typed load, and the checks gathered while tables are written."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import quality
from shelfmark.sources import loading, typed_load
from shelfmark.sources import tables as tables_io

PRODUCT = ("ProductID", "ProductName", "CategoryID", "SupplierID", "UnitPrice", "ReorderLevel", "LeadTimeDays")


def load_product(spark, **changed):
    row = {"ProductID": "1", "ProductName": "A", "CategoryID": "2", "SupplierID": "3", "UnitPrice": "9.5", "ReorderLevel": "4", "LeadTimeDays": "5"} | changed
    raw = spark.createDataFrame([tuple(row[c] for c in PRODUCT)], ", ".join(f"{c} string" for c in PRODUCT))
    got = typed_load.typed(raw, "Product")
    return rows(got.rows), [(r.column_name, r.value, r.reason) for r in got.quarantine.collect()]


@pytest.mark.parametrize("column, text, reason", [
    ("UnitPrice", "99999999.99", None), ("UnitPrice", "100000000", "out_of_range"), ("UnitPrice", "1.005", "too_many_decimals"),
    ("UnitPrice", "1.500", None), ("UnitPrice", "0000000000001.5", None), ("UnitPrice", "-3.25", None), ("UnitPrice", "1,5", "not_a_number"),
    ("UnitPrice", "1e3", "not_a_number"), ("UnitPrice", "", "null"), ("UnitPrice", None, "null"), ("UnitPrice", " 7 ", None),
    ("UnitPrice", "9" * 400, "out_of_range"), ("UnitPrice", ".", "not_a_number"),
    ("ReorderLevel", "12.5", "not_a_number"), ("ReorderLevel", "2147483648", "out_of_range"), ("ReorderLevel", "-2147483648", None),
    ("ReorderLevel", "+7", None), ("LeadTimeDays", " ", None), ("LeadTimeDays", None, None), ("LeadTimeDays", "x", "not_a_number"),
    ("ProductName", "n" * 150, None), ("ProductName", "n" * 151, "too_long"), ("ProductName", None, "null"), ("ProductName", "", None),
    ("ProductID", "9223372036854775808", "out_of_range"), ("ProductID", "P-1", "not_a_number"),
])
def test_each_value_is_typed_or_quarantined_with_its_reason(spark, column, text, reason):
    good, bad = load_product(spark, **{column: text})
    assert bad == ([] if reason is None else [(column, text, reason)])
    assert len(good) == (reason is None)


def test_row_with_several_misfits_names_them_all(spark):
    good, bad = load_product(spark, UnitPrice="n/a", ReorderLevel="", SupplierID="x")
    assert good == [] and {(c, r) for c, _, r in bad} == {("UnitPrice", "not_a_number"), ("ReorderLevel", "null"), ("SupplierID", "not_a_number")}
    good, _ = load_product(spark)
    assert good == [(1, "A", 2, 3, D("9.50"), 4, 5)]


def test_dates_and_statuses(spark):
    raw = spark.createDataFrame([("1", "a", "2025-02-28", "Shipped", None), ("2", "b", "2025-02-30", "Shipped", "1"), ("3", "c", "28/02/2025", "Lost", "1"),
                                 ("4", "d", "2025", "Pending", "1")],
                                "OrderID string, CustomerName string, OrderDate string, Status string, TotalAmount string")
    got = typed_load.typed(raw, "SalesOrder")
    assert rows(got.rows) == [(1, "a", dt.date(2025, 2, 28), "Shipped", None)]
    assert sorted(rows(got.quarantine, "row_key", "column_name", "reason")) == [
        ("2", "OrderDate", "not_a_date"), ("3", "OrderDate", "not_a_date"), ("3", "Status", "not_allowed"), ("4", "OrderDate", "not_a_date")]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_load_sets_misfits_aside_in_any_format(spark, seed, fmt):
    root = tempfile.mkdtemp(prefix=f"shelfmark-typed-{fmt}-")
    opts = {"header": "true"} if fmt == "csv" else {}
    for name, df in seed.items():
        if name == "Product":
            df = df.withColumn("UnitPrice", F.when(F.col("ProductID") == 3, "cheap").otherwise(F.col("UnitPrice").cast("string")))
        df.write.options(**opts).format(fmt).save(f"{root}/{name}")
    t, quarantine = typed_load.typed_load(spark, root, fmt, opts)
    assert rows(quarantine) == [("Product", "3", "UnitPrice", "cheap", "not_a_number")]
    assert t.product.schema.simpleString() == schemas.PRODUCT.simpleString()
    assert sorted(rows(t.product)) == sorted(r for r in rows(seed.product) if r[0] != 3)
    assert sorted(rows(t.order_detail)) == sorted(rows(seed.order_detail))
    _, report = loading.checked_load(spark, root, fmt, opts)
    found = {(r.check_name, r.table_name, r.detail): r.violations for r in report.collect()}
    assert found["declared_type", "Product", "UnitPrice: not_a_number"] == 1
    assert found["foreign_key", "OrderDetail", "ProductID->Product"] > 0  # the lines of the row that is set aside


def broken(spark, seed):
    """Tables with violations of every kind of check."""
    orders = spark.createDataFrame([(90, "x" * 101, dt.date(2025, 1, 1), "Lost", None), (90, None, None, "Pending", D("1"))],
                                   "OrderID long, CustomerName string, OrderDate date, Status string, TotalAmount decimal(20,4)")
    lines = spark.createDataFrame([(1, 77, 1, 1, D("1")), (901, 1, 99, None, None)], "DetailID long, OrderID long, ProductID long, Quantity int, SalePrice decimal(10,2)")
    sales = seed.sales_order.withColumn("TotalAmount", F.col("TotalAmount").cast("decimal(20,4)") + F.lit(D("0.0050")))
    return seed.replace(sales_order=sales.unionByName(orders), order_detail=seed.order_detail.unionByName(lines))


def test_report_of_the_write_equals_the_report_of_the_checks(spark, seed):
    for t in (seed, broken(spark, seed), seed.replace(order_detail=seed.order_detail.drop("DetailID"))):
        root = tempfile.mkdtemp(prefix="shelfmark-publish-")
        paths, report = loading.publish_checked(t, root)
        assert sorted(rows(report), key=str) == sorted(rows(quality.report(t)), key=str)
        for name, df in t.items():
            assert os.path.isdir(paths[name]) and sorted(rows(spark.read.parquet(paths[name])), key=str) == sorted(rows(df), key=str)
    found = {(r.check_name, r.detail): r.violations for r in quality.report(broken(spark, seed)).collect()}
    assert found["allowed_values", "Status"] == 1 and found["max_length", "CustomerName"] == 1 and found["not_null", "Quantity"] == 1
    assert found["decimal", "TotalAmount"] == 10 and found["unique", "DetailID"] == 1 and found["foreign_key", "OrderID->SalesOrder"] == 1


def test_row_checks_cost_no_scan_beside_the_write(spark, seed):
    """Each table's source is read once: by the write, which counts as it goes."""
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    t = tables_io.tables_of({name: df.mapInPandas(counted, df.schema) for name, df in seed.items()})
    loading.publish_checked(t, tempfile.mkdtemp(prefix="shelfmark-publish-"))
    assert reads.value == sum(df.count() for _, df in seed.items())
