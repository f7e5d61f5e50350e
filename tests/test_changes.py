"""Change operators W1-W7 and Q-DDL2 on the seed tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from conftest import rows

from shelfmark import schemas
from shelfmark.operators import changes, quality
from shelfmark.plans import reports

AS_OF = dt.date(2025, 5, 1)


def test_append_rows_defaults_and_keys(spark, seed):
    new = spark.createDataFrame(
        [(1, "Zara Mart", None), (2, "Yasir Shop", "Shipped"), (3, "Xeno", None)],
        "seq long, CustomerName string, Status string")
    # Status present (explicit NULL stays NULL); OrderDate absent -> as_of; TotalAmount absent -> NULL.
    out = changes.append_rows(seed.sales_order, new.drop("Status"), "OrderID", ["seq"],
                              defaults=schemas.DEFAULTS["SalesOrder"], as_of=AS_OF)
    added = rows(out.where("OrderID > 10").orderBy("OrderID"))
    assert added == [(11, "Zara Mart", AS_OF, "Pending", None), (12, "Yasir Shop", AS_OF, "Pending", None),
                     (13, "Xeno", AS_OF, "Pending", None)]
    kept_null = changes.append_rows(seed.sales_order, new, "OrderID", ["seq"],
                                    defaults=schemas.DEFAULTS["SalesOrder"], as_of=AS_OF)
    assert rows(kept_null.where("OrderID = 11"), "Status") == [(None,)]
    assert out.count() == 13


def test_append_rows_many_partitions_dense_and_ordered(spark, seed):
    new = spark.range(0, 1000).selectExpr("id * 7 % 1000 AS seq", "concat('c', id) AS CustomerName")
    out = changes.append_rows(seed.sales_order, new.repartition(13), "OrderID", ["seq"],
                              defaults=schemas.DEFAULTS["SalesOrder"], as_of=AS_OF)
    added = out.where("OrderID > 10").orderBy("OrderID").collect()
    assert [r.OrderID for r in added] == list(range(11, 1011))
    # keys follow the batch order: seq s gets key 11 + s
    by_name = {r.CustomerName: r.OrderID for r in added}
    assert by_name["c1"] == 11 + 7 and by_name["c0"] == 11


def test_append_rows_high_water(spark, seed):
    new = spark.createDataFrame([(1, "A")], "seq long, CustomerName string")
    out = changes.append_rows(seed.sales_order, new, "OrderID", ["seq"], schemas.DEFAULTS["SalesOrder"],
                              AS_OF, high_water=50)
    assert rows(out.where("CustomerName = 'A'"), "OrderID") == [(51,)]


def test_update_rows_six_columns_and_unmatched(spark, seed):
    ch = spark.createDataFrame(
        [(2, "Wireless Keyboard Pro", 1, 1, D("2700"), 35, None), (99, "Ghost", 1, 1, D("1"), 1, 1)],
        "ProductID long, ProductName string, CategoryID long, SupplierID long, UnitPrice decimal(10,2), "
        "ReorderLevel int, LeadTimeDays int")
    cols = ["ProductName", "CategoryID", "SupplierID", "UnitPrice", "ReorderLevel", "LeadTimeDays"]
    res = changes.update_rows(seed.product, ch, "ProductID", cols)
    assert rows(res.table.where("ProductID = 2")) == [(2, "Wireless Keyboard Pro", 1, 1, D("2700.00"), 35, None)]
    assert res.table.count() == 14
    assert rows(res.rejected, "ProductID") == [(99,)]
    assert rows(res.table.where("ProductID = 3")) == rows(seed.product.where("ProductID = 3"))


def test_update_rows_last_change_wins(spark, seed):
    ch = spark.createDataFrame([(5, 1, 99), (5, 3, 77), (5, 2, 88)], "ProductID long, seq long, ReorderLevel int")
    res = changes.update_rows(seed.product, ch, "ProductID", ["ReorderLevel"], order_by=["seq"])
    assert rows(res.table.where("ProductID = 5"), "ReorderLevel") == [(77,)]


def test_update_stock_absolute_latest_and_no_insert(spark, seed):
    ch = spark.createDataFrame(
        [(1, 2, 5, 30), (1, 2, 9, 3), (1, 2, 7, 40), (9, 2, 1, 10)],
        "ProductID long, WarehouseID long, seq long, QuantityOnHand int")
    res = changes.update_stock(seed.stock, ch, as_of=AS_OF)
    assert rows(res.table.where("ProductID = 1 AND WarehouseID = 2"), "QuantityOnHand", "LastUpdated") == [(3, AS_OF)]
    assert res.table.count() == 24                      # never inserts
    assert rows(res.rejected, "ProductID", "WarehouseID") == [(9, 2)]
    again = changes.update_stock(res.table, ch, as_of=AS_OF).table  # W3 twice = once
    assert sorted(rows(again)) == sorted(rows(res.table))
    # Alerts follow the new quantity: product 1 in North Hub is still at 3 <= 10
    t2 = seed.replace(stock=res.table)
    assert (1, "North Hub") in {(r[0], r[1]) for r in rows(reports.reorder_alerts(t2), "ProductID", "WarehouseName")}


def test_delete_products_cascade(spark, seed):
    ids = spark.createDataFrame([(12,)], "ProductID long")
    t = changes.delete_products(seed, ids)
    assert t.product.count() == 13
    assert t.stock.where("ProductID = 12").count() == 0
    assert t.order_detail.where("ProductID = 12").count() == 0
    assert t.sales_order.count() == 10  # orders stay
    assert quality.check_foreign_key(t.order_detail, "ProductID", t.product, "ProductID").count() == 0


def test_delete_orders_cascade(spark, seed):
    ids = spark.createDataFrame([(1,), (2,)], "OrderID long")
    t = changes.delete_orders(seed, ids)
    assert t.sales_order.count() == 8 and t.order_detail.count() == 18
    assert t.stock.count() == 24  # stock not given back
    assert quality.check_foreign_key(t.order_detail, "OrderID", t.sales_order, "OrderID").count() == 0


def test_validate_orders_and_products(spark):
    orders = spark.createDataFrame([("Ali", "Pending"), ("  \t", "Shipped"), ("Bo", "Lost"), (None, None)],
                                   "CustomerName string, Status string")
    ok, bad = changes.validate(orders, changes.order_rules())
    assert rows(ok) == [("Ali", "Pending")]
    reasons = {r[0]: r[1] for r in rows(bad, "CustomerName", "reasons")}
    assert reasons["  \t"] == ["customer_blank"] and reasons["Bo"] == ["status_unknown"]
    assert reasons[None] == ["customer_blank", "status_unknown"]
    prods = spark.createDataFrame([("P", D("0.5"), 1, None), ("Q", D("5"), 0, 0)],
                                  "ProductName string, UnitPrice decimal(10,2), ReorderLevel int, LeadTimeDays int")
    ok, bad = changes.validate(prods, changes.product_rules())
    assert ok.count() == 0
    assert {r[0]: r[1] for r in rows(bad, "ProductName", "reasons")} == {
        "P": ["price_below_1"], "Q": ["reorder_below_1", "lead_time_below_1"]}


def test_append_ignore_is_idempotent(spark, seed):
    # Re-running the seed load changes nothing.
    again = changes.append_ignore(seed.supplier, seed.supplier, [("SupplierID",), ("ContactEmail",)], ["SupplierID"])
    assert sorted(rows(again.table)) == sorted(rows(seed.supplier))
    assert again.rejected.count() == 5


def test_append_ignore_multi_key_sequential_semantics(spark, seed):
    base = seed.supplier
    new = spark.createDataFrame([
        (1, 10, "A", "a@x"),   # accepted
        (2, 11, "B", "a@x"),   # email collides with seq 1 -> skipped
        (3, 11, "C", "c@x"),   # id 11 was only taken by a skipped row -> accepted
        (4, 12, "D", "c@x"),   # collides with seq 3 -> skipped
        (5, 1, "E", "e@x"),    # id collides with base -> skipped
        (6, 13, "F", "techmart@gmail.com"),  # email collides with base -> skipped
        (7, 14, "G", None),    # NULL key parts never collide
        (8, 15, "H", None),
    ], "seq long, SupplierID long, SupplierName string, ContactEmail string")
    res = changes.append_ignore(base, new, [("SupplierID",), ("ContactEmail",)], ["seq"])
    added = sorted(r[0] for r in rows(res.table.where("SupplierID >= 10"), "SupplierID"))
    assert added == [10, 11, 14, 15]
    assert rows(res.table.where("SupplierID = 11"), "SupplierName") == [("C",)]
    assert sorted(r[0] for r in rows(res.rejected, "seq")) == [2, 4, 5, 6]


def test_append_ignore_single_key_first_wins_and_fk(spark, seed):
    new = spark.createDataFrame([(3, 2, 3, 70), (1, 6, 3, 10), (2, 6, 3, 20), (4, 99, 3, 5)],
                                "seq long, ProductID long, WarehouseID long, QuantityOnHand int")
    new = new.withColumn("StockID", new.seq + 100)
    res = changes.append_ignore(seed.stock, new, [("ProductID", "WarehouseID")], ["seq"],
                                parents=[("ProductID", seed.product, "ProductID")],
                                defaults=schemas.DEFAULTS["InventoryStock"], as_of=AS_OF)
    added = rows(res.table.where("StockID > 100"), "ProductID", "WarehouseID", "QuantityOnHand")
    assert added == [(6, 3, 10)]           # (2,3) exists in base; (6,3) first wins; 99 has no product
    assert rows(res.table.where("StockID > 100"), "LastUpdated") == [(AS_OF,)]
    assert sorted(r[0] for r in rows(res.rejected, "seq")) == [2, 3, 4]


def test_evolve_fills_existing_rows(seed):
    out = changes.evolve(seed.supplier.drop("Rating"), "Rating", "decimal(3,1)", D("5.0"))
    assert {r[0] for r in rows(out, "Rating")} == {D("5.0")}
    assert changes.evolve(seed.supplier, "Rating", "decimal(3,1)", D("5.0")) is seed.supplier


def test_stock_and_order_id_rules_and_fill_defaults(spark):
    stock = spark.createDataFrame([(1, 0), (2, -1)], "ProductID long, QuantityOnHand int")
    ok, bad = changes.validate(stock, changes.stock_rules())
    assert rows(ok, "ProductID") == [(1,)] and rows(bad, "reasons") == [(["quantity_below_0"],)]
    ids = spark.createDataFrame([(0,), (5,)], "OrderID long")
    ok, _ = changes.validate(ids, changes.order_id_rules())
    assert rows(ok) == [(5,)]
    new = spark.createDataFrame([("Ali", None)], "CustomerName string, TotalAmount decimal(12,2)")
    shaped = changes.fill_defaults(new, schemas.SALES_ORDER, schemas.DEFAULTS["SalesOrder"], AS_OF)
    assert rows(shaped) == [(None, "Ali", AS_OF, "Pending", None)]
