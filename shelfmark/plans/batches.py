"""Change batches derived from the driver tables for the registered change queries.

The source applies changes typed into a form; the registered queries need
batches whose size grows with the data, so each batch here is computed from
the driver tables by a Spark job:

* new orders: one Pending order per customer (W1, W6);
* reorder levels: each product's mean line quantity, rounded up (W2);
* stock counts: per day, the quantity on accepted-flag lines per
  (part, supplier region) - a daily count feed for W3 / ST1;
* stock rows to load: per flag, quantities per (part, supplier region) (W7);
* customers as suppliers: two unique keys colliding (W7, several keys);
* discontinued products: no warehouse holds more than the reorder level (W4);
* cancelled orders (W5);
* chained stock keys: customers whose two keys collide in long chains (W7);
* raw feeds: driver columns as text, some of which cannot fit (C5);
* order and stock forms with acceptable and unacceptable rows (W6, F14);
* reordered lines: returned lines bought again under new orders (W1 on the
  revenue state).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.tables import Tables

# Dates and flags of the derived batches.
AS_OF = _dt.date(2002, 1, 1)
ACCEPTED_FLAG = "A"
LOAD_FLAGS = ("A", "N")
EPOCH = "1970-01-01"

# Market segment -> order status of the new-order batch; other
# segments pass through unchanged and are rejected by the status rule.
SEGMENT_STATUS = {"BUILDING": "Pending", "AUTOMOBILE": "Shipped", "MACHINERY": "Confirmed"}


def _supplier_region(src: dict[str, DataFrame]) -> DataFrame:
    s, n = src["supplier"], src["nation"]
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", F.col("n_regionkey").cast("bigint").alias("WarehouseID"))


def new_orders(src: dict[str, DataFrame]) -> DataFrame:
    """One new order per customer, in customer key order; date/status omitted."""
    return src["customer"].select("c_custkey", F.col("c_name").alias("CustomerName"))


def new_orders_with_status(src: dict[str, DataFrame]) -> DataFrame:
    """New orders whose status comes from the market segment (some invalid)."""
    seg = F.col("c_mktsegment")
    status = seg
    for segment, value in reversed(list(SEGMENT_STATUS.items())):
        status = F.when(seg == segment, F.lit(value)).otherwise(status)
    return src["customer"].select("c_custkey", F.col("c_name").alias("CustomerName"), status.alias("Status"))


def customers_as_suppliers(src: dict[str, DataFrame]) -> DataFrame:
    """Customers loaded as suppliers, in key order.

    Two unique keys collide: the customer key against existing supplier ids,
    and one contact address per market segment within the batch.
    """
    return src["customer"].select(
        F.col("c_custkey").alias("seq"),
        F.col("c_custkey").alias("SupplierID"),
        F.col("c_name").alias("SupplierName"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("ContactEmail"),
    )


def new_products(src: dict[str, DataFrame]) -> DataFrame:
    """One product for every customer account, in key order.

    The balance is the price (often below 1) and one segment has a blank name.
    ReorderLevel and LeadTimeDays are left to the defaults.
    """
    first = src["supplier"].agg(F.min("s_suppkey").cast("bigint").alias("SupplierID")).scalar()
    return src["customer"].select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(" ")).otherwise(F.col("c_name")).alias("ProductName"),
        F.lit(1).cast("bigint").alias("CategoryID"),
        first.alias("SupplierID"),
        F.col("c_acctbal").cast("decimal(10,2)").alias("UnitPrice"),
    )


def product_edits(src: dict[str, DataFrame], t: Tables) -> DataFrame:
    """All six editable columns of every product that was sold."""
    sold = t.order_detail.groupBy("ProductID").agg(
        F.max("SalePrice").alias("UnitPrice"), F.max("Quantity").alias("ReorderLevel"),
        F.min("Quantity").alias("LeadTimeDays"))
    first = src["supplier"].agg(F.min("s_suppkey").cast("bigint")).scalar()
    names = t.product.select("ProductID", F.upper("ProductName").alias("ProductName"))
    return sold.join(names, "ProductID").select(
        "ProductID", "ProductName", F.lit(1).cast("bigint").alias("CategoryID"), first.alias("SupplierID"),
        "UnitPrice", "ReorderLevel", "LeadTimeDays")


def reorder_levels(t: Tables) -> DataFrame:
    return t.order_detail.groupBy("ProductID").agg(F.ceil(F.avg("Quantity")).cast("int").alias("ReorderLevel"))


def stock_counts(src: dict[str, DataFrame]) -> DataFrame:
    """(ProductID, WarehouseID, seq, QuantityOnHand, as_of): one count per pair and day."""
    li = src["lineitem"].where(F.col("l_returnflag") == ACCEPTED_FLAG)
    sr = _supplier_region(src)
    return (
        li.join(sr, li.l_suppkey == sr.s_suppkey)
        .groupBy(F.col("l_partkey").alias("ProductID"), "WarehouseID",
                 F.col("l_shipdate").cast("date").alias("as_of"))
        .agg(F.sum("l_quantity").cast("int").alias("QuantityOnHand"))
        .select("ProductID", "WarehouseID",
                F.datediff("as_of", F.lit(EPOCH).cast("date")).cast("bigint").alias("seq"),
                "QuantityOnHand", "as_of")
    )


def stock_rows_to_load(src: dict[str, DataFrame]) -> DataFrame:
    """Stock rows per (part, region, flag); a pair may appear under both flags."""
    li = src["lineitem"].where(F.col("l_returnflag").isin(*LOAD_FLAGS))
    sr = _supplier_region(src)
    return (
        li.join(sr, li.l_suppkey == sr.s_suppkey)
        .groupBy(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("ProductID"), "WarehouseID")
        .agg(F.sum("l_quantity").cast("int").alias("QuantityOnHand"),
             F.max("l_shipdate").cast("date").alias("LastUpdated"))
    )


def discontinued_products(t: Tables) -> DataFrame:
    """Products with no warehouse holding more than the reorder level."""
    from shelfmark.plans.views import stock_summary
    from shelfmark import schemas
    sufficient = F.max(F.col("StockStatus") == schemas.STOCK_OK)
    return (stock_summary(t).groupBy("ProductID").agg(sufficient.alias("_any_ok"))
            .where(~F.col("_any_ok")).select("ProductID"))


def cancelled_orders(t: Tables) -> DataFrame:
    return t.sales_order.where(F.col("Status") == "Cancelled").select("OrderID")


def reorder_alert_products(t: Tables) -> DataFrame:
    from shelfmark.plans.reports import reorder_alerts
    return reorder_alerts(t, sort=False).select("ProductID")


def product_names_to_resolve(src: dict[str, DataFrame]) -> DataFrame:
    return src["part"].select(F.col("p_partkey").alias("source_key"), F.col("p_name").alias("ProductName"))



# Rows of a collision chain, and the first key of the chains' range.
CHAIN, CHAIN_BASE = 1000, 1_000_000_000


def chained_suppliers(src: dict[str, DataFrame]) -> DataFrame:
    """Customers as suppliers whose keys collide in chains: a row shares one key with the row before and the other with the row after."""
    n = F.col("c_custkey")
    place, chain = n % CHAIN, F.floor(n / CHAIN)
    address = F.concat(F.lit("chain"), chain.cast("string"), F.lit("-"), F.floor((place + 1) / 2).cast("string"), F.lit("@example.com"))
    return src["customer"].select(
        n.alias("seq"), (F.lit(CHAIN_BASE) + chain * CHAIN + F.floor(place / 2)).cast("bigint").alias("SupplierID"),
        F.col("c_name").alias("SupplierName"), address.alias("ContactEmail"))


def _planted(key: str, every: int, value: Column, otherwise: Column) -> Column:
    return F.when(F.col(key) % every == 0, value).otherwise(otherwise)


def _text(c: str | Column, kind: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast(kind) if kind else c).cast("string")


def raw_products(src: dict[str, DataFrame]) -> DataFrame:
    """Products as text; every so many rows a value that cannot fit its column."""
    price = _text("p_retailprice", "decimal(10,2)")
    price = _planted("p_partkey", 109, F.concat(price, F.lit("5")), price)
    price = _planted("p_partkey", 113, F.concat(F.lit("123456789"), price), price)
    level = _planted("p_partkey", 131, F.lit("12.5"), _text(F.col("p_size") * 2))
    return src["part"].select(
        _planted("p_partkey", 101, F.concat(F.lit("P-"), _text("p_partkey")), _text("p_partkey")).alias("ProductID"),
        _planted("p_partkey", 103, F.repeat("p_name", F.lit(151)), F.col("p_name")).alias("ProductName"),
        _planted("p_partkey", 107, F.lit(None), F.lit("1")).alias("CategoryID"),
        _text(F.lit(1) + F.col("p_partkey") % 7).alias("SupplierID"),
        _planted("p_partkey", 127, F.lit("n/a"), price).alias("UnitPrice"),
        _planted("p_partkey", 137, F.lit("99999999999"), level).alias("ReorderLevel"),
        _planted("p_partkey", 139, F.lit(" "), _text(F.col("p_partkey") % 21)).alias("LeadTimeDays"))


def raw_suppliers(src: dict[str, DataFrame]) -> DataFrame:
    """Suppliers as text; the account balance stands for the rating, which seldom fits DECIMAL(3,1)."""
    address = F.concat(F.lit("supplier"), _text("s_suppkey"), F.lit("@example.com"))
    return src["supplier"].select(
        _text("s_suppkey").alias("SupplierID"), F.col("s_name").alias("SupplierName"),
        _planted("s_suppkey", 5, F.lit(None), address).alias("ContactEmail"), F.lit(None).cast("string").alias("Phone"),
        _text("s_nationkey").alias("City"), _text("s_acctbal", "decimal(12,2)").alias("Rating"))


def raw_orders(src: dict[str, DataFrame]) -> DataFrame:
    """Orders as text; the driver's flag P is no order status, and some dates are none."""
    day = _text("o_orderdate", "date")
    day = _planted("o_orderkey", 89, F.replace(day, F.lit("-"), F.lit("/")), day)
    status = F.when(F.col("o_orderstatus") == "O", "Pending").when(F.col("o_orderstatus") == "F", "Shipped").otherwise(F.col("o_orderstatus"))
    return src["orders"].select(
        _text("o_orderkey").alias("OrderID"), F.concat(F.lit("Customer "), _text("o_custkey")).alias("CustomerName"),
        _planted("o_orderkey", 97, F.lit("2024-13-01"), day).alias("OrderDate"), status.alias("Status"),
        _text("o_totalprice", "decimal(12,2)").alias("TotalAmount"))


def dated_orders(src: dict[str, DataFrame]) -> DataFrame:
    """New orders as the page's form gives them: customer, date and status, some of them not acceptable."""
    named = new_orders_with_status(src)
    return named.select("c_custkey", _planted("c_custkey", 11, F.lit("  "), F.col("CustomerName")).alias("CustomerName"),
                        F.date_add(F.lit(AS_OF), (F.col("c_custkey") % 28).cast("int")).alias("OrderDate"), "Status")


def stock_corrections(t: Tables) -> DataFrame:
    """Every stock row with what is left after a fixed withdrawal, often less than nothing."""
    return t.stock.select("ProductID", "WarehouseID", (F.col("QuantityOnHand") - 60).cast("int").alias("QuantityOnHand"))


def order_ids_asked(t: Tables) -> DataFrame:
    """Order ids as typed into the lookup form, every seventh below 1."""
    return t.sales_order.select(_planted("OrderID", 7, -F.col("OrderID"), F.col("OrderID")).alias("OrderID"))


def product_forms(t: Tables) -> DataFrame:
    """Products as the edit form gives them back: small levels and lead times, some of them 0."""
    return t.product.select("ProductID", "ProductName", (F.col("UnitPrice") % 10).cast("decimal(10,2)").alias("UnitPrice"),
                            (F.col("ReorderLevel") % 6).cast("int").alias("ReorderLevel"),
                            F.when(F.col("ProductID") % 3 > 0, (F.col("ProductID") % 4).cast("int")).alias("LeadTimeDays"))


def _new_order_offset(src: dict[str, DataFrame]) -> Column:
    return src["orders"].agg((F.max("o_orderkey") + 1).cast("bigint")).scalar()


def reorders(src: dict[str, DataFrame]) -> DataFrame:
    """Orders placed again a year later, under new ids."""
    return src["orders"].select((F.col("o_orderkey") + _new_order_offset(src)).alias("OrderID"), F.lit(None).cast("string").alias("CustomerName"),
                                F.add_months(F.col("o_orderdate").cast("date"), 12).alias("OrderDate"), F.lit("Confirmed").alias("Status"),
                                F.lit(None).cast("decimal(12,2)").alias("TotalAmount"))


def reordered_lines(src: dict[str, DataFrame]) -> DataFrame:
    """The returned lines, bought again under the new ids."""
    from shelfmark.sources.fixtures import RETURNED_FLAG, order_detail

    lines = order_detail(src["lineitem"].where(F.col("l_returnflag") == RETURNED_FLAG))
    return lines.withColumn("OrderID", F.col("OrderID") + _new_order_offset(src))


def pending_orders(t: Tables) -> DataFrame:
    return t.sales_order.where(F.col("Status") == "Pending").select("OrderID")


def order_edits(t: Tables) -> DataFrame:
    """Every pending order confirmed, and dated 40 days later."""
    pending = t.sales_order.where(F.col("Status") == "Pending")
    return pending.select("OrderID", F.lit("Confirmed").alias("Status"), F.date_add("OrderDate", 40).alias("OrderDate"))
