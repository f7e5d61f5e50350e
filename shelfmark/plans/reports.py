"""Named reports R3-R19 over the model tables.

Each function returns a lazy DataFrame. Wherever the SQL form joins order
lines to a dimension and then groups, the lines are grouped first by the join
key (partial + final hash aggregation) and grouped again after the join; all
measures are sums and counts, so the result is identical while the join and
its shuffle see one row per key instead of one per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import columns as C
from shelfmark.plans.views import lines_by_product, product_revenue, stock_summary
from shelfmark.sources.tables import Tables

CANCELLED = "Cancelled"


def _sorted(df: DataFrame, sort: bool, *order: Column | str) -> DataFrame:
    """Global sort for presentation; ``sort=False`` skips it for large outputs.

    The first key is the report's order; the others only break its ties. They
    make the order deterministic and let the range partitioner split a value
    that a third of the rows share, instead of sending all of them to one
    sort task.
    """
    return df.orderBy(*order) if sort else df


def stock_overview(t: Tables, sort: bool = True) -> DataFrame:
    """R3 (Q1): total stock per product name / category / supplier with alert.

    Groups by names, not ProductID (T10): same-named products merge.
    """
    per_product = t.stock.groupBy("ProductID").agg(F.sum("QuantityOnHand").alias("_qty"))
    joined = (
        t.product.select("ProductID", "ProductName", "CategoryID", "SupplierID", "ReorderLevel")
        .join(t.category.select("CategoryID", "CategoryName"), "CategoryID")
        .join(t.supplier.select("SupplierID", "SupplierName", F.col("City").alias("SupplierCity")), "SupplierID")
        .join(per_product, "ProductID")
    )
    out = (
        joined.groupBy("ProductName", "CategoryName", "SupplierName", "SupplierCity", "ReorderLevel")
        .agg(C.units_sum("_qty").alias("TotalStock"))
        .select(
            "ProductName", "CategoryName", "SupplierName", "SupplierCity", "TotalStock", "ReorderLevel",
            F.when(F.col("TotalStock") <= F.col("ReorderLevel"), F.lit(schemas.ALERT_REORDER))
            .otherwise(F.lit(schemas.ALERT_OK)).alias("Alert"),
        )
    )
    return _sorted(out, sort, "TotalStock", "ProductName", "CategoryName", "SupplierName", "SupplierCity",
                   "ReorderLevel")


def _category_lines(t: Tables, per_product: DataFrame | None = None) -> DataFrame:
    """Lines folded per product, with the category; ``per_product`` where a caller holds them folded already."""
    return (
        (lines_by_product(t.order_detail) if per_product is None else per_product)
        .join(t.product.select("ProductID", "CategoryID"), "ProductID")
        .join(t.category.select("CategoryID", "CategoryName"), "CategoryID")
    )


def category_revenue(t: Tables, min_revenue: float | int | None = 10000, sort: bool = True,
                     per_product: DataFrame | None = None) -> DataFrame:
    """R4 (Q2): per category: products (the lines are grouped per product, so a plain count), units, revenue, mean sale price.

    ``min_revenue`` is the HAVING threshold (strictly greater); None keeps all.
    """
    out = _category_lines(t, per_product).groupBy("CategoryName").agg(
        F.count("ProductID").alias("TotalProducts"),
        C.units_sum("_units").alias("TotalUnitsSold"),
        C.money_from_cents(F.sum("_revenue_cents")).alias("TotalRevenue"),
        C.mean_from_cents(F.sum("_price_cents"), F.sum("_price_n")).alias("AvgPrice"),
    )
    if min_revenue is not None:
        out = out.where(F.col("TotalRevenue") > F.lit(min_revenue))
    return _sorted(out, sort, F.desc("TotalRevenue"))


def category_revenue_page(t: Tables, min_revenue: float | int | None = 0, sort: bool = True,
                          per_product: DataFrame | None = None) -> DataFrame:
    """The page form of R4: threshold 0 and no mean price."""
    out = _category_lines(t, per_product).groupBy("CategoryName").agg(
        F.count("ProductID").alias("Products"),
        C.units_sum("_units").alias("UnitsSold"),
        C.money_from_cents(F.sum("_revenue_cents")).alias("Revenue"),
    )
    if min_revenue is not None:
        out = out.where(F.col("Revenue") > F.lit(min_revenue))
    return _sorted(out, sort, F.desc("Revenue"))


def below_average_stock(t: Tables, sort: bool = True) -> DataFrame:
    """R6 (Q3): product names whose stock is below the mean per-product stock.

    The mean keeps its fraction (T5) and is an uncorrelated scalar subquery
    over the per-product totals, which the main aggregate reuses.
    """
    per_product = t.stock.groupBy("ProductID").agg(F.sum("QuantityOnHand").alias("_qty"))
    mean_total = per_product.select(F.avg("_qty")).scalar()
    out = (
        per_product.join(t.product.select("ProductID", "ProductName", "ReorderLevel"), "ProductID")
        .groupBy("ProductName", "ReorderLevel")
        .agg(C.units_sum("_qty").alias("TotalStock"))
        .where(F.col("TotalStock") < mean_total)
        .select("ProductName", "TotalStock", "ReorderLevel")
    )
    return _sorted(out, sort, "TotalStock", "ProductName", "ReorderLevel")


def _open_order_lines_by_month(t: Tables) -> DataFrame:
    """Non-cancelled orders with their lines grouped per order first."""
    per_order = t.order_detail.groupBy("OrderID").agg(
        F.sum("Quantity").alias("_units"),
        C.line_cents_sum().alias("_revenue_cents"),
    )
    orders = t.sales_order.where(F.col("Status") != CANCELLED).select(
        "OrderID", C.month_start("OrderDate").alias("_month"))
    return orders.join(per_order, "OrderID")


def monthly_demand(t: Tables, sort: bool = True) -> DataFrame:
    """R7 (Q4): per month of non-cancelled orders: orders, units, revenue, mean order value.

    Lines are grouped per order before the join, so each joined row is one
    order (OrderID is the SalesOrder key, checked by ``check_unique``) and the
    distinct order count is a plain count: no second aggregation level.
    """
    monthly = _open_order_lines_by_month(t).groupBy("_month").agg(
        F.count("OrderID").alias("TotalOrders"),
        C.units_sum("_units").alias("TotalUnitsSold"),
        C.money_from_cents(F.sum("_revenue_cents")).alias("TotalRevenue"),
    )
    return demand_of(monthly, sort)


def demand_of(monthly: DataFrame, sort: bool = True) -> DataFrame:
    """R7 from its sums per ``_month``: ``TotalOrders, TotalUnitsSold, TotalRevenue``."""
    out = monthly.select(
        C.year_month("_month").alias("MonthYear"),
        "TotalOrders", "TotalUnitsSold", "TotalRevenue",
        C.half_up_div(F.col("TotalRevenue"), F.col("TotalOrders")).alias("AvgOrderValue"),
    )
    return _sorted(out, sort, "MonthYear")


def monthly_sales(t: Tables, sort: bool = True) -> DataFrame:
    """Revenue per month of non-cancelled orders."""
    out = (
        _open_order_lines_by_month(t).groupBy("_month")
        .agg(C.money_from_cents(F.sum("_revenue_cents")).alias("Revenue"))
        .select(C.year_month("_month").alias("Month"), "Revenue")
    )
    return _sorted(out, sort, "Month")


def _product_dims(t: Tables) -> DataFrame:
    return (
        t.product.join(t.category.select("CategoryID", "CategoryName"), "CategoryID")
        .join(t.supplier.select("SupplierID", "SupplierName"), "SupplierID")
    )


def _search_filter(term: str | None, min_price, max_price, escape: bool) -> Column:
    cond = F.lit(True)
    if term is not None:
        cond = cond & F.col("ProductName").ilike(C.contains_pattern(term, escape))
    if min_price is not None:
        cond = cond & (F.col("UnitPrice") >= F.lit(min_price))
    if max_price is not None:
        cond = cond & (F.col("UnitPrice") <= F.lit(max_price))
    return cond


def product_search(t: Tables, term: str = "", min_price=None, max_price=None,
                   escape: bool = False, sort: bool = True) -> DataFrame:
    """R8 (Q5): case-insensitive name match (T1) and an inclusive price range; a bound left out is none."""
    out = _product_dims(t).where(_search_filter(term, min_price, max_price, escape)).select(
        "ProductName", "CategoryName", "UnitPrice", "SupplierName")
    return _sorted(out, sort, "UnitPrice", "ProductName", "SupplierName")


def product_catalogue(t: Tables, term: str = "", min_price=None, max_price=None,
                      escape: bool = False, sort: bool = True) -> DataFrame:
    """The catalogue page; bounds are optional (no hidden price cap, T15)."""
    out = _product_dims(t).where(_search_filter(term, min_price, max_price, escape)).select(
        "ProductID", "ProductName", "CategoryName", "SupplierName", "UnitPrice", "ReorderLevel", "LeadTimeDays")
    return _sorted(out, sort, "ProductName", "ProductID")


def supplier_cities(t: Tables, sort: bool = True) -> DataFrame:
    """R10 (Q6): distinct supplier cities."""
    return _sorted(t.supplier.select("City").distinct(), sort, "City")


def top_products(t: Tables, n: int = 5) -> DataFrame:
    """R11 (Q7): the n products with most units sold; ties broken by ProductID."""
    return (
        product_revenue(t)
        .orderBy(F.desc("TotalUnitsSold"), F.asc("ProductID"))
        .limit(n)
        .select("ProductName", "CategoryName", "TotalUnitsSold", "TotalRevenue")
    )


def reorder_alerts(t: Tables, sort: bool = True) -> DataFrame:
    """R12 (Q8): stock rows at or below their reorder level."""
    out = stock_summary(t).where(F.col("StockStatus") == schemas.STOCK_REORDER)
    return _sorted(out, sort, "QuantityOnHand", "ProductID", "WarehouseName")


def kpis(t: Tables) -> DataFrame:
    """One row of headline figures, computed in one job.

    Revenue is the base aggregate; the three counts are uncorrelated scalar
    subqueries (each a one-row aggregate), so nothing is cross joined.
    """
    alerts = reorder_alerts(t, sort=False)
    return t.order_detail.agg(
        F.coalesce(C.money_from_cents(C.line_cents_sum()), F.lit(0).cast(C.MONEY_SUM)).alias("TotalRevenue")
    ).select(
        t.product.select(F.count(F.lit(1))).scalar().alias("TotalProducts"),
        t.sales_order.select(F.count(F.lit(1))).scalar().alias("TotalOrders"),
        "TotalRevenue",
        alerts.select(F.count(F.lit(1))).scalar().alias("ReorderAlerts"),
    )


def kpi_display(t: Tables, currency: str = "PKR") -> DataFrame:
    """R13 as display text: counts and revenue with thousands separators."""
    k = kpis(t)
    return k.select(
        C.thousands("TotalProducts").alias("TotalProducts"),
        C.thousands("TotalOrders").alias("TotalOrders"),
        F.concat(F.lit(currency + " "), C.thousands("TotalRevenue")).alias("TotalRevenue"),
        C.thousands("ReorderAlerts").alias("ReorderAlerts"),
    )


def catalogue_count(t: Tables, term: str = "", min_price=None, max_price=None, escape: bool = False) -> DataFrame:
    """The "N products found" figure of the catalogue page, as a one-row DataFrame."""
    found = product_catalogue(t, term, min_price, max_price, escape, sort=False)
    return found.agg(F.count(F.lit(1)).alias("ProductsFound"))


def revenue_by_category(t: Tables, per_product: DataFrame | None = None) -> DataFrame:
    """Revenue per category, all categories with sales."""
    return _category_lines(t, per_product).groupBy("CategoryName").agg(
        C.money_from_cents(F.sum("_revenue_cents")).alias("Revenue"))


def order_list(t: Tables, sort: bool = True) -> DataFrame:
    """Orders with their line count and value, newest first.

    Orders without lines are absent (inner join), as in the page.
    """
    per_order = t.order_detail.groupBy("OrderID").agg(
        F.count(F.lit(1)).alias("_items"),
        C.line_cents_sum().alias("_value_cents"),
    )
    out = (
        t.sales_order.select("OrderID", "CustomerName", "OrderDate", "Status")
        .join(per_order, "OrderID")
        .groupBy("OrderID", "CustomerName", "OrderDate", "Status")
        .agg(F.sum("_items").cast("bigint").alias("Items"),
             C.money_from_cents(F.sum("_value_cents")).alias("OrderValue"))
    )
    return _sorted(out, sort, F.desc("OrderDate"), F.asc("OrderID"))


def _orders_filter(order_detail: DataFrame, orders: int | DataFrame) -> DataFrame:
    """Lines of one order id, or of every id in a DataFrame with an OrderID column."""
    if isinstance(orders, DataFrame):
        # A plain key projection on the right keeps the join AQE-splittable on
        # the line side; repeated ids there do not change a semi join.
        return order_detail.join(orders.select("OrderID"), "OrderID", "left_semi")
    return order_detail.where(F.col("OrderID") == F.lit(int(orders)))


def order_lines(t: Tables, orders: int | DataFrame) -> DataFrame:
    """Lines of the given order(s) with product name and line total."""
    lines = _orders_filter(t.order_detail, orders)
    return lines.join(t.product.select("ProductID", "ProductName"), "ProductID").select(
        "OrderID", "ProductName", "Quantity", "SalePrice", C.line_total().alias("LineTotal"))


def order_total(t: Tables, orders: int | DataFrame) -> DataFrame:
    """Sum of the line totals of R17 per order; no row for an order without lines."""
    lines = _orders_filter(t.order_detail, orders)
    return (
        lines.join(t.product.select("ProductID"), "ProductID")
        .groupBy("OrderID")
        .agg(C.money_from_cents(C.line_cents_sum()).alias("OrderTotal"))
    )


def alert_stock_by_warehouse(t: Tables) -> DataFrame:
    """Quantity per alerted product split by warehouse (data of the alert chart)."""
    return reorder_alerts(t, sort=False).select("ProductName", "WarehouseName", "QuantityOnHand")

