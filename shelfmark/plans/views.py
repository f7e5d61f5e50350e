"""The two views of the model (R1 stock summary, R2 product revenue).

Both are plain views: every call returns a new lazy DataFrame; caching is the
caller's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import columns as C
from shelfmark.sources.tables import Tables


def stock_status(quantity: str = "QuantityOnHand", level: str = "ReorderLevel") -> F.Column:
    """'Reorder Required' when quantity <= reorder level (inclusive, T11)."""
    return F.when(F.col(quantity) <= F.col(level), F.lit(schemas.STOCK_REORDER)).otherwise(F.lit(schemas.STOCK_OK))


def stock_summary(t: Tables) -> DataFrame:
    """One row per stock row with product, category and warehouse names."""
    s, p, c, w = t.stock, t.product, t.category, t.warehouse
    return (
        s.select("ProductID", "WarehouseID", "QuantityOnHand", "LastUpdated")
        .join(p.select("ProductID", "ProductName", "CategoryID", "ReorderLevel"), "ProductID")
        .join(c.select("CategoryID", "CategoryName"), "CategoryID")
        .join(w.select("WarehouseID", "WarehouseName", "Location"), "WarehouseID")
        .select(
            "ProductID", "ProductName", "CategoryName", "WarehouseName", "Location",
            "QuantityOnHand", "ReorderLevel",
            stock_status().alias("StockStatus"),
            "LastUpdated",
        )
    )


def lines_by_product(order_detail: DataFrame) -> DataFrame:
    """Order lines pre-aggregated per product (partial + final hash aggregate).

    Every measure is decomposable, so grouping lines first and the product
    rows afterwards gives exactly the grouped join of the SQL form while the
    join sees one row per product instead of one per line.
    """
    return order_detail.groupBy("ProductID").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.sum("Quantity").alias("_units"),
        C.line_cents_sum().alias("_revenue_cents"),
        F.sum(C.cents("SalePrice")).alias("_price_cents"),
        F.count("SalePrice").alias("_price_n"),
    )


def product_revenue(t: Tables, per_product: DataFrame | None = None) -> DataFrame:
    """R2: per product: order lines, units, revenue and mean sale price.

    ``per_product``: the lines as ``lines_by_product`` folds them, where a
    caller holds them already (``operators.revenue_state``).
    """
    per_product = lines_by_product(t.order_detail) if per_product is None else per_product
    return (
        per_product
        .join(t.product.select("ProductID", "ProductName", "CategoryID"), "ProductID")
        .join(t.category.select("CategoryID", "CategoryName"), "CategoryID")
        .groupBy("ProductID", "ProductName", "CategoryName")
        .agg(
            F.sum("_lines").cast("bigint").alias("TotalOrderLines"),
            C.units_sum("_units").alias("TotalUnitsSold"),
            C.money_from_cents(F.sum("_revenue_cents")).alias("TotalRevenue"),
            C.mean_from_cents(F.sum("_price_cents"), F.sum("_price_n")).alias("AvgSellingPrice"),
        )
    )
