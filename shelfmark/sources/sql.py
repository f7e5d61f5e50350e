"""SQL access for Spark SQL users.

``register_views`` exposes the model tables and the two report views as
temporary views; ``query`` runs SQL with bound named parameters (values are
never spliced into the text). ``register_functions`` adds the reports that
take parameters as table functions, e.g. ``SELECT * FROM product_search('%a%',
500, 5000) WHERE ...``; their bodies are inlined, so a filter on the call
reaches the scans.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import reports, views
from shelfmark.sources.tables import Tables


def register_views(spark: SparkSession, t: Tables, prefix: str = "") -> list[str]:
    """Create temp views of the seven tables and the two report views."""
    names = []
    for name, df in t.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    for name, df in (("vw_StockSummary", views.stock_summary(t)), ("vw_ProductRevenue", views.product_revenue(t))):
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def query(spark: SparkSession, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run SQL with named parameter markers (``:name``) bound from ``args``."""
    return spark.sql(sql, args=args or None)


def register_report_views(spark: SparkSession, t: Tables, prefix: str = "") -> list[str]:
    """Temp views of every report that takes no parameter, under its report name.

    Each view is the report's lazy plan, so ``SELECT ... FROM monthly_demand
    WHERE ...`` is optimised together with the report (filters reach the scans).
    """
    frames = {
        "stock_summary": views.stock_summary(t),
        "product_revenue": views.product_revenue(t),
        "stock_overview": reports.stock_overview(t, sort=False),
        "category_revenue": reports.category_revenue(t, sort=False),
        "category_revenue_all": reports.category_revenue_page(t, sort=False),
        "below_average_stock": reports.below_average_stock(t, sort=False),
        "monthly_demand": reports.monthly_demand(t, sort=False),
        "supplier_cities": reports.supplier_cities(t, sort=False),
        "top_products": reports.top_products(t),
        "reorder_alerts": reports.reorder_alerts(t, sort=False),
        "kpis": reports.kpis(t),
        "revenue_by_category": reports.revenue_by_category(t),
        "monthly_sales": reports.monthly_sales(t, sort=False),
        "order_list": reports.order_list(t, sort=False),
        "alert_stock_by_warehouse": reports.alert_stock_by_warehouse(t),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in frames]


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Temporary table functions for the reports with parameters (R4, R8, R9, R11, R17), over the views of ``register_views``.

    A NULL bound is no bound. ``order_lines`` takes one order id; joined
    LATERAL to a table of ids it is a plain join.
    """
    p = prefix
    within = "ProductName ILIKE coalesce(pat, '%') AND (lo IS NULL OR UnitPrice >= lo) AND (hi IS NULL OR UnitPrice <= hi)"
    sourced = f"{p}Product JOIN {p}Category USING (CategoryID) JOIN {p}Supplier USING (SupplierID)"
    bounds = "pat STRING, lo DECIMAL(10,2), hi DECIMAL(10,2)"
    functions = {
        f"product_search({bounds})":
            f"SELECT ProductName, CategoryName, UnitPrice, SupplierName FROM {sourced} WHERE {within}",
        f"product_catalogue({bounds})":
            f"SELECT ProductID, ProductName, CategoryName, SupplierName, UnitPrice, ReorderLevel, LeadTimeDays FROM {sourced} WHERE {within}",
        "category_revenue(least DECIMAL(38,2))": f"""
            SELECT CategoryName, count(*) AS TotalProducts, CAST(sum(units) AS BIGINT) AS TotalUnitsSold,
                   CAST(sum(money) AS DECIMAL(38,2)) AS TotalRevenue, CAST(sum(prices) AS DOUBLE) / sum(n_prices) AS AvgPrice
            FROM (SELECT ProductID, sum(Quantity) AS units, CAST(sum(Quantity * SalePrice) AS DECIMAL(38,2)) AS money,
                         CAST(sum(SalePrice) AS DECIMAL(38,2)) AS prices, count(SalePrice) AS n_prices FROM {p}OrderDetail GROUP BY ProductID)
                 JOIN {p}Product USING (ProductID) JOIN {p}Category USING (CategoryID)
            GROUP BY CategoryName HAVING TotalRevenue > least""",
        "top_products(n INT)": f"""
            SELECT ProductName, CategoryName, TotalUnitsSold, TotalRevenue
            FROM (SELECT *, row_number() OVER (ORDER BY TotalUnitsSold DESC, ProductID) AS place FROM {p}vw_ProductRevenue) WHERE place <= n""",
        "order_lines(id BIGINT)": f"""
            SELECT ProductName, Quantity, SalePrice, CAST(Quantity * SalePrice AS DECIMAL(21,2)) AS LineTotal
            FROM {p}OrderDetail d JOIN {p}Product USING (ProductID) WHERE d.OrderID = id""",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {p}{head} RETURNS TABLE RETURN {body}")
    return [p + head.split("(")[0] for head in functions]
