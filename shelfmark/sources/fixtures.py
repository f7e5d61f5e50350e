"""Derive the seven model tables from the driver's TPC-H-style tables.

There is no stock or catalogue table in the driver data, so the model is
derived with plain Spark jobs; every derived table grows with its source.

| model          | derived from                                                    |
| -------------- | --------------------------------------------------------------- |
| Category       | distinct ``p_type`` numbered in name order                      |
| Supplier       | ``supplier`` joined to ``nation`` (City = nation name)           |
| Product        | ``part`` + its Category; supplier chosen by a rule on the key   |
| Warehouse      | ``region``                                                      |
| InventoryStock | returned line quantities summed per (part, supplier region)     |
| SalesOrder     | ``orders`` left-joined to ``customer``; status from flags       |
| OrderDetail    | ``lineitem`` projected                                          |

ReorderLevel, LeadTimeDays, Capacity, ContactEmail and the stock derivation
are invented for testing and carry no TPC-H meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.sources.tables import Tables

DRIVER_TABLES: tuple[str, ...] = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Declared schemas of the driver tables: scans never infer (no footer-reading job).
DRIVER_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}

# Flags of the status derivation.
PENDING_FLAG = "P"
OPEN_FLAG = "O"
LOW_PRIORITY = "5-LOW"
RETURNED_FLAG = "R"


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class DriverSources(dict):
    """name -> DataFrame, each scan created on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        df = read_driver(self.spark, self.sf_dir, name)
        self[name] = df
        return df


def category(part: DataFrame) -> DataFrame:
    # The global window runs over the distinct type names only; that domain is
    # fixed by the catalogue (a handful of types), not by the number of parts.
    types = part.where(F.col("p_type").isNotNull()).select(F.col("p_type").alias("CategoryName")).distinct()
    return types.select(
        F.row_number().over(Window.orderBy("CategoryName")).cast("bigint").alias("CategoryID"),
        "CategoryName",
        F.lit(None).cast("string").alias("Description"),
    )


def dim_supplier(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("SupplierID"),
        F.col("s_name").alias("SupplierName"),
        F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("ContactEmail"),
        F.lit(None).cast("string").alias("Phone"),
        F.col("n_name").alias("City"),
        F.lit(None).cast("decimal(3,1)").alias("Rating"),
    )


def product(part: DataFrame, category_df: DataFrame, supplier: DataFrame) -> DataFrame:
    # Supplier of a part: spread parts over the supplier key range. Two
    # one-row scalar subqueries over the supplier table; no lineitem scan.
    keys = supplier.select(F.struct(F.min("s_suppkey").alias("lo"), F.count(F.lit(1)).alias("n"))).scalar()
    lo, n = keys.getField("lo"), keys.getField("n")
    return part.join(category_df, part.p_type == category_df.CategoryName).select(
        F.col("p_partkey").alias("ProductID"),
        F.col("p_name").alias("ProductName"),
        F.col("CategoryID"),
        (lo + F.pmod(F.col("p_partkey"), n)).cast("bigint").alias("SupplierID"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("UnitPrice"),
        (F.col("p_size") * 2).cast("int").alias("ReorderLevel"),
        (F.lit(1) + F.pmod(F.col("p_partkey"), F.lit(21))).cast("int").alias("LeadTimeDays"),
    )


def warehouse(region: DataFrame) -> DataFrame:
    return region.select(
        F.col("r_regionkey").cast("bigint").alias("WarehouseID"),
        F.col("r_name").alias("WarehouseName"),
        F.col("r_name").alias("Location"),
        ((F.col("r_regionkey") + 1) * 10000).cast("int").alias("Capacity"),
    )


def inventory_stock(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    supp_region = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "s_suppkey", F.col("n_regionkey").cast("bigint").alias("WarehouseID"))
    returned = lineitem.where(F.col("l_returnflag") == RETURNED_FLAG)
    return (
        returned.join(supp_region, returned.l_suppkey == supp_region.s_suppkey)
        .groupBy(F.col("l_partkey").alias("ProductID"), "WarehouseID")
        .agg(F.sum("l_quantity").cast("int").alias("QuantityOnHand"),
             F.max("l_shipdate").cast("date").alias("LastUpdated"))
    )


def sales_order(orders: DataFrame, customer: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == PENDING_FLAG, "Pending")
        .when(F.col("o_orderstatus") == OPEN_FLAG, "Confirmed")
        .when(F.col("o_orderpriority") == LOW_PRIORITY, "Cancelled")
        .otherwise("Shipped")
    )
    # Left join to one row per customer key: an order stays an order when its
    # customer row is missing, and Catalyst drops the join (and the customer
    # scan) from every plan that does not read CustomerName.
    names = customer.groupBy("c_custkey").agg(F.max("c_name").alias("c_name"))
    return orders.join(names, orders.o_custkey == names.c_custkey, "left").select(
        F.col("o_orderkey").alias("OrderID"),
        F.col("c_name").alias("CustomerName"),
        F.col("o_orderdate").cast("date").alias("OrderDate"),
        status.alias("Status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("TotalAmount"),
    )


def order_detail(lineitem: DataFrame) -> DataFrame:
    # (l_orderkey, l_linenumber) repeats in the driver data, so it cannot
    # serve as DetailID; no report needs DetailID (COUNT(*) is used).
    return lineitem.select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("l_partkey").alias("ProductID"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("SalePrice"),
    )


def driver_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return DriverSources(spark, sf_dir)


def from_driver_tables(spark: SparkSession, sf_dir: str, src: dict[str, DataFrame] | None = None) -> Tables:
    """The model over the driver tables; each table is derived on first use."""
    src = src if src is not None else driver_sources(spark, sf_dir)
    cat: list[DataFrame] = []

    def category_df() -> DataFrame:
        if not cat:
            cat.append(category(src["part"]))
        return cat[0]

    return Tables(
        category=category_df,
        supplier=lambda: dim_supplier(src["supplier"], src["nation"]),
        warehouse=lambda: warehouse(src["region"]),
        product=lambda: product(src["part"], category_df(), src["supplier"]),
        stock=lambda: inventory_stock(src["lineitem"], src["supplier"], src["nation"]),
        sales_order=lambda: sales_order(src["orders"], src["customer"]),
        order_detail=lambda: order_detail(src["lineitem"]),
    )


# DuckDB form of the same derivation, used by the oracle queries. ``supplier``
# is a driver view already, so the model supplier is called ``dim_supplier``.
ORACLE_MODEL_CTES = """
Category AS (
  SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS CategoryID,
         p_type AS CategoryName, CAST(NULL AS VARCHAR) AS Description
  FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL) t
),
dim_supplier AS (
  SELECT s_suppkey AS SupplierID, s_name AS SupplierName,
         'supplier' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS ContactEmail,
         CAST(NULL AS VARCHAR) AS Phone, n_name AS City, CAST(NULL AS DECIMAL(3,1)) AS Rating
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
Product AS (
  SELECT p_partkey AS ProductID, p_name AS ProductName, c.CategoryID,
         CAST((SELECT MIN(s_suppkey) FROM supplier)
              + (p_partkey % (SELECT COUNT(*) FROM supplier)) AS BIGINT) AS SupplierID,
         CAST(p_retailprice AS DECIMAL(10,2)) AS UnitPrice,
         CAST(p_size * 2 AS INTEGER) AS ReorderLevel,
         CAST(1 + p_partkey % 21 AS INTEGER) AS LeadTimeDays
  FROM part JOIN Category c ON p_type = c.CategoryName
),
Warehouse AS (
  SELECT CAST(r_regionkey AS BIGINT) AS WarehouseID, r_name AS WarehouseName,
         r_name AS Location, CAST((r_regionkey + 1) * 10000 AS INTEGER) AS Capacity
  FROM region
),
InventoryStock AS (
  SELECT l_partkey AS ProductID, CAST(n_regionkey AS BIGINT) AS WarehouseID,
         CAST(SUM(l_quantity) AS INTEGER) AS QuantityOnHand,
         CAST(MAX(l_shipdate) AS DATE) AS LastUpdated
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
  WHERE l_returnflag = 'R'
  GROUP BY l_partkey, n_regionkey
),
SalesOrder AS (
  SELECT o_orderkey AS OrderID, c_name AS CustomerName,
         CAST(o_orderdate AS DATE) AS OrderDate,
         CASE WHEN o_orderstatus = 'P' THEN 'Pending'
              WHEN o_orderstatus = 'O' THEN 'Confirmed'
              WHEN o_orderpriority = '5-LOW' THEN 'Cancelled'
              ELSE 'Shipped' END AS Status,
         CAST(o_totalprice AS DECIMAL(12,2)) AS TotalAmount
  FROM orders LEFT JOIN (SELECT c_custkey, MAX(c_name) AS c_name FROM customer GROUP BY c_custkey) cu
       ON o_custkey = cu.c_custkey
),
OrderDetail AS (
  SELECT l_orderkey AS OrderID, l_partkey AS ProductID,
         CAST(l_quantity AS INTEGER) AS Quantity,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS SalePrice
  FROM lineitem
)
"""
