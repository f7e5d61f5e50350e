"""Declared schemas of the seven model tables, their defaults and constraints.

Spark tables reject identity columns and PK / UNIQUE / CHECK constraints, so the
constraints are kept here as data and enforced by the checks in
``shelfmark.operators.quality`` and the change operators.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import types as T

CATEGORY = T.StructType([
    T.StructField("CategoryID", T.LongType(), False),
    T.StructField("CategoryName", T.StringType(), False),
    T.StructField("Description", T.StringType(), True),
])

SUPPLIER = T.StructType([
    T.StructField("SupplierID", T.LongType(), False),
    T.StructField("SupplierName", T.StringType(), False),
    T.StructField("ContactEmail", T.StringType(), False),
    T.StructField("Phone", T.StringType(), True),
    T.StructField("City", T.StringType(), True),
    T.StructField("Rating", T.DecimalType(3, 1), True),
])

WAREHOUSE = T.StructType([
    T.StructField("WarehouseID", T.LongType(), False),
    T.StructField("WarehouseName", T.StringType(), False),
    T.StructField("Location", T.StringType(), False),
    T.StructField("Capacity", T.IntegerType(), False),
])

PRODUCT = T.StructType([
    T.StructField("ProductID", T.LongType(), False),
    T.StructField("ProductName", T.StringType(), False),
    T.StructField("CategoryID", T.LongType(), False),
    T.StructField("SupplierID", T.LongType(), False),
    T.StructField("UnitPrice", T.DecimalType(10, 2), False),
    T.StructField("ReorderLevel", T.IntegerType(), False),
    T.StructField("LeadTimeDays", T.IntegerType(), True),
])

INVENTORY_STOCK = T.StructType([
    T.StructField("StockID", T.LongType(), False),
    T.StructField("ProductID", T.LongType(), False),
    T.StructField("WarehouseID", T.LongType(), False),
    T.StructField("QuantityOnHand", T.IntegerType(), False),
    T.StructField("LastUpdated", T.DateType(), False),
])

SALES_ORDER = T.StructType([
    T.StructField("OrderID", T.LongType(), False),
    T.StructField("CustomerName", T.StringType(), False),
    T.StructField("OrderDate", T.DateType(), False),
    T.StructField("Status", T.StringType(), False),
    T.StructField("TotalAmount", T.DecimalType(12, 2), True),
])

ORDER_DETAIL = T.StructType([
    T.StructField("DetailID", T.LongType(), False),
    T.StructField("OrderID", T.LongType(), False),
    T.StructField("ProductID", T.LongType(), False),
    T.StructField("Quantity", T.IntegerType(), False),
    T.StructField("SalePrice", T.DecimalType(10, 2), False),
])

SCHEMAS: dict[str, T.StructType] = {
    "Category": CATEGORY,
    "Supplier": SUPPLIER,
    "Warehouse": WAREHOUSE,
    "Product": PRODUCT,
    "InventoryStock": INVENTORY_STOCK,
    "SalesOrder": SALES_ORDER,
    "OrderDetail": ORDER_DETAIL,
}

# Surrogate key of each table (identity column in the source schema).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "Category": ("CategoryID",),
    "Supplier": ("SupplierID",),
    "Warehouse": ("WarehouseID",),
    "Product": ("ProductID",),
    "InventoryStock": ("StockID",),
    "SalesOrder": ("OrderID",),
    "OrderDetail": ("DetailID",),
}

# Declared UNIQUE keys besides the primary keys.
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "Category": (("CategoryName",),),
    "Supplier": (("ContactEmail",),),
    "Warehouse": (("WarehouseName",),),
    "InventoryStock": (("ProductID", "WarehouseID"),),
}

# Declared foreign keys as (child table, column, parent table, parent column).
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("Product", "CategoryID", "Category", "CategoryID"),
    ("Product", "SupplierID", "Supplier", "SupplierID"),
    ("InventoryStock", "ProductID", "Product", "ProductID"),
    ("InventoryStock", "WarehouseID", "Warehouse", "WarehouseID"),
    ("OrderDetail", "OrderID", "SalesOrder", "OrderID"),
    ("OrderDetail", "ProductID", "Product", "ProductID"),
)

# The CHECK constraint on order status.
ORDER_STATUSES: tuple[str, ...] = ("Pending", "Confirmed", "Shipped", "Cancelled")

# Stock status and alert labels used by the reports.
STOCK_REORDER = "Reorder Required"
STOCK_OK = "Sufficient"
ALERT_REORDER = "REORDER NOW"
ALERT_OK = "OK"

TODAY = "today"  # marker: default is the caller's ``as_of`` date

# Column defaults of the source schema.
DEFAULTS: dict[str, dict[str, object]] = {
    "Supplier": {"Rating": Decimal("5.0")},
    "Product": {"ReorderLevel": 50, "LeadTimeDays": 7},
    "InventoryStock": {"QuantityOnHand": 0, "LastUpdated": TODAY},
    "SalesOrder": {"Status": "Pending", "OrderDate": TODAY},
}

# VARCHAR limits of the source schema.
MAX_LENGTHS: dict[str, dict[str, int]] = {
    "Category": {"CategoryName": 100, "Description": 255},
    "Supplier": {"SupplierName": 100, "ContactEmail": 100, "Phone": 20, "City": 50},
    "Warehouse": {"WarehouseName": 100, "Location": 100},
    "Product": {"ProductName": 150},
    "SalesOrder": {"CustomerName": 100, "Status": 20},
}

# DECIMAL(p, s) limits of the source schema.
DECIMAL_LIMITS: dict[str, dict[str, tuple[int, int]]] = {
    "Supplier": {"Rating": (3, 1)},
    "Product": {"UnitPrice": (10, 2)},
    "SalesOrder": {"TotalAmount": (12, 2)},
    "OrderDetail": {"SalePrice": (10, 2)},
}

NOT_NULL: dict[str, tuple[str, ...]] = {
    name: tuple(f.name for f in schema.fields if not f.nullable)
    for name, schema in SCHEMAS.items()
}


def resolve_default(value: object, as_of: _dt.date | str | None) -> object:
    """Turn the ``today`` marker into the caller's date (never the wall clock)."""
    if value is TODAY or value == TODAY:
        if as_of is None:
            raise ValueError("a default of 'today' needs an explicit as_of date")
        return _dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return value
