"""Seed rows of the source schema, used as unit-test input."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import SparkSession

from shelfmark import schemas
from shelfmark.sources.tables import Tables

# The seed rows of the source schema (85 rows in 7 tables).
CATEGORY = [
    (1, "Electronics", "Electronic gadgets and components"),
    (2, "Grocery", "Food and daily use items"),
    (3, "Apparel", "Clothing and fashion items"),
    (4, "Furniture", "Home and office furniture"),
    (5, "Pharmaceuticals", "Medicines and health products"),
]
SUPPLIER = [
    (1, "TechMart Pvt Ltd", "techmart@gmail.com", "0300-1234567", "Lahore", D("4.5")),
    (2, "GreenGrocer Co.", "green@grocery.pk", "0301-2345678", "Karachi", D("4.2")),
    (3, "FashionHub", "info@fashionhub.pk", "0302-3456789", "Faisalabad", D("4.8")),
    (4, "Comfort Furniture", "comfort@furniture.pk", "0303-4567890", "Islamabad", D("3.9")),
    (5, "MedSupply Pakistan", "med@supply.pk", "0304-5678901", "Lahore", D("4.6")),
]
WAREHOUSE = [
    (1, "Central Warehouse", "Lahore Industrial Zone", 50000),
    (2, "North Hub", "Islamabad Logistic Park", 30000),
    (3, "South Depot", "Karachi Port Area", 40000),
]
PRODUCT = [
    (1, 'Samsung 4K TV 55"', 1, 1, D("85000"), 10, 14),
    (2, "Wireless Keyboard", 1, 1, D("2500"), 30, 7),
    (3, "USB-C Hub 7-Port", 1, 1, D("1800"), 40, 5),
    (4, "Basmati Rice 25kg", 2, 2, D("3200"), 100, 3),
    (5, "Cooking Oil 5L", 2, 2, D("850"), 150, 3),
    (6, "Mineral Water 1L x24", 2, 2, D("480"), 200, 2),
    (7, "Men Shalwar Kameez", 3, 3, D("1200"), 60, 7),
    (8, "Women Kurti", 3, 3, D("950"), 80, 7),
    (9, "Kids School Uniform", 3, 3, D("700"), 50, 5),
    (10, "Office Chair Executive", 4, 4, D("12000"), 15, 21),
    (11, "Study Table 4ft", 4, 4, D("8500"), 10, 21),
    (12, "Panadol CF 10s", 5, 5, D("120"), 300, 3),
    (13, "ORS Sachets x10", 5, 5, D("85"), 250, 3),
    (14, "Vitamin C 500mg x30", 5, 5, D("350"), 200, 5),
]
STOCK_DATE = dt.date(2025, 4, 1)
INVENTORY_STOCK = [
    (1, 1, 1, 25), (2, 2, 1, 120), (3, 3, 1, 200), (4, 4, 1, 500), (5, 5, 1, 600), (6, 6, 1, 800),
    (7, 7, 1, 300), (8, 8, 1, 250), (9, 9, 1, 180), (10, 10, 1, 20), (11, 11, 1, 15), (12, 12, 1, 1200),
    (13, 13, 1, 900), (14, 14, 1, 700),
    (15, 1, 2, 8), (16, 4, 2, 300), (17, 7, 2, 150), (18, 10, 2, 12), (19, 12, 2, 600),
    (20, 2, 3, 80), (21, 5, 3, 400), (22, 8, 3, 200), (23, 11, 3, 8), (24, 13, 3, 500),
]
SALES_ORDER = [
    (1, "Ahmed Traders", "2025-01-10", "Shipped", D("96800")),
    (2, "Bilal Enterprises", "2025-01-18", "Shipped", D("18500")),
    (3, "Chaudhry Store", "2025-02-05", "Shipped", D("42000")),
    (4, "Dawood Retail", "2025-02-20", "Confirmed", D("12750")),
    (5, "Ehsan Medical", "2025-03-01", "Shipped", D("8400")),
    (6, "Farhan Grocers", "2025-03-15", "Shipped", D("25600")),
    (7, "Gulzar Fashion", "2025-03-22", "Pending", D("14250")),
    (8, "Hamid Electronics", "2025-04-02", "Confirmed", D("17300")),
    (9, "Imran Office Needs", "2025-04-10", "Shipped", D("20500")),
    (10, "Javed General Store", "2025-04-18", "Pending", D("5400")),
]
ORDER_DETAIL = [
    (1, 1, 1, 85000), (1, 2, 3, 2500), (1, 3, 2, 1800),
    (2, 7, 5, 1200), (2, 8, 8, 950), (2, 9, 5, 700),
    (3, 4, 10, 3200), (3, 5, 12, 850),
    (4, 12, 50, 120), (4, 13, 30, 85), (4, 14, 15, 350),
    (5, 12, 40, 120), (5, 13, 50, 85),
    (6, 4, 5, 3200), (6, 5, 10, 850), (6, 6, 20, 480),
    (7, 7, 8, 1200), (7, 8, 5, 950),
    (8, 2, 4, 2500), (8, 3, 6, 1800),
    (9, 10, 1, 12000), (9, 11, 1, 8500),
    (10, 12, 20, 120), (10, 14, 10, 350),
]


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def seed_rows() -> dict[str, list[tuple]]:
    return {
        "Category": CATEGORY,
        "Supplier": SUPPLIER,
        "Warehouse": WAREHOUSE,
        "Product": PRODUCT,
        "InventoryStock": [(sid, p, w, q, STOCK_DATE) for sid, p, w, q in INVENTORY_STOCK],
        "SalesOrder": [(o, c, _d(d), s, a) for o, c, d, s, a in SALES_ORDER],
        "OrderDetail": [(i + 1, o, p, q, D(price)) for i, (o, p, q, price) in enumerate(ORDER_DETAIL)],
    }


def make_tables(spark: SparkSession, rows: dict[str, list[tuple]] | None = None) -> Tables:
    rows = rows or seed_rows()
    frames = {name: spark.createDataFrame(rows[name], schemas.SCHEMAS[name]) for name in schemas.SCHEMAS}
    return Tables(
        category=frames["Category"], supplier=frames["Supplier"], warehouse=frames["Warehouse"],
        product=frames["Product"], stock=frames["InventoryStock"], sales_order=frames["SalesOrder"],
        order_detail=frames["OrderDetail"],
    )
