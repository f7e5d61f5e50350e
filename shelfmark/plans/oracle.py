"""DuckDB SQL stating the expected result of each registered query.

Every statement starts from the model derivation over the driver views
(``shelfmark.sources.fixtures.ORACLE_MODEL_CTES``) and from ``FOLDS``, which
folds order lines and stock rows per key before anything is joined. Only the
folds that a statement names are computed. Result types are pinned on both
sides: integer sums BIGINT, money sums DECIMAL(38,2), means DOUBLE from an
exact sum (T3, T4).
"""

from __future__ import annotations

from shelfmark import schemas
from shelfmark.sources.fixtures import ORACLE_MODEL_CTES

FOLDS = f"""
sold AS (
  SELECT ProductID, count(*) AS n_lines, sum(Quantity)::BIGINT AS units,
         sum(Quantity * SalePrice)::DECIMAL(38,2) AS money,
         sum(SalePrice)::DECIMAL(38,2) AS price_sum, count(SalePrice) AS n_prices
  FROM OrderDetail GROUP BY ALL
),
billed AS (
  SELECT OrderID, count(*) AS n_lines, sum(Quantity)::BIGINT AS units,
         sum(Quantity * SalePrice)::DECIMAL(38,2) AS money
  FROM OrderDetail GROUP BY ALL
),
held AS (SELECT ProductID, sum(QuantityOnHand)::BIGINT AS held_units FROM InventoryStock GROUP BY ALL),
goods AS (FROM Product JOIN Category USING (CategoryID)),
sourced AS (FROM goods JOIN dim_supplier USING (SupplierID)),
shelf AS (
  SELECT ProductID, ProductName, CategoryName, WarehouseName, Location, QuantityOnHand, ReorderLevel, LastUpdated,
         if(QuantityOnHand <= ReorderLevel, '{schemas.STOCK_REORDER}', '{schemas.STOCK_OK}') AS StockStatus
  FROM InventoryStock JOIN goods USING (ProductID) JOIN Warehouse USING (WarehouseID)
),
short AS (FROM shelf WHERE StockStatus = '{schemas.STOCK_REORDER}'),
by_category AS (
  SELECT CategoryName, count(*) AS n_products, sum(units)::BIGINT AS units, sum(money)::DECIMAL(38,2) AS money,
         sum(price_sum)::DOUBLE / sum(n_prices)::BIGINT AS mean_price
  FROM sold JOIN goods USING (ProductID) GROUP BY ALL
),
by_month AS (
  SELECT left(OrderDate::VARCHAR, 7) AS month, count(*) AS n_orders,
         sum(units)::BIGINT AS units, sum(money)::DECIMAL(38,2) AS money
  FROM billed JOIN SalesOrder USING (OrderID) WHERE Status <> 'Cancelled' GROUP BY ALL
)"""


def with_model(body: str, extra_ctes: str = "") -> str:
    ctes = [ORACLE_MODEL_CTES.strip(), FOLDS.strip()] + ([extra_ctes.strip()] if extra_ctes else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


# The catalogue rows whose name holds an "a", within the price range of the registered search.
SEARCHED = "contains(lower(ProductName), 'a') AND UnitPrice >= 500 AND UnitPrice <= 5000"
SEARCH = with_model(f"SELECT ProductName, CategoryName, UnitPrice, SupplierName FROM sourced WHERE {SEARCHED}")

#: Bodies of reports that other statements state over other tables, or reach by another way.
REPORT_BODIES: dict[str, str] = {
    "product_revenue": """
SELECT ProductID, ProductName, CategoryName, n_lines AS TotalOrderLines, units AS TotalUnitsSold,
       money AS TotalRevenue, price_sum::DOUBLE / n_prices AS AvgSellingPrice
FROM sold JOIN goods USING (ProductID)""",
    "category_revenue": """
SELECT CategoryName, n_products AS TotalProducts, units AS TotalUnitsSold, money AS TotalRevenue, mean_price AS AvgPrice
FROM by_category WHERE money > 10000""",
    # AvgOrderValue: exact half-up rounding in integer cents (H1).
    "monthly_demand": """
SELECT month AS MonthYear, n_orders AS TotalOrders, units AS TotalUnitsSold, money AS TotalRevenue,
       CAST(CAST((2 * CAST(money * 100 AS HUGEINT) + n_orders) // (2 * n_orders) AS DECIMAL(18,0))
            * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS AvgOrderValue
FROM by_month""",
    "monthly_sales": "SELECT month AS Month, money AS Revenue FROM by_month",
    "top_products": """
SELECT ProductName, CategoryName, units AS TotalUnitsSold, money AS TotalRevenue
FROM sold JOIN goods USING (ProductID)
QUALIFY row_number() OVER (ORDER BY units DESC, ProductID) <= 5""",
    # Set-wise form over every order of the table.
    "order_lines": """
SELECT OrderID, ProductName, Quantity, SalePrice, (Quantity * SalePrice)::DECIMAL(21,2) AS LineTotal
FROM OrderDetail JOIN Product USING (ProductID) SEMI JOIN SalesOrder USING (OrderID)""",
}

REPORTS: dict[str, str] = {
    **{name: with_model(body) for name, body in REPORT_BODIES.items()},
    "stock_summary": with_model("FROM shelf"),
    "stock_page": with_model("FROM shelf"),
    # Products of one name, category, supplier and level share a row.
    "stock_overview": with_model("""
SELECT ProductName, CategoryName, SupplierName, City AS SupplierCity, ReorderLevel,
       sum(held_units)::BIGINT AS TotalStock, if(TotalStock <= ReorderLevel, 'REORDER NOW', 'OK') AS Alert
FROM held JOIN sourced USING (ProductID)
GROUP BY ProductName, CategoryName, SupplierName, City, ReorderLevel"""),
    "category_revenue_all": with_model("""
SELECT CategoryName, n_products AS Products, units AS UnitsSold, money AS Revenue FROM by_category WHERE money > 0"""),
    "below_average_stock": with_model("""
FROM (SELECT ProductName, ReorderLevel, sum(held_units)::BIGINT AS TotalStock
      FROM held JOIN Product USING (ProductID) GROUP BY ALL)
WHERE TotalStock < (SELECT avg(held_units) FROM held)"""),
    "product_search": SEARCH,
    "product_catalogue": with_model("""
SELECT ProductID, ProductName, CategoryName, SupplierName, UnitPrice, ReorderLevel, LeadTimeDays
FROM sourced WHERE ProductName IS NOT NULL"""),
    "supplier_cities": with_model("SELECT City FROM dim_supplier GROUP BY ALL"),
    "reorder_alerts": with_model("FROM short"),
    "kpis": with_model("""
SELECT * FROM (SELECT count(*) AS TotalProducts FROM Product), (SELECT count(*) AS TotalOrders FROM SalesOrder),
     (SELECT coalesce(sum(money), 0)::DECIMAL(38,2) AS TotalRevenue FROM billed),
     (SELECT count(*) AS ReorderAlerts FROM short)"""),
    "revenue_by_category": with_model("SELECT CategoryName, money AS Revenue FROM by_category"),
    "order_list": with_model("""
SELECT OrderID, CustomerName, OrderDate, Status, n_lines AS Items, money AS OrderValue
FROM SalesOrder JOIN billed USING (OrderID)"""),
    "order_total": with_model("""
SELECT OrderID, sum(Quantity * SalePrice)::DECIMAL(38,2) AS OrderTotal
FROM OrderDetail SEMI JOIN Product USING (ProductID) SEMI JOIN SalesOrder USING (OrderID) GROUP BY ALL"""),
    "alert_stock_by_warehouse": with_model("SELECT ProductName, WarehouseName, QuantityOnHand FROM short"),
}


# --- change operators, quality checks, lookups and SQL surface -------------

# Lines of a flag with the region of their supplier (the batches of W3, W7 and ST1).
ROUTED = """
routed AS (
  SELECT l_returnflag AS flag, l_partkey AS ProductID, n_regionkey::BIGINT AS WarehouseID,
         l_shipdate::DATE AS day, l_quantity AS quantity
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
)"""

STOCK_CHANGES = ROUTED + """,
counts AS (
  SELECT ProductID, WarehouseID, day AS as_of, date_diff('day', DATE '1970-01-01', day)::BIGINT AS seq,
         sum(quantity)::INTEGER AS counted
  FROM routed WHERE flag = 'A' GROUP BY ALL
),
newest AS (
  SELECT ProductID, WarehouseID, max(seq) AS seq, max(as_of) AS as_of, arg_max(counted, seq) AS counted
  FROM counts GROUP BY ALL
),
recounted AS (
  SELECT ProductID, WarehouseID, if(seq IS NULL, QuantityOnHand, counted) AS QuantityOnHand,
         if(seq IS NULL, LastUpdated, as_of) AS LastUpdated
  FROM InventoryStock LEFT JOIN newest USING (ProductID, WarehouseID)
)"""

STOCK_LOADS = ROUTED + """,
loads AS (
  SELECT flag, ProductID, WarehouseID, sum(quantity)::INTEGER AS QuantityOnHand, max(day) AS LastUpdated
  FROM routed WHERE flag IN ('A', 'N') GROUP BY ALL
)"""

#: Products without a warehouse that holds more than the reorder level.
DISCONTINUED = f"""
discontinued AS (SELECT ProductID FROM shelf GROUP BY ALL HAVING bool_and(StockStatus <> '{schemas.STOCK_OK}'))"""
CANCELLED = "cancelled AS (SELECT OrderID FROM SalesOrder WHERE Status = 'Cancelled')"

#: One product for every customer account: its balance is the price, its name may be blank.
NEW_PRODUCTS = """
new_products AS (
  SELECT c_custkey AS seq, if(c_mktsegment = 'HOUSEHOLD', ' ', c_name) AS ProductName, 1::BIGINT AS CategoryID,
         s.first_supplier AS SupplierID, c_acctbal::DECIMAL(10,2) AS UnitPrice
  FROM customer, (SELECT min(s_suppkey)::BIGINT AS first_supplier FROM supplier) s
)"""

# Model tables as the oracle names them, with the columns the adapter provides.
ORACLE_TABLE = {
    "Category": "Category", "Supplier": "dim_supplier", "Warehouse": "Warehouse", "Product": "Product",
    "InventoryStock": "InventoryStock", "SalesOrder": "SalesOrder", "OrderDetail": "OrderDetail",
}
FIXTURE_COLUMNS = {
    "Category": ("CategoryID", "CategoryName", "Description"),
    "Supplier": ("SupplierID", "SupplierName", "ContactEmail", "Phone", "City", "Rating"),
    "Warehouse": ("WarehouseID", "WarehouseName", "Location", "Capacity"),
    "Product": ("ProductID", "ProductName", "CategoryID", "SupplierID", "UnitPrice", "ReorderLevel",
                "LeadTimeDays"),
    "InventoryStock": ("ProductID", "WarehouseID", "QuantityOnHand", "LastUpdated"),
    "SalesOrder": ("OrderID", "CustomerName", "OrderDate", "Status", "TotalAmount"),
    "OrderDetail": ("OrderID", "ProductID", "Quantity", "SalePrice"),
}


def _unique_summary_sql() -> str:
    parts = []
    for name in schemas.SCHEMAS:
        for k in (schemas.PRIMARY_KEYS[name], *schemas.UNIQUE_KEYS.get(name, ())):
            if not all(c in FIXTURE_COLUMNS[name] for c in k):
                continue
            cols = ", ".join(k)
            nn = " AND ".join(f"{c} IS NOT NULL" for c in k)
            parts.append(
                f"SELECT '{name}' AS table_name, '{','.join(k)}' AS key_columns, COUNT(*) AS duplicate_keys, "
                f"CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS surplus_rows FROM ("
                f"SELECT {cols}, COUNT(*) AS n FROM {ORACLE_TABLE[name]} WHERE {nn} "
                f"GROUP BY {cols} HAVING COUNT(*) > 1) d")
    return "\nUNION ALL\n".join(parts)


def _foreign_key_summary_sql() -> str:
    parts = []
    for child, col, parent, pcol in schemas.FOREIGN_KEYS:
        parts.append(
            f"SELECT '{child}' AS child_table, '{col}' AS column_name, '{parent}' AS parent_table, "
            f"COUNT(*) AS orphan_rows FROM {ORACLE_TABLE[child]} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {ORACLE_TABLE[parent]} p WHERE p.{pcol} = c.{col})")
    return "\nUNION ALL\n".join(parts)


def _not_null_summary_sql() -> str:
    parts = []
    for name in schemas.SCHEMAS:
        for c in schemas.NOT_NULL[name]:
            if c in FIXTURE_COLUMNS[name]:
                parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
                             f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_rows "
                             f"FROM {ORACLE_TABLE[name]}")
    return "\nUNION ALL\n".join(parts)


def _length_summary_sql() -> str:
    parts = []
    for name, limits in schemas.MAX_LENGTHS.items():
        for c, n in limits.items():
            if c in FIXTURE_COLUMNS[name]:
                parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, {n} AS \"limit\", "
                             f"CAST(COUNT(*) FILTER (WHERE length({c}) > {n}) AS BIGINT) AS too_long, "
                             f"CAST(COALESCE(MAX(length({c})), 0) AS INTEGER) AS max_length "
                             f"FROM {ORACLE_TABLE[name]}")
    return "\nUNION ALL\n".join(parts)


def _decimal_summary_sql() -> str:
    parts = []
    for name, limits in schemas.DECIMAL_LIMITS.items():
        for c, (p, s) in limits.items():
            if c in FIXTURE_COLUMNS[name]:
                fitted = f"TRY_CAST({c} AS DECIMAL({p},{s}))"
                parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
                             f"count(*) FILTER ({c} IS NOT NULL AND coalesce({fitted} <> {c}, true)) AS violations "
                             f"FROM {ORACLE_TABLE[name]}")
    return "\nUNION ALL\n".join(parts)


# --- typed load: the raw feeds as text, and what does not fit ---------------

RAW_PRODUCTS = """
raw_products AS (
  SELECT p_partkey AS k, p_retailprice::DECIMAL(10,2)::VARCHAR AS price,
         if(k % 101 = 0, 'P-' || k, k::VARCHAR) AS ProductID, if(k % 103 = 0, repeat(p_name, 151), p_name) AS ProductName,
         if(k % 107 = 0, NULL, '1') AS CategoryID, (1 + k % 7)::VARCHAR AS SupplierID,
         CASE WHEN k % 127 = 0 THEN 'n/a' ELSE if(k % 113 = 0, '123456789', '') || price || if(k % 109 = 0, '5', '') END AS UnitPrice,
         CASE WHEN k % 137 = 0 THEN '99999999999' WHEN k % 131 = 0 THEN '12.5' ELSE (p_size * 2)::VARCHAR END AS ReorderLevel,
         if(k % 139 = 0, ' ', (k % 21)::VARCHAR) AS LeadTimeDays
  FROM part
)"""
#: Reasons by numeric casts; the longest texts here have 30 digits.
PRODUCT_MISFITS = """
product_misfits AS (
  SELECT 'Product' AS table_name, ProductID AS row_key, UNNEST([
    {'c': 'ProductID', 'v': ProductID, 'r': if(TRY_CAST(ProductID AS BIGINT) IS NULL, 'not_a_number', NULL)},
    {'c': 'ProductName', 'v': ProductName, 'r': if(len(ProductName) > 150, 'too_long', NULL)},
    {'c': 'CategoryID', 'v': CategoryID, 'r': if(CategoryID IS NULL, 'null', NULL)},
    {'c': 'UnitPrice', 'v': UnitPrice, 'r': CASE WHEN TRY_CAST(UnitPrice AS DECIMAL(38,6)) IS NULL THEN 'not_a_number'
       WHEN CAST(UnitPrice AS DECIMAL(38,6)) >= 100000000 THEN 'out_of_range'
       WHEN CAST(UnitPrice AS DECIMAL(38,6)) <> CAST(UnitPrice AS DECIMAL(38,2)) THEN 'too_many_decimals' END},
    {'c': 'ReorderLevel', 'v': ReorderLevel, 'r': CASE WHEN contains(ReorderLevel, '.') THEN 'not_a_number'
       WHEN TRY_CAST(ReorderLevel AS INTEGER) IS NULL THEN 'out_of_range' END}]) AS m
  FROM raw_products
)"""

# --- tables after lines came and went (revenue state) -----------------------

CHANGED = f"""
offset_ AS (SELECT max(o_orderkey)::BIGINT + 1 AS first_new FROM orders),
orders_then AS (
  FROM SalesOrder
  UNION ALL
  SELECT o_orderkey + first_new, NULL, (o_orderdate + INTERVAL 12 MONTH)::DATE, 'Confirmed', NULL FROM orders, offset_
),
lines_then AS (
  FROM OrderDetail
  UNION ALL
  SELECT l_orderkey + first_new, l_partkey, l_quantity::INTEGER, l_extendedprice::DECIMAL(10,2)
  FROM lineitem, offset_ WHERE l_returnflag = 'R'
),
gone_products AS (
  SELECT ProductID FROM InventoryStock JOIN Product USING (ProductID) JOIN Category USING (CategoryID) JOIN Warehouse USING (WarehouseID)
  GROUP BY ALL HAVING bool_and(QuantityOnHand <= ReorderLevel)
),
gone_orders AS (SELECT OrderID FROM SalesOrder WHERE Status = 'Pending'),
lines_now AS (FROM lines_then ANTI JOIN gone_products USING (ProductID) ANTI JOIN gone_orders USING (OrderID)),
orders_now AS (FROM orders_then ANTI JOIN gone_orders USING (OrderID))"""


def after_changes(body: str) -> str:
    """``body`` over the folds of the changed tables."""
    folds = FOLDS.replace("OrderDetail", "lines_now").replace("SalesOrder", "orders_now")
    return "WITH " + ",\n".join(x.strip() for x in (ORACLE_MODEL_CTES, CHANGED, folds)) + "\n" + body.strip()


def _report_sql() -> str:
    columns = "check_name, table_name, detail, violations"
    parts = [
        f"SELECT 'unique' AS check_name, table_name, key_columns AS detail, duplicate_keys AS violations FROM ({_unique_summary_sql()})",
        f"SELECT 'foreign_key', child_table, column_name || '->' || parent_table, orphan_rows FROM ({_foreign_key_summary_sql()})",
        f"SELECT 'not_null', table_name, column_name, null_rows FROM ({_not_null_summary_sql()})",
        "SELECT 'allowed_values', 'SalesOrder', 'Status', "
        "count(*) FILTER (Status NOT IN ('Pending', 'Confirmed', 'Shipped', 'Cancelled')) FROM SalesOrder",
        f"SELECT 'max_length', table_name, column_name, too_long FROM ({_length_summary_sql()})",
        f"SELECT 'decimal', table_name, column_name, violations FROM ({_decimal_summary_sql()})",
        "SELECT 'unique (not checked)', * FROM (VALUES ('InventoryStock', 'StockID', NULL::BIGINT), ('OrderDetail', 'DetailID', NULL))",
    ]
    return f"SELECT {columns} FROM ({' UNION ALL '.join(parts)})"


PRODUCT_REASONS = """concat_ws(',', if(trim(ProductName) = '', 'name_blank', NULL),
                        if(UnitPrice < 1, 'price_below_1', NULL))"""

OPERATORS: dict[str, str] = {
    "append_rows": with_model("""
FROM SalesOrder
UNION ALL
SELECT last + row_number() OVER (ORDER BY c_custkey), c_name, DATE '2002-01-01', 'Pending', NULL::DECIMAL(12,2)
FROM customer, (SELECT coalesce(max(OrderID), 0) AS last FROM SalesOrder)"""),
    "append_products": with_model(f"""
FROM Product
UNION ALL
SELECT last + row_number() OVER (ORDER BY seq), ProductName, CategoryID, SupplierID, UnitPrice, 50::INTEGER, 7::INTEGER
FROM new_products, (SELECT coalesce(max(ProductID), 0) AS last FROM Product)
WHERE {PRODUCT_REASONS} = ''""", NEW_PRODUCTS),
    "validate_products": with_model(f"""
SELECT seq, ProductName, UnitPrice, {PRODUCT_REASONS} AS reasons FROM new_products WHERE reasons <> ''""", NEW_PRODUCTS),
    "validate_orders": """
SELECT c_name AS CustomerName,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Pending' WHEN 'AUTOMOBILE' THEN 'Shipped'
            WHEN 'MACHINERY' THEN 'Confirmed' ELSE c_mktsegment END AS Status,
       'status_unknown' AS reasons
FROM customer
WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')""",
    "update_rows": with_model("""
SELECT Product.* REPLACE (coalesce(level, ReorderLevel) AS ReorderLevel)
FROM Product LEFT JOIN (SELECT ProductID AS changed, ceil(avg(Quantity))::INTEGER AS level FROM OrderDetail GROUP BY ALL)
  ON ProductID = changed"""),
    "edit_products": with_model("""
SELECT Product.* REPLACE (
         if(changed IS NULL, ProductName, upper(ProductName)) AS ProductName,
         if(changed IS NULL, CategoryID, 1) AS CategoryID,
         if(changed IS NULL, SupplierID, first_supplier) AS SupplierID,
         if(changed IS NULL, UnitPrice, top_price) AS UnitPrice,
         if(changed IS NULL, ReorderLevel, most) AS ReorderLevel,
         if(changed IS NULL, LeadTimeDays, least) AS LeadTimeDays)
FROM Product LEFT JOIN (
  SELECT ProductID AS changed, max(SalePrice) AS top_price, max(Quantity) AS most, min(Quantity) AS least
  FROM OrderDetail GROUP BY ALL) ON ProductID = changed,
  (SELECT min(s_suppkey)::BIGINT AS first_supplier FROM supplier)"""),
    "update_stock": with_model("FROM recounted", STOCK_CHANGES),
    "update_stock_rejected": with_model("""
SELECT ProductID, WarehouseID, seq, counted AS QuantityOnHand, as_of
FROM newest ANTI JOIN InventoryStock USING (ProductID, WarehouseID)""", STOCK_CHANGES),
    "stock_stream": with_model("FROM recounted", STOCK_CHANGES),
    "live_alerts": with_model(f"""
SELECT ProductID, ProductName, CategoryName, WarehouseName, Location, QuantityOnHand, ReorderLevel,
       '{schemas.STOCK_REORDER}' AS StockStatus, LastUpdated
FROM recounted JOIN goods USING (ProductID) JOIN Warehouse USING (WarehouseID)
WHERE QuantityOnHand <= ReorderLevel""", STOCK_CHANGES),
    "delete_products": with_model("FROM OrderDetail ANTI JOIN discontinued USING (ProductID)", DISCONTINUED),
    "delete_products_stock": with_model("FROM InventoryStock ANTI JOIN discontinued USING (ProductID)", DISCONTINUED),
    "delete_products_product": with_model("FROM Product ANTI JOIN discontinued USING (ProductID)", DISCONTINUED),
    "delete_orders": with_model("FROM OrderDetail ANTI JOIN cancelled USING (OrderID)", CANCELLED),
    "delete_orders_orders": with_model("FROM SalesOrder ANTI JOIN cancelled USING (OrderID)", CANCELLED),
    # Of the two flags' rows for one pair, the row of flag A comes first.
    "append_ignore": with_model("""
FROM InventoryStock
UNION ALL
SELECT ProductID, WarehouseID, arg_min(QuantityOnHand, flag), arg_min(LastUpdated, flag)
FROM loads ANTI JOIN InventoryStock USING (ProductID, WarehouseID) GROUP BY ALL""", STOCK_LOADS),
    # The batch's warehouse 0 and its odd products are made to miss their parents; small counts fail the check.
    "append_ignore_parents": with_model("""
, fit AS (
  SELECT flag, ProductID, WarehouseID, QuantityOnHand, LastUpdated
  FROM loads ANTI JOIN InventoryStock USING (ProductID, WarehouseID)
  WHERE ProductID % 2 = 0 AND ProductID IN (SELECT ProductID FROM Product)
    AND WarehouseID > 0 AND WarehouseID IN (SELECT WarehouseID FROM Warehouse) AND QuantityOnHand >= 10
)
FROM InventoryStock
UNION ALL
SELECT ProductID, WarehouseID, arg_min(QuantityOnHand, flag), arg_min(LastUpdated, flag) FROM fit GROUP BY ALL""".lstrip(),
                                        STOCK_LOADS),
    # Batch ids are unique, so only the address collides inside the batch:
    # per address the earliest row that collides with no existing supplier wins.
    "append_ignore_multi_key": with_model("""
FROM dim_supplier
UNION ALL
SELECT SupplierID, arg_min(SupplierName, SupplierID), ContactEmail, NULL, NULL, 5.0::DECIMAL(3,1)
FROM (
  SELECT min(c_custkey) AS SupplierID, min_by(c_name, c_custkey) AS SupplierName,
         lower(c_mktsegment) || '@example.com' AS ContactEmail
  FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_mktsegment)
ANTI JOIN (SELECT ContactEmail FROM dim_supplier) USING (ContactEmail)
GROUP BY SupplierID, ContactEmail"""),
    # Keys of neighbours in a block of a thousand collide in turn, so every other row stays.
    "append_ignore_chain": with_model("""
FROM dim_supplier
UNION ALL
SELECT 1000000000 + block * 1000 + place // 2, c_name, 'chain' || block || '-' || (place + 1) // 2 || '@example.com',
       NULL, NULL, 5.0::DECIMAL(3,1)
FROM (SELECT c_name, c_custkey // 1000 AS block, c_custkey % 1000 AS place,
             row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) AS nth FROM customer)
WHERE nth % 2 = 1"""),
    "typed_load_rejects": "WITH " + RAW_PRODUCTS.strip() + "," + PRODUCT_MISFITS + """
SELECT table_name, row_key, m.c AS column_name, m.v AS value, m.r AS reason FROM product_misfits WHERE m.r IS NOT NULL
UNION ALL
SELECT 'Supplier', s_suppkey::VARCHAR, 'ContactEmail', NULL, 'null' FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL
SELECT 'Supplier', s_suppkey::VARCHAR, 'Rating', a::VARCHAR, if(abs(a) >= 100, 'out_of_range', 'too_many_decimals')
FROM (SELECT s_suppkey, s_acctbal::DECIMAL(12,2) AS a FROM supplier) WHERE abs(a) >= 100 OR a <> a::DECIMAL(12,1)
UNION ALL
SELECT 'SalesOrder', o_orderkey::VARCHAR, 'OrderDate',
       if(o_orderkey % 97 = 0, '2024-13-01', replace(o_orderdate::DATE::VARCHAR, '-', '/')), 'not_a_date'
FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0
UNION ALL
SELECT 'SalesOrder', o_orderkey::VARCHAR, 'Status', o_orderstatus, 'not_allowed' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""",
    "typed_load_products": "WITH " + RAW_PRODUCTS.strip() + "," + PRODUCT_MISFITS + """
SELECT ProductID::BIGINT AS ProductID, ProductName, CategoryID::BIGINT AS CategoryID, SupplierID::BIGINT AS SupplierID,
       UnitPrice::DECIMAL(10,2) AS UnitPrice, ReorderLevel::INTEGER AS ReorderLevel, nullif(trim(LeadTimeDays), '')::INTEGER AS LeadTimeDays
FROM (FROM raw_products ANTI JOIN (SELECT row_key AS ProductID FROM product_misfits WHERE m.r IS NOT NULL) USING (ProductID))""",
    "typed_load_orders": """
SELECT o_orderkey::BIGINT AS OrderID, 'Customer ' || o_custkey AS CustomerName, o_orderdate::DATE AS OrderDate,
       if(o_orderstatus = 'O', 'Pending', 'Shipped') AS Status, o_totalprice::DECIMAL(12,2) AS TotalAmount
FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0""",
    "publish_report": with_model(_report_sql()),
    "append_dated_orders": with_model("""
FROM SalesOrder
UNION ALL
SELECT last + row_number() OVER (ORDER BY c_custkey), c_name, DATE '2002-01-01' + (c_custkey % 28)::INTEGER,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Pending' WHEN 'AUTOMOBILE' THEN 'Shipped' ELSE 'Confirmed' END, NULL::DECIMAL(12,2)
FROM customer, (SELECT coalesce(max(OrderID), 0) AS last FROM SalesOrder)
WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') AND c_custkey % 11 <> 0"""),
    "update_valid_stock": with_model("""
SELECT ProductID, WarehouseID, if(QuantityOnHand >= 60, QuantityOnHand - 60, QuantityOnHand) AS QuantityOnHand,
       if(QuantityOnHand >= 60, DATE '2002-01-01', LastUpdated) AS LastUpdated FROM InventoryStock"""),
    "validate_stock": with_model("""
SELECT ProductID, WarehouseID, QuantityOnHand - 60 AS QuantityOnHand, 'quantity_below_0' AS reasons
FROM InventoryStock WHERE QuantityOnHand < 60"""),
    "valid_order_ids": with_model("SELECT OrderID FROM SalesOrder WHERE OrderID % 7 <> 0"),
    "validate_product_forms": with_model("""
SELECT * FROM (
  SELECT ProductID, ProductName, (UnitPrice % 10)::DECIMAL(10,2) AS UnitPrice, (ReorderLevel % 6)::INTEGER AS ReorderLevel,
         if(ProductID % 3 > 0, ProductID % 4, NULL)::INTEGER AS LeadTimeDays,
         concat_ws(',', if(trim(ProductName) = '', 'name_blank', NULL), if(UnitPrice % 10 < 1, 'price_below_1', NULL),
                   if(ReorderLevel % 6 = 0, 'reorder_below_1', NULL),
                   if(ProductID % 3 > 0 AND ProductID % 4 = 0, 'lead_time_below_1', NULL)) AS reasons
  FROM Product) WHERE reasons <> ''"""),
    "state_product_revenue": after_changes(REPORT_BODIES["product_revenue"]),
    "state_category_revenue": after_changes(REPORT_BODIES["category_revenue"]),
    "state_monthly_demand": after_changes(REPORT_BODIES["monthly_demand"]),
    "state_monthly_sales": after_changes(REPORT_BODIES["monthly_sales"]),
    "sql_function_search": with_model(f"SELECT ProductName, CategoryName, UnitPrice, SupplierName FROM sourced WHERE {SEARCHED} AND UnitPrice < 1500"),
    "sql_function_catalogue": with_model("""
SELECT ProductID, ProductName, CategoryName, SupplierName, UnitPrice, ReorderLevel, LeadTimeDays
FROM sourced WHERE contains(lower(ProductName), 'a') AND contains(CategoryName, 'STAN')"""),
    "sql_function_categories": with_model(REPORT_BODIES["category_revenue"]),
    "sql_function_top": with_model(REPORT_BODIES["top_products"]),
    "sql_function_order": with_model(REPORT_BODIES["order_lines"]),
    "delete_orders_by_month": with_model("FROM OrderDetail ANTI JOIN cancelled USING (OrderID)", CANCELLED),
    "delete_orders_by_month_orders": with_model("FROM SalesOrder ANTI JOIN cancelled USING (OrderID)", CANCELLED),
    "delete_products_by_month": with_model("FROM OrderDetail ANTI JOIN discontinued USING (ProductID)", DISCONTINUED),
    "update_orders_by_month": with_model("""
SELECT * REPLACE (if(Status = 'Pending', 'Confirmed', Status) AS Status, if(Status = 'Pending', OrderDate + 40, OrderDate) AS OrderDate)
FROM SalesOrder"""),
    "indexed_search": with_model("""
SELECT ProductName, CategoryName, UnitPrice, SupplierName FROM sourced
WHERE contains(lower(ProductName), 'widget') AND UnitPrice BETWEEN 500 AND 5000"""),
    "indexed_search_report": with_model("""
, asked AS (SELECT DISTINCT unnest(string_split(lower(ProductName), ' ')) AS term FROM Product),
tried AS (
  SELECT term, lower(ProductName) AS name,
         list_bool_and(list_transform(range(1, len(term) - 1), lambda i: contains(name, substring(term, i, 3)))) AS candidate
  FROM asked, Product WHERE len(term) >= 3)
SELECT term, count(*) FILTER (candidate) AS Candidates, count(*) FILTER (contains(name, term)) AS ProductsFound
FROM tried GROUP BY term""".lstrip()),
    "alert_transitions": with_model("""
SELECT ProductID, WarehouseID, if(counted <= ReorderLevel, 'began', 'ceased') AS transition
FROM InventoryStock JOIN newest USING (ProductID, WarehouseID) JOIN goods USING (ProductID) JOIN Warehouse USING (WarehouseID)
WHERE (counted <= ReorderLevel) <> (QuantityOnHand <= ReorderLevel)""", STOCK_CHANGES),
    "evolve_schema": with_model("SELECT * REPLACE (5.0::DECIMAL(3,1) AS Rating) FROM dim_supplier"),
    "check_unique": with_model(_unique_summary_sql()),
    "check_foreign_key": with_model(_foreign_key_summary_sql()),
    "check_not_null": with_model(_not_null_summary_sql()),
    "check_values": with_model("""
SELECT 'SalesOrder' AS table_name, 'Status' AS column_name,
       count(*) FILTER (Status NOT IN ('Pending', 'Confirmed', 'Shipped', 'Cancelled')) AS violations FROM SalesOrder"""),
    "check_batch_values": """
SELECT 'SalesOrder' AS table_name, 'Status' AS column_name,
       count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')) AS violations FROM customer""",
    "check_length": with_model(_length_summary_sql()),
    "check_decimal": with_model(_decimal_summary_sql()),
    "kpi_display": with_model("""
SELECT format('{:,}', p.n) AS TotalProducts, format('{:,}', o.n) AS TotalOrders,
       'PKR ' || format('{:,.0f}', r.money) AS TotalRevenue, format('{:,}', a.n) AS ReorderAlerts
FROM (SELECT count(*) AS n FROM Product) p, (SELECT count(*) AS n FROM SalesOrder) o,
     (SELECT coalesce(sum(money), 0)::DECIMAL(38,2) AS money FROM billed) r, (SELECT count(*) AS n FROM short) a"""),
    "catalogue_count": with_model(f"SELECT count(*) AS ProductsFound FROM sourced WHERE {SEARCHED}"),
    "product_lookup": with_model("FROM Product SEMI JOIN short USING (ProductID)"),
    "dimension_products": with_model("SELECT ProductID, ProductName FROM Product"),
    "dimension_categories": with_model("SELECT CategoryID, CategoryName FROM Category"),
    "dimension_suppliers": with_model("SELECT SupplierID, SupplierName FROM dim_supplier"),
    "dimension_warehouses": with_model("SELECT WarehouseID, WarehouseName FROM Warehouse"),
    "resolve_names": with_model("""
SELECT p_partkey AS source_key, p_name AS ProductName, ProductID, rows_with_name
FROM part LEFT JOIN (SELECT ProductName AS name, max(ProductID) AS ProductID, count(*) AS rows_with_name
                     FROM Product GROUP BY ALL) ON name = p_name"""),
    "names_for_keys": with_model("SELECT InventoryStock.*, ProductName FROM InventoryStock LEFT JOIN Product USING (ProductID)"),
    "sql_reorder_alerts": with_model("FROM short"),
    "sql_product_search": SEARCH,
}
