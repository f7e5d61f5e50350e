"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every entry derives the model from the driver tables of ``sf_dir`` and runs
over the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import changes, lookups, name_index, quality, revenue_state
from shelfmark.operators.changes import STOCK_KEY
from shelfmark.plans import batches, reports, views
from shelfmark.session import scratch_path
from shelfmark.sources import by_month, loading, sql, typed_load
from shelfmark.sources.fixtures import driver_sources, from_driver_tables
from shelfmark.sources.tables import Tables, write_version

SQL_PREFIX = "shelfmark_"

QueryFn = Callable[[SparkSession, str], DataFrame]


def _on_model(fn: Callable[[Tables], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(from_driver_tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def _all_orders(fn):
    return lambda t: fn(t, t.sales_order.select("OrderID"))


# The 19 reports as functions of the model tables (any source: driver
# derivation, ``tables.load`` or ``tables.load_tables``).
REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "stock_summary": views.stock_summary,
    "stock_page": lambda t: views.stock_summary(t).orderBy("QuantityOnHand"),
    "product_revenue": views.product_revenue,
    "stock_overview": reports.stock_overview,
    "category_revenue": reports.category_revenue,
    "category_revenue_all": reports.category_revenue_page,
    "below_average_stock": reports.below_average_stock,
    "monthly_demand": reports.monthly_demand,
    "product_search": lambda t: reports.product_search(t, "a", 500, 5000),
    "product_catalogue": reports.product_catalogue,
    "supplier_cities": reports.supplier_cities,
    "top_products": reports.top_products,
    "reorder_alerts": reports.reorder_alerts,
    "kpis": reports.kpis,
    "revenue_by_category": reports.revenue_by_category,
    "monthly_sales": reports.monthly_sales,
    "order_list": reports.order_list,
    "order_lines": _all_orders(reports.order_lines),
    "order_total": _all_orders(reports.order_total),
    "alert_stock_by_warehouse": reports.alert_stock_by_warehouse,
}

REPORT_QUERIES: dict[str, QueryFn] = {name: _on_model(fn) for name, fn in REPORTS.items()}


def _with_sources(fn: Callable[[dict[str, DataFrame], Tables], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = driver_sources(spark, sf_dir)
        return fn(src, from_driver_tables(spark, sf_dir, src))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _append_rows(src, t):
    return changes.append_rows(t.sales_order, batches.new_orders(src), "OrderID", ["c_custkey"],
                               defaults=schemas.DEFAULTS["SalesOrder"], as_of=batches.AS_OF)


def _append_products(src, t):
    fit, _ = changes.validate(batches.new_products(src), _new_product_rules())
    return changes.append_rows(t.product, fit, "ProductID", ["seq"], defaults=schemas.DEFAULTS["Product"],
                               as_of=batches.AS_OF)


def _validate_products(src, t):
    _, rejected = changes.validate(batches.new_products(src), _new_product_rules())
    return rejected.select("seq", "ProductName", "UnitPrice", F.array_join("reasons", ",").alias("reasons"))


def _new_product_rules():
    """The rules on the columns that the batch brings."""
    rules = changes.product_rules()
    return {k: rules[k] for k in ("name_blank", "price_below_1")}


def _edit_products(src, t):
    cols = ["ProductName", "CategoryID", "SupplierID", "UnitPrice", "ReorderLevel", "LeadTimeDays"]
    return changes.update_rows(t.product, batches.product_edits(src, t), "ProductID", cols).table


def _validate_orders(src, t):
    _, rejected = changes.validate(batches.new_orders_with_status(src), changes.order_rules())
    return rejected.select("CustomerName", "Status", F.array_join("reasons", ",").alias("reasons"))


def _update_rows(src, t):
    return changes.update_rows(t.product, batches.reorder_levels(t), "ProductID", ["ReorderLevel"]).table


def _update_stock(src, t):
    return changes.update_stock(t.stock, batches.stock_counts(src)).table


def _update_stock_rejected(src, t):
    return changes.update_stock(t.stock, batches.stock_counts(src)).rejected


def _delete_products(src, t):
    return changes.delete_products(t, batches.discontinued_products(t)).order_detail


def _delete_orders(src, t):
    return changes.delete_orders(t, batches.cancelled_orders(t)).order_detail


def _append_ignore_parents(src, t):
    """Two foreign keys and a CHECK with real violators: the parents lack odd products and warehouse 0."""
    parents = [("ProductID", t.product.where(F.col("ProductID") % 2 == 0), "ProductID"),
               ("WarehouseID", t.warehouse.where(F.col("WarehouseID") > 0), "WarehouseID")]
    return changes.append_ignore(t.stock, batches.stock_rows_to_load(src), [STOCK_KEY],
                                 order_by=["flag", "ProductID", "WarehouseID"], parents=parents,
                                 checks=F.col("QuantityOnHand") >= 10).table


def _check_batch_values(src, t):
    bad = quality.check_values(batches.new_orders_with_status(src), "Status", schemas.ORDER_STATUSES)
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("SalesOrder").alias("table_name"), F.lit("Status").alias("column_name"), "violations")


def _append_ignore(src, t):
    return changes.append_ignore(t.stock, batches.stock_rows_to_load(src), [STOCK_KEY],
                                 order_by=["flag", "ProductID", "WarehouseID"]).table


def _append_ignore_multi_key(src, t):
    return changes.append_ignore(t.supplier, batches.customers_as_suppliers(src),
                                 [("SupplierID",), ("ContactEmail",)], order_by=["seq"],
                                 defaults=schemas.DEFAULTS["Supplier"]).table


def _append_ignore_chain(src, t):
    """Two unique keys that collide in chains of many rows: every other row of a chain stays."""
    return changes.append_ignore(t.supplier, batches.chained_suppliers(src), [("SupplierID",), ("ContactEmail",)],
                                 order_by=["seq"], defaults=schemas.DEFAULTS["Supplier"]).table


def _typed_loads(src):
    raw = {"Product": batches.raw_products(src), "Supplier": batches.raw_suppliers(src), "SalesOrder": batches.raw_orders(src)}
    return {name: typed_load.typed(df, name) for name, df in raw.items()}


def _typed_load_rejects(src, t):
    loads = _typed_loads(src).values()
    return reduce(DataFrame.unionByName, [load.quarantine for load in loads])


def _publish_report(src, t):
    """Every table published, with the report that the writes themselves gather."""
    root = scratch_path(t.product.sparkSession, f"published-{uuid.uuid4().hex}")
    return loading.publish_checked(t, root)[1]


def _append_dated_orders(src, t):
    """The page's own insert names date and status; only acceptable rows are appended."""
    fit, _ = changes.validate(batches.dated_orders(src), changes.order_rules())
    return changes.append_rows(t.sales_order, fit, "OrderID", ["c_custkey"], as_of=batches.AS_OF)


def _update_valid_stock(src, t):
    fit, _ = changes.validate(batches.stock_corrections(t), changes.stock_rules())
    return changes.update_stock(t.stock, fit.withColumn("seq", F.lit(1)), as_of=batches.AS_OF).table


def _validate_stock(src, t):
    _, rejected = changes.validate(batches.stock_corrections(t), changes.stock_rules())
    return rejected.withColumn("reasons", F.array_join("reasons", ","))


def _valid_order_ids(src, t):
    fit, _ = changes.validate(batches.order_ids_asked(t), changes.order_id_rules())
    return fit


def _validate_product_forms(src, t):
    _, rejected = changes.validate(batches.product_forms(t), changes.product_rules())
    return rejected.withColumn("reasons", F.array_join("reasons", ","))


def _merged_state(src, t):
    """The revenue state of the tables, saved, after lines came (W1) and saved again, after lines went."""
    root = scratch_path(t.product.sparkSession, f"revenue-state-{uuid.uuid4().hex}")
    orders, lines = batches.reorders(src), batches.reordered_lines(src)
    state = revenue_state.save(revenue_state.build(t), root)
    state = revenue_state.save(revenue_state.merge(state, orders, inserted=lines), root)
    now = t.replace(order_detail=t.order_detail.unionByName(lines), sales_order=t.sales_order.unionByName(orders))
    gone = changes.removed_lines(now, batches.discontinued_products(t), batches.pending_orders(t))
    # folded by product and by order: found once
    gone = t.product.sparkSession.read.schema(gone.schema).parquet(write_version(gone, f"{root}/removed"))
    return revenue_state.save(revenue_state.merge(state, now.sales_order, deleted=gone), root)


def _of_state(fn):
    return _with_sources(lambda src, t: fn(_merged_state(src, t), t))


def _sql_functions(call, **args):
    """A parameterised report as a table function of Spark SQL."""
    def run(src, t):
        spark = t.product.sparkSession
        sql.register_views(spark, t, prefix=SQL_PREFIX)
        sql.register_functions(spark, prefix=SQL_PREFIX)
        return sql.query(spark, call.format(p=SQL_PREFIX), args)
    return _with_sources(run)


def _evolve_schema(src, t):
    return changes.evolve(t.supplier.drop("Rating"), "Rating", "decimal(3,1)", Decimal("5.0"))


def _product_lookup(src, t):
    return lookups.rows_by_key(t.product, "ProductID", batches.reorder_alert_products(t))


def _dimension(name):
    return _on_model(lambda t: lookups.dimension_list(t, name))


def _names_for_keys(src, t):
    return lookups.names_for_keys(t.stock, t.product, "ProductID", "ProductName")


def _resolve_names(src, t):
    return lookups.resolve_names(batches.product_names_to_resolve(src), t.product, "ProductID", "ProductName")


def _sql_reorder_alerts(src, t):
    spark = t.product.sparkSession
    sql.register_views(spark, t, prefix=SQL_PREFIX)
    return sql.query(spark, f"SELECT * FROM {SQL_PREFIX}vw_StockSummary WHERE StockStatus = :status "
                            "ORDER BY QuantityOnHand", {"status": schemas.STOCK_REORDER})


def _sql_product_search(src, t):
    spark = t.product.sparkSession
    sql.register_views(spark, t, prefix=SQL_PREFIX)
    p = SQL_PREFIX
    return sql.query(spark, f"""
        WITH hits AS (SELECT * FROM {p}Product WHERE UnitPrice BETWEEN :lo AND :hi AND ProductName ILIKE :pat)
        SELECT ProductName, CategoryName, UnitPrice, SupplierName
        FROM hits JOIN {p}Supplier USING (SupplierID) JOIN {p}Category USING (CategoryID)
        ORDER BY UnitPrice""", {"pat": "%a%", "lo": 500, "hi": 5000})


def _applied_changes(src, t):
    """ST1: change files -> stream -> folder of the applied changes."""
    from shelfmark.streaming import stock_stream as st

    spark = t.product.sparkSession
    run = scratch_path(spark, f"stock-stream-{uuid.uuid4().hex}")
    feed = batches.stock_counts(src)
    feed.write.parquet(f"{run}/source")  # as many files as the feed has partitions
    query = st.start_stock_stream(spark, f"{run}/source", f"{run}/applied", f"{run}/checkpoint")
    query.awaitTermination()
    return f"{run}/applied"


def _stock_stream(src, t):
    from shelfmark.streaming import stock_stream as st

    return st.current_stock(t.product.sparkSession, t.stock, _applied_changes(src, t)).table


def _live_alerts(src, t):
    from shelfmark.streaming import stock_stream as st

    return st.live_reorder_alerts(t.product.sparkSession, t, _applied_changes(src, t))


def _alert_transitions(src, t):
    """ST1: the same change files as a stream of transitions, and what they come to."""
    from shelfmark.streaming import alert_stream

    spark = t.product.sparkSession
    run = scratch_path(spark, f"alert-stream-{uuid.uuid4().hex}")
    batches.stock_counts(src).write.parquet(f"{run}/source")
    alert_stream.start_alert_stream(spark, t, f"{run}/source", f"{run}/transitions", f"{run}/checkpoint").awaitTermination()
    return alert_stream.net_transitions(spark, f"{run}/transitions").select(*STOCK_KEY, "transition")


def _by_month(change, name):
    """A change of the layout by month, and the table as it is then read."""
    def run(src, t):
        spark = t.product.sparkSession
        root = scratch_path(spark, f"by-month-{uuid.uuid4().hex}")
        by_month.save_by_month(t, root)
        change(spark, root, t)
        return by_month.read_by_month(spark, root, name).drop(by_month.MONTH)
    return _with_sources(run)


def _cancel(spark, root, t):
    by_month.delete_orders(spark, root, batches.cancelled_orders(t))


def _discontinue(spark, root, t):
    by_month.delete_product_lines(spark, root, batches.discontinued_products(t))


def _confirm(spark, root, t):
    by_month.update_orders(spark, root, batches.order_edits(t), ["Status", "OrderDate"])


def _name_index(t):
    spark = t.product.sparkSession
    return name_index.load_index(spark, name_index.save_index(t.product, scratch_path(spark, f"name-index-{uuid.uuid4().hex}")))


def _indexed_search_report(src, t):
    words = t.product.select(F.explode(F.split(F.lower("ProductName"), " ")).alias("term")).distinct()
    return name_index.search_report(t, _name_index(t), words)


OPERATOR_QUERIES: dict[str, QueryFn] = {
    "append_rows": _with_sources(_append_rows),
    "append_products": _with_sources(_append_products),
    "validate_products": _with_sources(_validate_products),
    "edit_products": _with_sources(_edit_products),
    "validate_orders": _with_sources(_validate_orders),
    "update_rows": _with_sources(_update_rows),
    "update_stock": _with_sources(_update_stock),
    "update_stock_rejected": _with_sources(_update_stock_rejected),
    "delete_products": _with_sources(_delete_products),
    "delete_products_stock": _with_sources(
        lambda src, t: changes.delete_products(t, batches.discontinued_products(t)).stock),
    "delete_products_product": _with_sources(
        lambda src, t: changes.delete_products(t, batches.discontinued_products(t)).product),
    "delete_orders": _with_sources(_delete_orders),
    "delete_orders_orders": _with_sources(
        lambda src, t: changes.delete_orders(t, batches.cancelled_orders(t)).sales_order),
    "append_ignore": _with_sources(_append_ignore),
    "append_ignore_parents": _with_sources(_append_ignore_parents),
    "append_ignore_multi_key": _with_sources(_append_ignore_multi_key),
    "append_ignore_chain": _with_sources(_append_ignore_chain),
    "typed_load_rejects": _with_sources(_typed_load_rejects),
    "typed_load_products": _with_sources(lambda src, t: _typed_loads(src)["Product"].rows),
    "typed_load_orders": _with_sources(lambda src, t: _typed_loads(src)["SalesOrder"].rows),
    "publish_report": _with_sources(_publish_report),
    "append_dated_orders": _with_sources(_append_dated_orders),
    "update_valid_stock": _with_sources(_update_valid_stock),
    "validate_stock": _with_sources(_validate_stock),
    "valid_order_ids": _with_sources(_valid_order_ids),
    "validate_product_forms": _with_sources(_validate_product_forms),
    "state_product_revenue": _of_state(revenue_state.product_revenue),
    "state_category_revenue": _of_state(revenue_state.category_revenue),
    "state_monthly_demand": _of_state(lambda state, t: revenue_state.monthly_demand(state)),
    "state_monthly_sales": _of_state(lambda state, t: revenue_state.monthly_sales(state)),
    "sql_function_search": _sql_functions("SELECT * FROM {p}product_search(:pat, :lo, :hi) WHERE UnitPrice < :under", pat="%a%", lo=500, hi=5000, under=1500),
    "sql_function_catalogue": _sql_functions("SELECT * FROM {p}product_catalogue(:pat, :lo, :hi) WHERE CategoryName LIKE :kind", pat="%a%", lo=None, hi=None, kind="%STAN%"),
    "sql_function_categories": _sql_functions("SELECT * FROM {p}category_revenue(:least)", least=10000),
    "sql_function_top": _sql_functions("SELECT * FROM {p}top_products(:n)", n=5),
    "sql_function_order": _sql_functions(
        "SELECT o.OrderID, l.ProductName, l.Quantity, l.SalePrice, l.LineTotal FROM {p}SalesOrder o, LATERAL {p}order_lines(o.OrderID) l"),
    "delete_orders_by_month": _by_month(_cancel, "OrderDetail"),
    "delete_orders_by_month_orders": _by_month(_cancel, "SalesOrder"),
    "delete_products_by_month": _by_month(_discontinue, "OrderDetail"),
    "update_orders_by_month": _by_month(_confirm, "SalesOrder"),
    "indexed_search": _with_sources(lambda src, t: name_index.product_search(t, _name_index(t), "widget", 500, 5000)),
    "indexed_search_report": _with_sources(_indexed_search_report),
    "alert_transitions": _with_sources(_alert_transitions),
    "evolve_schema": _with_sources(_evolve_schema),
    "check_unique": _on_model(quality.unique_summary),
    "check_foreign_key": _on_model(quality.foreign_key_summary),
    "check_not_null": _on_model(quality.not_null_summary),
    "check_values": _on_model(quality.values_summary),
    "check_batch_values": _with_sources(_check_batch_values),
    "check_length": _on_model(quality.length_summary),
    "check_decimal": _on_model(quality.decimal_summary),
    "kpi_display": _on_model(reports.kpi_display),
    "catalogue_count": _on_model(lambda t: reports.catalogue_count(t, "a", 500, 5000)),
    "product_lookup": _with_sources(_product_lookup),
    "dimension_products": _dimension("product"),
    "dimension_categories": _dimension("category"),
    "dimension_suppliers": _dimension("supplier"),
    "dimension_warehouses": _dimension("warehouse"),
    "names_for_keys": _with_sources(_names_for_keys),
    "resolve_names": _with_sources(_resolve_names),
    "sql_reorder_alerts": _with_sources(_sql_reorder_alerts),
    "sql_product_search": _with_sources(_sql_product_search),
    "stock_stream": _with_sources(_stock_stream),
    "live_alerts": _with_sources(_live_alerts),
}


def queries() -> dict[str, QueryFn]:
    return {**REPORT_QUERIES, **OPERATOR_QUERIES}


def oracle_sql() -> dict[str, str]:
    from shelfmark.plans.oracle import OPERATORS, REPORTS
    return {**REPORTS, **OPERATORS}
