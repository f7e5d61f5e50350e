"""Revenue figures kept current after inserts and deletes (A3, A5; R2, R4, R5, R7, R14, R15 after W1, W4, W5).

The state holds what the revenue reports need of the order lines, folded, so
that a change costs its own rows and a merge, and never a scan of all lines:

* ``products``: per product the lines, units and cents sold, and the sum and
  number of prices;
* ``orders``: per order its month, lines, units and cents (month is NULL for
  cancelled and unknown orders);
* ``months``: per month and bucket of order ids the units and cents, and the
  exact set of orders that have lines as a bitmap.

Sums are merged by adding signed deltas: lines that came count once, lines
that went count minus once. Distinct orders cannot be added up, so they are
sets: new orders are joined to a bucket's bitmap by OR; a bucket that lost an
order is built anew from ``orders``, that bucket alone. Distinct products of a
category are the products with lines, as each has one row.

The merged frames are lazy but for the change's own orders, which are
checkpointed; ``save`` writes a state as new versions, which are read
for the next change, and folds the months from the orders as written, so no
order is worked out twice. Order ids are spread over buckets of 32,768
neighbours. The orders of a bucket meet before its bitmap is made: bitmaps
made where the orders lie would be one for each task and bucket, in the end
one for each order.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.plans import reports, views
from shelfmark.session import checkpoint_dir
from shelfmark.sources.tables import Tables, write_version

PRODUCTS = "ProductID bigint, _lines bigint, _units bigint, _revenue_cents decimal(38,0), _price_cents decimal(38,0), _price_n bigint"
ORDERS = "OrderID bigint, _month date, _lines bigint, _units bigint, _revenue_cents decimal(38,0)"
MONTHS = "_month date, _bucket bigint, _units bigint, _revenue_cents decimal(38,0), _orders binary"


@dataclasses.dataclass(frozen=True)
class RevenueState:
    products: DataFrame
    orders: DataFrame
    #: the months, from the orders: those above or the same rows read back
    months_of: Callable[[DataFrame], DataFrame]

    @property
    def months(self) -> DataFrame:
        return self.months_of(self.orders)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in (f.split(" ", 1) for f in schema.split(", "))])


def _month_of(sales_order: DataFrame) -> DataFrame:
    """The month of each order that the monthly reports count."""
    open_ = sales_order.where(F.col("Status") != reports.CANCELLED)
    return open_.groupBy("OrderID").agg(F.max(C.month_start("OrderDate")).alias("_month"))


def _by_order(lines: DataFrame) -> DataFrame:
    return lines.groupBy("OrderID").agg(F.count(F.lit(1)).alias("_lines"), F.sum("Quantity").alias("_units"),
                                        C.line_cents_sum().alias("_revenue_cents"))


def _bucket() -> Column:
    return F.call_function("bitmap_bucket_number", F.col("OrderID"))


def _by_month(orders: DataFrame) -> DataFrame:
    """``orders`` with lines, folded per month and bucket."""
    held = orders.where(F.col("_month").isNotNull()).withColumn("_bucket", _bucket()).repartition("_month", "_bucket")
    return _shaped(held.groupBy("_month", "_bucket").agg(
        F.sum("_units").alias("_units"), F.sum("_revenue_cents").alias("_revenue_cents"),
        F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("OrderID"))).alias("_orders")), MONTHS)


def build(t: Tables) -> RevenueState:
    """The state of the tables as they are: the only step that reads all lines."""
    orders = _by_order(t.order_detail).join(_month_of(t.sales_order).hint("rebalance"), "OrderID", "left")
    return RevenueState(_shaped(views.lines_by_product(t.order_detail), PRODUCTS), _shaped(orders, ORDERS), _by_month)


def _signed(inserted: DataFrame | None, deleted: DataFrame | None, fold) -> DataFrame:
    """Per key the sums of the lines that came less those of the lines that went."""
    parts = []
    for lines, sign in ((inserted, 1), (deleted, -1)):
        if lines is not None:
            folded = fold(lines)
            parts.append(folded.select(folded.columns[0], *[(F.col(c) * F.lit(sign)).alias(c) for c in folded.columns[1:]]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _added_up(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in parts.columns if c != key])


def merge(state: RevenueState, sales_order: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> RevenueState:
    """The state after order lines came (``inserted``) and went (``deleted``).

    ``sales_order`` gives the months of orders that the state does not know
    yet. A whole order that is deleted (W5) is its lines; so are the lines of
    deleted products (W4). Deleting lines that were never added is an error
    of the caller and shows as negative sums.
    """
    if inserted is None and deleted is None:
        return state
    products = _added_up(state.products.unionByName(_shaped(_signed(inserted, deleted, views.lines_by_product), PRODUCTS)), "ProductID")
    products = _shaped(products.where("_lines <> 0"), PRODUCTS)

    delta = _added_up(_signed(inserted, deleted, _by_order), "OrderID")
    was = state.orders.select("OrderID", F.col("_month").alias("_was_month"), *[F.col(c).alias(f"_was{c}") for c in ("_lines", "_units", "_revenue_cents")])
    touched = (delta.join(was, "OrderID", "left")
               .join(_month_of(sales_order).hint("rebalance"), "OrderID", "left")
               .withColumn("_month", F.when(F.col("_was_lines").isNull(), F.col("_month")).otherwise(F.col("_was_month"))))
    checkpoint_dir(sales_order.sparkSession)
    touched = touched.checkpoint(eager=True)  # one row per order of the change, read for each part of the state
    now = {c: F.coalesce(F.col(f"_was{c}"), F.lit(0)) + F.col(c) for c in ("_lines", "_units", "_revenue_cents")}
    changed = touched.select("OrderID", "_month", *[e.alias(c) for c, e in now.items()])
    orders = state.orders.join(touched.select("OrderID").hint("rebalance"), "OrderID", "left_anti").unionByName(
        _shaped(changed.where("_lines <> 0"), ORDERS))

    counted = touched.where(F.col("_month").isNotNull()).withColumn("_bucket", _bucket())
    sums = counted.groupBy("_month", "_bucket").agg(F.sum("_units").alias("_units"), F.sum("_revenue_cents").alias("_revenue_cents"))

    def months_of(orders: DataFrame) -> DataFrame:
        return _merged_months(state.months, orders, counted, sums, counted.where((F.col("_was_lines") > 0) & (now["_lines"] == 0)))

    return RevenueState(products, orders, months_of)


def _merged_months(months: DataFrame, orders: DataFrame, counted: DataFrame, sums: DataFrame, gone: DataFrame) -> DataFrame:
    """``months`` after a change: ``orders`` as they are now, those that the change ``counted``, its ``sums``, and those ``gone``."""
    # sets: new orders by OR, buckets that lost an order from the orders that are left
    lost = gone.select("_month", "_bucket").distinct()
    came = _by_month(counted.where(F.col("_was_lines").isNull() & (F.col("_lines") > 0))).select("_month", "_bucket", "_orders")
    kept = months.select("_month", "_bucket", "_orders").unionByName(came).join(lost, ["_month", "_bucket"], "left_anti")
    anew = _by_month(orders.withColumn("_bucket", _bucket()).join(lost, ["_month", "_bucket"], "left_semi")).select("_month", "_bucket", "_orders")
    sets = kept.unionByName(anew).groupBy("_month", "_bucket").agg(F.call_function("bitmap_or_agg", F.col("_orders")).alias("_orders"))
    added = months.drop("_orders").unionByName(_shaped(sums.withColumn("_orders", F.lit(None).cast("binary")), MONTHS).drop("_orders"))
    added = added.groupBy("_month", "_bucket").agg(F.sum("_units").alias("_units"), F.sum("_revenue_cents").alias("_revenue_cents"))
    # a bucket without an order left has no set, and no row
    return _shaped(added.join(sets, ["_month", "_bucket"]), MONTHS)


def save(state: RevenueState, root: str) -> RevenueState:
    """Write the state as new versions under ``root`` and read it back: the next change starts from files."""
    spark = state.products.sparkSession

    def written(name: str, schema: str, df: DataFrame) -> DataFrame:
        return spark.read.schema(schema).parquet(write_version(df, f"{root.rstrip('/')}/{name}"))

    products, orders = written("products", PRODUCTS, state.products), written("orders", ORDERS, state.orders)
    months = written("months", MONTHS, state.months_of(orders))
    return RevenueState(products, orders, lambda _: months)


def load(spark: SparkSession, products: str, orders: str, months: str) -> RevenueState:
    """The state from the paths of its three versions."""
    products, orders, months = [spark.read.schema(s).parquet(p) for s, p in ((PRODUCTS, products), (ORDERS, orders), (MONTHS, months))]
    return RevenueState(products, orders, lambda _: months)


# The reports, as of the state; ``t`` gives the dimensions only.
def product_revenue(state: RevenueState, t: Tables) -> DataFrame:
    """R2."""
    return views.product_revenue(t, state.products)


def category_revenue(state: RevenueState, t: Tables, min_revenue: float | int | None = 10000, sort: bool = True) -> DataFrame:
    """R4."""
    return reports.category_revenue(t, min_revenue, sort, state.products)


def category_revenue_page(state: RevenueState, t: Tables, min_revenue: float | int | None = 0, sort: bool = True) -> DataFrame:
    """R5."""
    return reports.category_revenue_page(t, min_revenue, sort, state.products)


def revenue_by_category(state: RevenueState, t: Tables) -> DataFrame:
    """R14."""
    return reports.revenue_by_category(t, state.products)


def monthly_demand(state: RevenueState, sort: bool = True) -> DataFrame:
    """R7; the orders of a month are counted in its bitmaps."""
    counted = state.months.groupBy("_month").agg(
        F.sum(F.call_function("bitmap_count", F.col("_orders"))).alias("TotalOrders"), C.units_sum("_units").alias("TotalUnitsSold"),
        C.money_from_cents(F.sum("_revenue_cents")).alias("TotalRevenue"))
    return reports.demand_of(counted, sort)


def monthly_sales(state: RevenueState, sort: bool = True) -> DataFrame:
    """R15."""
    out = state.months.groupBy("_month").agg(C.money_from_cents(F.sum("_revenue_cents")).alias("Revenue")).select(
        C.year_month("_month").alias("Month"), "Revenue")
    return out.orderBy("Month") if sort else out
