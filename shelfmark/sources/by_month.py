"""Orders and order lines laid out by month, and changes that rewrite only what they touch.

The source updates and deletes rows in place. Files cannot do that, but a
change seldom touches more than a few months: ``save_by_month`` writes
SalesOrder and OrderDetail as one folder per month of the order, and the
changes here find the months that their batch touches, read those alone and
overwrite those alone (dynamic partition overwrite). The files of all other
months keep their names and times, and later reads prune by month.

The months of a batch are a list of at most as many texts as there are months.
An overwrite swaps a month's files when the whole job commits; a month that
loses its last row is removed then. A job that fails before changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import columns as C
from shelfmark.operators import changes
from shelfmark.sources.tables import Tables

MONTH = "OrderMonth"
#: Month of orders without a date and of lines without an order.
NO_MONTH = "none"
ORDERS, LINES = "SalesOrder", "OrderDetail"


def _month() -> F.Column:
    return F.coalesce(C.year_month("OrderDate"), F.lit(NO_MONTH)).alias(MONTH)


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def save_by_month(t: Tables, root: str) -> None:
    """Write SalesOrder and OrderDetail under ``root``, partitioned by the month of the order."""
    t.sales_order.withColumn(MONTH, _month()).repartition(MONTH, "OrderID").write.partitionBy(MONTH).parquet(_path(root, ORDERS))
    months = t.sales_order.groupBy("OrderID").agg(F.max(_month()).alias(MONTH)).hint("rebalance")
    lines = t.order_detail.join(months, "OrderID", "left").withColumn(MONTH, F.coalesce(MONTH, F.lit(NO_MONTH)))
    lines.repartition(MONTH, "OrderID").write.partitionBy(MONTH).parquet(_path(root, LINES))


def read_by_month(spark: SparkSession, root: str, name: str, months: Sequence[str] | None = None) -> DataFrame:
    """Table ``name`` with its ``OrderMonth``; given ``months``, only their folders are read."""
    present = spark.read.option("basePath", _path(root, name)).parquet(_path(root, name)).columns
    fields = [f for f in schemas.SCHEMAS[name].fields if f.name in present]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    df = spark.read.schema(f"{schema}, {MONTH} string").parquet(_path(root, name))
    return df if months is None else df.where(F.col(MONTH).isin(*months))


def _touched(df: DataFrame) -> list[str]:
    """The months of ``df``: a few texts, whatever its size."""
    return sorted(r[0] for r in df.select(MONTH).distinct().collect())


def _rewrite(spark: SparkSession, root: str, name: str, months: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """Overwrite ``months`` of table ``name`` with what ``change`` makes of their rows."""
    if not months:
        return
    path, now = _path(root, name), read_by_month(spark, root, name, months)
    after = change(now)
    after.repartition(MONTH, "OrderID").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    # the overwrite leaves a month alone that has no row any more: its rows are still those of before
    emptied = set(months) - set(_touched(change(read_by_month(spark, root, name, months))))
    hadoop = spark._jvm.org.apache.hadoop.fs
    for month in emptied:
        folder = hadoop.Path(f"{path}/{MONTH}={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_orders(spark: SparkSession, root: str, ids: DataFrame) -> list[str]:
    """W5 on the layout: remove orders with their lines; returns the months rewritten."""
    gone = ids.select("OrderID").distinct().hint("rebalance")
    touched = _touched(read_by_month(spark, root, ORDERS).join(gone, "OrderID", "left_semi"))
    for name in (LINES, ORDERS):
        _rewrite(spark, root, name, touched, lambda rows: rows.join(gone, "OrderID", "left_anti"))
    return touched


def delete_product_lines(spark: SparkSession, root: str, ids: DataFrame) -> list[str]:
    """W4 on the layout: remove the lines of products; the orders stay. Returns the months rewritten."""
    gone = ids.select("ProductID").distinct().hint("rebalance")
    touched = _touched(read_by_month(spark, root, LINES).join(gone, "ProductID", "left_semi"))
    _rewrite(spark, root, LINES, touched, lambda rows: rows.join(gone, "ProductID", "left_anti"))
    return touched


def update_orders(spark: SparkSession, root: str, edits: DataFrame, cols: Sequence[str], order_by: Sequence[str] | None = None) -> list[str]:
    """W2 on the layout: set ``cols`` of the orders whose id matches; returns the months rewritten.

    An order whose date moves to another month takes its lines along; both
    months are rewritten. Of several edits of an order the last one counts, as
    in ``changes.update_rows``.
    """
    touched_rows = read_by_month(spark, root, ORDERS).join(edits.select("OrderID").hint("rebalance"), "OrderID", "left_semi")

    def edited(rows: DataFrame) -> DataFrame:
        return changes.update_rows(rows, edits, "OrderID", list(cols), order_by).table

    moves = "OrderDate" in cols
    moved = edited(touched_rows).withColumn("_to", _month()) if moves else touched_rows.withColumn("_to", F.col(MONTH))
    # what moves is read before anything is overwritten
    moved = moved.select("OrderID", MONTH, "_to").where(F.col(MONTH) != F.col("_to")).groupBy("OrderID", MONTH).agg(F.max("_to").alias("_to"))
    moved = moved.checkpoint(eager=True) if moves else None
    touched = _touched(touched_rows)
    if moves:
        touched = sorted({*touched, *_touched(moved.select(F.col("_to").alias(MONTH)))})
    if moves and not moved.isEmpty():
        line_months = sorted({*_touched(moved), *_touched(moved.select(F.col("_to").alias(MONTH)))})

        def relocated(rows: DataFrame) -> DataFrame:
            to = moved.select("OrderID", "_to").hint("rebalance")
            return rows.join(to, "OrderID", "left").withColumn(MONTH, F.coalesce("_to", MONTH)).drop("_to")

        _rewrite(spark, root, LINES, line_months, relocated)
    _rewrite(spark, root, ORDERS, touched, (lambda rows: edited(rows).withColumn(MONTH, _month())) if moves else edited)
    return touched
