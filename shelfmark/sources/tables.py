"""The seven model tables as one object, and reading / writing them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from shelfmark import schemas

TABLE_NAMES: tuple[str, ...] = tuple(schemas.SCHEMAS)

_FIELD_OF = {
    "Category": "category",
    "Supplier": "supplier",
    "Warehouse": "warehouse",
    "Product": "product",
    "InventoryStock": "stock",
    "SalesOrder": "sales_order",
    "OrderDetail": "order_detail",
}
FIELDS: tuple[str, ...] = tuple(_FIELD_OF.values())

Frame = DataFrame | Callable[[], DataFrame]


class Tables:
    """The model's DataFrames; each may be given as a zero-argument builder.

    A builder runs on first access only, so a report that reads two tables
    never scans (or even lists) the sources of the other five. Nothing here
    is collected.
    """

    __slots__ = ("_given", "_built")

    def __init__(self, *, category: Frame, supplier: Frame, warehouse: Frame, product: Frame,
                 stock: Frame, sales_order: Frame, order_detail: Frame):
        self._given = {"category": category, "supplier": supplier, "warehouse": warehouse,
                       "product": product, "stock": stock, "sales_order": sales_order,
                       "order_detail": order_detail}
        self._built: dict[str, DataFrame] = {}

    def _get(self, field: str) -> DataFrame:
        if field not in self._built:
            value = self._given[field]
            self._built[field] = value if isinstance(value, DataFrame) else value()
        return self._built[field]

    category = property(lambda self: self._get("category"))
    supplier = property(lambda self: self._get("supplier"))
    warehouse = property(lambda self: self._get("warehouse"))
    product = property(lambda self: self._get("product"))
    stock = property(lambda self: self._get("stock"))
    sales_order = property(lambda self: self._get("sales_order"))
    order_detail = property(lambda self: self._get("order_detail"))

    def by_name(self, name: str) -> DataFrame:
        return self._get(_FIELD_OF[name])

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        for name in TABLE_NAMES:
            yield name, self.by_name(name)

    def replace(self, **changes: Frame) -> Tables:
        """New Tables with some DataFrames swapped (keyword = field name)."""
        unknown = set(changes) - set(FIELDS)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        merged = {f: self._built.get(f, self._given[f]) for f in FIELDS}
        merged.update(changes)
        return Tables(**merged)

    def __repr__(self) -> str:
        return f"Tables({', '.join(FIELDS)})"


def tables_of(frames: dict[str, Frame]) -> Tables:
    """Tables from a DataFrame (or builder) per table name."""
    return Tables(**{_FIELD_OF[name]: frame for name, frame in frames.items()})


def load(spark: SparkSession, root: str, fmt: str = "parquet",
         options: dict[str, str] | None = None) -> Tables:
    """Scan each table at ``{root}/{TableName}`` with its declared schema.

    The format is an argument: parquet, orc, csv and json take the same call;
    jdbc works through ``options`` with ``fmt='jdbc'`` and ``dbtable`` set per
    table by the caller. Scans are created on first use.
    """
    def reader(name: str) -> Callable[[], DataFrame]:
        def build() -> DataFrame:
            r = spark.read.format(fmt).options(**(options or {})).schema(schemas.SCHEMAS[name])
            return r.load(f"{root.rstrip('/')}/{name}")
        return build

    return Tables(**{_FIELD_OF[name]: reader(name) for name in TABLE_NAMES})


def save(tables: Tables, root: str, fmt: str = "parquet", mode: str = "errorifexists",
         partition_by: dict[str, list[str]] | None = None) -> None:
    """Write every table under ``{root}/{TableName}``."""
    for name, df in tables.items():
        writer = df.write.format(fmt).mode(mode)
        cols = (partition_by or {}).get(name)
        if cols:
            writer = writer.partitionBy(*cols)
        writer.save(f"{root.rstrip('/')}/{name}")


def write_version(df: DataFrame, table_root: str, fmt: str = "parquet") -> str:
    """Write a new version directory of a table and return its path (H4).

    A table that is being read is never overwritten in place: the caller
    switches its pointer to the returned path once the write has finished.
    """
    path = f"{table_root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.format(fmt).mode("errorifexists").save(path)
    return path


# Co-location layout: tables joined on the same key share a bucket count and
# bucket column, so those joins (and the per-key pre-aggregations before
# them) read matching buckets without a shuffle.
BUCKET_KEYS: dict[str, str] = {
    "SalesOrder": "OrderID",
    "OrderDetail": "OrderID",
    "Product": "ProductID",
    "InventoryStock": "ProductID",
}


def save_bucketed(t: Tables, database: str, buckets: int, location: str,
                  mode: str = "errorifexists") -> list[str]:
    """Write the model as catalog tables, the large ones bucketed on their join key.

    SalesOrder and OrderDetail are bucketed (and sorted) by OrderID; Product
    and InventoryStock by ProductID; the small dimensions are plain tables.
    ``location`` is the shared folder the files go to (external tables).
    """
    spark = t.product.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = []
    for name, df in t.items():
        writer = df.write.mode(mode).format("parquet").option("path", f"{location.rstrip('/')}/{name}")
        key = BUCKET_KEYS.get(name)
        if key and key in df.columns:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")
        names.append(f"{database}.{name}")
    return names


def load_tables(spark: SparkSession, database: str) -> Tables:
    """The model from catalog tables (bucketing metadata included), read on first use."""
    return Tables(**{_FIELD_OF[name]: (lambda n=name: spark.table(f"{database}.{n}")) for name in TABLE_NAMES})
