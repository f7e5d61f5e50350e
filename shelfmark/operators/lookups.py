"""Lookups behind the entry forms (S7-S10), set-wise.

The page resolves one name or key per click through a Python dict; here a
whole batch of change rows is resolved with joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.tables import Tables

# Fixed values: (table field, key column, name column) of each dimension list.
DIMENSIONS: dict[str, tuple[str, str]] = {
    "product": ("ProductID", "ProductName"),
    "category": ("CategoryID", "CategoryName"),
    "supplier": ("SupplierID", "SupplierName"),
    "warehouse": ("WarehouseID", "WarehouseName"),
}


def rows_by_key(df: DataFrame, key: str, ids: int | DataFrame) -> DataFrame:
    """All columns of the rows with the given key(s)."""
    if isinstance(ids, DataFrame):
        # ``df`` is keyed by ``key`` (one row each), so only the ids side can
        # repeat a key: distinct collapses repeats map-side.
        return df.join(ids.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key) == F.lit(int(ids)))


def dimension_list(t: Tables, dimension: str, sort: bool = True) -> DataFrame:
    """Id + name list of a dimension (products sorted by name)."""
    key, name = DIMENSIONS[dimension]
    out = getattr(t, dimension).select(key, name)
    return out.orderBy(name, key) if sort else out


def name_index(dim: DataFrame, key: str, name: str) -> DataFrame:
    """One row per name: the key a name resolves to, and how many rows share it.

    The page builds ``dict(zip(names, ids))``, so with repeated names one id
    silently wins; here the highest id wins and ``rows_with_name`` exposes
    the ambiguity instead of hiding it.
    """
    return dim.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.max(key).alias(key), F.count(F.lit(1)).alias("rows_with_name"))


def resolve_names(changes: DataFrame, dim: DataFrame, key: str, name: str,
                  name_column: str | None = None) -> DataFrame:
    """Add the key for each change row's name (NULL when the name is unknown)."""
    idx = name_index(dim, key, name)
    source = name_column or name
    if source != name:
        idx = idx.withColumnRenamed(name, source)
    # The index is an aggregate: dealt anew, the join shuffles both sides itself
    # and AQE may split a name that a third of the change rows share.
    return changes.join(idx.hint("rebalance"), source, "left")


def names_for_keys(df: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Attach the dimension name to rows that carry its key.

    No declared key keeps a dimension key from repeating; the greatest of its
    names counts then, and no row is multiplied.
    """
    names = dim.groupBy(key).agg(F.max(name).alias(name))
    return df.join(names.hint("rebalance"), key, "left")
