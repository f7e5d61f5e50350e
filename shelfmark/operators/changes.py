"""Batch change operators (W1-W7, Q-DDL2).

The source applies one change per click to a database table. Here each
operator takes the current table(s) and a change DataFrame of any size and
returns new DataFrames: the caller writes them as a new version
(``sources.tables.write_version``) instead of updating rows in place.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schemas
from shelfmark.functions import columns as C
from shelfmark.operators import collisions
from shelfmark.operators.keys import latest_per_key, sequential_keys
from shelfmark.sources.tables import Tables

STOCK_KEY = ("ProductID", "WarehouseID")


@dataclasses.dataclass(frozen=True)
class ChangeResult:
    """New table plus the change rows that were not applied."""

    table: DataFrame
    rejected: DataFrame


def _filled(new: DataFrame, f: T.StructField, defaults: dict[str, object],
            as_of: _dt.date | str | None) -> Column:
    if f.name in new.columns:
        return F.col(f.name).cast(f.dataType).alias(f.name)
    if f.name in defaults:
        value = schemas.resolve_default(defaults[f.name], as_of)
        return F.lit(value).cast(f.dataType).alias(f.name)
    return F.lit(None).cast(f.dataType).alias(f.name)


def fill_defaults(new: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None,
                  as_of: _dt.date | str | None = None) -> DataFrame:
    """Shape ``new`` to ``schema``; absent columns take their default, else NULL.

    A column present in ``new`` keeps its values, NULLs included: an explicit
    NULL is not an omitted column.
    """
    return new.select(*[_filled(new, f, defaults or {}, as_of) for f in schema.fields])


def append_rows(base: DataFrame, new: DataFrame, key: str, order_by: Sequence[str],
                defaults: dict[str, object] | None = None, as_of: _dt.date | str | None = None,
                high_water: int | None = None) -> DataFrame:
    """Append rows with defaults and keys numbered after the current maximum.

    ``order_by`` (columns of ``new``) fixes the insertion order. ``high_water``
    is a stored last-issued key; without it numbering continues from max(key)
    of ``base``, which can reuse ids of deleted top rows (T16).
    """
    fields = [f for f in base.schema.fields if f.name != key]
    order_cols = [f"_o{i}" for i in range(len(order_by))]
    staged = new.select(*[F.col(c).alias(o) for c, o in zip(order_by, order_cols)],
                        *[_filled(new, f, defaults or {}, as_of) for f in fields])
    if high_water is not None:
        start = F.lit(high_water).cast("bigint")
    else:
        start = F.coalesce(base.select(F.max(key)).scalar(), F.lit(0)).cast("bigint")
    keyed = sequential_keys(staged, order_cols, start, key)
    return base.unionByName(keyed.select(*base.columns))


def _apply(base: DataFrame, changes: DataFrame, keys: Sequence[str],
           setters: dict[str, Column]) -> DataFrame:
    """Left join one change row per key; matched rows take the setter values.

    A marker column (not the new value) decides, so a change may set NULL.
    """
    marked = changes.withColumn("_hit", F.lit(True))
    renamed = marked.select(*keys, "_hit", *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in keys])
    joined = base.join(renamed, list(keys), "left")
    cols = []
    for f in base.schema.fields:
        if f.name in setters:
            cols.append(F.when(F.col("_hit"), setters[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return joined.select(*cols)


def update_rows(base: DataFrame, changes: DataFrame, key: str | Sequence[str], cols: Sequence[str],
                order_by: Sequence[str] | None = None) -> ChangeResult:
    """Set ``cols`` of the rows whose key matches; unmatched changes are returned.

    Several changes for one key: the one with the greatest ``order_by`` wins
    (without ``order_by`` the pick is by value, still deterministic).
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = list(order_by or [])
    latest = latest_per_key(changes.select(*keys, *order, *cols), keys, order or list(cols))
    applied = latest.select(*keys, *cols)
    table = _apply(base, applied, keys, {c: F.col(f"_new_{c}") for c in cols})
    rejected = latest.join(base.select(*keys), keys, "left_anti")
    return ChangeResult(table, rejected)


def update_stock(stock: DataFrame, changes: DataFrame, as_of: _dt.date | str | None = None,
                 seq: str = "seq") -> ChangeResult:
    """Absolute stock quantity per (ProductID, WarehouseID); never inserts.

    The latest change per pair (greatest ``seq``) wins. LastUpdated becomes
    ``as_of``, or the change's own ``as_of`` column when no date is passed.
    Changes for pairs without a stock row come back as ``rejected`` (T17).
    """
    keys = list(STOCK_KEY)
    date_cols = [] if as_of is not None else ["as_of"]
    latest = latest_per_key(changes.select(*keys, seq, "QuantityOnHand", *date_cols), keys, [seq])
    date = F.lit(as_of).cast("date") if as_of is not None else F.col("_new_as_of")
    table = _apply(stock, latest.drop(seq), keys,
                   {"QuantityOnHand": F.col("_new_QuantityOnHand"), "LastUpdated": date})
    rejected = latest.join(stock.select(*keys), keys, "left_anti")
    return ChangeResult(table, rejected)


def _plain(ids: DataFrame) -> DataFrame:
    """``ids`` dealt anew, so that the join shuffles both sides itself and AQE may split a hot key.

    Where the ids come from an aggregate, the join would else reuse its
    partitioning. Repeated ids do no harm in an anti join.
    """
    return ids.hint("rebalance")


def delete_products(t: Tables, ids: DataFrame) -> Tables:
    """Remove products with their order lines and stock rows.

    Orders stay, even with no lines left; their TotalAmount is unchanged.
    """
    gone = _plain(ids.select("ProductID"))
    return t.replace(
        order_detail=t.order_detail.join(gone, "ProductID", "left_anti"),
        stock=t.stock.join(gone, "ProductID", "left_anti"),
        product=t.product.join(gone, "ProductID", "left_anti"),
    )


def delete_orders(t: Tables, ids: DataFrame) -> Tables:
    """Remove orders with their lines; stock is not given back."""
    gone = _plain(ids.select("OrderID"))
    return t.replace(
        order_detail=t.order_detail.join(gone, "OrderID", "left_anti"),
        sales_order=t.sales_order.join(gone, "OrderID", "left_anti"),
    )


def removed_lines(t: Tables, products: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """The order lines that W4 (of ``products``) and W5 (of ``orders``) take away, each once."""
    left, parts = t.order_detail, []
    for ids, key in ((products, "ProductID"), (orders, "OrderID")):
        if ids is not None:
            gone = _plain(ids.select(key))
            parts.append(left.join(gone, key, "left_semi").select(*t.order_detail.columns))
            left = left.join(gone, key, "left_anti")
    return reduce(DataFrame.unionByName, parts) if parts else left.limit(0)


# Input rules of the entry forms (a NULL in a nullable column passes, as a CHECK does).
def product_rules() -> dict[str, Column]:
    return {
        "name_blank": F.coalesce(C.not_blank("ProductName"), F.lit(False)),
        "price_below_1": F.coalesce(F.col("UnitPrice") >= 1, F.lit(False)),
        "reorder_below_1": F.coalesce(F.col("ReorderLevel") >= 1, F.lit(False)),
        "lead_time_below_1": F.col("LeadTimeDays").isNull() | (F.col("LeadTimeDays") >= 1),
    }


def order_rules() -> dict[str, Column]:
    return {
        "customer_blank": F.coalesce(C.not_blank("CustomerName"), F.lit(False)),
        "status_unknown": F.coalesce(F.col("Status").isin(*schemas.ORDER_STATUSES), F.lit(False)),
    }


def stock_rules() -> dict[str, Column]:
    return {"quantity_below_0": F.coalesce(F.col("QuantityOnHand") >= 0, F.lit(False))}


def order_id_rules() -> dict[str, Column]:
    return {"order_id_below_1": F.coalesce(F.col("OrderID") >= 1, F.lit(False))}


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split a change batch into accepted rows and rejected rows with reasons."""
    failed = F.filter(
        F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]),
        lambda x: x.isNotNull(),
    )
    tagged = df.withColumn("_failed", failed)
    accepted = tagged.where(F.size("_failed") == 0).drop("_failed")
    rejected = tagged.where(F.size("_failed") > 0).withColumnRenamed("_failed", "reasons")
    return accepted, rejected


_not_null = collisions.all_present


def _drop_colliding(rows: DataFrame, other: DataFrame, unique_keys: Sequence[Sequence[str]]) -> DataFrame:
    # Plain key projections on the probe side keep both join inputs plain
    # shuffles, so AQE can split a key value that many rows share; repeated
    # keys in ``other`` do not change an anti join.
    for k in unique_keys:
        rows = rows.join(other.select(*k).where(_not_null(k)), list(k), "left_anti")
    return rows


def append_ignore(base: DataFrame, new: DataFrame, unique_keys: Sequence[Sequence[str]],
                  order_by: Sequence[str],
                  parents: Sequence[tuple[str, DataFrame, str]] = (),
                  checks: Column | None = None,
                  defaults: dict[str, object] | None = None,
                  as_of: _dt.date | str | None = None) -> ChangeResult:
    """INSERT IGNORE for a batch: skip rows colliding on any unique key.

    ``unique_keys`` lists the primary key and every UNIQUE key. A row is
    skipped when it collides with ``base`` or with an earlier accepted row of
    the batch (``order_by`` gives the batch order and must be unique and
    non-NULL per row), when a foreign key in ``parents`` (column, parent table, parent
    key column) has no parent, or when ``checks`` is false. NULL key parts never
    collide. Columns absent from ``new`` take ``defaults`` (else NULL).
    Running the same batch twice changes nothing.
    """
    order = list(order_by)
    cand = new
    for col, parent, pcol in parents:
        # distinct: no declared key keeps a parent's key from repeating
        present = parent.select(F.col(pcol).alias("_parent")).where("_parent IS NOT NULL").distinct().hint("rebalance")
        cand = cand.join(present, cand[col] == present["_parent"], "left").where(
            F.col(col).isNull() | F.col("_parent").isNotNull()).drop("_parent")
    if checks is not None:
        cand = cand.where(F.coalesce(checks, F.lit(True)))
    cand = _drop_colliding(cand, base, unique_keys)

    if len(unique_keys) == 1:
        k = list(unique_keys[0])
        placed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in order])
        unplaced = F.raise_error(F.lit("order_by columns must be non-NULL")).cast("boolean")
        cand = cand.where(F.when(placed, F.lit(True)).otherwise(unplaced))
        keyed = cand.where(_not_null(k))
        accepted = latest_per_key(keyed, k, order, first=True).unionByName(cand.where(~_not_null(k)))
    else:
        accepted = _first_wins_multi(cand, unique_keys, order)
    rejected = new.join(accepted.select(*order), order, "left_anti")
    shaped = accepted.select(*[_filled(accepted, f, defaults or {}, as_of) for f in base.schema.fields])
    return ChangeResult(base.unionByName(shaped), rejected)


def _round(undecided: DataFrame, unique_keys: Sequence[Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, still undecided): rows that are earliest on all of their keys win, those that collide with a winner go.

    "Earliest on key k" is found without joining on k: the least number per
    key value is an aggregate (map-side combined), and the numbers are joined
    back, one row each, so that join is balanced whatever the key
    distribution. Collision removal is an anti join on plain key projections,
    which AQE can split.
    """
    flagged, earliest = undecided, F.lit(True)
    for i, k in enumerate(unique_keys):
        firsts = (undecided.where(_not_null(k)).groupBy(*k).agg(F.min("_n").alias("_n"))
                  .select("_n", F.lit(True).alias(f"_first{i}")))
        flagged = flagged.join(firsts, "_n", "left")
        earliest = earliest & (~_not_null(k) | F.col(f"_first{i}").isNotNull())
    winners = flagged.where(earliest).select(*undecided.columns).checkpoint(eager=True)
    rest = undecided.join(winners.select("_n"), "_n", "left_anti")
    return winners, _drop_colliding(rest, winners, unique_keys).checkpoint(eager=True)


def _first_wins_multi(cand: DataFrame, unique_keys: Sequence[Sequence[str]], order: list[str],
                      group_rows: int = collisions.GROUP_ROWS) -> DataFrame:
    """Sequential INSERT IGNORE semantics with several unique keys (H2).

    1. The rows are numbered in batch order. One round accepts the rows that
       are earliest on all of their keys and drops what collides with them;
       that settles most rows, a value that many rows share among them.
    2. What is left is split into collision components
       (``operators.collisions``); each is resolved in order on its own, in a
       number of jobs that does not grow with its chains.
    3. Components of more than ``group_rows`` rows go on in rounds; the
       earliest undecided row always wins, so every round makes progress.
    """
    placed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in order])
    unplaced = F.raise_error(F.lit("order_by columns must be non-NULL")).cast("boolean")
    numbered = sequential_keys(cand.where(F.when(placed, F.lit(True)).otherwise(unplaced)), order, F.lit(0), "_n")
    accepted, undecided = _round(numbered, unique_keys)
    if not undecided.isEmpty():
        members = collisions.components(collisions.key_numbers(undecided, unique_keys, "_n"), "_n").checkpoint(eager=True)
        large = members.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group_rows).select("root")
        large = large.checkpoint(eager=True)
        gone = collisions.refused(members.join(large, "root", "left_anti"), "_n")
        waiting = members.join(large.hint("rebalance"), "root", "left_semi").select("_n")
        apart = undecided.join(gone.unionByName(waiting), "_n", "left_anti")
        accepted = accepted.unionByName(apart.checkpoint(eager=True))
        undecided = undecided.join(waiting, "_n", "left_semi").checkpoint(eager=True)
    while not undecided.isEmpty():
        winners, undecided = _round(undecided, unique_keys)
        accepted = accepted.unionByName(winners)
    return accepted.drop("_n")


def evolve(df: DataFrame, column: str, dtype: str | T.DataType, default: object = None) -> DataFrame:
    """Q-DDL2: add a column if absent; existing rows get the default (MySQL behaviour)."""
    if column in df.columns:
        return df
    return df.withColumn(column, F.lit(default).cast(dtype))
