"""Data-quality checks (C1-C5): the declared constraints, checked over whole tables.

Each ``check_*`` returns the violating rows (or keys); each ``*_summary``
returns one row per checked constraint with its violation count, so a clean
table still yields a row with 0.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.sources.tables import Tables


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _present(df: DataFrame, cols: Sequence[str]) -> bool:
    return all(c in df.columns for c in cols)


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their row count.

    Rows with a NULL key part are ignored (several NULLs are allowed).
    """
    cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    # The parent side is a plain key projection (unique by its primary key), so
    # AQE can split a parent key that a third of the child rows reference.
    parents = parent.select(F.col(parent_column).alias(column))
    return child.where(F.col(column).isNotNull()).join(parents, column, "left_anti")


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any of ``cols``, with the names of those columns."""
    nulls = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return df.withColumn("null_columns", nulls).where(F.size("null_columns") > 0)


def check_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """C4: rows whose value is outside ``allowed``; NULL passes, as a CHECK does."""
    return df.where(~F.col(column).isin(*allowed))


def check_length(df: DataFrame, column: str, max_length: int) -> DataFrame:
    """Text longer than its VARCHAR limit."""
    return df.where(F.length(column) > max_length)


def check_decimal(df: DataFrame, column: str, precision: int, scale: int) -> DataFrame:
    """Values that do not fit DECIMAL(precision, scale) (try_cast gives NULL)."""
    fits = F.col(column).try_cast(f"decimal({precision},{scale})")
    exact = fits == F.col(column)
    return df.where(F.col(column).isNotNull() & (fits.isNull() | ~exact))


def unique_summary(t: Tables) -> DataFrame:
    """C1 over every declared key present: duplicated key values and surplus rows."""
    rows = []
    for name, df in t.items():
        keys = [schemas.PRIMARY_KEYS[name], *schemas.UNIQUE_KEYS.get(name, ())]
        for k in keys:
            if not _present(df, k):
                continue
            dup = check_unique(df, k).agg(
                F.count(F.lit(1)).alias("duplicate_keys"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"))
            rows.append(dup.select(F.lit(name).alias("table_name"), F.lit(",".join(k)).alias("key_columns"),
                                   "duplicate_keys", "surplus_rows"))
    return _union(rows)


def unchecked_keys(t: Tables) -> list[tuple[str, str]]:
    """(table, key columns) of the declared keys whose columns are absent, which C1 cannot check."""
    return [(name, ",".join(k)) for name, df in t.items()
            for k in [schemas.PRIMARY_KEYS[name], *schemas.UNIQUE_KEYS.get(name, ())] if not _present(df, k)]


def foreign_key_summary(t: Tables) -> DataFrame:
    """C2 over the six declared foreign keys: orphan rows per key."""
    rows = []
    for child, col, parent, pcol in schemas.FOREIGN_KEYS:
        orphans = check_foreign_key(t.by_name(child), col, t.by_name(parent), pcol)
        rows.append(orphans.agg(F.count(F.lit(1)).alias("orphan_rows")).select(
            F.lit(child).alias("child_table"), F.lit(col).alias("column_name"),
            F.lit(parent).alias("parent_table"), "orphan_rows"))
    return _union(rows)


def not_null_summary(t: Tables) -> DataFrame:
    """C3 over every NOT NULL column present: NULL count per column (one pass per table)."""
    rows = []
    for name, df in t.items():
        cols = [c for c in schemas.NOT_NULL[name] if c in df.columns]
        if not cols:
            continue
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        stacked = counts.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("null_rows")) for c in cols
        ])).alias("s")).select("s.*")
        rows.append(stacked.select(F.lit(name).alias("table_name"), "column_name", "null_rows"))
    return _union(rows)


def values_summary(t: Tables) -> DataFrame:
    """C4: rows with a status outside the allowed list."""
    bad = check_values(t.sales_order, "Status", schemas.ORDER_STATUSES)
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("SalesOrder").alias("table_name"), F.lit("Status").alias("column_name"), "violations")


def length_summary(t: Tables) -> DataFrame:
    """Per limited text column, rows longer than the limit and the longest value."""
    rows = []
    for name, limits in schemas.MAX_LENGTHS.items():
        df = t.by_name(name)
        cols = [c for c in limits if c in df.columns]
        if not cols:
            continue
        agg = df.agg(*[F.struct(F.count_if(F.length(c) > limits[c]).cast("bigint").alias("too_long"),
                                F.coalesce(F.max(F.length(c)), F.lit(0)).alias("max_length")).alias(c)
                       for c in cols])
        stacked = agg.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(limits[c]).alias("limit"),
                     F.col(f"{c}.too_long").alias("too_long"), F.col(f"{c}.max_length").alias("max_length"))
            for c in cols])).alias("s")).select("s.*")
        rows.append(stacked.select(F.lit(name).alias("table_name"), "column_name", "limit", "too_long", "max_length"))
    return _union(rows)


def decimal_summary(t: Tables) -> DataFrame:
    """Per DECIMAL(p, s) column, values that do not fit the declared type."""
    rows = []
    for name, limits in schemas.DECIMAL_LIMITS.items():
        df = t.by_name(name)
        for c, (p, sc) in limits.items():
            if c not in df.columns:
                continue
            bad = check_decimal(df, c, p, sc)
            rows.append(bad.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "violations"))
    return _union(rows)


@dataclasses.dataclass(frozen=True)
class RowCheck:
    """A constraint that a single row can break: ``count`` is the aggregate that counts such rows."""

    check_name: str
    detail: str
    count: Column


def row_checks(name: str, df: DataFrame) -> list[RowCheck]:
    """C3-C5 of a table as aggregates over its rows, for one pass over it."""
    found = [RowCheck("not_null", c, F.count_if(F.col(c).isNull())) for c in schemas.NOT_NULL[name] if c in df.columns]
    if name == "SalesOrder" and "Status" in df.columns:
        found.append(RowCheck("allowed_values", "Status", F.count_if(~F.col("Status").isin(*schemas.ORDER_STATUSES))))
    found += [RowCheck("max_length", c, F.count_if(F.length(c) > n))
              for c, n in schemas.MAX_LENGTHS.get(name, {}).items() if c in df.columns]
    for c, (p, sc) in schemas.DECIMAL_LIMITS.get(name, {}).items():
        if c in df.columns:
            fits = F.col(c).try_cast(f"decimal({p},{sc})")
            found.append(RowCheck("decimal", c, F.count_if(F.col(c).isNotNull() & (fits.isNull() | (fits != F.col(c))))))
    return found


def between_rows(t: Tables) -> DataFrame:
    """C1 and C2, which compare rows with each other, as rows of the report.

    A declared key whose columns are absent has a ``unique (not checked)`` row
    with NULL violations.
    """
    parts = [
        unique_summary(t).select(F.lit("unique").alias("check_name"), "table_name",
                                 F.col("key_columns").alias("detail"), F.col("duplicate_keys").alias("violations")),
        foreign_key_summary(t).select(F.lit("foreign_key").alias("check_name"), F.col("child_table").alias("table_name"),
                                      F.concat_ws("->", "column_name", "parent_table").alias("detail"),
                                      F.col("orphan_rows").alias("violations")),
    ]
    skipped = unchecked_keys(t)
    if skipped:
        rows = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(k).alias("detail")) for name, k in skipped])
        parts.append(t.product.sparkSession.range(1).select(F.explode(rows).alias("s")).select(
            F.lit("unique (not checked)").alias("check_name"), "s.table_name", "s.detail",
            F.lit(None).cast("bigint").alias("violations")))
    return _union(parts)


def report(t: Tables) -> DataFrame:
    """All checks C1-C5 as one table: (check_name, table_name, detail, violations).

    C3-C5 of a table are counted in one pass over it.
    """
    parts = [between_rows(t)]
    for name, df in t.items():
        checks = row_checks(name, df)
        if checks:
            counts = df.agg(*[c.count.alias(f"c{k}") for k, c in enumerate(checks)])
            stacked = F.array(*[F.struct(F.lit(c.check_name).alias("check_name"), F.lit(name).alias("table_name"), F.lit(c.detail).alias("detail"),
                                         F.col(f"c{k}").cast("bigint").alias("violations")) for k, c in enumerate(checks)])
            parts.append(counts.select(F.inline(stacked)))
    return _union(parts)
