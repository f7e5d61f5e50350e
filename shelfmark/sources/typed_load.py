"""Two-phase typed load (C5, Q-DDL1): text first, declared types second, misfits set aside.

The source's database refuses a row whose value does not fit its column.
Reading text files with the declared schema would instead raise, or turn the
value into NULL before any check can see it. So the first phase scans every
column as it is stored, and the second casts each one with ``try_cast`` to its
declared type: a row whose values all fit goes on with typed columns, any
other row is quarantined with the column, the value and the reason of each
misfit. Both sides come from one scan each; nothing is collected.

Blank text counts as NULL in columns that are not text, as in the source's
CSV-like loads. Columns that a file lacks are NULL and are not checked for
NOT NULL (the load fills their defaults, or the table has no such key).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schemas
from shelfmark.sources.tables import TABLE_NAMES, Tables, tables_of

#: Formats without column types of their own: every column is read as text.
TEXT_FORMATS = ("csv", "json")

# The reasons of a misfit.
NULL_VALUE, NO_NUMBER, NO_DATE = "null", "not_a_number", "not_a_date"
TOO_LARGE, TOO_FINE, TOO_LONG, NOT_ALLOWED = "out_of_range", "too_many_decimals", "too_long", "not_allowed"

WHOLE = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


class TypedLoad(NamedTuple):
    """The rows that fit, in their declared types, and ``table_name, row_key, column_name, value, reason`` of the misfits."""

    rows: DataFrame
    quarantine: DataFrame


def raw_schema(name: str) -> T.StructType:
    """The table's columns as nullable text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.SCHEMAS[name].fields])


def _misfit(name: str, f: T.StructField, text: Column) -> Column:
    """The reason why ``text`` does not fit the column, or NULL."""
    kind, why = f.dataType, F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        limit = schemas.MAX_LENGTHS.get(name, {}).get(f.name)
        if limit:
            why = F.when(F.length(text) > limit, TOO_LONG)
        if (name, f.name) == ("SalesOrder", "Status"):
            why = F.coalesce(why, F.when(~text.isin(*schemas.ORDER_STATUSES), NOT_ALLOWED))
    elif isinstance(kind, T.DecimalType):
        # the text is cut at the point: no cast rounds or overflows before the check
        whole = F.length(F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), "^0+", ""))
        decimals = F.length(F.regexp_replace(F.regexp_extract(text, r"[.]([0-9]*)$", 1), "0+$", ""))
        why = (F.when(~text.rlike(NUMBER), NO_NUMBER).when(whole > kind.precision - kind.scale, TOO_LARGE)
               .when(decimals > kind.scale, TOO_FINE))
    elif isinstance(kind, T.IntegralType):
        why = F.when(~text.rlike(WHOLE), NO_NUMBER).when(text.try_cast(kind).isNull(), TOO_LARGE)
    elif isinstance(kind, T.DateType):
        why = F.when(~text.rlike(DAY) | text.try_cast(kind).isNull(), NO_DATE)
    missing = F.lit(None).cast("string") if f.nullable else F.lit(NULL_VALUE)
    return F.when(text.isNull(), missing).otherwise(why)


def typed(raw: DataFrame, name: str) -> TypedLoad:
    """Cast the columns of ``raw`` to the declared types of table ``name``; rows with a misfit are set aside.

    A column may be text or have a type of its own already. Columns that
    ``raw`` lacks become NULL. ``row_key`` is the row's primary key as stored,
    or NULL where the table comes without it.
    """
    fields = schemas.SCHEMAS[name].fields
    texts = {}
    for f in fields:
        if f.name in raw.columns:
            text = F.col(f.name).cast("string")
            texts[f.name] = text if isinstance(f.dataType, T.StringType) else F.nullif(F.trim(text), F.lit(""))
    (key,) = schemas.PRIMARY_KEYS[name]
    misfits = F.filter(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"),
                 _misfit(name, f, texts[c]).alias("reason")) for f in fields if (c := f.name) in texts]),
        lambda m: m["reason"].isNotNull())
    tagged = raw.select("*", misfits.alias("_misfits"))
    good = tagged.where(F.size("_misfits") == 0).select(*[
        (texts[f.name] if f.name in texts else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in fields])
    row_key = F.col(key).cast("string") if key in texts else F.lit(None).cast("string")
    bad = tagged.where(F.size("_misfits") > 0).select(
        F.lit(name).alias("table_name"), row_key.alias("row_key"), F.explode("_misfits").alias("m")).select(
        "table_name", "row_key", "m.column_name", "m.value", "m.reason")
    return TypedLoad(good, bad)


def scan_raw(spark: SparkSession, root: str, name: str, fmt: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """Table ``name`` as stored: all text in text formats, else with the types of its files."""
    reader = spark.read.format(fmt).options(**(options or {}))
    if fmt in TEXT_FORMATS:
        reader = reader.schema(raw_schema(name))
    return reader.load(f"{root.rstrip('/')}/{name}")


def typed_load(spark: SparkSession, root: str, fmt: str = "parquet", options: dict[str, str] | None = None) -> tuple[Tables, DataFrame]:
    """The seven tables with their declared types, and the quarantine of all of them (both lazy)."""
    loads = {name: typed(scan_raw(spark, root, name, fmt, options), name) for name in TABLE_NAMES}
    quarantine = None
    for load in loads.values():
        quarantine = load.quarantine if quarantine is None else quarantine.unionByName(load.quarantine)
    return tables_of({name: load.rows for name, load in loads.items()}), quarantine


def misfit_summary(quarantine: DataFrame) -> DataFrame:
    """Quarantined values per table, column and reason, shaped as rows of the quality report."""
    return quarantine.groupBy("table_name", "column_name", "reason").agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("declared_type").alias("check_name"), "table_name", F.concat_ws(": ", "column_name", "reason").alias("detail"), "violations")
