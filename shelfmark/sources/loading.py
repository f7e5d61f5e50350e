"""Loading the model (E5): declared schemas, every check, then new table versions.

The source runs a script of statements against a database and prints errors
as it goes. Here the seven tables are scanned as stored, values that do not
fit their declared type are set aside (``sources.typed_load``), and the rest
is checked and written as new version directories; switching readers to the
new versions is the caller's step once every write has finished.

``checked_load`` gives the report of all checks before anything is written,
one job per check. ``publish_checked`` counts what a single row can break
(C3-C5) while the versions are written, so each table is read once for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from shelfmark.operators import quality
from shelfmark.sources.tables import Tables, tables_of, write_version
from shelfmark.sources.typed_load import misfit_summary, typed_load


def checked_load(spark: SparkSession, root: str, fmt: str = "parquet",
                 options: dict[str, str] | None = None) -> tuple[Tables, DataFrame]:
    """The tables with their declared types and the full quality report (lazy).

    Rows with a value that does not fit are left out of the tables; the report
    has a ``declared_type`` row for each column and reason that occurs
    (``typed_load`` gives the values themselves).
    """
    t, quarantine = typed_load(spark, root, fmt, options)
    return t, quality.report(t).unionByName(misfit_summary(quarantine))


def publish(t: Tables, root: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each table as a new version under ``{root}/{TableName}``; returns the paths."""
    return {name: write_version(df, f"{root.rstrip('/')}/{name}", fmt) for name, df in t.items()}


def publish_checked(t: Tables, root: str, fmt: str = "parquet") -> tuple[dict[str, str], DataFrame]:
    """Write each table as a new version and report on it; returns the paths and the report.

    The counts of C3, C4 and C5 are observed on the rows as they are written,
    so they describe the very rows of the new version and cost no scan of
    their own. C1 and C2 compare rows with each other; they read the written
    versions, and so does whoever switches to them.
    """
    spark = t.product.sparkSession
    paths, counted = {}, []
    for name, df in t.items():
        checks = quality.row_checks(name, df)
        observed = Observation(f"checks of {name}")
        if checks:
            df = df.observe(observed, *[c.count.alias(f"c{k}") for k, c in enumerate(checks)])
        paths[name] = write_version(df, f"{root.rstrip('/')}/{name}", fmt)
        if checks:
            counts = observed.get
            counted += [(c.check_name, name, c.detail, int(counts[f"c{k}"])) for k, c in enumerate(checks)]
    written = tables_of({name: spark.read.format(fmt).schema(t.by_name(name).schema).load(path) for name, path in paths.items()})
    between = quality.between_rows(written)
    # one row per declared constraint
    return paths, between.unionByName(spark.createDataFrame(counted, between.schema))
