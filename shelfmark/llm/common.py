"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

#: Upper-case ASCII letters and what they become; other letters keep their case.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


@functools.lru_cache(maxsize=None)
def _package_zip() -> str:
    package = Path(__file__).resolve().parents[1]
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='shelfmark-')}/shelfmark-package", "zip", package.parent, package.name)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it (once for each application)."""
    sc = spark.sparkContext
    if _shipped.get("application") != sc.applicationId:
        sc.addPyFile(_package_zip())
        _shipped["application"] = sc.applicationId


_shipped: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text`` (null: empty); every other column is left behind."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id written as text, modulo ``buckets`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(buckets))


def give_back() -> None:
    """Return what a worker has freed to the system: workers go on to other stages, and their allocators keep free memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which does so by itself
        pass


_held: dict = {}


def worker_model(key, build):
    """The model that a Python worker holds. A worker serves one operator after the other, so another model takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder (``spark.checkpoint.dir``) and read back.

    Cuts the lineage: a lost executor costs a re-read of the files, not the
    work before them. The files stay until the folder is cleared, as the lazy
    result still reads them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
