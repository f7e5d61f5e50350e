"""Substring search of product names by trigram postings.

``ILIKE '%term%'`` reads every name. Here an index maps each three letters in a
row ("gram") of the lower-cased names to the products that have them. A term's
products have all of its grams, so a search intersects a few postings lists,
joins the survivors to the catalogue and verifies them with ``ILIKE``: a gram
may stand elsewhere in the name, so survivors are candidates only.

The index is written in gram order, so the files' statistics keep a search from
reading other grams' postings. A search term may hold the wildcards ``%`` and
``_`` as the catalogue search does; the letters between them give the grams.
Where no three letters stand together there is nothing to look up, and the
search is the scan of ``reports.product_search``. NULL names are in no posting
and match nothing, as in the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.plans import reports
from shelfmark.sources.tables import Tables, write_version

GRAM = 3
POSTINGS = "gram string, ProductID bigint"


def postings(product: DataFrame) -> DataFrame:
    """``gram, ProductID``: each distinct gram of each name once."""
    name = F.lower("ProductName")
    starts = F.sequence(F.lit(1), F.length("name") - (GRAM - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("name"), i, F.lit(GRAM))))
    return product.select("ProductID", name.alias("name")).where(F.length("name") >= GRAM).select(F.explode(grams).alias("gram"), "ProductID")


def save_index(product: DataFrame, root: str) -> str:
    """Write the postings as a new version under ``root``, in gram order; returns its path.

    Products of one gram are spread over ranges by their id, so a gram that a
    third of the names have is not one task's.
    """
    ordered = postings(product).repartitionByRange("gram", "ProductID").sortWithinPartitions("gram", "ProductID")
    return write_version(ordered, root)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(path)


def grams_of(spark: SparkSession, term: str, escape: bool = False) -> list[str]:
    """The grams that a name with ``term`` must have; none for a term without three letters in a row.

    The engine lower-cases the term as it does the names, so both agree.
    """
    (low,) = spark.range(1).select(F.lower(F.lit(term))).first()
    if "\\" in low and not escape:  # the pattern's own escape character: leave it to the scan
        return []
    runs = [low] if escape else re.split("[%_]", low)
    return sorted({run[k:k + GRAM] for run in runs for k in range(len(run) - GRAM + 1)})


def candidates(index: DataFrame, grams: list[str]) -> DataFrame:
    """``ProductID`` of the products that have every gram."""
    found = index.where(F.col("gram").isin(*grams))
    return found.groupBy("ProductID").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("ProductID")


def _narrowed(t: Tables, index: DataFrame, term: str, escape: bool) -> Tables:
    grams = grams_of(index.sparkSession, term, escape)
    if not grams:
        return t
    return t.replace(product=t.product.join(candidates(index, grams), "ProductID", "left_semi"))


def product_search(t: Tables, index: DataFrame, term: str = "", min_price=None, max_price=None,
                   escape: bool = False, sort: bool = True) -> DataFrame:
    """R8 by the index: the rows of ``reports.product_search``."""
    return reports.product_search(_narrowed(t, index, term, escape), term, min_price, max_price, escape, sort)


def product_catalogue(t: Tables, index: DataFrame, term: str = "", min_price=None, max_price=None,
                      escape: bool = False, sort: bool = True) -> DataFrame:
    """R9 by the index: the rows of ``reports.product_catalogue``."""
    return reports.product_catalogue(_narrowed(t, index, term, escape), term, min_price, max_price, escape, sort)


def search_report(t: Tables, index: DataFrame, terms: DataFrame) -> DataFrame:
    """For each of many ``terms`` (column ``term``, no wildcards): candidates looked at and products found.

    All terms in one job: a term is looked up by its grams, its candidates
    share them all, and a name is verified once per candidate. Terms shorter
    than a gram are left out (``product_search`` scans for them).
    """
    low = F.lower("term")
    starts = F.sequence(F.lit(1), F.length("low") - (GRAM - 1))
    asked = terms.select("term", low.alias("low")).distinct().where(F.length("low") >= GRAM)
    asked = asked.select("term", "low", F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("low"), i, F.lit(GRAM)))).alias("grams"))
    wanted = asked.select("term", "low", F.size("grams").alias("need"), F.explode("grams").alias("gram"))
    held = wanted.join(index, "gram").groupBy("term", "low", "need", "ProductID").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    named = held.join(t.product.select("ProductID", F.lower("ProductName").alias("name")), "ProductID")
    hits: Column = F.count_if(F.contains("name", "low"))
    counted = named.groupBy("term").agg(F.count(F.lit(1)).alias("Candidates"), hits.alias("ProductsFound"))
    return asked.select("term").join(counted, "term", "left").select(
        "term", *[F.coalesce(c, F.lit(0)).cast(C.COUNT_SUM).alias(c) for c in ("Candidates", "ProductsFound")])
