"""Exact deduplication by skew-safe combining (operator 2).

Texts are equal when identical after lower-casing A-Z only. Three combining
stages, each grouping by digest *and* whole text, so a digest only places
rows and full content decides:

1. local: every map task folds its own copies of a text (the map side of the
   salted aggregate), so a hot text leaves a task at most once for each salt;
2. salted: the copies of a digest and salt meet, spread over ``salts`` groups;
3. global: the salt winners of a digest meet, at most ``salts`` rows a text.

The winners (digest, id, count; no text) are written once to the shared
folder and joined back to the documents by digest. Where different texts share
a digest, their winners keep the text and the join compares it too. The
documents' side of that join is a plain scan, which adaptive execution can
split where one digest is hot.

Null text counts as empty; empty texts are equal to each other. Repeated rows
count each in ``group_size``; rows that repeat both id and text are one
document (each gets the same answer; ``keep_documents`` returns it once). A
null ``doc_id`` loses to any other; a group of null ids alone keeps one row.
An empty table gives no rows. Input columns with any names are left behind
(``exact_duplicates``) or returned unchanged (``keep_documents``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, text_rows, written

#: Groups that the copies of one digest are spread over before they meet.
SALTS = 16

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def winners(docs: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """One row per distinct text: ``digest, keep_id, group_size``, and ``norm`` (the text) only where its digest has several."""
    rows = text_rows(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    rows = rows.select(digest(F.col("norm")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "norm", "doc_id")
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    # dealt by digest alone: the same rows then meet for the count of texts per digest
    merged = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    alone = F.count("*").over(Window.partitionBy("digest")) == 1
    return written(merged.select("digest", "keep_id", "group_size", F.when(~alone, F.col("norm")).alias("norm")), "dedup-winners")


def _shared_digests(won: DataFrame) -> bool:
    """Whether different texts share a digest, so that joins must carry the texts."""
    return not won.filter("norm IS NOT NULL").isEmpty()


def _same_text(won: DataFrame, digest: Column, norm: Column, shared: bool) -> Column:
    same = digest == won.digest
    return same & (F.coalesce(won.norm, norm) == norm) if shared else same


def exact_duplicates(docs: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """One row per document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    won = winners(docs, salts, digest)
    rows = text_rows(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm_d"))
    rows = rows.select("doc_id", "norm_d", digest(F.col("norm_d")).alias("digest_d"), sha256(F.col("norm_d")).alias("sha"))
    found = rows.join(won, _same_text(won, rows.digest_d, rows.norm_d, _shared_digests(won)))
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_documents(docs: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns."""
    won = winners(docs, salts, digest)
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), digest(norm).alias("digest_d"), norm.alias("norm_d"))
    shared = _shared_digests(won)
    stay = rows.join(won, _same_text(won, rows.digest_d, rows.norm_d, shared) & F.expr("row.doc_id <=> keep_id"), "left_semi")
    # what is left of a text repeats one id: one of those rows
    return stay.dropDuplicates(["digest_d", "norm_d"] if shared else ["digest_d"]).select("row.*")
