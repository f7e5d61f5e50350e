"""Corpus pipeline: documents -> clean, deduplicated, packed training sequences.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and works on
all rows that the stage before it kept. All but the last return the columns of
``docs``:

1. language ID drops documents in no learned language (null or no letter);
2. exact dedup keeps one row of each text;
3. near dedup keeps the smallest ``doc_id`` of each SimHash component;
4. the secret scan replaces secrets in the texts;
5. packing returns the token pieces of every sequence.

Null, empty and repeated rows are handled as the operators' docstrings say; an
empty table gives empty tables. Further columns pass through stages 1 to 4.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import exact_dedup, lang_crossparse, secret_grammar, simhash_pivots, window_packing
from shelfmark.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_crossparse.keep_documents(docs, lang_crossparse.samples(docs, F.lit(True)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_pivots.keep_documents(docs, shingle=3, max_bits=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_grammar.redact_documents(docs, secret_grammar.learn(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return window_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("secret_scan", secrets), ("packing", packing)]

#: SQL has no automata, XXH64 or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
