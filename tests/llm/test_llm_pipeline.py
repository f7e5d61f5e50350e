"""The pipeline's stages against brute force, and odd tables through all of them."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_llm_operators import component_by_hand, fingerprint_by_hand, lower
from tokenizers import Tokenizer

from shelfmark.llm import lang_crossparse, secret_grammar

SF = "/root/testdata/sf0.001"


def test_each_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 90_000).withColumn("text", F.lit("12 34 !!"))
    docs = docs.unionByName(odd).unionByName(odd.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 7))
    rows = {r.doc_id: r for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, SF).cache()
        after = {r.doc_id: r for r in now.collect()}
        assert now.columns == docs.columns and now.count() == len(after)
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if lang_crossparse.words_of(r.text or "")}
        elif name == "exact_dedup":
            keep = defaultdict(lambda: -1)
            for i, r in before.items():
                keep[lower(r.text)] = max(keep[lower(r.text)], i)
            assert set(after) == set(keep.values())
        elif name == "simhash_near_dedup":
            ids = list(before)
            assert set(after) == set(component_by_hand(ids, [fingerprint_by_hand(before[i].text) for i in ids]))
        else:
            grammar = secret_grammar.learn(spark.createDataFrame(list(before.values()), docs.schema))
            assert {i: r.text for i, r in after.items()} == {i: secret_grammar.redacted(r.text, grammar) for i, r in before.items()}
            assert not any(secret_grammar.base_spans(r.text) for r in after.values() if "token" not in r.text)
        if name != "secret_scan":
            assert all(after[i] == rows[i] for i in after)
    texts = {r.doc_id: r.text for r in now.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    lengths = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumn("keep_id", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0, name
        if name != "packing":
            assert none.columns[-1] == "keep_id"
