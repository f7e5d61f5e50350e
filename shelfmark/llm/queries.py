"""The thin registered queries of this subpackage: name -> callable(spark, sf_dir) -> DataFrame.

Each applies one operator, with production parameters, to its whole table and
derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    audit_repair,
    bpe_automaton,
    chat_format,
    cover_lloyd,
    exact_dedup,
    lang_crossparse,
    pivot_topk,
    quality_gam,
    secret_grammar,
    simhash_pivots,
    style_tree,
    tensored_minhash,
    window_packing,
)
from shelfmark.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))]
    columns = ["conv_id", "turn", "role", "text"]
    turns = table(spark, sf_dir, "conversations").select(*columns)
    turns = turns.unionByName(spark.createDataFrame(own, turns.schema))
    return chat_format.conversation_digests(chat_format.read_back(chat_format.format_turns(turns)))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_documents(table(spark, sf_dir, "documents"),
                                          public_tokenizers.path("byte_bpe_50k.json"), keep=False)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), quality_gam.is_held_out(F.col("doc_id"))
    return quality_gam.score(docs, quality_gam.learn(docs, table(spark, sf_dir, "labels"), ~held_out), held_out)


def op6_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op7_lang_crossparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lang_crossparse.is_held_out(F.col("doc_id"))
    return lang_crossparse.predict(docs, lang_crossparse.samples(docs, ~held_out), held_out)


def op8_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_grammar.scan(docs, secret_grammar.learn(docs))


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op10_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op11_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_repair.repair(audit_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_cover_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_lloyd.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensored_minhash.components(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def _escaped_sql(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for mark in chat_format.CONTROL:
        sql = f"replace({sql}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return sql


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat_format.START + chat_format.SEPARATOR + chat_format.END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP2_SQL = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY norm)
"""


OP3_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, QueryFn]:
    return {f.__name__: f for f in (op1_chat_format, op2_exact_dedup, op3_pivot_topk, op4_bpe_automaton, op5_quality_gam,
                                     op6_style_tree, op7_lang_crossparse, op8_secret_grammar, op9_simhash_pivots, op10_window_packing,
                                     op11_audit_repair, op12_cover_lloyd, op13_tensored_minhash)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express at this speed; tests hold the others against brute force."""
    return {"op1_chat_format": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_pivot_topk": OP3_SQL}
