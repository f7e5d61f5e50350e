"""Chat formatting by prefix-target expansion (operator 1).

Every assistant turn becomes an example of its own (``expanded``): a row with
the whole text of all turns before it, as context, and of that reply, which
alone carries loss. What is trained on is read back from these texts: the loss
range counts from the start of the context, so a context that lacks or gains
anything gives another loss. ``examples`` are the ranges alone.

The texts of a conversation's examples together are as long as its length
times half its replies, as the method has it. They are never shuffled, sorted
or written: they stream from the window that makes them to the reading back,
one at a time. The time for one very long conversation grows with its square.

The template marks turns with control strings. Those inside texts and roles,
and those of other common templates, are broken by a backslash; backslashes
are doubled, so ``unescaped`` restores every text.

Turns are ordered by ``turn`` (null first), then role and text; repeated rows
are turns of their own. Null text and role count as empty, a null ``conv_id``
is a conversation of its own. Conversations without an assistant turn have
segments but no example. An empty table gives no rows. Other columns are left
behind. The turns of a conversation meet in one task, sorted (a sort that
spills); the windows over them and the digests stream and hold one turn.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import ship_package

START, SEPARATOR, END = "<|turn|>", "<|says|>", "<|over|>"
#: Fixed control strings of common chat templates; ``<|`` covers the whole family that it opens, this template's own too.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """``text`` without control strings."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id, position, segment, char_start, is_target, loss_start, loss_end, example``.

    ``char_start`` places the segment in the conversation's formatted text
    (code points); ``loss_start`` and ``loss_end`` place the reply of a
    target (an assistant turn) there, and ``example`` numbers the targets of
    a conversation from 1; these are null for other turns.
    """
    empty = F.lit("")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEPARATOR))
    turns = turns.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    turns = turns.withColumn("segment", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("*", (F.row_number().over(order) - 1).cast("long").alias("position"),
                         F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).cast("long").alias("char_start"),
                         (F.col("role") == "assistant").alias("is_target"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("example", F.when(F.col("is_target"), F.count_if("is_target").over(upto)))
    reply = F.when(F.col("is_target"), F.col("char_start") + F.length("head"))
    return turns.select("conv_id", "position", "segment", "char_start", "is_target",
                        reply.alias("loss_start"), (reply + F.length("body")).alias("loss_end"), "example")


def expanded(formatted: DataFrame) -> DataFrame:
    """The segments and, after each target's, its example (``is_example``), with ``text``, ``context_start`` and ``context_end``.

    ``text`` is the whole example, its context and its reply's segment; it is
    null for segments. Rows keep their order, so nothing is shuffled.
    """
    upto = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = F.when(F.col("is_target"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    whole = F.when(F.col("is_target"), F.array_join(F.collect_list("segment").over(upto), ""))
    rows = formatted.withColumn("text", whole).withColumn("is_example", F.explode(kinds))
    begin = F.when(F.col("is_example"), F.lit(0).cast("long"))
    return rows.withColumns({"text": F.when(F.col("is_example"), F.col("text")), "context_start": begin,
                             "context_end": F.when(F.col("is_example"), F.col("char_start"))})


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, position, context_start, context_end, loss_start, loss_end``.

    The ranges are code points of the conversation's formatted text: all turns
    before the reply, and the reply.
    """
    return expanded(formatted).filter("is_example").select(
        "conv_id", "example", "position", "context_start", "context_end", "loss_start", "loss_end")


def inline_examples(formatted: DataFrame) -> DataFrame:
    """One row per example with its whole text: ``conv_id, position, text, loss_start, loss_end``."""
    return expanded(formatted).filter("is_example").select("conv_id", "position", "text", "loss_start", "loss_end")


def read_back(rows: DataFrame) -> DataFrame:
    """What the formatted segments and the examples hold: ``conv_id, position, role, text, loss_text, formatted_chars``.

    ``rows`` are segments or what ``expanded`` makes of them. A segment's row
    has its ``role``, ``text`` and length; an example's row has the
    ``loss_text`` that the loss range covers in its whole text. All are unescaped.
    """
    formatted = rows if "is_example" in rows.columns else expanded(rows)
    body = F.expr(f"substring(segment, {len(START) + 1}, length(segment) - {len(START) + len(END)})")
    cut = F.locate(SEPARATOR, F.col("body"))
    masked = F.expr("substring(text, CAST(loss_start AS INT) + 1, CAST(loss_end - loss_start AS INT))")
    turn = ~F.col("is_example")
    return formatted.withColumn("body", body).select(
        "conv_id", "position", F.when(turn, unescaped(F.substring(F.col("body"), F.lit(1), cut - 1))).alias("role"),
        F.when(turn, unescaped(F.substring(F.col("body"), cut + len(SEPARATOR), F.length("body")))).alias("text"),
        F.when(~turn, unescaped(masked)).alias("loss_text"), F.when(turn, F.length("segment")).otherwise(0).cast("long").alias("formatted_chars"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of what ``read_back`` gives.

    Digests need the turns of a conversation in order: they stream through
    one task, which holds a turn at a time.
    """
    def run(frames):
        open_id, state = None, None

        def closed():
            return (open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for frame in frames:
            done = []
            ids = frame["conv_id"].astype("Int64")
            for conv, role, text, loss, chars in zip(ids, frame["role"], frame["text"], frame["loss_text"], frame["formatted_chars"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if state is None or conv != open_id:
                    if state is not None:
                        done.append(closed())
                    open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if text is not None:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += chars
            yield _digest_frame(done)
        if state is not None:
            yield _digest_frame([closed()])

    ship_package(turns.sparkSession)
    return turns.sortWithinPartitions("conv_id", "position").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})
