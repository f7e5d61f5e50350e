"""Collision components: which rows of a batch can decide each other's fate.

Rows that share a value of a unique key are linked; a row's acceptance depends
on rows of its own connected component only. So components are resolved each
on its own, in batch order, by one pass over their rows, and a long chain of
collisions costs no more jobs than a short one.

A row carries the numbers of its key values, not the values: the number of a
value is the batch number of the first row that has it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpoint_dir

#: Rows of a component that one task resolves at most (a few MB of numbers).
GROUP_ROWS = 100_000


def all_present(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True))


def key_numbers(rows: DataFrame, unique_keys: Sequence[Sequence[str]], number: str) -> DataFrame:
    """``number`` and, as ``_k0, _k1, ...``, the number of each key's value (NULL where a part of the key is)."""
    out = rows.select(number, *{c: None for k in unique_keys for c in k})
    for i, k in enumerate(unique_keys):
        # the first rows are an aggregate: dealt anew, so that AQE may split a value that many rows share
        firsts = rows.where(all_present(k)).groupBy(*k).agg(F.min(number).alias(f"_k{i}")).hint("rebalance")
        out = out.join(firsts, list(k), "left")
    return out.select(number, *[f"_k{i}" for i in range(len(unique_keys))])


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``): the smallest node that it reaches.

    The edges of neighbouring nodes are contracted within tasks first, one
    Arrow batch at a time; then large and small stars alternate until no root
    hangs on another node. Each round is checkpointed.
    """
    def ordered(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()

    def contracted(frames):
        for frame in frames:
            root: dict[int, int] = {}
            for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
                ends = []
                for x in (u, v):
                    path = []
                    while root.get(x, x) != x:
                        path.append(x)
                        x = root[x]
                    for p in path:
                        root[p] = x
                    ends.append(x)
                low, high = min(ends), max(ends)
                root[high] = low
                root.setdefault(u, low)
                root.setdefault(v, low)
            tops = []
            for x in root:
                y = x
                while root[y] != y:
                    y = root[y]
                tops.append(y)
            yield pd.DataFrame({"u": list(root), "v": tops}, dtype="int64")

    def star(e: DataFrame, small: bool) -> DataFrame:
        near = e if small else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        moved = near.join(low.hint("rebalance"), "u")
        if small:
            kept = moved.select(F.col("v").alias("u"), F.col("low").alias("v"))
            return ordered(kept.unionByName(low.select("u", F.col("low").alias("v"))))
        return ordered(moved.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")))

    checkpoint_dir(edges.sparkSession)
    near = edges.repartitionByRange("u").sortWithinPartitions("u").mapInPandas(contracted, "u long, v long")
    now = ordered(near).checkpoint(eager=True)
    while not now.join(now.select(F.col("u").alias("hangs")), F.col("v") == F.col("hangs"), "left_semi").isEmpty():
        now = star(star(now, False), True).checkpoint(eager=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(numbered: DataFrame, number: str) -> DataFrame:
    """The rows of ``key_numbers`` that share a value with another row, with their component's ``root``."""
    keys = [c for c in numbered.columns if c != number]
    links = F.array(*[F.when(F.col(k) < F.col(number), F.col(k)) for k in keys])
    edges = numbered.select(F.col(number).alias("u"), F.explode(links).alias("v")).where("v IS NOT NULL")
    return numbered.join(connected(edges).withColumnRenamed("node", number), number)


def refused(members: DataFrame, number: str) -> DataFrame:
    """The numbers of the rows of whole components that collide with an earlier accepted row of theirs.

    ``members`` has ``root`` and the rows' key numbers. A task streams over
    its components in batch order and holds the key values taken in one.
    """
    keys = [c for c in members.columns if c not in (number, "root")]

    def run(frames):
        root, taken = None, [set() for _ in keys]
        for frame in frames:
            out = []
            columns = [frame[k].astype("Int64").astype(object).where(frame[k].notna(), None) for k in keys]
            for r, n, *values in zip(frame["root"].tolist(), frame[number].tolist(), *columns, strict=True):
                if r != root:
                    root, taken = r, [set() for _ in keys]
                if any(v is not None and v in held for v, held in zip(values, taken, strict=True)):
                    out.append(n)
                    continue
                for v, held in zip(values, taken, strict=True):
                    if v is not None:
                        held.add(v)
            yield pd.DataFrame({number: out}, dtype="int64")

    placed = members.select("root", number, *keys).repartition("root").sortWithinPartitions("root", number)
    return placed.mapInPandas(run, f"{number} long")
