"""Key helpers against brute force on small random fixtures."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfmark.operators import changes
from shelfmark.operators.keys import latest_per_key, sequential_keys


def _sequential_insert_ignore(base, batch, keys):
    """Row-by-row INSERT IGNORE in batch order (the brute-force reference)."""
    taken = [{tuple(r[i] for i in k) for r in base} for k in keys]
    accepted = []
    for r in batch:
        vals = [tuple(r[i] for i in k) for k in keys]
        clash = any(None not in v and v in t for v, t in zip(vals, taken))
        if not clash:
            accepted.append(r)
            for v, t in zip(vals, taken):
                if None not in v:
                    t.add(v)
    return accepted


@pytest.mark.parametrize("seed_no", range(4))
def test_append_ignore_multi_key_matches_sequential(spark, seed_no):
    rnd = random.Random(seed_no)
    schema = "seq long, a long, b string, c long"
    base = [(0, rnd.randint(0, 9), f"b{rnd.randint(0, 9)}", rnd.randint(0, 4)) for _ in range(3)]
    batch = []
    for i in range(1, 31):
        b = None if rnd.random() < 0.1 else f"b{rnd.randint(0, 12)}"
        batch.append((i, rnd.randint(0, 15), b, rnd.randint(0, 6)))
    keys_idx = [(1,), (2,), (3,)]
    want = _sequential_insert_ignore(base, batch, keys_idx)
    res = changes.append_ignore(spark.createDataFrame(base, schema), spark.createDataFrame(batch, schema),
                                [("a",), ("b",), ("c",)], ["seq"])
    got = sorted(rows(res.table.where("seq > 0")))
    assert got == sorted(want)
    assert res.rejected.count() == len(batch) - len(want)


def test_sequential_keys_dense_under_skewed_order(spark):
    # A third of the rows share one ordering value: ties stay in one range, keys stay dense.
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("o"), F.col("id"))
    keyed = sequential_keys(df.repartition(9), ["o", "id"], F.lit(100), "k")
    got = keyed.orderBy("k").collect()
    assert [r.k for r in got] == list(range(101, 3101))
    order = [(r.o, r.id) for r in got]
    assert order == sorted(order)


def test_latest_per_key_hot_key_and_ties(spark):
    data = [(1, s, s % 5) for s in range(1000)] + [(2, 1, 9), (2, 1, 3)]
    df = spark.createDataFrame(data, "k long, seq long, v long")
    out = dict((r[0], (r[1], r[2])) for r in rows(latest_per_key(df, ["k"], ["seq"])))
    assert out == {1: (999, 4), 2: (1, 9)}  # ties broken by the remaining columns
    first = dict((r[0], (r[1], r[2])) for r in rows(latest_per_key(df, ["k"], ["seq"], first=True)))
    assert first == {1: (0, 0), 2: (1, 3)}


def test_sequential_keys_are_stable_across_recomputation(spark):
    # The checkpoint freezes ranges and order: recomputing (as after a lost
    # executor) yields the same keys.
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("o"))
    keyed = sequential_keys(df.repartition(7), ["o"], F.lit(0), "k")
    first = sorted(rows(keyed, "o", "k"))
    assert first == sorted(rows(keyed, "o", "k"))
    assert all(o + 1 == k for o, k in first)


@pytest.mark.parametrize("seed_no", range(3))
def test_latest_per_key_matches_python(spark, seed_no):
    rnd = random.Random(100 + seed_no)
    data = [(rnd.randint(0, 5), rnd.randint(0, 20), rnd.randint(0, 3), rnd.choice(["a", "b", None]))
            for _ in range(300)]
    df = spark.createDataFrame(data, "k long, seq long, v long, w string")
    for first in (False, True):
        want = {}
        for k, seq, v, w in data:
            cand = (seq, v, w or "")
            cur = want.get(k)
            if cur is None or (cand < cur if first else cand > cur):
                want[k] = cand
        got = {r[0]: (r[1], r[2], r[3] or "") for r in rows(latest_per_key(df, ["k"], ["seq"], first=first))}
        assert got == want
