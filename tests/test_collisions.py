"""W7 with several unique keys by collision components, against insertion one row after the other."""

from __future__ import annotations

import random
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfmark.operators import changes, collisions

KEYS = [("a",), ("b", "c")]
SCHEMA = "seq long, a long, b string, c int, note string"


def inserted(base, batch):
    """Sequential INSERT IGNORE: the batch's rows that are accepted."""
    seen = [{r[1] for r in base}, {(r[2], r[3]) for r in base}]
    out = []
    for r in sorted(batch):
        values = (r[1], None if None in (r[2], r[3]) else (r[2], r[3]))
        if any(v is not None and v in s for v, s in zip(values, seen)):
            continue
        for v, s in zip(values, seen):
            if v is not None:
                s.add(v)
        out.append(r)
    return out


def random_batch(seed, n=400):
    random.seed(seed)
    wide = random.choice([40, 150, 400])
    batch = []
    for k in range(n):
        a = 7 if random.random() < 0.3 else random.choice([None, random.randrange(wide)])  # a hot value
        batch.append((k * 3, a, random.choice([None, f"b{random.randrange(wide // 2)}"]), random.choice([None, 1, 2]), f"n{k}"))
    random.shuffle(batch)
    return batch


@pytest.mark.parametrize("seed", range(4))
def test_random_batches_equal_sequential_insertion(spark, seed):
    batch, base = random_batch(seed), [(-1, 3, "b3", 1, "base"), (-2, 11, "b4", 2, "base")]
    df = spark.createDataFrame(batch, SCHEMA).repartition(5)
    res = changes.append_ignore(spark.createDataFrame(base, SCHEMA), df, KEYS, ["seq"])
    want = inserted(base, batch)
    assert sorted(rows(res.table), key=str) == sorted(base + want, key=str)
    assert sorted(r[0] for r in rows(res.rejected, "seq")) == sorted({r[0] for r in batch} - {r[0] for r in want})


def test_components_above_the_bound_go_on_in_rounds(spark):
    batch = random_batch(9) + [(10_000 + k, 1000 + k // 2, f"x{(k + 1) // 2}", 1, "chain") for k in range(30)]
    df = spark.createDataFrame(batch, SCHEMA)
    want = sorted(inserted([], batch))
    for bound in (1, 8, 10**6):
        assert sorted(rows(changes._first_wins_multi(df, KEYS, ["seq"], group_rows=bound))) == want


def chain(spark, n):
    """Row k shares ``a`` with one neighbour and ``b`` with the other."""
    k = F.col("id")
    return spark.range(n).select(k.alias("seq"), F.floor(k / 2).alias("a"), F.concat(F.lit("b"), F.floor((k + 1) / 2).cast("string")).alias("b"),
                                 F.lit(1).alias("c"), F.lit("").alias("note"))


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_a_chain(spark):
    counts = {}
    for n in (100, 10_000):
        got, counts[n] = jobs_of(spark, lambda: sorted(r[0] for r in rows(changes._first_wins_multi(chain(spark, n), KEYS, ["seq"]), "seq")))
        assert got == list(range(0, n, 2))
    assert counts[10_000] <= counts[100] + 12, counts


def test_connected_finds_the_smallest_reachable(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1400)] + [(5000, k) for k in range(5001, 5600)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            low, high = sorted((top(u), top(v)))
            root[high] = low
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    assert dict(rows(collisions.connected(df))) == {x: top(x) for x in root}
    assert collisions.connected(df.limit(0)).count() == 0


def test_null_order_values_are_refused(spark):
    df = spark.createDataFrame([(None, 1, "x", 1, "")], SCHEMA)
    with pytest.raises(Exception, match="non-NULL"):
        changes.append_ignore(df.limit(0), df, KEYS, ["seq"]).table.collect()


@pytest.mark.parametrize("keys", [[("StockID",)], [("StockID",), ("ProductID", "WarehouseID")]])
def test_repeated_parents_do_not_multiply_rows(spark, seed, keys):
    """No declared key keeps a parent row from occurring twice."""
    twice = seed.product.unionByName(seed.product)
    new = spark.createDataFrame([(1, 500, 2, 3, 9), (2, 501, 6, 3, 9), (3, None, 7, 3, 9), (4, 502, None, 3, 9), (5, 503, 99, 3, 9)],
                                "seq long, StockID long, ProductID long, WarehouseID long, QuantityOnHand int")
    res = changes.append_ignore(seed.stock.where("ProductID > 100"), new, keys, ["seq"], parents=[("ProductID", twice, "ProductID")])
    assert sorted(rows(res.table, "StockID", "ProductID"), key=str) == [(500, 2), (501, 6), (502, None), (None, 7)]
    assert [r[0] for r in rows(res.rejected, "seq")] == [5]
