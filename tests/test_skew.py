"""A key holding a third of all rows: AQE splits it instead of one task taking it all."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from conftest import rows
from seeds import make_tables, seed_rows

from pyspark.sql import functions as F

from shelfmark.operators.keys import sequential_keys
from shelfmark.plans import reports, views

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _skewed_tables(spark, n=6000):
    r = {k: list(v) for k, v in seed_rows().items()}
    r["SalesOrder"] = [(o, f"c{o}", dt.date(2025, 1, 1 + o % 28), "Shipped", None) for o in range(1, n + 1)]
    # A third of all lines are for product 1; the rest spread over products 2..14.
    r["OrderDetail"] = [(i, i, 1 if i % 3 == 0 else 2 + i % 13, 1 + i % 5, D("10.00")) for i in range(1, n + 1)]
    return make_tables(spark, r)


def test_hot_product_is_split(spark):
    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        t = _skewed_tables(spark)
        df = reports.order_lines(t, t.sales_order.select("OrderID"))
        got = df.collect()
        final = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in final
        assert "skew=true" in final, final
        assert sum(1 for r in got if r.ProductName == 'Samsung 4K TV 55"') == 2000
        assert len(got) == 6000
        # Aggregates over the hot key combine map-side: results stay whole and exact.
        pr = dict(rows(views.product_revenue(t), "ProductID", "TotalOrderLines"))
        assert pr[1] == 2000 and sum(pr.values()) == 6000
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_name_in_resolution_is_split(spark, seed):
    from shelfmark.operators import lookups

    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        names = [r[1] for r in seed_rows()["Product"]]
        data = [(i, names[0] if i % 3 == 0 else names[1 + i % 13], i % 7) for i in range(6000)]
        ch = spark.createDataFrame(data, "seq long, ProductName string, qty int")
        df = lookups.resolve_names(ch, seed.product, "ProductID", "ProductName")
        got = df.collect()
        final = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final, final
        assert len(got) == 6000 and all(r.ProductID is not None for r in got)
        hot = [r for r in got if r.ProductName == names[0]]
        assert len(hot) == 2000 and {r.ProductID for r in hot} == {1}
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_cascade_delete_reads_lines_once_and_splits_a_hot_product(spark):
    from pyspark.sql import functions as F

    from shelfmark.operators import changes

    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        t = _skewed_tables(spark)
        ids = t.order_detail.groupBy("ProductID").count().where(F.col("ProductID") == 2).select("ProductID")
        df = changes.delete_products(t, ids).order_detail
        got = df.collect()
        final = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final, final
        assert len(got) == sum(1 for r in t.order_detail.collect() if r.ProductID != 2)
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_foreign_key_check_splits_a_hot_parent(spark):
    from shelfmark.operators import quality

    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        t = _skewed_tables(spark)
        df = quality.check_foreign_key(t.order_detail, "ProductID", t.product, "ProductID")
        assert df.collect() == []
        final = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final, final
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_one_order_value_splits_across_key_ranges(spark):
    """A third of the rows share one order value: no range holds them all, and keys stay dense and ordered."""
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("o"), F.col("id").alias("v"))
    keyed = sequential_keys(df, ["o"], F.lit(10).cast("bigint"), "k", partitions=8)
    sizes = [r["count"] for r in keyed.where("o = 500").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 2 and max(sizes) < n // 4
    got = sorted(rows(keyed, "k", "o", "v"))
    assert [g[0] for g in got] == list(range(11, n + 11))
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    assert sorted(g[2] for g in got) == list(range(n))
    again = sequential_keys(df, ["o"], F.lit(10).cast("bigint"), "k", partitions=5)
    assert sorted(rows(again, "k", "o", "v")) == got
