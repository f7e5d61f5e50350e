"""Money beyond 64-bit cents, and means rounded once."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import columns as C


def test_sum_of_large_lines(spark):
    lines = spark.range(20).select(F.lit(900_000_000).alias("Quantity"), F.lit(Decimal("99999999.99")).cast("decimal(10,2)").alias("SalePrice"))
    total = lines.agg(C.line_cents_sum().alias("c")).select(C.money_from_cents("c").alias("m")).first().m
    assert total == Decimal("1799999999820000000.00")


def test_second_level_sum_is_decimal(spark):
    parts = spark.range(3).select(F.lit(Decimal(10) ** 19).cast("decimal(38,0)").alias("c"))
    assert parts.agg(C.money_from_cents(F.sum("c")).alias("m")).first().m == Decimal(3 * 10 ** 17)


@pytest.mark.parametrize(("total", "count", "mean"), [("499999.99", 100_000_000, "0.00"), ("500000.00", 100_000_000, "0.01"), ("0.05", 2, "0.03"),
                                                     ("-0.05", 2, "-0.03"), ("10.00", 3, "3.33"), (None, 3, None)])
def test_mean_is_rounded_once(spark, total, count, mean):
    value = spark.range(1).select(C.half_up_div(F.lit(None if total is None else Decimal(total)).cast("decimal(38,2)"), F.lit(count).cast("long")).alias("m")).first().m
    assert value == (None if mean is None else Decimal(mean))


def test_search_without_bounds_has_none(seed):
    from shelfmark.plans import reports

    assert reports.product_search(seed).count() == seed.product.count()
