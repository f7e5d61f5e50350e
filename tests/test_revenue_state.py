"""The revenue state after changes equals the reports of the changed tables."""

from __future__ import annotations

import datetime as dt
import random
import tempfile
from decimal import Decimal as D

import pytest
from conftest import rows

from shelfmark import schemas
from shelfmark.operators import changes, revenue_state
from shelfmark.plans import reports, views


def same(state, t):
    assert sorted(rows(revenue_state.product_revenue(state, t))) == sorted(rows(views.product_revenue(t)))
    assert sorted(rows(revenue_state.category_revenue(state, t))) == sorted(rows(reports.category_revenue(t)))
    assert sorted(rows(revenue_state.category_revenue_page(state, t))) == sorted(rows(reports.category_revenue_page(t)))
    assert sorted(rows(revenue_state.revenue_by_category(state, t))) == sorted(rows(reports.revenue_by_category(t)))
    assert rows(revenue_state.monthly_demand(state)) == rows(reports.monthly_demand(t))
    assert rows(revenue_state.monthly_sales(state)) == rows(reports.monthly_sales(t))


def random_changes(spark, seed_value, t, first):
    """New orders (some cancelled, some in one far bucket) with lines, and more lines for old orders."""
    random.seed(seed_value)
    ids = [first + k * random.choice([1, 40_000]) for k in range(12)]
    orders = [(i, "c", dt.date(2025, random.randint(1, 6), 3), random.choice(["Pending", "Cancelled", "Shipped"]), None) for i in ids]
    lines = [(first + k, random.choice([*ids[:-1], 1, 2, 3]), random.randint(1, 14), random.randint(1, 9), D(random.randint(1, 99999)) / 100) for k in range(40)]
    return (spark.createDataFrame(orders, schemas.SALES_ORDER), spark.createDataFrame(lines, schemas.ORDER_DETAIL))


def test_inserts_and_deletes_in_turn(spark, seed):
    t, state, root = seed, revenue_state.build(seed), tempfile.mkdtemp(prefix="shelfmark-state-")
    same(state, t)
    for step in range(3):
        orders, lines = random_changes(spark, step, t, 1000 * (step + 1))
        t = t.replace(sales_order=t.sales_order.unionByName(orders), order_detail=t.order_detail.unionByName(lines))
        state = revenue_state.save(revenue_state.merge(state, t.sales_order, inserted=lines), root)
        same(state, t)
        products = spark.createDataFrame([(step + 2,), (step + 5,)], "ProductID long")
        gone = spark.createDataFrame([(step + 1,), (1000 * (step + 1),), (4,)], "OrderID long")
        removed = changes.removed_lines(t, products, gone)
        state = revenue_state.save(revenue_state.merge(state, t.sales_order, deleted=removed), root)
        t = changes.delete_orders(t.replace(order_detail=changes.delete_products(t, products).order_detail), gone)
        same(state, t)
    assert state.months.where("_orders IS NULL").count() == 0


def test_lines_come_and_go_in_one_merge(spark, seed):
    orders, lines = random_changes(spark, 7, seed, 5000)
    gone = spark.createDataFrame([(1,), (2,)], "OrderID long")
    removed = changes.removed_lines(seed, orders=gone)
    state = revenue_state.merge(revenue_state.build(seed), seed.sales_order.unionByName(orders), inserted=lines.where("OrderID > 3"), deleted=removed)
    t = changes.delete_orders(seed, gone)
    same(state, t.replace(sales_order=t.sales_order.unionByName(orders), order_detail=t.order_detail.unionByName(lines.where("OrderID > 3"))))


def test_an_order_that_lost_all_lines_counts_again_when_it_gets_one(spark, seed):
    gone = changes.removed_lines(seed, orders=spark.createDataFrame([(1,)], "OrderID long"))
    state = revenue_state.merge(revenue_state.build(seed), seed.sales_order, deleted=gone)
    assert state.orders.where("OrderID = 1").count() == 0
    same(revenue_state.merge(state, seed.sales_order, inserted=gone), seed)


def test_everything_deleted_and_nothing_changed(spark, seed):
    state = revenue_state.build(seed)
    assert revenue_state.merge(state, seed.sales_order) is state
    empty = revenue_state.merge(state, seed.sales_order, deleted=seed.order_detail)
    assert [df.count() for df in (empty.products, empty.orders, empty.months)] == [0, 0, 0]


@pytest.mark.parametrize("products, orders", [(True, True), (True, False), (False, True), (False, False)])
def test_removed_lines_are_what_the_cascades_take(spark, seed, products, orders):
    p = spark.createDataFrame([(2,), (3,), (3,)], "ProductID long") if products else None
    o = spark.createDataFrame([(1,), (5,)], "OrderID long") if orders else None
    left = seed
    left = changes.delete_products(left, p) if products else left
    left = changes.delete_orders(left, o) if orders else left
    removed = rows(changes.removed_lines(seed, p, o))
    assert sorted(removed + rows(left.order_detail, *seed.order_detail.columns)) == sorted(rows(seed.order_detail))


def test_orders_meet_before_their_bitmaps_are_made(spark, seed):
    """No bitmap of a part of a bucket is shuffled, or there would be one for each task and bucket."""
    plan = revenue_state.build(seed).months._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.splitlines() if "bitmap_construct_agg" in line or "Exchange" in line]
    partial = next(k for k, line in enumerate(made) if "partial_bitmap_construct_agg" in line)
    assert partial == 1 and "bitmap_construct_agg" in made[0] and "Exchange hashpartitioning(_month" in made[2]


def test_months_are_folded_from_the_orders_as_written(spark, seed):
    root, seen = tempfile.mkdtemp(prefix="shelfmark-state-"), []
    state = revenue_state.build(seed)

    def months_of(orders):
        seen.append(orders)
        return state.months_of(orders)

    saved = revenue_state.save(revenue_state.RevenueState(state.products, state.orders, months_of), root)
    assert len(seen) == 1 and all(f"{root}/orders/" in f for f in seen[0].inputFiles())
    same(saved, seed)
