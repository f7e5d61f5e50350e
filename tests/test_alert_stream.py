"""ST1: alert transitions equal the difference of two batch alert reports, under replays and late changes."""

from __future__ import annotations

import datetime as dt
import os
import random
import shutil
import tempfile

import pytest
from conftest import rows

from shelfmark.operators import changes
from shelfmark.plans import reports
from shelfmark.streaming import alert_stream, stock_stream


def change_files(spark, root, batches):
    for k, batch in enumerate(batches):
        path = f"{root}/source/part={k:03d}"
        spark.createDataFrame(batch, stock_stream.CHANGE_SCHEMA).coalesce(1).write.parquet(path)
        for f in os.listdir(path):  # the stream reads files in the order of their times
            os.utime(f"{path}/{f}", (1_700_000_000 + 10 * k,) * 2)


def alerts(t, stock=None):
    t = t if stock is None else t.replace(stock=stock)
    return {(r.ProductID, r.WarehouseName) for r in reports.reorder_alerts(t).collect()}


def run(spark, t, root):
    query = alert_stream.start_alert_stream(spark, t, f"{root}/source/*", f"{root}/transitions", f"{root}/ckpt", max_files_per_trigger=1)
    query.awaitTermination()


def difference(spark, t, root):
    names = dict(rows(t.warehouse, "WarehouseID", "WarehouseName"))
    net = rows(alert_stream.net_transitions(spark, f"{root}/transitions"), "ProductID", "WarehouseID", "transition")
    return {(p, names[w]) for p, w, kind in net if kind == "began"}, {(p, names[w]) for p, w, kind in net if kind == "ceased"}


@pytest.mark.parametrize("seed_value", [1, 2])
def test_transitions_equal_the_difference_of_two_reports(spark, seed, seed_value):
    random.seed(seed_value)
    day = dt.date(2025, 5, 1)
    keys = [tuple(r) for r in rows(seed.stock, "ProductID", "WarehouseID")] + [(9, 3), (99, 1)]  # the last two have no stock row
    batches = []
    for epoch in range(4):  # late changes have an older number than earlier files
        batches.append([(*random.choice(keys), random.choice([epoch, epoch, epoch + 1, max(0, epoch - 2)]), random.choice([0, 3, 40, 500]), day)
                        for _ in range(40)])
    batches.append(batches[1])  # a file that comes again
    (product, name), ids = min(alerts(seed)), {n: w for w, n in rows(seed.warehouse, "WarehouseID", "WarehouseName")}
    batches.append([(product, ids[name], 99, 999, day)])  # an alert that ceases
    root = tempfile.mkdtemp(prefix="shelfmark-alerts-")
    change_files(spark, root, batches)
    run(spark, seed, root)
    all_changes = spark.createDataFrame([r for b in batches for r in b], stock_stream.CHANGE_SCHEMA)
    # W3 takes the change of the greatest number; the stream breaks its ties alike
    after = alerts(seed, changes.update_stock(seed.stock, stock_stream.latest_changes(all_changes)).table)
    began, ceased = difference(spark, seed, root)
    assert (began, ceased) == (after - alerts(seed), alerts(seed) - after)
    assert began and ceased
    seen = rows(alert_stream.transitions(spark, f"{root}/transitions"), "ProductID", "WarehouseID", "epoch")
    assert len(seen) == len(set(seen)) and len({e for _, _, e in seen}) > 1


def test_replayed_epoch_writes_its_transitions_once(spark, seed):
    """The driver died after the last epoch's write but before its commit: the epoch runs again."""
    day = dt.date(2025, 5, 1)
    root = tempfile.mkdtemp(prefix="shelfmark-alerts-")
    change_files(spark, root, [[(1, 1, 1, 0, day), (4, 1, 1, 999, day)], [(1, 1, 2, 900, day), (2, 1, 1, 0, day)], [(1, 1, 0, 0, day), (2, 1, 9, 0, day)]])
    run(spark, seed, root)
    first = sorted(rows(alert_stream.transitions(spark, f"{root}/transitions")))
    commits = sorted((f for f in os.listdir(f"{root}/ckpt/commits") if f.isdigit()), key=int)
    kept = tempfile.mkdtemp(prefix="shelfmark-alerts-commit-")
    for f in (commits[-1], f".{commits[-1]}.crc"):
        shutil.move(f"{root}/ckpt/commits/{f}", f"{kept}/{f}")
    run(spark, seed, root)
    assert sorted(rows(alert_stream.transitions(spark, f"{root}/transitions"))) == first
    assert (1, 1, "began") not in {r[:3] for r in first if r[-1] == 2}  # the late change alters nothing


def test_stream_goes_on_where_it_ended(spark, seed):
    day = dt.date(2025, 5, 1)
    root = tempfile.mkdtemp(prefix="shelfmark-alerts-")
    change_files(spark, root, [[(1, 1, 5, 0, day)]])
    run(spark, seed, root)
    before = difference(spark, seed, root)
    path = f"{root}/source/part=100"
    spark.createDataFrame([(1, 1, 4, 999, day), (3, 1, 1, 0, day)], stock_stream.CHANGE_SCHEMA).coalesce(1).write.parquet(path)
    run(spark, seed, root)
    began, ceased = difference(spark, seed, root)
    assert before[0] <= began and (1, "Central Warehouse") not in ceased


def test_python_is_called_for_ranges_of_products(spark, seed, monkeypatch):
    """A state row for a range of products, not for a key; keys of a range stay apart."""
    day, n = dt.date(2025, 5, 1), 4 * alert_stream.RANGE
    stock = spark.createDataFrame([(p, w, 5, day) for p in range(-n, n) for w in (1, 2)],
                                  "ProductID long, WarehouseID long, QuantityOnHand int, LastUpdated date")
    product = spark.range(-n, n).selectExpr(*[
        {"ProductID": "id", "ReorderLevel": "10", "CategoryID": "1L", "ProductName": "''"}.get(f.name, "NULL") + f" AS {f.name}" for f in seed.product.schema.fields])
    t = seed.replace(stock=stock, product=product)
    batches = [[(p, 1, 1, 50, day) for p in range(-n, n)], [(p, 1, 2, p % 3 and 60, day) for p in range(-n, n)] + [(7, 2, 1, 99, day), (8, 2, 1, 0, day)]]
    root = tempfile.mkdtemp(prefix="shelfmark-alerts-")
    change_files(spark, root, batches)
    run(spark, t, root)
    net = rows(alert_stream.net_transitions(spark, f"{root}/transitions"), "ProductID", "WarehouseID", "transition", "seq", "as_of")
    assert sorted(net) == sorted([(p, 1, "ceased", 1, day) for p in range(-n, n) if p % 3] + [(7, 2, "ceased", 1, day)])
    state = spark.read.format("statestore").load(f"{root}/ckpt")
    assert state.count() == 8  # 4,098 keys
