"""ST1: the streaming stock job equals batch W3, across micro-batches and replays."""

from __future__ import annotations

import datetime as dt
import tempfile

from conftest import rows

from shelfmark.operators import changes
from shelfmark.streaming import stock_stream as st


def _changes(spark, data):
    return spark.createDataFrame(data, st.CHANGE_SCHEMA)


def test_stream_equals_batch_with_late_and_unknown(spark, seed):
    d = dt.date
    batches = [
        [(1, 2, 10, 50, d(2025, 5, 1)), (4, 1, 3, 7, d(2025, 5, 1))],
        [(1, 2, 5, 99, d(2025, 4, 20)),          # late: older seq must not win
         (9, 3, 1, 1, d(2025, 5, 2))],           # unknown pair: never inserted
        [(4, 1, 8, 70, d(2025, 5, 3)), (4, 1, 8, 70, d(2025, 5, 3))],  # duplicate
    ]
    root = tempfile.mkdtemp(prefix="shelfmark-stream-")
    for i, b in enumerate(batches):
        _changes(spark, b).coalesce(1).write.parquet(f"{root}/source/part={i}")
    q = st.start_stock_stream(spark, f"{root}/source/*", f"{root}/applied", f"{root}/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    assert q.lastProgress is not None
    streamed = st.current_stock(spark, seed.stock, f"{root}/applied")
    all_changes = _changes(spark, [r for b in batches for r in b])
    batch = changes.update_stock(seed.stock, all_changes)
    assert sorted(rows(streamed.table)) == sorted(rows(batch.table))
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(streamed.table, "ProductID", "WarehouseID", "QuantityOnHand",
                                                    "LastUpdated")}
    assert got[(1, 2)] == (50, d(2025, 5, 1))
    assert got[(4, 1)] == (70, d(2025, 5, 3))
    assert rows(streamed.rejected, "ProductID", "WarehouseID") == [(9, 3)]
    # Several micro-batches ran.
    epochs = {r[0] for r in rows(st.applied_changes(spark, f"{root}/applied"), "epoch")}
    assert len(epochs) >= 2


def test_replayed_epoch_is_harmless(spark, seed):
    root = tempfile.mkdtemp(prefix="shelfmark-stream-")
    data = [(3, 1, 1, 11, dt.date(2025, 5, 1))]
    _changes(spark, data).write.parquet(f"{root}/source")
    q = st.start_stock_stream(spark, f"{root}/source", f"{root}/applied", f"{root}/ckpt")
    q.awaitTermination()
    first = sorted(rows(st.current_stock(spark, seed.stock, f"{root}/applied").table))
    # Re-deliver the same epoch (what an at-least-once sink may see).
    latest = st.latest_changes(_changes(spark, data))
    latest.write.mode("overwrite").parquet(f"{root}/applied/epoch=0")
    again = sorted(rows(st.current_stock(spark, seed.stock, f"{root}/applied").table))
    assert first == again


def test_live_alerts_follow_the_stream(spark, seed):
    root = tempfile.mkdtemp(prefix="shelfmark-stream-")
    # Product 1 in Central Warehouse drops to 5 (alert); product 10 in North Hub rises to 99 (no alert).
    data = [(1, 1, 1, 5, dt.date(2025, 5, 1)), (10, 2, 1, 99, dt.date(2025, 5, 1))]
    _changes(spark, data).write.parquet(f"{root}/source")
    st.start_stock_stream(spark, f"{root}/source", f"{root}/applied", f"{root}/ckpt").awaitTermination()
    alerts = {(r[0], r[1]) for r in rows(st.live_reorder_alerts(spark, seed, f"{root}/applied"),
                                         "ProductID", "WarehouseName")}
    assert (1, "Central Warehouse") in alerts
    assert (10, "North Hub") not in alerts


def test_compacted_snapshot_gives_the_same_stock(spark, seed):
    root = tempfile.mkdtemp(prefix="shelfmark-stream-")
    d = dt.date
    first = [(1, 2, 10, 50, d(2025, 5, 1)), (4, 1, 3, 7, d(2025, 5, 1))]
    later = [(1, 2, 12, 44, d(2025, 5, 4)), (4, 1, 2, 99, d(2025, 4, 30)), (2, 3, 1, 5, d(2025, 5, 4))]
    _changes(spark, first).coalesce(1).write.parquet(f"{root}/source/part=0")
    st.start_stock_stream(spark, f"{root}/source/*", f"{root}/applied", f"{root}/ckpt").awaitTermination()
    st.compact_applied(spark, f"{root}/applied", f"{root}/snap1")
    _changes(spark, later).coalesce(1).write.parquet(f"{root}/source/part=1")
    st.start_stock_stream(spark, f"{root}/source/*", f"{root}/applied", f"{root}/ckpt").awaitTermination()
    with_snap = sorted(rows(st.current_stock(spark, seed.stock, f"{root}/applied", f"{root}/snap1").table))
    without = sorted(rows(st.current_stock(spark, seed.stock, f"{root}/applied").table))
    assert with_snap == without
    got = {(r[0], r[1]): r[2] for r in rows(st.current_stock(spark, seed.stock, f"{root}/applied", f"{root}/snap1")
                                            .table, "ProductID", "WarehouseID", "QuantityOnHand")}
    assert got[(1, 2)] == 44 and got[(4, 1)] == 7 and got[(2, 3)] == 5
