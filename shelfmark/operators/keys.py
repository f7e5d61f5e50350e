"""Key helpers: dense sequential keys (W1, H3) and the latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import checkpoint_dir


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                   first: bool = False) -> DataFrame:
    """One row per key: the row with the greatest (or least) ``order_by``.

    An aggregate, not a window: the partial aggregate collapses each key to
    one row per map task before the shuffle, so a key that holds a third of
    all rows still moves only one row per task. Ties on ``order_by`` are
    broken by the remaining columns, so the pick is deterministic.
    """
    order = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    pick = F.min(packed) if first else F.max(packed)
    out = df.groupBy(*keys).agg(pick.alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def sequential_keys(df: DataFrame, order_by: Sequence[str], start: Column, name: str,
                    partitions: int | None = None) -> DataFrame:
    """Number the rows ``start + 1, start + 2, ...`` in ``order_by`` order.

    No global (single-task) window and no second shuffle:

    1. range partition on ``order_by`` and, for equal values, a hash of the
       whole row, so that a value which many rows share splits across ranges
       and ties have a defined order (boundaries from a sample, so ranges
       are balanced), sort inside each range, and checkpoint to the shared
       checkpoint folder. The checkpoint freezes which row sits where, so a
       task retried after an executor loss computes the same keys;
    2. a row's position inside its range is the low 33 bits of
       ``monotonically_increasing_id`` (documented layout: partition id in the
       upper bits, record number within the partition in the lower 33);
    3. each range is shifted by the row count of the ranges before it. The
       counts table has one row per range, so its broadcast is bounded by the
       number of partitions.
    """
    checkpoint_dir(df.sparkSession)
    # Without an explicit count AQE sizes the ranges (coalescing adjacent
    # ranges keeps them in order); the checkpoint then fixes that layout.
    order = [*order_by, "_tie"]
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    ranged = tied.repartitionByRange(partitions, *order) if partitions else tied.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).drop("_tie").checkpoint(eager=True)
    placed = ranged.select(
        "*",
        F.spark_partition_id().alias("_range"),
        (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_pos"),
    )
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(name, (start + F.col("_offset") + F.col("_pos") + 1).cast("bigint"))
        .drop("_range", "_offset", "_pos")
    )
