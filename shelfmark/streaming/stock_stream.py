"""ST1: keep stock levels current from a stream of stock-count changes.

The source re-reads the table after each update to look "real-time"; here a
Structured Streaming job consumes change files:

    readStream (ProductID, WarehouseID, seq, QuantityOnHand, as_of)
      -> groupBy(ProductID, WarehouseID).max(struct(seq, ...))   [state store]
      -> update mode -> foreachBatch: write the updated keys to epoch=<id>

* The streaming aggregate keeps the latest change per key in the
  fault-tolerant state store, so a change that arrives late with an older
  ``seq`` never overrides a newer one, across micro-batches.
* ``foreachBatch`` is at-least-once: a replayed epoch rewrites its own
  ``epoch=<id>`` folder with the same rows (overwrite of that folder only),
  so replays are harmless.
* ``current_stock`` applies the latest change per key over all epochs to the
  base stock table with the batch operator W3; ``reorder_alerts`` (R12) on
  that result gives the live alert list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.changes import STOCK_KEY, ChangeResult, update_stock
from shelfmark.sources.tables import Tables

CHANGE_SCHEMA = T.StructType([
    T.StructField("ProductID", T.LongType(), False),
    T.StructField("WarehouseID", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("QuantityOnHand", T.IntegerType(), False),
    T.StructField("as_of", T.DateType(), False),
])

APPLIED_SCHEMA = T.StructType([*CHANGE_SCHEMA.fields, T.StructField("epoch", T.LongType(), False)])


def latest_changes(changes: DataFrame) -> DataFrame:
    """Latest change per stock key; works on a streaming or a static DataFrame."""
    last = F.max(F.struct("seq", "QuantityOnHand", "as_of")).alias("_last")
    return changes.groupBy(*STOCK_KEY).agg(last).select(
        *STOCK_KEY, "_last.seq", "_last.QuantityOnHand", "_last.as_of")


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_stock_stream(spark: SparkSession, source_dir: str, applied_dir: str, checkpoint_location: str,
                       fmt: str = "parquet", max_files_per_trigger: int | None = None,
                       available_now: bool = True, processing_time: str | None = None,
                       state_store: str | None = "rocksdb") -> StreamingQuery:
    """Start the stream; returns the running query (caller awaits or stops it).

    The state holds one row per (product, warehouse), which outgrows executor
    heaps at scale, so by default the session's state store is RocksDB
    (``state_store=None`` keeps whatever the session names). The number of
    state partitions is fixed by ``spark.sql.shuffle.partitions`` when the
    checkpoint is first created.
    """
    if state_store == "rocksdb":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    reader = spark.readStream.schema(CHANGE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    latest = latest_changes(reader.load(source_dir))

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        (batch.select(*[f.name for f in CHANGE_SCHEMA.fields])
         .write.mode("overwrite").parquet(f"{applied_dir.rstrip('/')}/epoch={epoch_id}"))

    writer = (latest.writeStream.outputMode("update").foreachBatch(write_epoch)
              .option("checkpointLocation", checkpoint_location))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def applied_changes(spark: SparkSession, applied_dir: str) -> DataFrame:
    return spark.read.schema(APPLIED_SCHEMA).parquet(applied_dir)


def current_stock(spark: SparkSession, base_stock: DataFrame, applied_dir: str,
                  snapshot_dir: str | None = None) -> ChangeResult:
    """Base stock with every applied change (latest ``seq`` per key wins).

    With a ``snapshot_dir`` from ``compact_applied``, only epochs after the
    snapshot are read from ``applied_dir`` (the cut-off is a scalar subquery,
    nothing is collected); the result is the same either way.
    """
    changes = applied_changes(spark, applied_dir)
    if snapshot_dir:
        snap = applied_changes(spark, snapshot_dir)
        newer = changes.where(F.col("epoch") > snap.select(F.max("epoch")).scalar())
        changes = snap.unionByName(newer)
    return update_stock(base_stock, changes.drop("epoch"), seq="seq")


def compact_applied(spark: SparkSession, applied_dir: str, snapshot_dir: str,
                    previous_snapshot: str | None = None) -> str:
    """Collapse every epoch (and an earlier snapshot) into one snapshot folder.

    The snapshot holds the latest change per key, stored as
    ``{snapshot_dir}/epoch=<last epoch covered>``; epoch folders up to that
    epoch are then no longer read. A new snapshot folder is written each
    time; the caller switches to it once the write has finished.
    """
    changes = applied_changes(spark, applied_dir)
    if previous_snapshot:
        changes = changes.unionByName(applied_changes(spark, previous_snapshot))
    covered = changes.select(F.max("epoch")).scalar()
    latest = latest_changes(changes.drop("epoch"))
    (latest.withColumn("epoch", covered).write.mode("errorifexists")
     .partitionBy("epoch").parquet(snapshot_dir))
    return snapshot_dir


def live_reorder_alerts(spark: SparkSession, t: Tables, applied_dir: str,
                        snapshot_dir: str | None = None) -> DataFrame:
    """R12 over the current stock: the alert list as of the last finished micro-batch."""
    from shelfmark.plans.reports import reorder_alerts

    return reorder_alerts(t.replace(stock=current_stock(spark, t.stock, applied_dir, snapshot_dir).table))
