"""ST1: a stream of alert transitions, which stock rows began or ceased to need a reorder.

The page shows the alerts as they are; whoever acts on them needs to know what
changed. Here the change files of the stock stream feed a state per stock key:

    readStream -> join the stock row (quantity, reorder level)
      -> groupBy(range of ProductID).applyInPandasWithState: latest change and alert of each key
      -> foreachBatch: write the epoch's transitions to epoch=<id>

* The keys of ``RANGE`` neighbouring products share one state row, a packed
  table: Python is called once for a range, not once for a key, and follows
  its changes as arrays. A range holds its keys and one Arrow batch of changes.
* A key's state holds its latest change (greatest ``seq``, then quantity, then
  date, as in the stock stream) and whether it was an alert. A late change
  with an older ``seq`` alters nothing. Before its first change a key is what
  its stock row says.
* An epoch emits a row for a key only if the alert differs from that before
  the epoch: so the transitions of any range of epochs are the difference of
  the reorder alerts (R12) before and after it.
* A replayed epoch starts from the state of the epoch before and overwrites
  its own folder with the same rows: each transition is there exactly once.
* Changes for keys without a stock row are left out, as W3 never inserts.

The join has one stock row per key on its right side, so a key that a third of
the changes share costs no more rows than its changes; the state of all ranges
is spread over the state partitions (RocksDB by default). A checkpoint of the
former layout, a state row for each key, cannot be gone on with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.operators.changes import STOCK_KEY
from shelfmark.sources.tables import Tables
from shelfmark.streaming.stock_stream import CHANGE_SCHEMA, ROCKSDB_PROVIDER

# The kinds of a transition.
BEGAN, CEASED = "began", "ceased"

# Products of one state row; the day of a change without a date.
RANGE, NO_DAY = 256, -(2**31)

#: Per key ``ProductID, WarehouseID, seq, QuantityOnHand, day, alert``, a column after the other, as 64-bit integers.
STATE = "keys binary"
TRANSITION_SCHEMA = T.StructType([
    *[f for f in CHANGE_SCHEMA.fields if f.name in STOCK_KEY],
    T.StructField("transition", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("QuantityOnHand", T.IntegerType(), False),
    T.StructField("as_of", T.DateType(), False),
])


def stock_levels(t: Tables) -> DataFrame:
    """``ProductID, WarehouseID, _held, _level``: one row per stock key, for those that the reorder report (R1, R12) has."""
    levels = (t.product.join(t.category.select("CategoryID"), "CategoryID", "left_semi")
              .select("ProductID", F.col("ReorderLevel").alias("_level")))
    held = t.stock.groupBy(*STOCK_KEY).agg(F.max("QuantityOnHand").alias("_held"))
    return held.join(levels, "ProductID").join(t.warehouse.select("WarehouseID"), "WarehouseID", "left_semi").select(*STOCK_KEY, "_held", "_level")


def _following():
    """The function that follows a range of products; made here, so that it travels whole to the workers."""
    def latest(table: np.ndarray, after_row: np.ndarray) -> np.ndarray:
        """Per key its greatest change, of equal ones the first, with the ``before`` of its first row.

        Rows of ``table`` are columns: ProductID, WarehouseID, seq, quantity, day, alert, before.
        """
        product, warehouse = table[0], table[1]
        by_change = np.lexsort((-after_row, table[4], table[3], table[2], warehouse, product))
        by_row = np.lexsort((after_row, warehouse, product))
        new = (np.diff(product[by_row]) != 0) | (np.diff(warehouse[by_row]) != 0)
        found = table[:, by_change[np.append(new, True)]]
        found[6] = table[6, by_row[np.insert(new, 0, True)]]
        return found

    def follow(key: tuple, frames, state: GroupState):
        """The transitions of a range's stock keys in this epoch."""
        if state.exists:
            held = np.frombuffer(bytes(state.get[0]), "<i8").reshape(6, -1)
        else:
            held = np.empty((6, 0), "<i8")
        known = np.vstack([held, held[5:]])  # before the epoch each key is as it was left
        for frame in frames:
            if frame.empty:
                continue
            changes = [frame[c].astype("int64") for c in ("ProductID", "WarehouseID", "seq", "QuantityOnHand", "_day")]
            alerts = [(frame[c] <= frame["_level"]).astype("int64") for c in ("QuantityOnHand", "_held")]
            table = np.hstack([known, np.vstack([c.to_numpy() for c in changes + alerts])])
            known = latest(table, np.arange(table.shape[1]))
        if known.shape[1] == held.shape[1] and np.array_equal(known[:6], held):
            return
        state.update((np.ascontiguousarray(known[:6], "<i8").tobytes(),))
        turned = known[:, known[5] != known[6]]
        if turned.shape[1]:
            yield pd.DataFrame({"ProductID": turned[0], "WarehouseID": turned[1], "transition": np.where(turned[5] == 1, BEGAN, CEASED).astype(object),
                                "seq": turned[2], "QuantityOnHand": turned[3], "_day": turned[4]})

    return follow


def alert_transitions(changes: DataFrame, levels: DataFrame) -> DataFrame:
    """Streaming ``changes`` to streaming transitions; ``levels`` as ``stock_levels`` gives them."""
    day = F.coalesce(F.unix_date("as_of"), F.lit(NO_DAY)).alias("_day")
    known = changes.join(levels, list(STOCK_KEY)).select(
        F.floor(F.col("ProductID") / RANGE).alias("_range"), *STOCK_KEY, "seq", "QuantityOnHand", day, "_held", "_level")
    found = known.groupBy("_range").applyInPandasWithState(
        _following(), "ProductID long, WarehouseID long, transition string, seq long, QuantityOnHand int, _day int",
        STATE, "update", GroupStateTimeout.NoTimeout)
    as_of = F.when(F.col("_day") != NO_DAY, F.date_from_unix_date("_day")).alias("as_of")
    return found.select(*[as_of if f.name == "as_of" else f.name for f in TRANSITION_SCHEMA.fields])


def start_alert_stream(spark: SparkSession, t: Tables, source_dir: str, transitions_dir: str, checkpoint_location: str,
                       fmt: str = "parquet", max_files_per_trigger: int | None = None, processing_time: str | None = None,
                       state_store: str | None = "rocksdb") -> StreamingQuery:
    """Start the stream of transitions; returns the running query (caller awaits or stops it).

    Without ``processing_time`` it ends when the files that are there have
    been read. Reorder levels are those of the tables when the query starts.
    """
    if state_store == "rocksdb":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    reader = spark.readStream.schema(CHANGE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    transitions = alert_transitions(reader.load(source_dir), stock_levels(t))

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{transitions_dir.rstrip('/')}/epoch={epoch_id}")

    writer = transitions.writeStream.outputMode("update").foreachBatch(write_epoch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start()


def transitions(spark: SparkSession, transitions_dir: str) -> DataFrame:
    """All transitions so far, with their ``epoch``."""
    schema = T.StructType([*TRANSITION_SCHEMA.fields, T.StructField("epoch", T.LongType(), False)])
    return spark.read.schema(schema).parquet(transitions_dir)


def net_transitions(spark: SparkSession, transitions_dir: str) -> DataFrame:
    """Per stock key that ends otherwise than it started: its last transition.

    A key's transitions alternate, so an even number of them cancels out.
    """
    last = F.max(F.struct("epoch", "transition", "seq", "QuantityOnHand", "as_of")).alias("_last")
    per_key = transitions(spark, transitions_dir).groupBy(*STOCK_KEY).agg(F.count(F.lit(1)).alias("_n"), last)
    return per_key.where("_n % 2 = 1").select(*STOCK_KEY, "_last.transition", "_last.seq", "_last.QuantityOnHand", "_last.as_of")
