"""Bounded-space online packing of tokenized documents (operator 10).

Every input partition keeps a fixed number of open windows. A document that
fills whole windows is cut into them; what is left of it goes to the open
window that it fits best. Where none fits and no more may be opened, the
fullest is topped up with the head of the document, emitted, and the rest is
placed again, so every emitted window is full. At the end of a partition its
open windows are merged into each other; less than one window stays over.
These leftovers (with their ids) are merged in groups of ``fan_in``
partitions, again and again, until one group remains; the last leftover is
cut at powers of two, which need no padding.

A task holds its open windows and one batch of texts, never a partition. No
document is shuffled: only leftovers are, one window for each partition at
most. Sequences and offsets follow from the partition's rows alone, so a
retried task gives the same ones.

Null text counts as empty, and an empty document is its closing id alone.
Very long documents are cut over many windows. Repeated rows are packed each
for itself; a null ``doc_id`` stays null. An empty table gives no pieces.
Other columns of the input are left behind.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.bpe_automaton import batches, coder
from shelfmark.llm.common import give_back, text_rows, written

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long")
#: sequence_id = round << 58 | partition or group << 30 | number of the sequence there.
ROUND_BIT, TASK_BIT = 58, 30


class Packer:
    """The open windows of one task. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, base: int):
        self.window, self.most, self.next = window, open_windows, base
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)
        self.sealed: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.sealed.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at, ids))
            at += n
        self.next += 1

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        """Place a piece of a document."""
        size, at = 4 * self.window, 0
        while len(ids) - at >= size:
            self._emit([(doc_id, start + at // 4, ids[at:at + size], total)])
            at += size
        while at < len(ids):
            n = (len(ids) - at) // 4
            fits = [i for i, (used, _) in enumerate(self.open) if used + n <= self.window]
            if fits:
                i = max(fits, key=lambda i: self.open[i][0])
            elif len(self.open) < self.most:
                self.open.append((0, []))
                i = len(self.open) - 1
            else:
                i = max(range(len(self.open)), key=lambda i: self.open[i][0])
                n = self.window - self.open[i][0]
            used, pieces = self.open[i]
            pieces.append((doc_id, start + at // 4, ids[at:at + 4 * n], total))
            at += 4 * n
            if used + n == self.window:
                self._emit(pieces)
                del self.open[i]
            else:
                self.open[i] = (used + n, pieces)

    def merge_open(self) -> list:
        """Merge the open windows; the pieces of the one that does not get full."""
        windows = sorted(self.open, key=lambda w: -w[0])
        self.open, self.most = [], 1
        for _, pieces in windows:
            for piece in pieces:
                self.add(*piece)
        left = self.open[0][1] if self.open else []
        self.open = []
        return left

    def cut_at_powers_of_two(self, pieces: list) -> None:
        """Emit the last leftover as sequences whose lengths are powers of two."""
        left = sum(len(p[2]) // 4 for p in pieces)
        pieces = pieces[::-1]
        while left:
            room = n = 1 << (left.bit_length() - 1)
            sequence = []
            while room:
                doc_id, start, ids, total = pieces.pop()
                if len(ids) // 4 > room:
                    pieces.append((doc_id, start + room, ids[4 * room:], total))
                    ids = ids[:4 * room]
                sequence.append((doc_id, start, ids, total))
                room -= len(ids) // 4
            self._emit(sequence)
            left -= n

    def take(self, keep_ids: bool) -> pd.DataFrame:
        out = pd.DataFrame(self.sealed, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        if not keep_ids:
            out["ids"] = None
        self.sealed = []
        return out.astype({"doc_id": "Int64"}).assign(task=None)


def _leftover(pieces: list, task: int) -> pd.DataFrame:
    return pd.DataFrame([(p[0], p[1], len(p[2]) // 4, p[3], n, p[2], task) for n, p in enumerate(pieces)],
                        columns=["doc_id", "start", "length", "doc_tokens", "offset", "ids", "task"]
                        ).astype({"doc_id": "Int64"}).assign(ids_crc32=0, sequence_id=-1)


def pack(docs: DataFrame, path: str, window: int = 2048, open_windows: int = 64, end_id: int = 1,
         fan_in: int = 64, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``, array<long>, with ``keep_ids``).

    Each document is its ids by the ``tokenizers`` file at ``path`` and then
    ``end_id``. Sequences hold ``window`` tokens each, but for the last
    leftover's, whose lengths are powers of two.
    """
    whole = PIECE + ", ids binary, task long"
    columns = [c.split()[0] for c in whole.split(", ")]
    tail = end_id.to_bytes(4, "little")

    def first(frames):
        task = TaskContext.get().partitionId()
        packer, code = Packer(window, open_windows, task << TASK_BIT), coder(path)
        for frame in frames:
            doc_ids, texts = frame["doc_id"].astype("Int64").tolist(), frame["text"].tolist()
            for part in batches(texts):
                for doc_id, ids in zip(doc_ids[part], code.encode(texts[part]), strict=True):
                    packer.add(None if doc_id is pd.NA else doc_id, 0, ids + tail, len(ids) // 4 + 1)
                give_back()
                yield packer.take(keep_ids)[columns]
        left = packer.merge_open()
        yield packer.take(keep_ids)[columns]
        yield _leftover(left, task)[columns]

    def merge(level: int, last: bool):
        def run(key, frame):
            packer = Packer(window, 1, (level << ROUND_BIT) + (int(key[0]) << TASK_BIT))
            frame = frame.sort_values(["task", "offset"], kind="stable")
            for r in frame.itertuples(index=False):
                packer.add(None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.ids, r.doc_tokens)
            left = packer.merge_open()
            if last:
                packer.cut_at_powers_of_two(left)
            return pd.concat([packer.take(keep_ids)[columns]] + ([] if last else [_leftover(left, int(key[0]))[columns]]))
        return run

    rows = text_rows(docs)
    tasks = rows.rdd.getNumPartitions()
    packed = written(rows.mapInPandas(first, whole), "packed")
    done = packed.filter("sequence_id >= 0")
    left, level = packed.filter("sequence_id < 0"), 0
    while True:
        level += 1
        last = tasks <= fan_in
        tasks = -(-tasks // fan_in)
        group = F.lit(0).cast("long") if last else F.expr(f"task div {fan_in}")
        merged = left.groupBy(group.alias("group")).applyInPandas(merge(level, last), whole)
        done = done.unionByName(merged.filter("sequence_id >= 0"))
        if last:
            break
        left = merged.filter("sequence_id < 0")
    if not keep_ids:
        return done.drop("ids", "task")

    def as_longs(frames):
        for frame in frames:
            yield frame.assign(ids=pd.Series([np.frombuffer(x, "<u4").astype(np.int64) for x in frame["ids"]], dtype=object).to_numpy())

    return done.drop("task").mapInPandas(as_longs, PIECE + ", ids array<long>")
