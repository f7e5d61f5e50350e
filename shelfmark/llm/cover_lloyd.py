"""Vector code compression by Lloyd rounds on cover trees (operator 12).

Components become floor(256 * x); vectors are cut into ``PARTS`` consecutive
parts, each with a codebook of ``ENTRIES`` entries. A code is the index of the
nearest entry of each part (squared distance, ties to the lower index).

The parts of up to ``BLOCK`` vectors of a partition become cover trees: a node
is a point with all points within its radius below it, the radius halves from
level to level, and a node knows the number and the sum of its points. The
trees are written once. A Lloyd round walks each tree from its root: by the
triangle inequality an entry that is nearer than every other one by twice the
node's radius is nearest for the whole subtree, whose number and sum go to
that entry at once. Other nodes pass the entries that are still possible to
their children; only points of leaves that stay ambiguous are compared one by
one, in integers. Entries become the componentwise floor of sum / count;
unused ones stay. What reaches the driver are the codebooks and their sums.

The first codebooks are the parts of the ``ENTRIES`` rows with the smallest
``vec_id`` (null last, then by vector); fewer rows give fewer entries. Trees
depend on how rows are dealt over tasks, results do not.

Rows whose vector is null or holds a null or non-finite component are left
out. Shorter vectors count as padded with zeros, up to a multiple of
``PARTS``. Components are held within 2**24 (|x| of 65,536), where all sums
are exact. Repeated rows and ids each have a result. Null labels are one
group. An empty table gives no rows. Other columns are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import ship_package, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 8192
#: Points of a leaf, which are not divided further.
LEAF = 8
LIMIT = 1 << 24
#: Distances held at a time.
CELLS = 1 << 20


def scaled(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, x``: the integer vectors of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter("e IS NOT NULL").filter(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    held = lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), v * 256.0))))).cast("int")
    return rows.select("vec_id", "label", F.transform("e", held).alias("x"))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


class Tree:
    """The cover tree of integer ``points``: for each level its nodes' points, radii, ranges of ``order`` and first children."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.levels: list[dict[str, np.ndarray]] = []
        if not len(points):
            return
        node, lo, hi = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(points)])
        scale = self._level(node, lo, hi).max()
        while True:
            level = self.levels[-1]
            size = level["hi"] - level["lo"]
            inner = np.nonzero((size > LEAF) & (level["radius"] > 0))[0]
            level["child"] = np.zeros(len(size) + 1, np.int64)
            if not len(inner):
                return
            scale /= 2
            node, lo, hi, parent = self._split(level["node"][inner], level["lo"][inner], level["hi"][inner], scale)
            level["child"] = np.searchsorted(inner[parent], np.arange(len(size) + 1))
            self._level(node, lo, hi)

    def _level(self, node, lo, hi) -> np.ndarray:
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        held, owner = self.points[self.order[at]], np.repeat(np.arange(len(node)), size)
        starts = np.cumsum(size) - size
        far = ((held - self.points[node][owner]) ** 2).sum(axis=1)
        radius = np.sqrt(np.maximum.reduceat(far, starts).astype(np.float64)) * (1 + 1e-9)
        self.levels.append({"node": node, "lo": lo, "hi": hi, "radius": radius, "sum": np.add.reduceat(held, starts, axis=0)})
        return radius

    def _split(self, node, lo, hi, scale):
        """Greedy nets of the points of each node: every point goes to a child within ``scale``, the node's own point first."""
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(node)), size)
        index = self.order[at]
        child = np.full(len(at), -1, np.int64)
        open_, centre, number, centres = np.arange(len(at)), node.copy(), 0, []
        while len(open_):
            own = owner[open_]
            if number:
                first = np.concatenate([[True], own[1:] != own[:-1]])
                centre[own[first]] = index[open_[first]]
            centres.append((np.unique(own), number, centre[np.unique(own)].copy()))
            near = ((self.points[index[open_]] - self.points[centre[own]]) ** 2).sum(axis=1) <= scale * scale
            child[open_[near]] = number
            open_, number = open_[~near], number + 1
        rank = np.lexsort((child, owner))  # keeps the order within a child
        self.order[at] = index[rank]
        owner, child = owner[rank], child[rank]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (child[1:] != child[:-1])])
        parent, kid = owner[new], child[new]
        table = np.full((len(node), number), -1, np.int64)
        for owners, k, points in centres:
            table[owners, k] = points
        begin = at[new]
        return table[parent, kid], begin, begin + np.diff(np.concatenate([np.nonzero(new)[0], [len(new)]])), parent

    def assigned(self, entries: np.ndarray):
        """``(lo, hi, sum, entry)`` of subtrees with one nearest entry, and ``(positions, entries)`` of the points compared alone."""
        whole, alone = [], []
        if not self.levels:
            return whole, alone
        front, possible = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        for level in self.levels:
            step, further = max(1, CELLS // len(entries)), []
            for k in range(0, len(front), step):
                nodes, may = front[k:k + step], possible[k:k + step]
                far = squares(self.points[level["node"][nodes]], entries)
                away = np.where(may, np.sqrt(far.astype(np.float64)), np.inf)
                best = np.where(may, far, np.iinfo(np.int64).max).argmin(axis=1)
                radius = level["radius"][nodes]
                slack = 2 * radius + 1e-9 * (away[np.arange(len(nodes)), best] + radius)
                may = away <= (away[np.arange(len(nodes)), best] + slack)[:, None]
                sure = (may.sum(axis=1) == 1) | (radius == 0)
                whole.append((level["lo"][nodes[sure]], level["hi"][nodes[sure]], level["sum"][nodes[sure]], best[sure]))
                nodes, may = nodes[~sure], may[~sure]
                kids = level["child"][nodes + 1] - level["child"][nodes]
                leaf = kids == 0
                lo, size = level["lo"][nodes[leaf]], (level["hi"] - level["lo"])[nodes[leaf]]
                at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                for j in range(0, len(at), step):
                    here = at[j:j + step]
                    alone.append((here, squares(self.points[self.order[here]], entries).argmin(axis=1)))
                kids = kids[~leaf]
                begin = level["child"][nodes[~leaf]]
                down = np.repeat(begin - (np.cumsum(kids) - kids), kids) + np.arange(kids.sum())
                further.append((down, np.repeat(may[~leaf], kids, axis=0)))
            front = np.concatenate([x[0] for x in further])
            possible = np.concatenate([x[1] for x in further])
            if not len(front):
                break
        return whole, alone

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points of each entry."""
        count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        whole, alone = self.assigned(entries)
        for lo, hi, added, entry in whole:
            np.add.at(count, entry, hi - lo)
            np.add.at(total, entry, added)
        for at, entry in alone:
            np.add.at(count, entry, 1)
            np.add.at(total, entry, self.points[self.order[at]])
        return count, total

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each point."""
        ordered = np.zeros(len(self.points), np.uint8)
        whole, alone = self.assigned(entries)
        for lo, hi, _, entry in whole:
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ordered[at] = np.repeat(entry, size)
        for at, entry in alone:
            ordered[at] = entry
        out = np.empty_like(ordered)
        out[self.order] = ordered
        return out

    def packed(self) -> dict:
        return {"order": self.order, "levels": self.levels}

    @classmethod
    def unpacked(cls, points: np.ndarray, held: dict) -> Tree:
        tree = cls.__new__(cls)
        tree.points, tree.order, tree.levels = points, held["order"], held["levels"]
        return tree


FIELDS = ("node", "lo", "hi", "radius", "sum", "child")


def _to_bytes(trees: list[Tree]) -> bytes:
    """The trees' arrays, one after the other, in numpy's own file format."""
    import io

    out = io.BytesIO()
    arrays = {}
    for p, tree in enumerate(trees):
        arrays[f"{p}_order"] = tree.order
        for k, level in enumerate(tree.levels):
            arrays |= {f"{p}_{k}_{name}": level[name] for name in FIELDS}
    np.savez(out, **arrays)
    return out.getvalue()


def _from_bytes(data: bytes, points: np.ndarray) -> list[Tree]:
    import io

    trees = []
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        names = set(held.files)
        for p in range(PARTS):
            levels, k = [], 0
            while f"{p}_{k}_node" in names:
                levels.append({name: held[f"{p}_{k}_{name}"] for name in FIELDS})
                k += 1
            trees.append(Tree.unpacked(points[:, p], {"order": held[f"{p}_order"], "levels": levels}))
    return trees


def _cut(column: pa.Array, width: int) -> np.ndarray:
    """The rows' parts: rows x PARTS x width, padded with zeros."""
    out = np.zeros((len(column), PARTS * width), np.int64)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out.reshape(len(column), PARTS, width)


def tree_blocks(vectors: DataFrame, width: int) -> DataFrame:
    """A row for each block of up to ``BLOCK`` vectors: ``vec_id, label, x`` as lists, and its ``trees``."""
    label = vectors.schema["label"].dataType

    def listed(column: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                block = batch.slice(begin, BLOCK)
                cut = _cut(block.column("x"), width)
                trees = [Tree(cut[:, p]) for p in range(PARTS)]
                yield pa.RecordBatch.from_arrays(
                    [listed(block.column("vec_id")), listed(block.column("label")), pa.array([cut.tobytes()], pa.binary()),
                     pa.array([_to_bytes(trees)], pa.binary())], names=["vec_id", "label", "x", "trees"])

    schema = T.StructType([T.StructField("vec_id", T.ArrayType(T.LongType())), T.StructField("label", T.ArrayType(label)),
                           T.StructField("x", T.BinaryType()), T.StructField("trees", T.BinaryType())])
    return vectors.select("vec_id", "label", "x").mapInArrow(run, schema)


def _block(batch: pa.RecordBatch, k: int, width: int) -> tuple[np.ndarray, list[Tree]]:
    cut = np.frombuffer(batch.column("x")[k].as_py(), np.int64).reshape(-1, PARTS, width)
    return cut, _from_bytes(batch.column("trees")[k].as_py(), cut)


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (PARTS x entries x width) after a round."""
    width = books.shape[2]

    def run(batches):
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                _, trees = _block(batch, k, width)
                for p, tree in enumerate(trees):
                    n, s = tree.sums(books[p])
                    count[p] += n
                    total[p] += s
        part, entry, dim = (x.ravel() for x in np.indices(books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, dim, np.repeat(count.ravel(), width), total.ravel())],
                                         names=["part", "entry", "dim", "n", "total"])

    sums = blocks.select("x", "trees").mapInArrow(run, "part long, entry long, dim long, n long, total long")
    # as many rows as the codebooks have components
    rows = sums.groupBy("part", "entry", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    new = books.copy()
    for r in rows:
        if r.n:
            new[r.part, r.entry, r.dim] = int(r.total) // r.n
    return new


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _codes(blocks: DataFrame, books: np.ndarray, label: T.DataType) -> DataFrame:
    width = books.shape[2]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                cut, trees = _block(batch, k, width)
                codes = np.stack([tree.codes(books[p]) for p, tree in enumerate(trees)], axis=1)
                error = np.zeros(len(cut), np.int64)
                for p in range(PARTS):
                    error += ((cut[:, p] - books[p][codes[:, p]]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(k, 1).flatten(), batch.column("label").slice(k, 1).flatten(),
                     pa.array([row.tobytes().hex() for row in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return blocks.mapInArrow(run, schema)


def compress(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every row that takes part."""
    ship_package(embeddings.sparkSession)
    vectors = scaled(embeddings)
    longest = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    books = np.zeros((PARTS, max(1, len(first)), width), np.int64)
    for k, row in enumerate(first):
        books[:, k] = np.pad(np.array(row.x, np.int64), (0, PARTS * width - len(row.x))).reshape(PARTS, width)
    blocks = written(tree_blocks(vectors, width), "cover-trees")
    for _ in range(ROUNDS):
        books = lloyd_round(blocks, books)
    codes = written(_codes(blocks, books, vectors.schema["label"].dataType), "vector-codes")
    per_label = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    per_label = per_label.select(F.col("label").alias("its"), F.least("label_error", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = codes.join(per_label.hint("rebalance"), codes.label.eqNullSafe(per_label.its))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
