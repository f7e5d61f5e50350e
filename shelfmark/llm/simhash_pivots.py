"""SimHash near-duplicates by pivot distance tables (operator 9).

Fingerprints: the 64-bit majority of the XXH64 hashes (seed 42) of a text's
word shingles. Two fingerprints link if they differ in at most ``max_bits``
bits (1 or 2); the connected components are the groups.

For every fingerprint the Hamming distances to reference fingerprints
("pivots") are the coordinates of a table. By the triangle inequality the
coordinates of linked fingerprints differ by at most ``max_bits``, and as all
distances change parity together, by 1 in *every* coordinate (one bit) or by
0 or 2 in each (two bits). So:

* the first coordinates are a cell number; a fingerprint goes to its own cell
  and probes the neighbouring cells that such differences reach (one half of
  them, as links are symmetric);
* within a cell, pairs are discarded by the largest difference over the other
  coordinates, one coordinate after the other;
* the survivors are verified by the bits themselves.

A cell that would hold more than ``CELL_ROWS`` rows, as when many texts are
nearly alike, is cut into blocks by a hash, and each pair of blocks is a cell
of its own: no task holds more, whatever the texts. The pair checks of such a
cell are dealt out, not saved.

Equal fingerprints are one node, so exact copies of any number cost nothing.
The number of cell coordinates follows from the number of distinct
fingerprints and changes the cost only, never the result. Every cell emits a
spanning star for each of its linked sets, not all its pairs. Components come
from alternating large-star and small-star rounds over tables in the shared
folder; nothing of the graph reaches the driver but counts.

Null text counts as empty: fingerprint zero, linked like any other. Shorter
texts than a shingle are one shingle. Repeated rows share a component. A null
``doc_id`` is never a ``component_id`` unless the component has no other. An
empty table gives no rows. Other columns of the input are left behind
(``components``) or returned unchanged (``keep_documents``).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ship_package, text_rows, written

SEED = 42
#: Coordinates that only discard, beside those that number the cells.
FILTER_PIVOTS = 12
#: Rows of a cell beyond which it is cut into blocks.
CELL_ROWS = 20_000
#: What a row does in a cell: meets the later rows at home, meets all at home, or is only met.
HOME, PROBE, STILL = 0, 1, 2
#: Candidate pairs looked at together.
PAIRS = 1_000_000
#: Hashes whose bits are counted together.
HASHES = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:len(words) - shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:], strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), HASHES):
        bits = np.array(hashes[k:k + HASHES], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""
    def run(frames):
        for frame in frames:
            fps = np.array([fingerprint(t, shingle) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": fps})

    return text_rows(docs).mapInPandas(run, "doc_id long, fp long")


def pivots(n: int) -> np.ndarray:
    """``n`` reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), SEED) for k in range(n)], np.uint64)


def offsets(n: int, max_bits: int) -> list[tuple[int, ...]]:
    """Differences of ``n`` coordinates that linked fingerprints may have: zero, and one of each pair of opposites."""
    reach = set(itertools.product((-1, 1), repeat=n))
    if max_bits == 2:
        reach |= set(itertools.product((-2, 0, 2), repeat=n))
    return [(0,) * n, *sorted(o for o in reach if o > (0,) * n)]


def cell_pivots(distinct: int, max_bits: int) -> int:
    """Coordinates for the cells: the fewest row copies and pair checks for so many fingerprints.

    A random fingerprint shares its parity with half of the others and then
    each coordinate with about 0.14 of them; a copied row costs about as much
    as 500 pair checks.
    """
    def cost(n: int) -> float:
        copies = len(offsets(n, max_bits))
        return copies * (500 + distinct * 0.5 * 0.14 ** n)
    return min(range(3, 8), key=cost)


def _candidate_links(max_bits: int, refs: np.ndarray):
    """Links among the rows (``cell, fp, role``) of partitions that are sorted by cell."""
    def table(fp: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[None, :] ^ refs[:, None]).astype(np.int8)

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        cell, fp = rows["cell"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        role = rows["role"].to_numpy()
        home = np.nonzero(role != PROBE)[0]
        home_cell, home_fp = cell[home], fp[home]
        coord, home_coord = table(fp), table(home_fp)
        first = np.searchsorted(home_cell, cell, "left")
        count = np.searchsorted(home_cell, cell, "right") - first
        # a row at home meets the later rows of its cell, a probe all of them
        rank = np.full(len(rows), -1, np.int64)
        rank[home] = np.arange(len(home))
        skip = np.where(rank >= 0, rank - first + 1, 0)
        first, count = first + skip, np.where(role == STILL, 0, count - skip)
        ends = np.cumsum(count)
        found = []
        for begin in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            stop = min(begin + PAIRS, int(ends[-1]))
            lo, hi = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, stop, "left") + 1
            n = np.minimum(ends[lo:hi], stop) - np.maximum(ends[lo:hi] - count[lo:hi], begin)
            a = np.repeat(np.arange(lo, hi), n)
            b = first[a] + np.arange(begin, stop) - (ends[a] - count[a])
            for mine, theirs in zip(coord, home_coord, strict=True):
                near = np.abs(mine[a] - theirs[b]) <= max_bits
                a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ home_fp[b]) <= max_bits
            found.append(np.stack([fp[a[near]].view(np.int64), home_fp[b[near]].view(np.int64)]))
        return _stars(np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64))

    def run(frames):
        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            ends = int(np.searchsorted(rows["cell"].to_numpy(), rows["cell"].iloc[-1], "left")) if len(rows) else 0
            held = rows.iloc[ends:].reset_index(drop=True)
            yield links(rows.iloc[:ends])
        if held is not None:
            yield links(held)
    return run


def _stars(pairs: np.ndarray) -> pd.DataFrame:
    """A star for each linked set: every member with the smallest one."""
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[far], "v": nodes[label[far]]})


def _in_blocks(rows: DataFrame, cells: DataFrame, moves: list[int], cell_rows: int) -> DataFrame:
    """``rows`` (``cell, fp, role``) with each cell of more than ``cell_rows`` rows cut into cells of block pairs."""
    # cells whose neighbours are all smaller than this hold few enough
    large = cells.groupBy("cell").count().filter(F.col("count") > cell_rows // len(moves))
    reached = large.select("cell", "count", F.explode(F.array(*[F.lit(m).cast("long") for m in moves])).alias("move"))
    hot = reached.select((F.col("cell") + F.col("move")).alias("hot"), "count").groupBy("hot").agg(F.sum("count").alias("rows")).filter(F.col("rows") > cell_rows)
    hot = written(hot.select("hot", F.ceil(F.col("rows") / cell_rows).cast("long").alias("blocks")), "hot-cells")
    if hot.isEmpty():
        return rows
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)

    def place(home, probe, role):
        # cells that share a hash cost checks, not results
        return F.struct(F.xxhash64("cell", home, probe).alias("cell"), role.cast("int").alias("role"))

    met = F.transform(every, lambda k: place(F.col("own"), k, F.when(k == F.col("own"), HOME).otherwise(STILL)))
    meets = F.transform(F.filter(every, lambda k: (F.col("role") == PROBE) | (k < F.col("own"))), lambda k: place(k, F.col("own"), F.lit(PROBE)))
    places = F.when(F.col("blocks").isNull(), F.array(F.struct("cell", "role"))).when(
        F.col("role") == HOME, F.concat(met, meets)).otherwise(meets)
    dealt = rows.join(hot, rows.cell == hot.hot, "left").withColumn("own", own)
    return dealt.select("fp", F.explode(places).alias("place")).select("place.cell", "fp", "place.role")


def links(nodes: DataFrame, max_bits: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges ``u > v`` between distinct fingerprints (``nodes``: column ``fp``) that connect what the links connect."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    ship_package(nodes.sparkSession)
    n = cell_pivots(nodes.count(), max_bits)
    refs = pivots(n + FILTER_PIVOTS)
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)))).cast("long") for p in refs[:n].view(np.int64)]
    moves = [sum((128 ** k * o for k, o in enumerate(offset)), 0) for offset in offsets(n, max_bits)]
    cell = sum((d + 2) * 128 ** k for k, d in enumerate(distance))
    cells = nodes.select("fp", cell.alias("cell"))
    rows = cells.select("fp", "cell", F.explode(F.array(*[F.lit(m).cast("long") for m in moves])).alias("move"))
    rows = rows.select((F.col("cell") + F.col("move")).alias("cell"), "fp", F.when(F.col("move") != 0, PROBE).otherwise(HOME).alias("role"))
    rows = _in_blocks(rows, cells, moves, cell_rows)
    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_candidate_links(max_bits, refs[n:]), "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``): the smallest node that it reaches."""
    def ordered(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()

    def star(e: DataFrame, small: bool) -> DataFrame:
        """Small star: a node and its smaller neighbours meet at the smallest. Large star: the larger ones do."""
        near = e if small else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        moved = near.join(low, "u")
        if not small:
            return ordered(moved.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")))
        return ordered(moved.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(ordered(edges), "edges")
    seen = state(now)
    while seen[0]:
        now = written(star(star(now, False), True), "edges")
        was, seen = seen, state(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _groups(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root, component_id`` for every distinct fingerprint."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = connected(links(nodes, max_bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def components(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (the smallest doc_id reachable)."""
    fps = written(with_fingerprints(docs, shingle), "document-fingerprints")
    groups = _groups(fps, max_bits)
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_documents(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The row of each component's smallest ``doc_id``, with all its columns.

    A component of null ids alone keeps one of its rows.
    """
    fps = written(with_fingerprints(docs, shingle), "document-fingerprints")
    groups = written(_groups(fps, max_bits), "groups")
    named = groups.filter("component_id IS NOT NULL").select(F.col("component_id").alias("stay_id")).distinct()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(row)
    stay = rows.join(named, F.col("row.doc_id").cast("long") == named.stay_id, "left_semi").select("row.*")
    fp = F.pandas_udf(lambda t: pd.Series(np.array([fingerprint(x or "", shingle) for x in t], np.uint64).view(np.int64)), "long")
    nameless = rows.filter("row.doc_id IS NULL").select("row", fp(F.col("row.text").cast("string")).alias("fp"))
    nameless = nameless.join(groups.filter("component_id IS NULL"), "fp").dropDuplicates(["root"]).select("row.*")
    return stay.unionByName(nameless)
