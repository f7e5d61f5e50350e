"""MinHash near-duplicates by tensored banding (operator 13).

A text's set holds its distinct word shingles. Two texts link if their sets'
intersection is at least ``percent`` hundredths of their union; the connected
components are the groups.

Two collections of ``HALVES`` half keys, each of ``ROWS`` minhashes, are
combined in pairs: table (i, j) is keyed by the i-th half key of the first
collection and the j-th of the second. So HALVES squared tables cost
2 * HALVES * ROWS minhashes, not HALVES squared times 2 * ROWS of them. A link
of similarity s is in no common table only if all half keys of one collection
differ, with probability below 2 * (1 - s ** ROWS) ** HALVES: 2.2e-5 at 0.85,
3e-7 at 0.9. Half keys that only one set has cannot meet; they go before the
pairs are formed, so an ordinary text gives no rows at all.

Candidates of a table are looked at in three turns:

* star: each set with the smallest one of its buckets that it resembles most;
  the whole sets verify the link;
* families: within each bucket, a task compares the minhashes of sets that are
  not joined yet and gives out a spanning forest of the pairs that may reach
  the similarity (a link stays with probability 1 - 1e-6). What these forests
  connect is a family; every pair that may link lies in one;
* rest: the sets of a family meet in one task, whole, once each; all of its
  pairs that are not joined yet and may link are verified there, the most
  agreeing first, and the links that join something are given out.

So no step gives out more pairs than there are sets in its groups. A bucket or
family of more than ``CELL_ROWS`` rows (or ``CELL_SHINGLES`` shingles) is cut
into blocks, whose pairs are dealt over tasks. Equal sets are one node, so
exact copies cost nothing, and pairs that are joined already are not looked at.

Sets are verified as sets of 64-bit hashes of all shingles (of the words'
XXH64), equality of sets by a 128-bit digest of them.

Null and empty texts and those without a word have an empty set, linked with
nothing. Fewer words than a shingle are one shingle. Repeated rows share a
component. A null ``doc_id`` is never a ``component_id`` unless the component
has no other. An empty table gives no rows. Other columns are left behind.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ship_package, text_rows, written
from shelfmark.llm.simhash_pivots import connected

SEED = 42
HALVES, ROWS = 12, 3
MINHASHES = 2 * HALVES * ROWS
#: Rows of a bucket or family, and shingles of a family, that one task compares with each other or with another block.
CELL_ROWS, CELL_SHINGLES = 8192, 2_000_000
#: Nodes whose ids are broadcast at most (8 MB); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Links between components that one task joins at most (16 MB); more are joined by rounds over all tasks.
LOCAL_LINKS = 1_000_000
#: Characters of texts, and shingles, that a task looks at together.
CHARS, PIECE = 4_000_000, 1 << 18
#: Pairs whose minhashes are compared together.
PAIRS = 1 << 17


def _factors(n: int) -> np.ndarray:
    """``n`` odd factors: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), SEED) | 1 for k in range(n)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(texts: pa.Array, shingle: int = 3) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = words.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    offsets = words.offsets.to_numpy()
    count = np.diff(upto[offsets - offsets[0]])
    coded = flat.filter(real).dictionary_encode()
    digest = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = np.concatenate([digest[coded.indices.to_numpy()] if len(digest) else digest, np.zeros(shingle, np.uint64)])
    given = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    ends = np.cumsum(given)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(count) - count) - (ends - given), given)
    size = np.repeat(np.minimum(count, shingle), given)
    total = size.astype(np.uint64)
    for k, factor in enumerate(_factors(shingle)):
        total += np.where(size > k, hashes[at + k], np.uint64(0)) * factor
    total = _mixed(total)
    return [np.unique(total[b - n:b]) for b, n in zip(ends.tolist(), given.tolist(), strict=True)]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each minhash, a row for each set (zeros for an empty one)."""
    least = np.full((len(sets), MINHASHES), np.iinfo(np.uint64).max, np.uint64)
    factors = _factors(MINHASHES)
    full = [k for k, s in enumerate(sets) if len(s)]
    owner = np.repeat(np.array(full, np.int64), [len(sets[k]) for k in full])
    flat = np.concatenate([sets[k] for k in full]) if full else np.zeros(0, np.uint64)
    for begin in range(0, len(flat), PIECE):
        own, part = owner[begin:begin + PIECE], flat[begin:begin + PIECE]
        starts = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
        who = own[starts]
        for k, factor in enumerate(factors):
            least[who, k] = np.minimum(least[who, k], np.minimum.reduceat(part * factor, starts))
    out = (_mixed(least) >> np.uint64(48)).astype(np.uint16)
    out[[len(s) == 0 for s in sets]] = 0
    return out


def _text_slices(batches):
    """Slices of Arrow batches with about ``CHARS`` bytes of text each."""
    for batch in batches:
        length = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False) + 1)
        begin = 0
        while begin < batch.num_rows:
            before = length[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(length, before + CHARS, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def with_sketches(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, n`` (size of the set), ``digest`` of the whole set and ``sketch`` (its minhashes)."""
    def run(batches):
        for batch in _text_slices(batches):
            sets = shingles(batch.column("text"), shingle)
            sketch = minhashes(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.array([row.tobytes() for row in sketch], pa.binary())], names=["doc_id", "n", "digest", "sketch"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n long, digest binary, sketch binary")


def bucket_members(sketches: DataFrame) -> DataFrame:
    """``key, node, lead`` for the tables' buckets of two nodes or more; ``lead`` is the smallest of the bucket."""
    width = 2 * ROWS
    half = [F.struct(F.lit(k // HALVES).alias("side"), F.xxhash64(F.lit(k), F.substring("sketch", k * width + 1, width)).alias("half"))
            for k in range(2 * HALVES)]
    halves = sketches.select("node", F.inline(F.array(*half)))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("half")
    both = halves.join(shared.hint("rebalance"), "half", "left_semi").groupBy("node").agg(
        *[F.collect_list(F.when(F.col("side") == k, F.col("half"))).alias(name) for k, name in enumerate("ab")])
    both = written(both.filter((F.size("a") > 0) & (F.size("b") > 0)), "minhash-halves")
    table_keys = F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.xxhash64(a, b))))
    keys = both.select("node", F.explode(table_keys).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return keys.join(buckets.select("key", "lead").hint("rebalance"), "key").select("key", "node", "lead")


def least_agreement(percent: int, chance: float = 1e-6) -> int:
    """Minhashes that sets of ``percent`` similarity share at least, but for this chance."""
    p, below = percent / 100, 0.0
    for k in range(MINHASHES + 1):
        below += math.comb(MINHASHES, k) * p ** k * (1 - p) ** (MINHASHES - k)
        if below > chance:
            return k
    return MINHASHES


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, MINHASHES)


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``u, v, agreeing`` of the pairs that may link, by set sizes and minhashes."""
    least = least_agreement(percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                agreeing = (_lanes(batch.column("su")) == _lanes(batch.column("sv"))).sum(axis=1)
                out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(agreeing, pa.int64())], names=["u", "v", "agreeing"])
                yield out.filter(pa.array(agreeing >= least))

    for end in "uv":
        pairs = pairs.join(sketches.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}")), end)
    near = pairs.filter(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return near.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long, agreeing long")


def _cross_pairs(comp, n, own, halved, lanes, percent: int, least: int):
    """Pairs ``a < b`` of a cell's rows that share no component and may link, and their agreeing minhashes, the most agreeing first.

    ``halved`` cells hold two blocks, whose rows meet those of the other block only.
    """
    found = [np.zeros((3, 0), np.int64)]
    step = max(1, PAIRS // max(1, len(comp)))
    for begin in range(0, len(comp), step):
        a, b = np.nonzero(comp[begin:begin + step, None] != comp[None, :])
        a += begin
        fit = (a < b) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (~halved[a] | (own[a] != own[b]))
        a, b = a[fit], b[fit]
        agreeing = (lanes[a] == lanes[b]).sum(axis=1)
        good = agreeing >= least
        found.append(np.stack([a[good], b[good], agreeing[good]]))
    a, b, agreeing = np.concatenate(found, axis=1)
    order = np.argsort(-agreeing, kind="stable")
    return a[order].tolist(), b[order].tolist()


def _joining(percent: int, verify: bool):
    """For rows sorted by cell (``cell, own, halved, node, comp, n, sketch``, and ``shingles`` to ``verify`` with): pairs that join components, in each cell a forest."""
    least = least_agreement(percent)

    def of_cell(rows: pa.Table) -> list[tuple[int, int]]:
        comp, n, own, halved, node = (rows.column(c).to_numpy() for c in ("comp", "n", "own", "halved", "node"))
        if (comp == comp[0]).all():
            return []
        a, b = _cross_pairs(comp, n, own, halved, _lanes(rows.column("sketch")), percent, least)
        root: dict[int, int] = {}

        def top(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        sets: dict[int, np.ndarray] = {}

        def whole(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = rows.column("shingles")[k].values.to_numpy()
            return sets[k]

        out = []
        for i, j in zip(a, b, strict=True):
            x, y = top(int(comp[i])), top(int(comp[j]))
            if x == y:
                continue
            if verify:
                both = len(np.intersect1d(whole(i), whole(j), assume_unique=True))
                if 100 * both < percent * (int(n[i]) + int(n[j]) - both):
                    continue
            root[max(x, y)] = min(x, y)
            out.append((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
        return out

    def of_cells(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        cell = rows.column("cell").to_numpy()
        cuts = [0, *(np.nonzero(np.diff(cell))[0] + 1).tolist(), len(cell)]
        pairs = [p for lo, hi in zip(cuts, cuts[1:]) if hi - lo > 1 for p in of_cell(rows.slice(lo, hi - lo))]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            last = int(np.searchsorted(cell, cell[-1], "left"))
            if held and cell[0] != held[-1].column("cell")[0].as_py():
                yield of_cells(pa.Table.from_batches(held))
                held = []
            if last:
                yield of_cells(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield of_cells(pa.Table.from_batches(held))
    return run


def _in_cells(rows: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """``rows`` of the groups that ``blocks`` (``group, blocks``) names, in the cells of their blocks' pairs."""
    rows = rows.join(blocks.hint("rebalance"), group)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(cell.alias("cell"), "own", (F.col("own") != F.col("other")).alias("halved"), "node", "comp")


def jumped(links: DataFrame) -> DataFrame:
    """``node, root`` of all ends of ``links`` (``u, v``) where each ``v`` has one ``u < v``: pointers are followed until none leads on."""
    now = written(links.select(F.col("v").alias("node"), F.col("u").alias("root")), "minhash-roots")
    while True:
        further = now.select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = written(now.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "minhash-roots")
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.select("node", "root")


def _united(frames):
    """``node, root`` of all ends of the links in ``frames``."""
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(root), "root": [top(x) for x in root]}, dtype="int64")


def rooted(frame: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``frame`` with the root of ``column`` in its place (itself where it has none)."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return frame.join(named, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further ``links`` (``u, v``) between nodes."""
    between = rooted(rooted(links, roots, "u"), roots, "v").filter("u <> v").distinct()
    between = written(between, "minhash-between")
    if between.count() <= LOCAL_LINKS:
        tops = between.coalesce(1).mapInPandas(_united, "node long, root long")
    else:
        tops = connected(between)
    tops = written(tops.filter("node <> root"), "minhash-tops")
    return written(rooted(roots, tops, "root").unionByName(tops.join(roots, "node", "left_anti")), "minhash-roots")


def families(members: DataFrame, sketches: DataFrame, roots: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """Pairs ``u < v`` that connect, over all buckets, all nodes of different roots that may link."""
    named = written(rooted(members.select("key", "node", F.col("node").alias("comp")), roots, "comp"), "minhash-members")
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo < hi")
    cells = _in_cells(named, "key", mixed.select("key", F.ceil(F.col("rows") / cell_rows).cast("long").alias("blocks")))
    rows = cells.join(sketches.select("node", "n", "sketch"), "node").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(_joining(percent, False), "u long, v long").distinct()


def rest(family_of: DataFrame, docs: DataFrame, sketches: DataFrame, roots: DataFrame, shingle: int, percent: int, cell_rows: int) -> DataFrame:
    """Verified links ``u < v`` that connect, within families (``node, family``), what all links connect."""
    named = written(rooted(family_of.withColumn("comp", F.col("node")), roots, "comp").join(sketches, "node"), "minhash-families")
    sizes = named.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("rows") / cell_rows), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("long")
    cells = _in_cells(named.select("family", "node", "comp"), "family", sizes.select("family", blocks.alias("blocks")))
    sets = written(whole_sets(docs, named.select("node", "doc_id", "digest"), shingle), "minhash-sets")
    rows = cells.join(named.select("node", "n", "sketch"), "node").join(sets, "node").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(_joining(percent, True), "u long, v long").distinct()


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` (all hashes of the set) for ``wanted`` (``node, doc_id, digest``)."""
    def run(batches):
        for batch in _text_slices(batches):
            sets = shingles(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()),
                                              pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    rows, ids = text_rows(docs), wanted.select("doc_id").filter("doc_id IS NOT NULL")
    nodes, nameless = wanted.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    if nodes <= BROADCAST_NODES:
        ids = F.broadcast(ids)
    texts = rows.join(ids, "doc_id", "left_semi")
    if nameless:
        texts = texts.unionByName(rows.filter("doc_id IS NULL"))
    sets = texts.mapInArrow(run, "digest binary, shingles array<long>")
    return sets.join(wanted.select("digest", "node").hint("rebalance"), "digest").select("node", "shingles").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``u, v`` of the pairs whose whole sets reach the similarity."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = written(sketches.join(ends, "node", "left_semi").select("node", "doc_id", "digest"), "minhash-wanted")
    sets = written(whole_sets(docs, wanted, shingle), "minhash-sets")
    for end in "uv":
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}")), end)
    both = F.size(F.array_intersect("su", "sv"))
    sized = pairs.select("u", "v", both.cast("long").alias("both"), (F.size("su") + F.size("sv")).cast("long").alias("all"))
    return sized.filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("u", "v")


def joined_nodes(docs: DataFrame, sketches: DataFrame, shingle: int = 3, percent: int = 85, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``node, root`` for nodes that links join to another one; ``root`` is the smallest reachable (roots themselves may be absent).

    ``sketches``: ``node, doc_id, n, digest, sketch``, one row for each distinct set.
    """
    members = written(bucket_members(sketches), "minhash-buckets")
    stars = members.filter("node > lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct()
    best = likely(stars, sketches, percent).groupBy("v").agg(F.max(F.struct("agreeing", -F.col("u"))).alias("best"))
    pairs = written(best.select((-F.col("best.col2")).alias("u"), "v"), "minhash-pairs")
    roots = jumped(confirmed(pairs, docs, sketches, shingle, percent))
    near = written(families(members, sketches, roots, percent, cell_rows), "minhash-near")
    if near.isEmpty():
        return roots
    tops = merged(roots, near).select("node", F.col("root").alias("family"))
    # nodes of families that hold more than one root; a family's own top is one of them
    met = rooted(near.select(F.col("u").alias("family")), tops.select("node", F.col("family").alias("root")), "family").distinct()
    family_of = tops.unionByName(met.select(F.col("family").alias("node"), "family")).join(met.hint("rebalance"), "family", "left_semi").select("node", "family")
    found = written(rest(family_of, docs, sketches, roots, shingle, percent, cell_rows), "minhash-links")
    return merged(roots, found)


def components(docs: DataFrame, shingle: int = 3, percent: int = 85, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the smallest doc_id reachable), ``kept`` (it is that one)."""
    ship_package(docs.sparkSession)
    # the rows' numbers are written, so they name sets from here on
    sets = written(with_sketches(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "minhash-sketches")
    nodes = written(sets.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")), "minhash-nodes")
    sketches = sets.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    roots = joined_nodes(docs, written(sketches, "minhash-nodes"), shingle, percent, cell_rows)
    tops = rooted(nodes.withColumn("root", F.col("node")), roots, "root")
    least = tops.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = tops.join(least, "root").select("digest", "component_id")
    full = sets.filter("n > 0").join(named.hint("rebalance"), "digest").select("doc_id", "n", "component_id")
    alone = sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                          F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
