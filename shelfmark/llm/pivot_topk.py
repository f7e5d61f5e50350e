"""Exact top-k inner products by a pivot-distance index (operator 3).

Components become floor(1024 * x); the score is the integer inner product. To
search it as a distance, every indexed vector gets one more component,
sqrt(M - |x|^2) with M the largest squared length, and a query gets zero: then
|q - x|^2 = |q|^2 + M - 2 q.x.

The index keys each vector by its nearest pivot and its distance to it, in
rings ("annuli"). For a query, the triangle inequality bounds the score of
every vector of an annulus. Annuli are visited in the order of their bounds:
first as many as hold a few times k vectors, which gives each query its k-th
best score so far; then all others whose bound reaches that score. The rest
cannot hold a result.

Annuli are cut into blocks of ``BLOCK`` vectors and the queries that visit an
annulus into blocks as well, so a task joins two bounded blocks. Of equal
vectors only the k + 1 smallest ids are indexed (more can never be among k
results of any query); a hot vector leaves each task k + 1 times at most.
Only what is bounded by a parameter reaches the driver: pivots, fitted on at
most ``SAMPLE`` vectors, and the annulus table. The search is exact for any
pivots.

Vectors that are null or hold a null or non-finite component, and null ids,
take no part; repeated ids count once, with the greatest vector. Shorter
vectors count as padded with zeros. Ties go to the smaller id. Scores beyond
64 bits are held at the limits. With no other vector a query has no rows. An
empty table gives no rows. Other columns are left behind.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import ship_package, written

PIVOTS, RINGS, SAMPLE = 64, 64, 10_000
BLOCK = 4096
#: Indexed vectors, in multiples of k, that a query's first annuli hold.
SEED = 16
LEAST, MOST = -2**63, 2**63 - 1


def block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A block below ``blocks`` for each id, by a mixed hash: ids may share factors with the number of blocks."""
    h = np.asarray(ids).astype(np.int64).view(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) % np.asarray(blocks).astype(np.uint64)).astype(np.int64)


def scaled(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x``: the integer vectors that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter("vec_id IS NOT NULL AND e IS NOT NULL")
    rows = rows.filter(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.select("vec_id", F.transform("e", lambda v: F.floor(v * 1024.0)).alias("x"))
    return rows.groupBy("vec_id").agg(F.max("x").alias("x"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of integer components, padded with zeros; exact Python integers where 64-bit products may not do."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    width = max(1, q.shape[1])
    top = max([1, *(int(abs(int(f(m)))) for m in (q, x) if m.size for f in (np.min, np.max))])
    if top * top * width < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


class Index(NamedTuple):
    """What the tasks need to place vectors and queries; all bounded by parameters."""
    width: int
    power: float  # M
    pivots: np.ndarray  # with the added component
    ring: float  # width of a ring
    annuli: np.ndarray  # pivot, ring
    near: np.ndarray  # least and greatest distance in each annulus
    far: np.ndarray
    count: np.ndarray

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Distances of vectors with the added component ``extra`` to the pivots."""
        x = x.astype(np.float64)
        square = (x * x).sum(1) + extra ** 2
        body = self.pivots[:, :-1]
        dots = x @ body.T + extra[:, None] * self.pivots[:, -1]
        return np.sqrt(np.maximum(0, square[:, None] + (self.pivots ** 2).sum(1) - 2 * dots))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, ring and distance of indexed vectors."""
        square = (x.astype(np.float64) ** 2).sum(1)
        d = self.distances(x, np.sqrt(np.maximum(0, self.power - square)))
        pivot = d.argmin(1)
        least = d[np.arange(len(x)), pivot]
        return pivot, np.minimum(least // self.ring, RINGS - 1).astype(np.int64), least

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and annulus, a score that none of its vectors exceeds."""
        d = self.distances(q, np.zeros(len(q)))[:, self.annuli[:, 0]]
        short = np.maximum(0, np.maximum(d - self.far, self.near - d))
        square = (q.astype(np.float64) ** 2).sum(1)[:, None]
        return (square + self.power - short ** 2) / 2 + 1e-6 * (square + self.power + 1)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Marks each query's first annuli."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, held < SEED * k, axis=1)
        return out


def fit_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first pivots: each is the sample vector farthest from those before it."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [int(np.argmax((sample ** 2).sum(1)))]
    least = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _place_all(rows: DataFrame, index: Index) -> DataFrame:
    """``vec_id, x, pivot, ring, dist`` of the vectors to be indexed."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(frames):
        for frame in frames:
            pivot, ring, dist = shared.value.place(_matrix(frame["x"], shared.value.width))
            yield frame.assign(pivot=pivot, ring=ring, dist=dist)

    return rows.mapInPandas(run, "vec_id long, x array<long>, pivot long, ring long, dist double")


def build(vectors: DataFrame, k: int) -> tuple[DataFrame, Index]:
    """The placed vectors (a table in the shared folder) and the index over them."""
    ship_package(vectors.sparkSession)
    copies = Window.partitionBy("x").orderBy("vec_id")
    few = vectors.withColumn("n", F.row_number().over(copies)).filter(F.col("n") <= k + 1).select("vec_id", "x")
    power = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    total, width, most = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(power), F.lit(0.0))).first()
    chance = F.xxhash64("vec_id").cast("double") / F.lit(2.0 ** 64) + 0.5
    sample = vectors.filter(chance <= SAMPLE / max(1, total)).orderBy(chance, "vec_id").limit(SAMPLE).select("x").toPandas()
    x = _matrix(sample["x"], width).astype(np.float64)
    pivots = fit_pivots(np.column_stack([x, np.sqrt(np.maximum(0, most - (x ** 2).sum(1)))]))
    none = np.zeros(0)
    index = Index(width, most, pivots, max(1e-9, 2 * np.sqrt(most) / RINGS), none.reshape(0, 2), none, none, none)
    placed = written(_place_all(few, index), "placed-vectors")
    table = placed.groupBy("pivot", "ring").agg(F.min("dist").alias("near"), F.max("dist").alias("far"), F.count("*").alias("n")).orderBy("pivot", "ring").toPandas()
    return placed, index._replace(annuli=table[["pivot", "ring"]].to_numpy(np.int64), near=table["near"].to_numpy(float),
                                  far=table["far"].to_numpy(float), count=table["n"].to_numpy(np.int64))


def _search(placed: DataFrame, queries: DataFrame, index: Index, k: int, rest: bool) -> DataFrame:
    """``query_id, vec_id, score``: the best of each visited block.

    ``queries``: ``query_id, x, least`` (the k-th best score so far, or null).
    Visits the first annuli, or with ``rest`` all others that may matter.
    """
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def visits(frames):
        ix = shared.value
        for frame in frames:
            q = _matrix(frame["x"], ix.width)
            bounds = ix.bounds(q)
            go = ix.first(bounds, k)
            if rest:
                least = frame["least"].to_numpy(float)
                go = ~go & (np.isnan(least)[:, None] | (bounds >= least[:, None]))
            row, annulus = np.nonzero(go)
            yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[row], "q": frame["x"].take(row).to_numpy(), "annulus": annulus})

    asked = written(queries.mapInPandas(visits, "query_id long, q array<long>, annulus long"), "visits")
    # a row for each annulus: at most PIVOTS * RINGS
    asks = np.zeros(len(index.count), np.int64)
    for annulus, n in asked.groupBy("annulus").count().toLocalIterator():
        asks[annulus] = n
    parts = np.maximum(1, -(-index.count // BLOCK))
    asking = -(-asks // BLOCK)
    plan = spark.sparkContext.broadcast(({tuple(a): i for i, a in enumerate(index.annuli.tolist())}, parts, asking))

    def spread_vectors(frames):
        number, parts, asking = plan.value
        for frame in frames:
            at = np.array([number[a] for a in zip(frame["pivot"], frame["ring"], strict=True)], np.int64).reshape(-1)
            times = asking[at]
            row = np.repeat(np.arange(len(frame)), times)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            ids = frame["vec_id"].to_numpy()
            yield pd.DataFrame({"vec_id": ids[row], "x": frame["x"].take(row).to_numpy(), "annulus": at[row],
                                "part": block_of(ids, parts[at])[row], "asking": turn})

    def spread_queries(frames):
        _, parts, asking = plan.value
        for frame in frames:
            at = frame["annulus"].to_numpy()
            times = parts[at]
            row = np.repeat(np.arange(len(frame)), times)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            ids = frame["query_id"].to_numpy()
            yield pd.DataFrame({"query_id": ids[row], "q": frame["q"].take(row).to_numpy(), "annulus": at[row],
                                "part": turn, "asking": block_of(ids, np.maximum(1, asking[at]))[row]})

    def best(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x = x.sort_values("vec_id")
        ids, width = x["vec_id"].to_numpy(), shared.value.width
        vectors, out = _matrix(x["x"], width), []
        for a in range(0, len(q), 256):
            part = q.iloc[a:a + 256]
            own = part["query_id"].to_numpy()
            s = _scores(_matrix(part["q"], width), vectors)
            s = np.where(own[:, None] == ids[None, :], LEAST, s)
            n = min(k, len(ids))
            floor = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
            row, col = np.nonzero((s >= floor[:, None]) & (own[:, None] != ids[None, :]))
            found = pd.DataFrame({"query_id": own[row], "vec_id": ids[col], "score": s[row, col]})
            found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(found[found.groupby("query_id").cumcount() < k])
        return pd.concat(out)

    key = ["annulus", "part", "asking"]
    left = asked.mapInPandas(spread_queries, "query_id long, q array<long>, annulus long, part long, asking long").groupBy(*key)
    right = placed.mapInPandas(spread_vectors, "vec_id long, x array<long>, annulus long, part long, asking long").groupBy(*key)
    return left.cogroup(right).applyInPandas(best, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries, the rows whose id is divisible by ``every``."""
    vectors = written(scaled(embeddings), "vectors")
    placed, index = build(vectors, k)
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "x")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = written(ranked(_search(placed, queries.withColumn("least", F.lit(None).cast("double")), index, k, False)), "first-results")
    least = first.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    rest = _search(placed, queries.join(least, "query_id", "left"), index, k, True)
    found = first.select("query_id", "vec_id", "score").unionByName(rest)
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
