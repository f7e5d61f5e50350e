"""Quality classifier: a generalised additive model with pairwise interactions (operator 5).

Every whole text becomes a few numbers (shares of character kinds, word and
line repetition, lengths). Each number is cut into quantile bins. Boosting
goes round the features in a cycle; each step fits a shallow tree to the
residuals over one feature's bins and adds it, shrunk, to that feature's
lookup table. Then the pairs whose four-quadrant cut explains most of what is
left are boosted the same way into two-way tables. A score is the sum of the
looked-up values, through the logistic function.

Fitting takes at most ``max_rows`` labelled documents, in the order of a hash
of their id, on the driver (a few numbers each). Scoring is one pass over all
documents without a shuffle.

Null text counts as empty; an empty text has all features zero and gets a
score like any other. Very long texts are read whole. Repeated documents are
scored each; of repeated labels of one id the lowest counts. Null ids and null
labels teach nothing. With no label, or labels of one kind only, the model is
a constant. An empty table gives no rows. Other columns are left behind.
"""

from __future__ import annotations

from itertools import combinations
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import crc_bucket, ship_package

MAX_ROWS = 20_000
BINS = 32
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 150, 60, 0.15, 8
#: Least curvature in a leaf, and the penalty on leaf values.
LEAST_LEAF, RIDGE = 2.0, 1.0

FEATURES = ("chars", "words", "word_length", "upper", "digits", "marks", "symbols", "bangs", "pipes", "stops",
            "distinct_words", "repeated_words", "lines", "distinct_lines", "longest_word", "other_bytes", "entropy")

_MARKS = [ord(c) for c in ".,;:'\"-()?"]
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]


def features(text: str) -> list[float]:
    """The numbers of one whole text, in the order of ``FEATURES``."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    n, w = len(data), len(words)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    share = counts[counts > 0] / n
    lines = [x for x in text.split("\n") if x.strip()]
    return [np.log1p(n), np.log1p(w), (n - counts[32] - counts[10]) / w, upper / max(1, upper + lower),
            counts[48:58].sum() / n, counts[_MARKS].sum() / w, counts[_SYMBOLS].sum() / w, counts[33] / w, counts[124] / w, counts[46] / w,
            len(set(words)) / w, sum(map(eq, words, words[1:])) / w, len(lines) / w, len(set(lines)) / max(1, len(lines)),
            max(map(len, words)), counts[128:].sum() / n, float(-(share * np.log2(share)).sum())]


class Model(NamedTuple):
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features, by adding up bins."""
        bins = binned(x, self.edges)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, f], bins[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), int)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _value(g, h):
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most three leaves for gradient and curvature sums by bin."""
    def best(a: int, b: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        tg, th = g[a:b].sum(), h[a:b].sum()
        gain = _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th)
        gain = np.where((ch >= LEAST_LEAF) & (th - ch >= LEAST_LEAF), gain, 0)
        at = int(np.argmax(gain)) if len(gain) else 0
        return (float(gain[at]) if len(gain) else 0.0), a + at + 1

    parts = [(0, len(g))]
    for _ in range(2):
        gain, cut, part = max(((*best(*p), p) for p in parts), key=lambda t: t[0])
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a two-way table into four quadrants."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    def corner(c):
        a = c[1:-1, 1:-1]
        return a, c[1:-1, -1:] - a, c[-1:, 1:-1] - a, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + a
    gain = sum(_gain(x, y) for x, y in zip(corner(cg), corner(ch), strict=True)) if min(g.shape) > 1 else np.zeros((0, 0))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _value(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1])), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the tables to features ``x`` and labels ``y`` (0 or 1)."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(rate / (1 - rate))), [], [], [], [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = binned(x, edges)
    sizes = [len(e) + 1 for e in edges]
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    tables = [np.zeros(s) for s in sizes]

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, s in enumerate(sizes):
            r, c = slopes()
            step = RATE * _tree(np.bincount(bins[:, f], r, s), np.bincount(bins[:, f], c, s))
            tables[f] += step
            total += step[bins[:, f]]

    def two_way(f: int, g: int):
        r, c = slopes()
        at = bins[:, f] * sizes[g] + bins[:, g]
        shape = (sizes[f], sizes[g])
        return [np.bincount(at, v, sizes[f] * sizes[g]).reshape(shape) for v in (r, c)]

    ranked = sorted(combinations(range(len(sizes)), 2), key=lambda p: -_quadrants(*two_way(*p))[0])
    pairs = ranked[:PAIRS]
    pair_tables = [np.zeros((sizes[f], sizes[g])) for f, g in pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, g), table in zip(pairs, pair_tables, strict=True):
            step = RATE * _quadrants(*two_way(f, g))[1]
            table += step
            total += step[bins[:, f], bins[:, g]]
    return Model(base, edges, tables, pairs, pair_tables)


def is_held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return crc_bucket(doc_id, folds) == fold


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit to ``labels`` (``doc_id`` and the 0/1 column ``label``) of the rows that ``teaches`` allows."""
    ship_package(docs.sparkSession)
    known = labels.filter(teaches & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.col(label).cast("double")).alias("y"))
    chance = F.xxhash64("id").cast("double") / F.lit(2.0 ** 64) + 0.5
    share = 1.5 * max_rows / max(1, known.count())
    few = known.withColumn("chance", chance).filter(F.col("chance") <= share).orderBy("chance", "id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most max_rows ids and labels
    rows = rows.join(F.broadcast(few.select("id", "y")), "id")

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "x": pd.Series([features(t) for t in frame["text"]], dtype=object).to_numpy()})

    # repeated documents teach once
    found = rows.mapInPandas(run, "id long, y double, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("id").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["y"].to_numpy())


def score(docs: DataFrame, model: Model, held_out: Column | None = None, least: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in frames:
            x = np.array([features(t) for t in frame["text"]], float).reshape(len(frame), len(FEATURES))
            p = shared.value.score(x)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": p, "predicted": (p >= least).astype(int)})

    held = (held_out if held_out is not None else F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held)
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
