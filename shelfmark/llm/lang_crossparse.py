"""Language identification by cross-parsing (operator 7).

Per language, a suffix automaton of a bounded sample of labelled text yields
the longest match of an unseen text at any position. A text is parsed into
such longest phrases, one after the other, across words; a phrase starts with
the letter where the match before it broke off. The language that needs the
fewest bits (phrases times log2 of its sample's length, as the classical
cross-parsing estimate has it) wins. Texts are parsed in lower case, as words
of letters and combining marks closed by a space. A text of more than
``PIECE`` letters is parsed in pieces that end at spaces, where a phrase ends
in every language. All pieces of a batch take each step together in all
languages, as numpy arrays.

The sample: for every label, slices of ``SLICE`` characters of documents in the
order of a hash of their id, until ``sample_chars`` letters are gathered;
where the languages are so many that this exceeds ``all_chars``, each gets an
equal share of that. The slices are drawn by a hash threshold that follows
from the labels' letters, so neither the driver nor a task ever holds much
more than the bounded sample. Scoring reads every text whole, without a
shuffle.

Null text or text without a letter (Unicode category L): ``und``, score 0. A
tie goes to the language first in alphabetical order. Without any learned
label every text is ``und``. ``score`` is the winner's share of the languages'
likelihoods (two to the power of minus the bits), between 0 and 1. Rows with
null ``lang`` or ``doc_id`` teach nothing (a null id counts as empty text in
the fold). Repeated rows are scored each. Other columns are left behind
(``predict``) or returned unchanged (``keep_documents``).
"""

from __future__ import annotations

import functools
import itertools
import math
import sys
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import crc_bucket, give_back, ship_package, worker_model, written

#: Letters and spaces that a language is learned from at most, and all languages together.
SAMPLE_CHARS, ALL_CHARS = 60_000, 600_000
#: Characters that a document adds to a sample at most.
SLICE = 500
#: Letters a phrase of a text in a learned language has at least on average.
LEAST_PHRASE = 2.0
UNKNOWN = "und"
#: Letters of a piece: longer texts are parsed in pieces that end at spaces.
PIECE = 2048
#: Characters of texts parsed in step.
BATCH = 1_500_000
#: Labels whose shares are broadcast at most (a few MB); more are joined by a shuffle.
BROADCAST_LABELS = 50_000


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark that joins letters, else 0."""
    kind = {"L": 2, "M": 1}
    return np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.int8, sys.maxunicode + 1)


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as code points of their words in lower case, each word closed by a space, and where each text ends.

    A word is a run of letters and marks; a text without a letter is empty.
    """
    kinds = _kinds()
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) + 1 for p in parts], np.int64)
    flat = np.concatenate([x for p in parts for x in (p, _SPACE)]) if parts else _SPACE[:0]
    kind = kinds[flat]
    word = kind > 0
    closes = np.zeros(len(flat), bool)
    closes[1:] = ~word[1:] & word[:-1]
    ends = np.cumsum(size)
    has_letter = np.add.reduceat(kind == 2, ends - size) > 0 if len(parts) else np.zeros(0, bool)
    keep = (word | closes) & np.repeat(has_letter, size)
    out = np.where(word, flat, np.uint32(32))[keep]
    return out, np.cumsum(keep)[ends - 1] if len(parts) else ends


_SPACE = np.array([32], np.uint32)


def pieces_of(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of the pieces of all texts: of up to ``PIECE`` letters, ended by the last space among them."""
    spaces = np.nonzero(letters == 32)[0]
    owner, begin, length = [], [], []
    for k in np.nonzero(ends > starts)[0].tolist():
        at, end = int(starts[k]), int(ends[k])
        while at < end:
            stop = end
            if end - at > PIECE:
                last = int(np.searchsorted(spaces, at + PIECE)) - 1
                stop = int(spaces[last]) + 1 if last >= 0 and spaces[last] >= at else at + PIECE
            owner.append(k), begin.append(at), length.append(stop - at)
            at = stop
    return np.array(owner, np.int64), np.array(begin, np.int64), np.array(length, np.int64)


def words_of(text: str) -> list[str]:
    """Runs of letters and marks in lower case; none without a letter."""
    letters, _ = letters_of([text])
    return letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()


class SuffixAutomaton:
    """All substrings of a text, as the smallest automaton."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            now = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[now] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
            last = now

    def phrases(self, text: str) -> int:
        """Longest-match phrases that ``text`` is parsed into; an unknown letter is a phrase of its own."""
        count, at, step = 0, 0, self.next
        for c in text:
            to = step[at].get(c)
            if to is None:
                count += at != 0
                to = step[0].get(c, 0)
                count += to == 0
            at = to
        return count + (at != 0)


class ParseTables:
    """Suffix automata as arrays, so that many texts are parsed in step against all languages.

    The arcs of a state span a row from its least to its greatest letter code;
    an entry belongs to the state that ``owner`` names. Letter code 0 is a
    letter of no sample.
    """

    def __init__(self, texts: list[str]):
        seen = Counter("".join(texts))
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.code = np.zeros(sys.maxunicode + 1, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: k + 1 for k, c in enumerate(letters)}
        bases, owners, targets, roots, states, end = [], [], [], [], 0, 0
        for text in texts:
            step = SuffixAutomaton(text).next
            state = np.repeat(np.arange(len(step)), [len(arcs) for arcs in step])
            code = np.array([number[c] for arcs in step for c in arcs], np.int64)
            to = np.array([t for arcs in step for t in arcs.values()], np.int64)
            low, high = np.full(len(step), len(letters)), np.zeros(len(step), np.int64)
            np.minimum.at(low, state, code)
            np.maximum.at(high, state, code)
            span = np.maximum(high - low + 1, 0)
            span[high == 0] = 0
            base = end + np.cumsum(span) - span - low
            base[span == 0] = 0
            owner, target = np.full(int(span.sum()), -1, np.int32), np.zeros(int(span.sum()), np.int32)
            owner[base[state] + code - end], target[base[state] + code - end] = state + states, to + states
            bases.append(base.astype(np.int32)), owners.append(owner), targets.append(target), roots.append(states)
            states, end = states + len(step), end + len(owner)
        room = len(letters) + 1  # a state without arcs looks here in vain, and so does every last row
        self.base = np.concatenate([*[b + room for b in bases], np.zeros(0, np.int32)]).astype(np.int32)
        self.owner = np.concatenate([np.full(room, -1, np.int32), *owners, np.full(room, -1, np.int32)])
        self.target = np.concatenate([np.zeros(room, np.int32), *targets, np.zeros(room, np.int32)])
        self.roots = np.array(roots, np.int32)
        # the arcs of the roots, by letter and language; the root itself where there is none
        place = self.base[self.roots][None, :] + np.arange(len(letters) + 1)[:, None]
        known = self.owner[place] == self.roots
        self.first = np.where(known, self.target[place], self.roots).astype(np.int32)

    def phrases(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each piece ``letters[start:start + length]`` (code points) in each language; pieces in falling order of length."""
        codes = self.code[letters]
        at = np.repeat(self.roots[None, :], len(starts), axis=0)
        count = np.zeros(at.shape, np.int32)
        active = len(starts)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            while active and lengths[active - 1] <= i:
                active -= 1
            code = codes[starts[:active] + i]
            now = at[:active]
            place = self.base.take(now)
            place += code[:, None]
            goes = self.owner.take(place) == now
            # a phrase starts at the root, and with the letter where a match breaks off; one that no sample has is a phrase of its own
            count[:active] += ~goes | (now == self.roots)
            at[:active] = np.where(goes, self.target.take(place), self.first.take(code, axis=0))
        return count


class Model:
    """The automata of the learned languages; ``samples`` in alphabetical order of language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [lang for lang, _ in samples]
        self.tables = ParseTables([text for _, text in samples])
        self.bits = np.array([math.log2(len(text) + 1) for _, text in samples])

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and letters per phrase of each text."""
        langs, scores, means = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores, means
        begin = 0
        while begin < len(texts):
            stop, size = begin, 0
            while stop < len(texts) and (stop == begin or size + len(texts[stop] or "") <= BATCH):
                size += len(texts[stop] or "")
                stop += 1
            self._score(texts[begin:stop], begin, langs, scores, means)
            begin = stop
        return langs, scores, means

    def _score(self, texts, begin, langs, scores, means) -> None:
        letters, ends = letters_of(texts)
        starts = np.concatenate([[0], ends[:-1]])
        owner, piece_start, piece_length = pieces_of(letters, starts, ends)
        order = np.argsort(-piece_length, kind="stable")
        phrases = np.zeros((len(texts), len(self.languages)), np.int64)
        found = self.tables.phrases(letters, piece_start[order], piece_length[order])
        np.add.at(phrases, owner[order], found)
        bits = phrases * self.bits
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
        for k in np.nonzero(ends > starts)[0].tolist():
            langs[begin + k], scores[begin + k] = self.languages[best[k]], float(share[k])
            means[begin + k] = float((ends[k] - starts[k]) / phrases[k, best[k]])


def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return worker_model(("languages", samples), lambda: Model(samples))


def samples(docs: DataFrame, teaches: Column, sample_chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample text) pairs; ``teaches`` says which rows may be learned from."""
    rows = docs.filter(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chance = (F.xxhash64("doc_id").cast("double") / F.lit(2.0 ** 64) + 0.5).alias("chance")
    cut = F.least(F.length("text"), F.lit(SLICE))
    totals = written(rows.groupBy("lang").agg(F.sum(cut).alias("letters")).filter("letters > 0"), "language-letters")
    languages = totals.count()
    if not languages:
        return ()
    each = max(SLICE, min(sample_chars, all_chars // languages))
    # half as many again as fill the sample; the labels are as many as the languages
    share = totals.select("lang", (F.lit(1.5 * each) / F.col("letters")).alias("share"))
    begin = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SLICE + 1)).cast("int") + 1
    drawn = rows.select("lang", "doc_id", chance, F.substring("text", begin, F.lit(SLICE)).alias("slice"))
    # the draw comes before any shuffle of slices
    drawn = drawn.join(F.broadcast(share) if languages <= BROADCAST_LABELS else share.hint("rebalance"), "lang").filter("chance <= share")
    drawn = drawn.groupBy("lang", "chance", "doc_id").agg(F.min("slice").alias("slice"))  # a repeated id counts once
    upto = Window.partitionBy("lang").orderBy("chance", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    fits = drawn.withColumn("before", F.coalesce(F.sum(F.length("slice")).over(upto), F.lit(0))).filter(F.col("before") < each)
    found = []
    for lang, group in itertools.groupby(fits.orderBy("lang", "chance", "doc_id").toLocalIterator(), key=lambda r: r.lang):
        letters, _ = letters_of([r.slice for r in group])
        text = letters.astype("<u4").tobytes().decode("utf-32-le")[:each]
        if text.strip():
            found.append((lang, text))
    return tuple(found)


def predict(docs: DataFrame, learned: tuple[tuple[str, str], ...], held_out: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(frames):
        model = _model(shared.value)
        for frame in frames:
            langs, scores, _ = model.score(frame["text"].tolist())
            give_back()
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": langs, "score": scores})

    held = (held_out if held_out is not None else F.lit(False)).alias("held_out")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held)
    ship_package(docs.sparkSession)
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def is_held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return crc_bucket(doc_id, folds) == fold


def keep_documents(docs: DataFrame, learned: tuple[tuple[str, str], ...]) -> DataFrame:
    """The rows of ``docs`` that are in a learned language, with all their columns.

    A text goes if it has no letter, or if even its best language explains it
    by phrases of under ``LEAST_PHRASE`` letters on average: the automata know
    hardly more of it than its alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    ship_package(docs.sparkSession)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        langs, _, means = _model(shared.value).score(texts.tolist())
        give_back()
        return pd.Series([x != UNKNOWN and n >= LEAST_PHRASE for x, n in zip(langs, means, strict=True)], dtype=bool)

    return docs.filter(known(F.col("text").cast("string")))
