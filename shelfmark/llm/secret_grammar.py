"""Secret scan by base patterns and inferred grammars (operator 8).

Base patterns give the certain spans (``assign``, ``access``, ``hex``). From
a bounded sample of their matches in all documents ("labelled credentials")
probabilistic automata are inferred, one for each character set (letter cases,
digits, marks) of a kind: a prefix tree over character classes whose states of
one depth are merged where their futures are statistically compatible
(Hoeffding bound). Merging within a depth keeps what a format is known by, its
marks, their places and its lengths; the end of a token has a probability as
its characters have. Values longer than ``DEPTH`` go on in the last state. A
background automaton is inferred from the other tokens with merges across
depths, without those that a credential automaton finds likely unless that is
most of them. Every other token of 12 characters or more, with a digit
or without, in every whole text, is a candidate: it is a ``format`` span if a
credential automaton finds it as likely for each character as labelled
credentials that it was not inferred from (but the unlikeliest few), and likelier than the
background by a margin.

The sample: the distinct values of each kind in all documents, and of them the
``per_kind`` with the smallest hashes. Each task keeps no more than that of a
kind, so a kind is learned however rare it is, from its first value on. The scan itself is one pass without a shuffle.

Null text counts as empty: no spans. Without labelled credentials there are no
``format`` spans. Repeated rows are scanned each; null ids are scanned but
teach nothing. An empty table gives no rows. Other columns are left behind
(``scan``) or returned unchanged (``redact_documents``).
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import ship_package, text_rows

KINDS = ("assign", "access", "hex", "format")
PER_KIND = 500
#: Tokens whose verdict a task remembers.
REMEMBERED = 1 << 16
#: Share of the labelled credentials that their own automaton may find too unlikely.
MISSED = 0.02
SLACK = 1.1
#: Bits by which a credential automaton must beat the background.
MARGIN_BITS = 12.0
#: Merge test: confidence, and the count under which a state has no say of its own.
ALPHA, LEAST = 0.05, 10
#: Depth of the last state of a credential automaton, and the bits of a character where none of its labelled values went.
DEPTH, LOST_BITS = 256, 8.0

#: Fixed base patterns.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_keywords = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, int]  # start, number of the kind, end

#: Character classes and how many characters share one.
CLASSES = [("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789")]
CLASS_OF = {c: k for k, chars in CLASSES for c in chars}
CHAR_BITS = {k: math.log2(len(chars)) for k, chars in CLASSES}


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that are long enough."""
    found = []
    low = text.lower()
    if any(k in low for k in _keywords):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # runs are matched whole, so the least length can stand in the pattern
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Long tokens that touch no base span."""
    found = []
    ends, most = [], 0  # the furthest end of the base spans up to each, which stand by start
    for _, _, e in base:
        most = max(most, e)
        ends.append(most)
    n = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while n < len(base) and base[n][0] < b:
            n += 1
        if not n or ends[n - 1] <= a:
            found.append((a, b))
    return found


class Automaton(NamedTuple):
    """A probabilistic automaton over character classes."""
    arcs: tuple[dict[str, int], ...]
    counts: tuple[dict[str, int], ...]
    ends: tuple[int, ...]
    layered: bool = True

    def bits(self, text: str) -> float:
        """Minus log2 of the probability of ``text``; what was never seen costs as a tenth of one sighting.

        After it a layered automaton has nothing to say of the rest; another one starts anew.
        """
        at, cost = 0, 0.0
        for n, c in enumerate(text):
            k = CLASS_OF.get(c, c)
            total = sum(self.counts[at].values()) + self.ends[at] + 2.0
            cost += CHAR_BITS.get(k, 0.0) - math.log2((self.counts[at].get(k, 0) + 0.1) / total)
            if k not in self.arcs[at] and self.layered:
                return cost + LOST_BITS * (len(text) - n - 1)
            at = self.arcs[at].get(k, 0)
        total = sum(self.counts[at].values()) + self.ends[at] + 2.0
        return cost - math.log2((self.ends[at] + 0.1) / total)


def infer(texts: list[str], layered: bool = True) -> Automaton:
    """Prefix tree of ``texts`` with statistically compatible states merged; if ``layered``, only states of one depth."""
    child: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    end, depth = [0], [0]
    for text in texts:
        at = 0
        for c in text:
            k = CLASS_OF.get(c, c)
            count[at][k] = count[at].get(k, 0) + 1
            if k not in child[at]:
                if depth[at] == DEPTH:
                    child[at][k] = at
                else:
                    child[at][k] = len(child)
                    child.append({})
                    count.append({})
                    end.append(0)
                    depth.append(depth[at] + 1)
            at = child[at][k]
        end[at] += 1
    width = math.sqrt(0.5 * math.log(2 / ALPHA))

    def size(q: int) -> int:
        return end[q] + sum(count[q].values())

    def compatible(p: int, q: int) -> bool:
        pairs, seen = [(p, q)], set()
        while pairs:
            p, q = pairs.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            n, m = size(p), size(q)
            if n < LEAST or m < LEAST:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(end[p] / n - end[q] / m) > bound:
                return False
            for k in count[p].keys() | count[q].keys():
                if abs(count[p].get(k, 0) / n - count[q].get(k, 0) / m) > bound:
                    return False
                if k in child[p] and k in child[q]:
                    pairs.append((child[p][k], child[q][k]))
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree at ``q`` to the automaton at ``p``."""
        pairs, done = [(p, q)], set()
        while pairs:
            p, q = pairs.pop()
            if p == q or q in done:
                continue
            done.add(q)
            end[p] += end[q]
            for k, n in count[q].items():
                count[p][k] = count[p].get(k, 0) + n
            for k, to in child[q].items():
                if k in child[p]:
                    pairs.append((child[p][k], to))
                else:
                    child[p][k] = p if to == q else to

    kept, known = [0], {0}
    while True:
        # arcs of kept states to states of the tree, in the order the states were kept
        front = next(((p, k) for p in kept for k in sorted(child[p]) if child[p][k] not in known), None)
        if front is None:
            break
        q = child[front[0]][front[1]]
        match = next((r for r in kept if (not layered or depth[r] == depth[q]) and compatible(r, q)), None)
        if match is None:
            kept.append(q)
            known.add(q)
        else:
            child[front[0]][front[1]] = match
            fold(match, q)
    number = {q: i for i, q in enumerate(kept)}
    return Automaton(tuple({k: number[to] for k, to in child[q].items()} for q in kept),
                     tuple(count[q] for q in kept), tuple(end[q] for q in kept), layered)


def character_set(value: str) -> str:
    """The kinds of characters of a value: ``a`` and ``A`` for letters, ``0`` for digits, and each mark."""
    return "".join(sorted({"a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in value}))


def by_character_set(values: list[str]) -> list[list[str]]:
    """``values`` by character set; sets with fewer than ``LEAST`` values join the largest one."""
    groups: dict[str, list[str]] = {}
    for v in values:
        groups.setdefault(character_set(v), []).append(v)
    order = sorted(groups.values(), key=lambda g: (-len(g), g))
    large = [g for g in order if len(g) >= LEAST] or order[:1]
    few = [v for g in order if g not in large for v in g]
    return [large[0] + few, *large[1:]] if large else []


def most_bits(bits: list[float]) -> float:
    """What all but the share ``MISSED`` of ``bits`` stay within."""
    return sorted(bits)[min(len(bits) - 1, int((1 - MISSED) * len(bits)))]


def fitted(values: list[str]) -> tuple[Automaton, float]:
    """The automaton of ``values``, and the most bits a character that it accepts.

    Values cost more bits in an automaton that was not inferred from them. So
    each half is scored by the automaton of the other one; but what is
    accepted costs at most ``SLACK`` times what the values cost in their own.
    """
    automaton = infer(values)
    own = most_bits([automaton.bits(v) / len(v) for v in values])
    halves = values[::2], values[1::2]
    if not halves[1]:
        return automaton, own
    crossed = [a.bits(v) / len(v) for a, other in zip(map(infer, halves), reversed(halves), strict=True) for v in other]
    return automaton, min(max(own, most_bits(crossed)), SLACK * own)


class Grammar(NamedTuple):
    """Credential automata with the most bits a character that each accepts, and the background."""
    kinds: tuple[tuple[Automaton, float], ...]
    background: Automaton | None

    def accepts(self, token: str) -> bool:
        if not self.kinds:
            return False
        bits = [n for a, most in self.kinds if (n := a.bits(token)) <= most * len(token)]
        if not bits:
            return False
        plain = self.background.bits(token) if self.background else 6.0 * len(token)
        return plain - min(bits) >= MARGIN_BITS


def remembering(grammar: Grammar):
    """``grammar.accepts`` that remembers its last verdicts on tokens of usual length."""
    usual = functools.lru_cache(REMEMBERED)(grammar.accepts)
    return lambda token: usual(token) if len(token) <= 64 else grammar.accepts(token)


def spans_of(text: str, grammar: Grammar, accepts=None) -> list[Span]:
    """Base and ``format`` spans by start, then kind."""
    base = base_spans(text)
    accepts = accepts or grammar.accepts
    return sorted(base + [(a, 3, b) for a, b in candidates(text, base) if accepts(text[a:b])])


def learn(docs: DataFrame, per_kind: int = PER_KIND) -> Grammar:
    """Grammars from at most ``per_kind`` values of each kind in all of ``docs``."""
    def values(frames):
        kept: dict[str, dict[str, int]] = {kind: {} for kind in (*KINDS[:3], "plain")}
        top = dict.fromkeys(kept, 1 << 63)

        def bound(kind: str) -> None:
            few = sorted(kept[kind].items(), key=lambda v: (v[1], v[0]))[:per_kind]
            kept[kind] = dict(few)
            if len(few) == per_kind:
                top[kind] = few[-1][1]

        def take(kind: str, value: str) -> None:
            if value in kept[kind]:
                return
            h = xxhash.xxh64_intdigest(value) - (1 << 63)
            if h <= top[kind]:
                kept[kind][value] = h
                if len(kept[kind]) >= 4 * per_kind:
                    bound(kind)

        for frame in frames:
            for text in frame["text"]:
                base = base_spans(text)
                for a, k, b in base:
                    take(KINDS[k], ASSIGN.match(text, a)[2] if k == 0 else text[a:b])
                for a, b in candidates(text, base):
                    take("plain", text[a:b])
        for kind in kept:
            bound(kind)
        yield pd.DataFrame([(kind, v, h) for kind, vs in kept.items() for v, h in vs.items()], columns=["kind", "value", "h"])

    rows = text_rows(docs).filter("doc_id IS NOT NULL")
    # a value that many documents share counts once; the few are first found in parts of a kind
    few = rows.mapInPandas(values, "kind string, value string, h long").distinct().withColumn("part", F.pmod("h", F.lit(64)))
    for keys in (("kind", "part"), ("kind",)):
        first = Window.partitionBy(*keys).orderBy("h", "value")
        few = few.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_kind)
    by_kind: dict[str, list[str]] = {}
    for r in few.select("kind", "value").orderBy("kind", "value").toLocalIterator():
        by_kind.setdefault(r.kind, []).append(r.value)
    kinds = []
    for kind in KINDS[:3]:
        for values_of_set in by_character_set(by_kind.get(kind, [])):
            kinds.append(fitted(values_of_set))
    # bare credentials among the tokens are no background; but automata that know most tokens say nothing of them
    tokens = by_kind.get("plain", [])
    unlike = [t for t in tokens if not any(a.bits(t) <= most * len(t) for a, most in kinds)]
    plain = unlike if 2 * len(unlike) >= len(tokens) else tokens
    return Grammar(tuple(kinds), infer(plain, layered=False) if plain else None)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(frames):
        accepts = remembering(shared.value)
        for frame in frames:
            found = [spans_of(t, shared.value, accepts) for t in frame["text"]]
            base = [[s for s in spans if s[1] < 3] for spans in found]
            out = {"doc_id": frame["doc_id"]}
            for k, kind in enumerate(KINDS[:3]):
                out[f"n_{kind}"] = [sum(s[1] == k for s in spans) for spans in base]
            out["base_sha256"] = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
            out["spans"] = [joined(spans) for spans in found]
            out["n_format"] = [len(a) - len(b) for a, b in zip(found, base, strict=True)]
            yield pd.DataFrame(out)

    return text_rows(docs).mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def redacted(text: str, grammar: Grammar, mark: str = "[secret]", accepts=None) -> str:
    """``text`` with every secret replaced by ``mark``; of an assignment only its value."""
    out, at = [], 0
    for a, k, b in spans_of(text, grammar, accepts):
        a = ASSIGN.match(text, a).start(2) if k == 0 else a
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced (and ``n_chars``, where there is one, counted anew for changed texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        accepts = remembering(shared.value)
        return pd.Series([None if t is None else redacted(t, shared.value, accepts=accepts) for t in texts], dtype=object)

    row = F.struct(*[docs[c] for c in docs.columns])
    both = docs.select(row.alias("row"), clean(docs["text"].cast("string")).alias("clean"))
    out = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            same = F.col("clean").eqNullSafe(F.col("row.text"))
            out.append(F.when(same, old).otherwise(F.length("clean").cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(old.alias(c))
    return both.select(*out)
