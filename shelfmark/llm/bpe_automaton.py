"""Byte-pair encoding by a tokenization automaton (operator 4).

The merge table of a public tokenizer is compiled into a deterministic
automaton over *token sequences* that accepts exactly the sequences BPE
produces. It starts as one state with a loop for every byte. Each merge
``(u, v) -> w`` then applies a gadget, in merge order: every state with an arc
``u`` to a state that has an arc ``v`` gains an arc ``w`` to where ``u v``
led, and its ``u`` arc is sent to a copy of the old target that lacks the
``v`` arc. All arcs of one token lead to one state, so a state is "after token
``u``, with the gadgets applied so far"; the copies made for ``u`` form a
chain, and only what a copy removes is stored (``(u, v)`` -> merge number).
An arc is looked up by walking down the chain and the left spine of the
label; looked-up arcs are kept in a transition table.

A word (a piece of the tokenizer's pre-split) has exactly one path through
the automaton. It is found left to right: the label of the path's last arc at
each position follows from the positions before it, by the byte trie and the
transition table. All new words of a batch take each step together, as numpy
arrays. Decoding emits the byte labels of the arcs.

Nulls count as empty text; an empty text has no ids and decodes to "". Very
long words cost time in proportion to their length. Rows are handled one by
one, so ties, repeated rows and empty tables need no rule.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from shelfmark.llm.common import text_rows, worker_model

NO_MERGE = 2**31 - 1
ROOT = 1
#: Remembered (state, label) arcs; a power of two. Older ones are overwritten and looked up again.
ARC_SLOTS = 1 << 20
#: Bytes of symbols whose words take their steps together.
STEP_CELLS = 4_000_000
#: Chunks remembered by a worker, and their code points. Half are the recent ones; beyond that half the older ones go.
CACHED_CHUNKS = 200_000
CACHED_CHARS = 10_000_000
#: Marks that a pre-split never joins to letters before them.
CLOSING = ".,;:!?&$#%*)]}\""
#: Letters under U+0250 that stay one letter in lower case (U+0130 becomes two code points).
LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha())


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of many runs, one run after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class MergeAutomaton:
    """The compiled automaton of one merge table."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        letters = byte_letters()
        self.end = 256 if end else None  # the symbol that closes a word, where the vocabulary marks word ends
        self.symbols = 258 if end else 257
        self.filler = self.symbols - 1

        def label(token: str) -> tuple[int, ...]:
            closed = bool(end) and token.endswith(end)
            body = token[:-len(end)] if closed else token
            return (*(letters[c] for c in body), *((256,) if closed else ()))

        names = [c for c in letters] + ([c + end for c in letters] if end else [])
        index = {t: i for i, t in enumerate(names)}
        left, right, rank = [[x] * len(names) for x in (-1, -1, -1)]
        dead: set[int] = set()
        removed: dict[tuple[int, int], int] = {}

        def arc(u: int, t: int, now: int) -> bool:
            """Whether the state after ``u`` has an arc ``t`` when ``now`` gadgets have been applied."""
            below_u = below_t = now
            while True:
                k = removed.get((u, t), NO_MERGE)
                if k < below_u and k <= below_t:
                    return False
                if rank[t] >= 0 and rank[t] >= rank[u]:
                    below_t, t = rank[t], left[t]
                elif rank[u] >= 0:
                    below_u, u = rank[u], right[u]
                else:
                    return True

        for k, (a, b) in enumerate(merges):
            u, v = index[a], index[b]
            if a + b in index:
                raise ValueError(f"two merges make {a + b!r}")
            w = index[a + b] = len(names)
            names.append(a + b)
            left.append(u), right.append(v), rank.append(k)
            if u in dead or v in dead or not arc(u, v, k):
                dead.add(w)  # no state has the arcs u, v in a row any more: nothing to merge
            else:
                removed[u, v] = k
        self.left, self.right, self.rank = (np.array(x, np.int64) for x in (left, right, rank))
        self.size = len(names)
        keys = np.array([u * self.size + v for u, v in removed], np.int64)
        order = np.argsort(keys)
        self.removed_key, self.removed_at = keys[order], np.array(list(removed.values()), np.int64)[order]
        self.ids = np.array([vocab[t] for t in names], np.uint32)
        labels = [label(t) for t in names]
        self.length = np.array([len(x) for x in labels], np.int64)
        self.label = {int(i): bytes(s for s in x if s < 256) for i, x in zip(self.ids, labels, strict=True)}
        self._build_trie([(t, x) for t, x in enumerate(labels) if t not in dead])
        self.arc_key = np.full(ARC_SLOTS, -1, np.int64)
        self.arc_ok = np.zeros(ARC_SLOTS, bool)

    def _build_trie(self, labels: list[tuple[int, tuple[int, ...]]]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        token = {}
        for t, symbols in labels:
            at = ROOT
            for s in symbols:
                at = nodes.setdefault((at, s), len(nodes) + 2)
            token[at] = t
        # transition table: a node's row spans its least to its greatest symbol; entries name the row's node
        arcs: dict[int, list[tuple[int, int]]] = {}
        for (at, s), to in nodes.items():
            arcs.setdefault(at, []).append((s, to))
        spans = {at: (min(own)[0], max(own)[0]) for at, own in arcs.items()}
        size = sum(b - a + 1 for a, b in spans.values()) + 2 * self.symbols
        self.base = np.zeros(len(nodes) + 2, np.int32)
        self.owner, self.target = np.zeros(size, np.int32), np.zeros(size, np.int32)
        end = self.symbols
        for at, own in arcs.items():
            low, high = spans[at]
            self.base[at] = end - low
            for s, to in own:
                self.owner[end - low + s], self.target[end - low + s] = at, to
            end += high - low + 1
        self.token_at = np.full(len(nodes) + 2, -1, np.int64)
        self.token_at[list(token)] = list(token.values())

    def _walk(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For each pair, whether the final state after ``u`` has an arc ``t``."""
        ok = np.ones(len(u), bool)
        at = np.arange(len(u))
        below_u = np.full(len(u), NO_MERGE - 1, np.int64)
        below_t = below_u.copy()
        while len(at):
            key = u * self.size + t
            place = np.minimum(np.searchsorted(self.removed_key, key), len(self.removed_key) - 1)
            k = np.where(self.removed_key[place] == key, self.removed_at[place], NO_MERGE)
            blocked = (k < below_u) & (k <= below_t)
            ok[at[blocked]] = False
            ru, rt = self.rank[u], self.rank[t]
            go = ~blocked & ((ru >= 0) | (rt >= 0))
            down = rt >= ru
            below_t, t = np.where(down, rt, below_t), np.where(down, self.left[t], t)
            below_u, u = np.where(down, below_u, ru), np.where(down, u, self.right[u])
            at, u, t, below_u, below_t = at[go], u[go], t[go], below_u[go], below_t[go]
        return ok

    def arcs(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """As ``_walk``, by the transition table where it has the arc."""
        key = u * self.size + t
        slot = (key * 0x9E3779B97F4A7C1 >> 24) & (ARC_SLOTS - 1)
        ok = self.arc_ok[slot]
        new = np.nonzero(self.arc_key[slot] != key)[0]
        if len(new):
            found = self._walk(u[new], t[new])
            ok[new] = found
            self.arc_key[slot[new]], self.arc_ok[slot[new]] = key[new], found
            # two new arcs may share a slot: keep key and value of the same one
            self.arc_ok[slot[new]] = np.where(self.arc_key[slot[new]] == key[new], found, self.arc_ok[slot[new]])
            wrong = self.arc_key[slot[new]] != key[new]
            self.arc_key[slot[new][wrong]] = -1
        return ok

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array(list(map(len, words)), np.int64)
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        begin = 0
        while begin < len(order):
            # words of similar length, at least one
            alike = int(np.searchsorted(lengths, 2 * lengths[begin] + 7, "right"))
            cells = (lengths[begin:alike] + 1) * np.arange(1, alike - begin + 1)
            stop = begin + max(1, int(np.searchsorted(cells, STEP_CELLS, "right")))
            part = order[begin:stop].tolist()
            for i, ids in zip(part, self._encode_sorted([words[i] for i in part]), strict=True):
                out[i] = ids
            begin = stop
        return out

    def _encode_sorted(self, words: list[bytes]) -> list[bytes]:
        """``encode_words`` for words in order of length, all steps taken together."""
        flat, counts = self._encode_bytes(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))
        data = flat.astype("<u4").tobytes()
        cuts = [0, *(np.cumsum(counts) * 4).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (UTF-8 or binary), one word after the other, and their number in each word."""
        words = words.cast(pa.large_binary())
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
        order = np.argsort(lengths, kind="stable")
        words, lengths = words.take(pa.array(order)), lengths[order]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flats, counts, begin = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while begin < len(order):
            alike = int(np.searchsorted(lengths, 2 * lengths[begin] + 7, "right"))
            cells = (lengths[begin:alike] + 1) * np.arange(1, alike - begin + 1)
            stop = begin + max(1, int(np.searchsorted(cells, STEP_CELLS, "right")))
            flat, count = self._encode_bytes(data[ends[begin]:ends[stop]], lengths[begin:stop])
            flats.append(flat), counts.append(count)
            begin = stop
        flat, sorted_counts = np.concatenate(flats), np.concatenate(counts)
        back = np.argsort(order)
        starts = np.cumsum(sorted_counts) - sorted_counts
        return flat[ragged(starts[back], sorted_counts[back])], sorted_counts[back]

    def _encode_bytes(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in order of length, given as their bytes one after the other and their lengths."""
        width = int(n[-1]) + 1
        symbols = np.full((len(n), width), self.filler, np.int16)
        symbols[np.arange(width) < n[:, None]] = data
        if self.end is not None:
            symbols[np.arange(len(n)), n] = self.end
            n = n + (n > 0)
        last = np.full((len(n), width + 1), -1, np.int64)
        for j in range(int(n[-1])):
            at = np.arange(int(np.searchsorted(n, j, "right")), len(n))
            node = np.full(len(at), ROOT, np.int32)
            for k in range(j, width):
                place = self.base[node] + symbols[at, k]
                alive = self.owner[place] == node
                at, node = at[alive], self.target[place[alive]]
                if not len(at):
                    break
                t = self.token_at[node]
                some = t >= 0
                to, t = at[some], t[some]
                if j:
                    ok = self.arcs(last[to, j], t)
                    to, t = to[ok], t[ok]
                last[to, k + 1] = t
        steps, pos, rows = [], n.copy(), np.arange(len(n))
        counts = np.zeros(len(n), np.int64)
        while True:
            go = pos > 0
            if not go.any():
                break
            t = np.where(go, last[rows, pos], 0)
            steps.append(t)
            counts += go
            pos = pos - np.where(go, self.length[t], 0)
        if not steps:
            return np.zeros(0, np.uint32), counts
        back = np.stack(steps, 1)
        place = counts[:, None] - 1 - np.arange(back.shape[1])
        keep = place >= 0
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), np.uint32)
        flat[(ends - counts)[:, None].repeat(back.shape[1], 1)[keep] + place[keep]] = self.ids[back[keep]]
        return flat, counts


class PieceTable:
    """Encoded pieces of the pre-split as arrays: the piece in slot k has the ids ``pool[start[k]:start[k] + length[k]]``.

    Slots are found by hashing in Arrow, so no piece becomes a Python object.
    """

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.clear()

    def clear(self) -> None:
        self.pieces = pa.array([], pa.large_binary())
        self.pool = np.zeros(0, np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slots(self, pieces: pa.Array) -> np.ndarray:
        """The slot of each piece (all different); new ones are encoded."""
        pieces = pieces.cast(pa.large_binary())
        found = pc.index_in(pieces, value_set=self.pieces)
        missing = pc.is_null(found)
        new = pieces.filter(missing)
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            flat, count = self.automaton.encode_flat(new)
            at[missing.to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(count) - count])
            self.length = np.concatenate([self.length, count])
            self.pool = np.concatenate([self.pool, flat])
            self.pieces = pa.concat_arrays([self.pieces, new])
        return at


class TextCoder:
    """Whole texts to ids and back, as the tokenizer file says.

    Texts are cut into chunks at white space where the pre-split certainly
    has a boundary; a chunk's ids depend on nothing else, so each chunk is
    encoded once and remembered. Where pieces do not take a space along, all
    chunks of a batch are handled together as Arrow and numpy arrays
    (``_encode_arrays``); the few texts with special tokens, rare separators or
    code points from U+0250 up take the way chunk by chunk. Code points under U+0250 take the pre-split
    pattern here; chunks with others ask the tokenizer file's own normalizer
    and pre-tokenizer, whose letter classes may be of another Unicode version.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, end)
        self.keeps_space = not end
        # the library reads its own normalizer and pre-tokenizer; its vocabulary is not needed
        tok = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.normalizer, self.pre_tokenizer = tok.normalizer, tok.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        if self.keeps_space:
            # the fixed pre-split pattern of byte-level BPE files
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        else:
            split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            self.pattern = regex.compile(split["pattern"]["Regex"])
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # chunks that follow a space, without it
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # what both held before
        self.cached_chars = 0
        self.table = PieceTable(self.automaton)
        self.labels = self.automaton.label | {i: s.encode() for s, i in self.special.items()}

    _space_before_word = re.compile(r" (?=\S)")
    _separators = re.compile(r"[\x1c-\x1f]")
    _safe_space = re.compile(r"[ \t\r\n]+")
    _other_letters = re.compile(r"[^\x00-ɏ]")
    _latin_word = re.compile(f"[{LATIN}]+")
    _no_plain_lower = re.compile("[^\x00-ɏ]|İ")

    def _presplit(self, chunk: str) -> list[bytes]:
        if self._other_letters.search(chunk):
            if self.normalizer is not None:
                chunk = self.normalizer.normalize_str(chunk)
            return [bytes(map(self.letters.__getitem__, w)) for w, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]
        if not self.keeps_space:
            chunk = chunk.lower()
        return [w.encode() for w in self.pattern.findall(chunk)]

    def _learn(self, chunks: set[str], cache: dict[str, bytes], older: dict[str, bytes], lead: str) -> None:
        new = chunks.difference(cache)
        known = {c: older[c] for c in new if c in older}
        cache.update(known)
        self.cached_chars += sum(map(len, new))
        new.difference_update(known)
        if not new:
            return
        # Latin letters are one word in every pre-split, and the marks that close them another
        closed: list[tuple[str, str, str]] = []
        split: list[tuple[str, list[bytes]]] = []
        for c in new:
            core = c.rstrip(CLOSING)
            if core.isalpha() and (core.isascii() or self._latin_word.fullmatch(core)):
                closed.append((c, core if self.keeps_space else core.lower(), c[len(core):]))
            else:
                split.append((c, self._presplit(lead + c)))
        # a word alone is a chunk too, and may be known as one
        cores = {core for _, core, _ in closed}
        word = {c: cache[c] if c in cache else older[c] for c in cores if c in cache or c in older}
        cores.difference_update(word)
        words = {end.encode() for _, _, end in closed if end}.union(*[ws for _, ws in split])
        todo = [*[(lead + c).encode() for c in cores], *words]
        found = self.automaton.encode_words(todo)
        word.update(zip(cores, found, strict=False))
        ids = dict(zip(words, found[len(cores):], strict=True))
        cache.update([(c, word[core] + ids[end.encode()] if end else word[core]) for c, core, end in closed])
        cache.update([(c, ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])) for c, ws in split])

    def _cut(self, text: str) -> list[str]:
        if self.keeps_space:
            return self._space_before_word.split(text)
        if text.isascii() or not self._no_plain_lower.search(text):
            text = text.lower()  # as the normalizer does; fewer different chunks
        return self._safe_space.split(text) if self._separators.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.keeps_space:
            return self._encode_chunks(texts)
        column = pa.array(texts, pa.large_string())
        plain = self._plain(column, texts)
        found = iter(self._encode_arrays(pc.utf8_lower(column.filter(pa.array(plain)))))
        others = iter(self._encode_chunks([t for t, p in zip(texts, plain.tolist(), strict=True) if not p]))
        return [next(found) if p else next(others) for p in plain.tolist()]

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _plain(self, column: pa.Array, texts: list[str]) -> np.ndarray:
        """Marks the texts for ``_encode_arrays``, by their bytes: no lead byte from 0xC9 up, no U+0130, no U+001C to U+001F, no special token."""
        data, offsets = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.frombuffer(column.buffers()[1], np.int64)[:len(texts) + 1]
        odd = (data >= 0xC9) | ((data >= 0x1C) & (data <= 0x1F))
        odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(odd, dtype=np.int32)])
        return (upto[offsets[1:]] == upto[offsets[:-1]]) & np.array([not self._has_special(t) for t in texts], bool)

    #: A word of letters that the pre-split keeps together, and the marks that close it.
    _closed_word = f"^(?P<core>[{''.join(sorted(set(LATIN.lower())))}]+)(?P<end>[{re.escape(CLOSING)}]*)$"

    def _encode_arrays(self, texts: pa.Array) -> list[bytes]:
        """Ids of lower-case texts under U+0250 without special tokens, by whole columns.

        The texts' chunks are reduced to the different ones; those are words
        with closing marks, or cut by the pre-split pattern; the different
        pieces are encoded, and the ids gathered back by offsets.
        """
        table = self.table
        if len(table.pieces) > CACHED_CHUNKS or 4 * table.pieces.nbytes > CACHED_CHARS:
            table.clear()
        split = pc.utf8_split_whitespace(texts)
        chunks = split.flatten()
        filled = pc.greater(pc.binary_length(chunks), 0)
        upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
        per_text = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        coded = chunks.filter(filled).dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        closed = pc.extract_regex(words, self._closed_word)
        is_closed = closed.is_valid().to_numpy(zero_copy_only=False)
        cores, ends = (closed.field(k).filter(pa.array(is_closed)) for k in (0, 1))
        cores, ends = cores.dictionary_encode(), ends.dictionary_encode()
        others = [self._presplit(w) for w in words.filter(pa.array(~is_closed)).to_pylist()]
        other_pieces = pa.array([p for ws in others for p in ws], pa.large_binary()).dictionary_encode()

        # the pieces of each different chunk: a word and its marks, or what the pattern found
        end_length = pc.binary_length(ends.dictionary).to_numpy(zero_copy_only=False)
        end_at = ends.indices.to_numpy()
        with_end = end_length[end_at] > 0 if len(end_at) else np.zeros(0, bool)
        pieces = np.zeros(len(words), np.int64)
        pieces[is_closed] = 1 + with_end
        pieces[~is_closed] = [len(ws) for ws in others]
        first = np.cumsum(pieces) - pieces
        slot = np.zeros(int(pieces.sum()), np.int64)
        slot[first[is_closed]] = table.slots(cores.dictionary)[cores.indices.to_numpy()]
        if with_end.any():
            filled_end = np.nonzero(end_length > 0)[0]
            end_slot = np.zeros(len(end_length), np.int64)
            end_slot[filled_end] = table.slots(ends.dictionary.take(pa.array(filled_end)))
            slot[first[is_closed][with_end] + 1] = end_slot[end_at[with_end]]
        slot[ragged(first[~is_closed], pieces[~is_closed])] = table.slots(other_pieces.dictionary)[other_pieces.indices.to_numpy()]

        ids_upto = np.concatenate([[0], np.cumsum(table.length[slot])])
        ids = table.pool[ragged(table.start[slot], table.length[slot])]
        begin, length = ids_upto[first], ids_upto[first + pieces] - ids_upto[first]
        flat = ids[ragged(begin[which], length[which])]
        text_ends = np.concatenate([[0], np.cumsum(length[which])])[per_text] * 4
        data, cuts = flat.astype("<u4").tobytes(), text_ends.tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode_chunks(self, texts: list[str]) -> list[bytes]:
        if 2 * (len(self.cache) + len(self.spaced)) > CACHED_CHUNKS or 2 * self.cached_chars > CACHED_CHARS:
            self.older = self.cache, self.spaced
            self.cache, self.spaced, self.cached_chars = {}, {}, 0
        # known chunks are looked up text by text; only unknown ones are held until the batch is learned
        found: list[list[list[bytes | None]]] = []
        first: list[tuple[list[bytes | None], str]] = []
        rest: list[tuple[list[bytes | None], list[int], list[str]]] = []
        get = self.spaced.get
        for text in texts:
            parts: list[list[bytes | None]] = []
            for part in self.special_split.split(text) if self._has_special(text) else [text]:
                if part in self.special:
                    parts.append([self.special[part].to_bytes(4, "little")])
                elif part:
                    chunks = self._cut(part)
                    if self.keeps_space:
                        parts.append([None])
                        first.append((parts[-1], chunks.pop(0)))
                    ids = list(map(get, chunks))
                    parts.append(ids)
                    if None in ids:
                        gaps = [i for i, x in enumerate(ids) if x is None]
                        rest.append((ids, gaps, [chunks[i] for i in gaps]))
            found.append(parts)
        self._learn({c for _, c in first}, self.cache, self.older[0], "")
        self._learn(set().union(*[chunks for _, _, chunks in rest]), self.spaced, self.older[1], " " if self.keeps_space else "")
        for ids, chunk in first:
            ids[0] = self.cache[chunk]
        for ids, gaps, chunks in rest:
            for i, x in zip(gaps, map(self.spaced.__getitem__, chunks), strict=True):
                ids[i] = x
        return [b"".join(parts[0] if len(parts) == 1 else itertools.chain.from_iterable(parts)) for parts in found]

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, as text; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def coder(path: str) -> TextCoder:
    """The compiled coder of a file, held by the worker process."""
    return worker_model(("coder", path), lambda: TextCoder(path))


def batches(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of about ``chars`` code points each (a longer text has a slice of its own)."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode_documents(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document, and with
    ``keep`` also ``ids`` (array of long) and ``decoded``.

    ``path`` names a ``tokenizers`` file of byte-pair merges that every
    executor can open. One pass over the table, no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep

    def run(frames):
        code = coder(path)
        for frame in frames:
            doc_ids, texts = frame["doc_id"], frame["text"].tolist()
            for part in batches(texts):
                ids = code.encode(texts[part])
                plain = [code.decode(x) for x in ids]
                out = {"doc_id": doc_ids.iloc[part], "n_tokens": [len(x) // 4 for x in ids],
                       "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                       "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in plain]}
                if keep:
                    out |= {"ids": pd.Series([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], dtype=object).to_numpy(), "decoded": plain}
                yield pd.DataFrame(out)

    return text_rows(docs).mapInPandas(run, schema)
