"""Operators 11 to 13 of shelfmark.llm against brute force, and odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import audit_repair, chat_format, cover_lloyd, lang_crossparse, queries, secret_grammar, tensored_minhash

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, dropped string, fault int, cost long"
VECTORS = "vec_id long, embedding array<double>, label int, code string, x int, its int, error string"
DOCS = "doc_id long, text string, node long, n string, digest string, row int"


# 11 conversation structure repair

def best_repair(turns):
    """The cheapest (cost, audit, lines), found by all edits of each turn from the end on."""
    @lru_cache(None)
    def best(i, state, put_in):
        found = [(0, "", ())] if i == len(turns) and state in (0, 3) else []

        def then(step, after, rest, edit, line):
            if rest:
                found.append((rest[0] + step, edit + rest[1], (() if line is None else (line,)) + rest[2]))

        moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
        if put_in < 3:
            for initial, role in (("u", "user"), ("a", "assistant")):
                if state in moves[initial]:
                    then(5, None, best(i, moves[initial][state], put_in + 1), "I", f"{role}:")
        if i < len(turns):
            role, text, fault = turns[i]
            then(2, None, best(i + 1, state, 0), "D", None)
            for edit, initial, name, step in (("K", role[:1], role, 0), ("R", "u", "user", 1), ("R", "a", "assistant", 1)):
                if fault not in (1, 2) and state in moves.get(initial, {}):
                    then(step + 5 * (fault == 3), None, best(i + 1, moves[initial][state], 0), edit, f"{name}:{text}")
        return min(found) if found else None
    return best(0, 0, 0)


def after_damage(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        turns[conv] += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return turns


def repaired(rows):
    """What the contract asks for, conversation by conversation."""
    out = set()
    for conv, turns in after_damage(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults, marked = set(), [0] * 4, []
        for _, role, text in turns:
            last = re.sub("[\x20\x09-\x0d]+$", "", text)[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault))
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum((a[0][:1] or " ") + (b[0][:1] or " ") not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = best_repair(tuple(marked))
        out.add((conv, gaps, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def random_turns(n, conversations, seed=3):
    random.seed(seed)
    roles, texts = ["user", "assistant", "assistant", "system", "tool", "", None], ["One.", "Two!", "Three", " ", "", None, "\t\x0b", "Fin?  ", "é"]
    rows = [(random.randrange(conversations), random.choice([None, *range(12)]), random.choice(roles), random.choice(texts)) for _ in range(n)]
    return rows + [rows[0], rows[0], (None, None, "user", "No id."), (None, 1, "assistant", "No id.")]


def test_repairs_equal_all_edits_tried(spark):
    rows = random_turns(900, 120) + [(1000 + k, k % 9, "user" if k % 2 else "assistant", f"Text {k}.") for k in range(60)]
    turns = spark.createDataFrame([(*r, "x", 7, 9) for r in rows], TURNS).repartition(3)
    got = [tuple(r) for r in audit_repair.repair(audit_repair.damaged(turns)).collect()]
    assert set(got) == repaired(rows) and len(got) == len(repaired(rows))
    assert set("KRD") <= set("".join(r[7] for r in got))  # an insertion never is the cheapest at these costs


def test_conversation_with_all_rows_dropped(spark):
    turn = next(k for k in range(1000) if zlib.crc32(f"5:{k}".encode()) % 20 == 0)
    turns = spark.createDataFrame([(5, turn, "user", "Gone.", "", 0, 0)], TURNS)
    (row,) = audit_repair.repair(audit_repair.damaged(turns)).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert audit_repair.repair(audit_repair.damaged(turns.limit(0))).count() == 0


@pytest.mark.parametrize("flush", [1, 5, 10**9])
def test_long_conversation_in_one_task(monkeypatch, flush):
    """The common beginning moves away at any pace, without a change of the result; ties abound."""
    monkeypatch.setattr(audit_repair, "FLUSH", flush)
    for seed in range(6):
        random.seed(seed)
        turns = [(random.choice(["user", "assistant", "system", "tool"]), random.choice("abc") + random.choice([".", ""]), random.choice([0, 0, 1, 2, 3])) for _ in range(180)]
        now = audit_repair.Repair()
        for k, t in enumerate(turns):
            now.add(k, *t)
        cost, audit, lines = best_repair(tuple(turns))
        assert now.result(1)[6:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_long_conversation_holds_little():
    now = audit_repair.Repair()
    for k in range(60_000):
        now.add(k, ("user", "assistant")[k % 2], "Text.", 0)
    assert max(w.audit.depth for w in now.ways.values()) <= 2 * audit_repair.FLUSH
    assert now.result(1)[6:8] == (0, "K" * 60_000)


def test_colliding_digests_are_verified(monkeypatch):
    """With digests that all collide, the strings decide."""
    monkeypatch.setattr(audit_repair, "PRIME", 1)
    random.seed(1)
    turns = [(random.choice(["user", "assistant"]), "a.", random.choice([0, 3])) for _ in range(60)]
    now = audit_repair.Repair()
    for k, t in enumerate(turns):
        now.add(k, *t)
    assert now.result(1)[6:8] == best_repair(tuple(turns))[:2]


# 12 vector code compression

def lloyd(rows):
    """``vec_id -> [(code, error)]`` and the codebooks' digest, by plain Lloyd rounds in Python integers."""
    kept = [(v, [int(np.floor(256 * x)) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    width = max([1, *(-(-len(x) // 16) for _, x, _ in kept)])
    kept = [(v, np.array(x + [0] * (16 * width - len(x)), dtype=np.int64).reshape(16, width), label) for v, x, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].ravel().tolist()))[:64]
    books = [[r[1][p].tolist() for r in first] for p in range(16)]

    def nearest(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, entry)), k) for k, entry in enumerate(book))

    for _ in range(2):
        for p in range(16):
            groups = defaultdict(list)
            for _, x, _ in kept:
                groups[nearest(x[p].tolist(), books[p])[1]].append(x[p].tolist())
            for k, points in groups.items():
                books[p][k] = [sum(c) // len(points) for c in zip(*points)]
    out, per_label = [], defaultdict(int)
    for v, x, label in kept:
        found = [nearest(x[p].tolist(), books[p]) for p in range(16)]
        out.append((v, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        per_label[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((*r, per_label[r[1]], digest) for r in out), key=str)


def check_lloyd(spark, rows, parts):
    df = spark.createDataFrame([(v, e, label, "c", 1, 2, "e") for v, e, label in rows], VECTORS).repartition(parts)
    got = sorted((tuple(r) for r in cover_lloyd.compress(df).collect()), key=str)
    assert got == lloyd(rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_codes_equal_plain_lloyd(spark, parts):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 32))
    rows = [(int(k), (centres[k % 9] + rng.normal(size=32) * 0.2).tolist(), [None, 1, 2][k % 3]) for k in rng.permutation(700)]
    rows += [(701, None, 1), (702, [None] + [0.0] * 31, 1), (703, [float("nan")] * 32, 2), (704, [float("inf")] * 32, 2), (None, [0.5] * 32, None),
             (3, [0.25] * 32, 1), (3, [0.25] * 32, 1), (705, [], 1), (706, [0.1] * 5, None), *[(800 + k, [1.0] * 32, 7) for k in range(50)]]
    check_lloyd(spark, rows, parts)


def test_few_wide_and_empty_vectors(spark):
    check_lloyd(spark, [(k, [float(k)] * 50, k) for k in range(5)], 2)
    check_lloyd(spark, [(1, [-0.001] * 3, None)], 1)
    empty = spark.createDataFrame([], VECTORS)
    assert cover_lloyd.compress(empty).count() == 0


def test_trees_spare_comparisons_and_add_up():
    rng = np.random.default_rng(1)
    points = np.rint(rng.normal(size=(20, 4))[rng.integers(0, 20, 4000)] * 400 + rng.normal(size=(4000, 4)) * 4).astype(np.int64)
    entries = points[::200][:16].copy()
    tree = cover_lloyd.Tree(points)
    exact = cover_lloyd.squares(points, entries).argmin(axis=1)
    assert (tree.codes(entries) == exact).all()
    count, total = tree.sums(entries)
    assert (count == np.bincount(exact, minlength=16)).all() and (total.sum(axis=0) == points.sum(axis=0)).all()
    whole, alone = tree.assigned(entries)
    assert sum(len(at) for at, _ in alone) < len(points) / 4 and sum(len(lo) for lo, *_ in whole) < len(points) / 4
    for upper, lower in zip(tree.levels, tree.levels[1:]):  # a child's points lie within its parent's range
        parent = np.repeat(np.arange(len(upper["node"])), np.diff(upper["child"]))
        assert (lower["lo"] >= upper["lo"][parent]).all() and (lower["hi"] <= upper["hi"][parent]).all()


# 13 MinHash near-dedup

def shingle_set(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def grouped(rows, percent=85):
    """``doc_id, n, component, kept`` by comparing all sets."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)] = min(least.get(top(k), doc), doc)
    return sorted(((doc, len(sets[k]), least.get(top(k)), doc == least.get(top(k))) for k, (doc, _) in enumerate(rows)), key=str)


def near_texts(seed=2):
    """Families of edited copies near the threshold on both sides, chains, shared passages, short and odd texts."""
    random.seed(seed)
    words = [f"w{k}" for k in range(4000)]
    passage = random.choices(words, k=40)
    texts = []
    for _ in range(12):
        base = random.choices(words, k=random.choice([12, 60, 200]))
        for _ in range(12):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy))
            base = random.choice([base, copy])
    for _ in range(60):
        texts.append(" ".join(passage + random.choices(words, k=random.randint(1, 30))))
    texts += ["one two", "ONE\ttwo", "one", "", None, " \n ", "one two three", "one  two\x0bthree", "é É", "é é", "x　y z", "long " * 5000, "long " * 4000]
    return texts


@pytest.mark.parametrize("cell_rows", [8192, 4])
def test_near_copies_equal_all_pairs_compared(spark, cell_rows):
    texts = near_texts()
    rows = list(zip(random.sample(range(1000), len(texts)), texts)) + [(None, texts[0]), (None, "alone without an id"), (None, "alone without an id"), (5000, texts[1]), (5000, texts[20])]
    docs = spark.createDataFrame([(d, t, 1, "n", "d", 2) for d, t in rows], DOCS).repartition(3)
    got = tensored_minhash.components(docs, cell_rows=cell_rows).collect()
    want = [(d, n, c, k or (d is None and c is None)) for d, n, c, k in grouped(rows)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_no_documents(spark):
    assert tensored_minhash.components(spark.createDataFrame([], DOCS)).count() == 0
    assert tensored_minhash.components(spark.createDataFrame([(1, None, 1, "", "", 1)], DOCS)).collect()[0].component_id == 1


def test_half_keys_cost_the_root_of_the_tables():
    assert tensored_minhash.MINHASHES == 2 * tensored_minhash.HALVES * tensored_minhash.ROWS
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([a[:368], rng.integers(0, 2**63, 32, dtype=np.uint64)])  # similarity 368 / 432 = 0.852
        x, y = tensored_minhash.minhashes([a, b]).reshape(2, 2, tensored_minhash.HALVES, tensored_minhash.ROWS)
        met = (x == y).all(axis=2).any(axis=1)
        missed += not met.all()
        assert (tensored_minhash.minhashes([a]) == tensored_minhash.minhashes([b])).sum() >= tensored_minhash.least_agreement(85)
    assert missed == 0


def test_shingle_hashes_are_the_distinct_shingles():
    texts = [t or "" for t in near_texts()]
    got = tensored_minhash.shingles(pa.array(texts))
    assert [len(s) for s in got] == [len(shingle_set(t)) for t in texts]
    joined = {}
    for t, s in zip(texts, got):
        assert joined.setdefault(shingle_set(t), s.tobytes()) == s.tobytes()


def test_new_queries_run(spark):
    run = queries.queries()
    for name, columns in (("op11_audit_repair", "audit,blank,conv_id,cost,duplicate,gaps,illegal,repaired_sha256,truncated"),
                          ("op12_cover_lloyd", "code,codebooks_sha256,error,label_error,vec_id"),
                          ("op13_tensored_minhash", "component_id,doc_id,kept,n_shingles")):
        df = run[name](spark, SF)
        assert ",".join(sorted(df.columns)) == columns and df.count() > 0


# 10: the coder's way by whole columns

def test_columns_of_latin_texts_equal_the_library():
    """Every code point under U+0250 in words, marks and between them, special tokens and far letters among them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from shelfmark.llm import bpe_automaton

    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), bpe_automaton.TextCoder(path)
    library.no_truncation(), library.no_padding()
    random.seed(11)
    latin = [chr(c) for c in range(1, 0x250)]
    letters = [c for c in latin if c.isalpha()]
    texts = ["".join(latin), "".join(reversed(latin)), "", " "]
    texts += [" ".join("".join(random.choices(letters, k=random.randint(1, 9))) + random.choice([".", "", "!?", ")", "'s", "1"]) for _ in range(6)) for _ in range(400)]
    texts += ["".join(random.choices([*latin, "漢", "Σ", "<|endoftext|>", "<|", " ", " "], k=20)) for _ in range(600)]
    for part in (slice(0, 500), slice(500, None), slice(0, 500)):  # known and new pieces
        got = coder.encode(texts[part])
        want = [e.ids for e in library.encode_batch(texts[part], add_special_tokens=False)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == want


# 7: cross-parsing

def parsed_by_hand(text, samples):
    """Letters, and phrases of each language: the longest match at each place, found by looking it up in the sample."""
    import unicodedata

    kind = [unicodedata.category(c)[0] for c in text.lower()]
    words = "".join(c if k in "LM" else " " for c, k in zip(text.lower(), kind)).split()
    if "L" not in kind:
        return 0, None
    line = " ".join(words) + " "
    pieces = []
    while line:
        cut = len(line)
        if cut > lang_crossparse.PIECE:
            cut = line.rfind(" ", 0, lang_crossparse.PIECE) + 1 or lang_crossparse.PIECE
        pieces.append(line[:cut])
        line = line[cut:]
    counts = []
    for _, sample in samples:
        n = 0
        for piece in pieces:
            at = 0
            while at < len(piece):
                end = at + 1
                while end < len(piece) and piece[at:end + 1] in sample:
                    end += 1
                at, n = end, n + 1
        counts.append(n)
    return sum(map(len, pieces)), counts


def test_cross_parse_by_hand_chooses_the_same_language():
    random.seed(21)
    alphabets = {"aa": "abcdefgh ", "bb": "fghijklm ", "cc": "अआइईउऊँंः ", "dd": "漢字仮名交文 "}
    samples = tuple((lang, "".join(random.choices(a, k=3000)) + " ") for lang, a in sorted(alphabets.items()))
    model = lang_crossparse.Model(samples)
    texts = ["", "½", "② Ⅷ 12 _", "\u0301", "a\u0301", "Zz!", None, "  a "]
    texts += ["".join(random.choices(random.choice(list(alphabets.values())) + random.choice(["", "xyz", "12.!"]), k=random.randint(1, 300))) for _ in range(120)]
    texts += ["".join(random.choices(alphabets["aa"], k=9000)), "".join(random.choices("abfgh", k=10_000))]
    got = model.score(texts)
    for text, lang, score, mean in zip(texts, *got):
        letters, counts = parsed_by_hand(text or "", samples)
        if counts is None:
            assert (lang, score, mean) == ("und", 0.0, 0.0), text
            continue
        bits = [n * np.log2(len(s) + 1) for n, (_, s) in zip(counts, samples)]
        assert lang == samples[int(np.argmin(bits))][0] and 0 <= score <= 1
        assert abs(mean - letters / counts[int(np.argmin(bits))]) < 1e-9


def test_a_hundred_languages_are_all_learned(spark):
    random.seed(22)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = {f"l{k:03d}": ["".join(random.choices(letters, k=3)) for _ in range(12)] for k in range(100)}

    def text(lang, n):
        return " ".join("".join(random.choices(syllables[lang], k=3)) for _ in range(n))

    rows = [(k * 10 + j, text(lang, 30), lang) for k, lang in enumerate(syllables) for j in range(6)]
    rows += [(5000 + k, text("l000", 40_000), "l000") for k in range(2)]  # a long document is not a language's whole sample
    rows += [(9000 + k, text(lang, 15), None) for k, lang in enumerate(syllables)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = lang_crossparse.samples(docs, lang_crossparse.F.lit(True), sample_chars=2000, all_chars=100_000)
    assert [lang for lang, _ in learned] == sorted(syllables) and max(len(t) for _, t in learned) <= 1000
    got = {r.doc_id: r.lang_pred for r in lang_crossparse.predict(docs, learned).collect()}
    assert sum(got[9000 + k] == lang for k, lang in enumerate(syllables)) >= 99


def test_language_stage_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = lang_crossparse.samples(docs, lang_crossparse.F.lit(True))
    clean = [r for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").collect() if lang_crossparse.words_of(r.text)]
    more = spark.createDataFrame([(90_001, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "en", "s", 3), (90_002, "xqzjkvw zxqvkj qqxzj wvxzkq", "en", "s", 3),
                                  (90_003, clean[0].text[:200], "en", "s", 3), (90_004, "12 ½ !!", "en", "s", 3)], docs.schema)
    kept = {r.doc_id for r in lang_crossparse.keep_documents(docs.unionByName(more), learned).collect()}
    assert kept & {90_001, 90_002, 90_003, 90_004} == {90_003}
    assert {r.doc_id for r in clean} <= kept


# 8: automata that keep length and shape

def test_learned_format_is_found_and_long_words_are_not(spark):
    random.seed(23)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def key(n=36):
        return "ghp_" + "".join(random.choices(alnum, k=n))

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ordinary = {r.doc_id: r.text or "" for r in docs.collect()}
    labelled = [(100_000 + k, f"deploy token = '{key()}' now") for k in range(80)]
    planted = {200_000 + k: key() for k in range(100)}
    wrong = {300_000 + k: key(20) for k in range(50)}
    long_words = {400_000 + k: "".join(random.choices("aeioustrnlm", k=40)) for k in range(100)}
    rows = labelled + [(i, f"see {t} there") for group in (planted, wrong, long_words) for i, t in group.items()]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    grammar = secret_grammar.learn(docs)
    assert all(len(a.arcs) > 10 for a, _ in grammar.kinds)
    found = {r.doc_id for r in secret_grammar.scan(docs, grammar).filter("n_format > 0").collect()}
    assert len(found & set(planted)) >= 85
    assert not found & set(long_words) and not found & set(ordinary)


def test_each_character_set_has_its_automaton_and_values_are_whole():
    random.seed(24)
    hexes = ["".join(random.choices("0123456789abcdef", k=40)) for _ in range(50)]
    upper = ["-".join("".join(random.choices("GHIJKLMNOP", k=4)) for _ in range(3)) for _ in range(30)]
    groups = secret_grammar.by_character_set(hexes + upper + ["one.odd+value"])
    assert [len(g) for g in groups] == [51, 30]
    automaton, most = secret_grammar.fitted(upper)
    assert len(automaton.arcs) == 15  # a state for each place of the format
    assert automaton.bits("GHIJ-KLMN-OPGH") < automaton.bits("GHIJK-LMN-OPGH") and automaton.bits("GHIJ-KLMN-OPGH") < automaton.bits("GHIJ-KLMN-OPGH-GHIJ")
    long_values = ["".join(random.choices("abc", k=2000)) for _ in range(20)]
    automaton, most = secret_grammar.fitted(long_values)
    assert len(automaton.arcs) <= secret_grammar.DEPTH + 1 and all(automaton.bits(v) / len(v) <= 1.05 * most for v in long_values)
    alone, most = secret_grammar.fitted(["just-one-value-1"])
    assert alone.bits("just-one-value-1") / 16 <= most < alone.bits("other-two-words2") / 16


# 1: examples

def test_examples_carry_the_loss(spark):
    """A row for each reply; what is trained on is lost with it."""
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "one <|turn|>"), (1, 3, "user", None), (1, 4, "assistant", "two"),
            (2, 0, "user", "u"), (3, 0, "assistant", "only"), *[(9, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(20_000)]]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = chat_format.examples(formatted)
    assert {r.conv_id: r.n for r in found.groupBy("conv_id").agg(chat_format.F.count("*").alias("n")).collect()} == {1: 2, 3: 1, 9: 10_000}
    whole = "".join(r.segment for r in formatted.filter("conv_id = 1").orderBy("position").collect())
    first, second = found.filter("conv_id = 1").orderBy("example").collect()
    assert (first.example, second.example) == (1, 2) and first.context_start == second.context_start == 0
    assert whole[second.context_start:second.context_end].count(chat_format.START) == 4
    assert whole[second.loss_start:second.loss_end] == "two" and whole[first.loss_start:first.loss_end] == "one <\\|turn|>"

    def digests(expanded):
        return {r.conv_id: r for r in chat_format.conversation_digests(chat_format.read_back(expanded)).collect()}

    everything = chat_format.expanded(formatted)
    full, less = digests(everything), digests(everything.filter("NOT (is_example AND conv_id = 9 AND example = 77)"))
    assert full[9].n_turns == less[9].n_turns == 20_000 and full[9].turns_sha256 == less[9].turns_sha256
    replies = [f"turn {k}" for k in range(1, 20_000, 2)]
    assert full[9].loss_sha256 == hashlib.sha256("".join(replies).encode()).hexdigest() and less[9].loss_chars == full[9].loss_chars - len(replies[76])
    assert full[1] == less[1] and full[1].loss_chars == len("one <|turn|>two") and full[2].loss_chars == 0


def test_examples_hold_their_whole_context(spark):
    """The expansion spells every prefix out; a loss is read at its place behind the whole context."""
    rows = [(c, k, ("system", "user", "assistant", "assistant")[k % 4], f"t{c}.{k} \\ </s>é") for c in (1, 2) for k in range(9)]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    everything = chat_format.expanded(formatted)
    found = everything.filter("is_example").collect()
    assert len(found) == 8 and everything.filter("NOT is_example").count() == 18
    segments = {(r.conv_id, r.position): r.segment for r in formatted.collect()}
    for r in found:
        assert r.text == "".join(segments[r.conv_id, p] for p in range(r.position + 1))
        assert r.text[r.context_start:r.context_end] == "".join(segments[r.conv_id, p] for p in range(r.position))
    cut = everything.withColumn("text", chat_format.F.expr("CASE WHEN conv_id = 2 AND example = 3 THEN substring(text, 2) ELSE text END"))
    full, less = ({r.conv_id: r for r in chat_format.conversation_digests(chat_format.read_back(e)).collect()} for e in (everything, cut))
    assert full[1] == less[1] and full[2].turns_sha256 == less[2].turns_sha256 and full[2].loss_sha256 != less[2].loss_sha256
    assert full[2].loss_sha256 == hashlib.sha256("".join(r[3] for r in rows if r[0] == 2 and r[2] == "assistant").encode()).hexdigest()
