"""Conversation structure repair by a persistent audit DP (operator 11).

A repaired conversation's roles are an optional system turn and then pairs of
a user and an assistant turn, or nothing. Each turn is kept (cost 0), given the
role user or assistant (1) or deleted (2); turns with an empty text may be put
in anywhere (5). Blank and duplicate turns must go; a truncated turn that
stays adds 5. The audit is the string of the edits' initials in order
(``K R D I``); of the cheapest repairs the one with the least audit is taken.

Turn by turn, the cheapest audit is held for each state of the role grammar
(nothing yet, after system, after user, after assistant). Audits share their
prefixes: an audit is a linked node with its last edit, the digest of the
whole string and its ancestors 1, 2, 4, ... edits back. Two audits of the same
cost are compared at the first edit where they differ, which the digests find
by binary lifting; equal digests are trusted only if the nodes are the same
one, else the strings are spelled out. (Of two different audits that reach the
same state after the same turns at the same cost neither begins the other: the
longer one would have more insertions, so a higher cost. So the less of two
prefixes stays the less, whatever follows.)

A way that costs too much to win is dropped. What all held audits begin with is
moved to a byte string from time to time, and each state carries a running SHA-256 of its repaired text. So a task
streams over its conversations and holds no turns, one byte for each edit and
the nodes in which the four audits differ. Repeats of a turn within a
conversation are told by a window over equal turns, not by what a task
remembers.

Roles count by their first letter; only a turn whose initial is ``s``, ``u``
or ``a`` can be kept. Null role and text are one space. Turns are ordered by
``turn`` (null first), then role and text; repeated rows are turns of their
own. A null ``conv_id`` is a conversation of its own. Without turns there are
no faults, no cost and an empty audit. An empty table gives no rows. Other
columns are left behind.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import ship_package

#: Costs: another role, deletion, insertion, a truncated turn that stays.
RENAME, DELETE, INSERT, STUMP = 1, 2, 5, 5
#: A way that costs more than this beyond another one cannot win: a user and an assistant turn put in and a system turn deleted lead from any state to what follows any other.
BEYOND = 2 * INSERT + DELETE
#: Faults of a turn; the first counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACES = " \t\n\x0b\x0c\r"
#: States of the role grammar and the state after a turn of a role, by the role's initial.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Turns after which the common beginning of the audits is moved away.
FLUSH = 4096
PRIME, BASE = (1 << 61) - 1, 0x1F35_7A3D_9E11
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class Audit:
    """An audit string: the node of its last edit."""

    __slots__ = ("depth", "digest", "edit", "up")

    def __init__(self, before: Audit | None, edit: str):
        self.edit = edit
        if before is None:
            self.depth, self.digest, self.up = 0, 0, ()
            return
        self.depth, self.digest = before.depth + 1, (before.digest * BASE + ord(edit)) % PRIME
        up = [before]
        while len(up) <= len(up[-1].up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def at(self, depth: int) -> Audit:
        """The ancestor of this depth."""
        node, back = self, self.depth - depth
        while back:
            k = back.bit_length() - 1
            node, back = node.up[k], back - (1 << k)
        return node

    def spelled(self, depth: int = 0) -> str:
        """The edits below the ancestor of this depth."""
        edits, node = [], self
        while node.depth > depth:
            edits.append(node.edit)
            node = node.up[0]
        return "".join(reversed(edits))


def common_depth(a: Audit, b: Audit) -> int:
    """The length of the longest common prefix of two audits."""
    depth = min(a.depth, b.depth)
    a, b = a.at(depth), b.at(depth)
    if a is b:
        return depth
    for k in reversed(range(len(a.up))):
        if k < len(a.up) and a.up[k].digest != b.up[k].digest:
            a, b = a.up[k], b.up[k]
    if a.digest != b.digest and a.up[0] is b.up[0] and a.edit != b.edit:
        return a.depth - 1
    x, y = a.spelled(), b.spelled()  # digests that collide
    return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), len(x))


def less(a: Audit, b: Audit) -> bool:
    depth = common_depth(a, b)
    if depth == min(a.depth, b.depth):
        return a.depth < b.depth
    return a.at(depth + 1).edit < b.at(depth + 1).edit


class Way(NamedTuple):
    """The best way to a state: its cost, its audit, and the digest of the repaired text so far."""
    cost: int
    audit: Audit
    text: object

    def follow(self, cost: int, edit: str) -> tuple[int, Audit, Way]:
        return self.cost + cost, Audit(self.audit, edit), self


def _add(found: dict, state: int, step: tuple, line: tuple | None) -> None:
    """Hold the step if it is the best to ``state`` so far; ``line``: role and text that it adds."""
    old = found.get(state)
    if old is None or step[0] < old[0][0] or (step[0] == old[0][0] and less(step[1], old[0][1])):
        found[state] = (step, line)


def _taken(found: dict) -> dict[int, Way]:
    ways = {}
    most = min(step[0] for step, _ in found.values()) + BEYOND
    for state, ((cost, audit, source), line) in found.items():
        if cost > most:
            continue
        text = source.text
        if line is not None:
            text = text.copy() if text is not None else hashlib.sha256()
            text.update(((b"\n" if source.text is not None else b"") + f"{line[0]}:{line[1]}".encode("utf-8", "surrogatepass")))
        ways[state] = Way(cost, audit, text)
    return ways


def inserted(ways: dict[int, Way]) -> dict[int, Way]:
    """The ways with insertions at this place: a user turn, an assistant turn or both."""
    for initial in "ua":
        found = {s: ((w.cost, w.audit, w), None) for s, w in ways.items()}
        for state, after in AFTER[initial].items():
            if state in ways and (after not in ways or ways[state].cost + INSERT <= ways[after].cost):
                _add(found, after, ways[state].follow(INSERT, "I"), (ROLE[initial], ""))
        ways = _taken(found)
    return ways


def edited(ways: dict[int, Way], role: str, text: str, fault: int) -> dict[int, Way]:
    """The ways after a turn."""
    found: dict = {}
    for state, way in ways.items():
        _add(found, state, way.follow(DELETE, "D"), None)
    if fault not in (BLANK, DUPLICATE):
        stays = STUMP if fault == TRUNCATED else 0
        for initial, after in AFTER.items():
            own = role[:1] == initial
            if not own and initial not in ROLE:
                continue
            for state, then in after.items():
                if state in ways:
                    cost, edit, name = (0, "K", role) if own else (RENAME, "R", ROLE[initial])
                    _add(found, then, ways[state].follow(stays + cost, edit), (name, text))
    return _taken(found)


class Repair:
    """A conversation whose turns come one after the other."""

    def __init__(self):
        self.ways = {NOTHING: Way(0, Audit(None, ""), None)}
        self.done = bytearray()
        self.faults = [0] * 4
        self.turns = self.illegal = self.distinct = 0
        self.least = self.most = None
        self.initial = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.turns += 1
        self.faults[fault] += 1
        initial = role[:1] or " "
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if self.most != turn:
                self.distinct += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        self.ways = edited(inserted(self.ways), role, text, fault)
        if self.turns % FLUSH == 0:
            self.flush()

    def flush(self) -> None:
        """Move what all audits begin with to ``done`` and build the rest anew."""
        audits = [w.audit for w in self.ways.values()]
        depth = min(common_depth(audits[0], a) for a in audits)
        self.done += audits[0].at(depth).spelled().encode()
        made: dict[tuple, Audit] = {}
        root = Audit(None, "")
        for state, way in self.ways.items():
            node = root
            for edit in way.audit.spelled(depth):
                if (id(node), edit) not in made:
                    made[id(node), edit] = Audit(node, edit)
                node = made[id(node), edit]
            self.ways[state] = way._replace(audit=node)

    def result(self, conv_id: int | None) -> tuple:
        ends = {s: w for s, w in inserted(self.ways).items() if s in (NOTHING, ASSISTANT)}
        best = ends.get(NOTHING) or ends[ASSISTANT]
        for way in ends.values():
            if way.cost < best.cost or (way.cost == best.cost and way is not best and less(way.audit, best.audit)):
                best = way
        gaps = self.most - self.least + 1 - self.distinct if self.least is not None else 0
        text = (best.text or hashlib.sha256()).hexdigest()
        return (conv_id, min(gaps, 2**63 - 1), *self.faults[1:], self.illegal, best.cost, (self.done + best.audit.spelled().encode()).decode(), text)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: the rows after a damage that follows from the crc32 of ``conv_id:turn``.

    Of 20 remainders, 0 drops the row (it stays here, marked), 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats it and 4 makes its role user.
    """
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("damage", F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20)))
    hit = F.col("damage")
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (hit == 0).alias("dropped"),
                       F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
    return rows.drop("_copy")


def _fault(seen: Column) -> Column:
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    return (F.when(stripped == "", BLANK).when(seen, DUPLICATE)
            .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))


def with_faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` with the turn's ``fault``; nothing else is looked at in dropped rows."""
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    return turns.withColumn("fault", _fault(F.row_number().over(same) > 1).cast("int"))


def repair(turns: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``turns`` (``conv_id, turn, role, text, dropped``).

    ``gaps`` (numbers missing between the least and the greatest turn), the
    numbers of ``blank``, ``duplicate`` and ``truncated`` turns and of
    ``illegal`` neighbours, the ``cost``, the ``audit`` and
    ``repaired_sha256`` of the repaired ``role:text`` lines.
    """
    def run(frames):
        open_id, now = None, None
        for frame in frames:
            out = []
            ids, numbers = (frame[c].astype("Int64").astype(object) for c in ("conv_id", "turn"))
            for conv, turn, role, text, dropped, fault in zip(ids, numbers, frame["role"], frame["text"], frame["dropped"], frame["fault"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if now is None or conv != open_id:
                    if now is not None:
                        out.append(now.result(open_id))
                    open_id, now = conv, Repair()
                if not dropped:
                    now.add(None if turn is pd.NA else int(turn), role, text, int(fault))
            yield _frame(out)
        if now is not None:
            yield _frame([now.result(open_id)])

    ship_package(turns.sparkSession)
    rows = with_faults(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "fault")
    return rows.select("conv_id", "turn", "role", "text", "dropped", "fault").mapInPandas(run, RESULT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"conv_id": "Int64"})
