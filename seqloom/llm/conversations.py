"""Conversation structure repair by a persistent audit DP.

The rows of a conversation, by turn (nulls first, then role, then text), are edited at the least
cost so that the initials of their roles read ``(s?(ua)+)?``. Each row is kept (0), given the other
role (``R``, 3) or deleted (``D``, 4; required for blank and duplicate ones); rows without text may
be inserted (``I``, 3); a truncated row that stays adds 3. Of equal costs the audit, the initials
of the edits in order, that sorts first wins.

* The DP goes over rows and four states of the pattern. An audit is a linked node, letter and
  prefix, so audits share their prefixes. Nodes hold binary-lifting ancestors and rolling hashes:
  of two audits of equal cost the first letter that differs is found by halving over ancestors,
  and an equal hash is verified letter by letter up to the node both share.
* Rows that are equal are counted before the shuffle, then rows are range-partitioned and sorted.
  What a task holds of a conversation is cut into pieces of at most ``PIECE_ROWS`` rows and about
  ``PIECE_BYTES`` of text. A conversation whole within one piece is repaired there.
* Any other one, however long, has its pieces repaired from each state to each state where they
  lie. One pass over the pieces in order then extends the best audit of each state, piece by piece:
  of two audits only their order is kept, or what the longer adds to the shorter, so the pass holds
  neither rows nor audits in order to compare them. The text flows through one hash per state.

Nulls in role or text are one space, and so are null ``conv_id`` and ``turn`` in what the query
hashes for its damage; rows with a null ``conv_id`` are one conversation. Repeated rows are duplicates.
A conversation without rows gives zeros, an empty audit and the hash of the empty string. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import cut_lineage, tidy

PIECE_ROWS = 1024
PIECE_BYTES = 1 << 22
#: Characters of the text that take part in dealing rows out; the sort takes whole texts.
DEALT_BY = 64

# States of the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
STEPS = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
RULE = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED = 3
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")

_BASE, _FIELD = 1_000_003, (1 << 61) - 1


class Audit:
    """A letter after another audit; ``ups[k]`` is the audit ``2**k`` letters shorter."""

    __slots__ = ("depth", "hash", "letter", "ups")

    def __init__(self, before: Audit | None, letter: str):
        self.letter = letter
        if before is None:
            self.depth, self.hash, self.ups = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * _BASE + ord(letter)) % _FIELD
        ups, k = [before], 0
        while k < len(ups[k].ups):
            ups.append(ups[k].ups[k])
            k += 1
        self.ups = tuple(ups)

    def at(self, depth: int) -> Audit:
        node = self
        while node.depth > depth:
            node = node.ups[(node.depth - depth).bit_length() - 1]
        return node

    def letters(self, after: int = 0) -> str:
        found, node = [], self
        while node.depth > after:
            found.append(node.letter)
            node = node.ups[0]
        return "".join(reversed(found))


EMPTY = Audit(None, "")


def common_depth(one: Audit, other: Audit) -> int:
    """Letters two audits share from the first on."""
    depth = min(one.depth, other.depth)
    one, other = one.at(depth), other.at(depth)
    if one.hash != other.hash:
        # above the lowest ancestors that differ in hash, hashes are equal
        for k in range(len(one.ups) - 1, -1, -1):
            if k < len(one.ups) and one.ups[k].hash != other.ups[k].hash:
                one, other = one.ups[k], other.ups[k]
        one, other = one.ups[0], other.ups[0]
    shared = one.depth
    while one is not other:  # verify: equal hashes may belong to other letters
        if one.letter != other.letter:
            shared = one.depth - 1
        one, other = one.ups[0], other.ups[0]
    return shared


def sorts_before(one: Audit, other: Audit) -> bool:
    depth = common_depth(one, other)
    if depth in (one.depth, other.depth):
        return one.depth < other.depth
    return one.at(depth + 1).letter < other.at(depth + 1).letter


Best = dict[int, tuple[int, Audit]]


def _offer(best: Best, state: int, cost: int, before: Audit, letter: str) -> None:
    held = best.get(state)
    if held is not None and held[0] < cost:
        return
    audit = Audit(before, letter)
    if held is None or cost < held[0] or sorts_before(audit, held[1]):
        best[state] = cost, audit


def _inserted(best: Best) -> Best:
    """With rows put in: twice over, as two in a row may be needed and three never are."""
    for _ in range(2):
        for state in STATES:
            if state in best:
                cost, audit = best[state]
                for role in ROLES:
                    if state in STEPS[role]:
                        _offer(best, STEPS[role][state], cost + RULE["I"], audit, "I")
    return best


def repair(rows: list[tuple[str, str]], begin: int) -> Best:
    """Cheapest audits of ``(role initial, fault)`` rows, from state ``begin`` to each state."""
    best = _inserted({begin: (0, EMPTY)})
    for initial, fault in rows:
        then: Best = {}
        for state, (cost, audit) in best.items():
            _offer(then, state, cost + RULE["D"], audit, "D")
            if fault in ("blank", "duplicate"):
                continue
            cost += TRUNCATED * (fault == "truncated")
            kept = STEPS.get(initial, {}).get(state)
            if kept is not None:
                _offer(then, kept, cost, audit, "K")
            for role in ROLES:
                if state in STEPS[role]:
                    _offer(then, STEPS[role][state], cost + RULE["R"], audit, "R")
        best = _inserted(then)
    return best


def apply_audit(audit: str, begin: int, rows: list[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of each row an audit leaves, from state ``begin`` on; the audit fixes the roles."""
    state, at = begin, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            initial = role[:1]
        else:
            initial = "a" if state == USER else "u"
            role = ROLES[initial]
        state = STEPS[initial][state]
        yield f"{role}:{text}"


@dataclass
class Piece:
    """Consecutive rows of one conversation: ``(turn, role, text, fault)``."""

    conv_id: int | None
    rows: list[tuple[int | None, str, str, str]] = field(default_factory=list)
    size: int = 0

    def facts(self) -> tuple:
        """First and last turn (of those known), their number, faults, and illegal pairs."""
        turns = [turn for turn, *_ in self.rows if turn is not None]
        initials = [role[:1] for _, role, _, _ in self.rows]
        faults = [fault for *_, fault in self.rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        return (
            turns[0] if turns else None,
            turns[-1] if turns else None,
            len(set(turns)),
            *map(faults.count, FAULTS),
            illegal,
            initials[0] if initials else None,
            initials[-1] if initials else None,
        )


FACTS = "first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string"
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
#: A piece's ways from each state to each state.
WAYS = "ways array<struct<begin: int, end: int, cost: bigint, audit: string>>"
ROWS = "rows array<struct<role: string, text: string>>"
PIECE = f"conv_id bigint, part int, piece int, {FACTS}, {WAYS}, {ROWS}"
DONE = f"done struct<{', '.join(f.replace(' ', ': ', 1) for f in RESULT.split(', ')[1:])}>"
Way = tuple[int, int, int, str]


class _Live:
    """The cheapest audit of one state, as far as the pieces went."""

    __slots__ = ("audit", "cost", "empty", "hasher")

    def __init__(self, cost: int, hasher, audit: tuple, empty: bool):
        self.cost, self.hasher, self.audit, self.empty = cost, hasher, audit, empty

    def extended(self, cost: int, audit: str, left: list[str]) -> _Live:
        hasher, empty = self.hasher.copy(), self.empty
        if left:
            hasher.update(("\n" * (not empty) + "\n".join(left)).encode("utf-8", "replace"))
            empty = False
        return _Live(self.cost + cost, hasher, (self.audit, audit), empty)


class Repair:
    """One conversation, piece by piece."""

    def __init__(self) -> None:
        self.live = {START: _Live(0, hashlib.sha256(), (), True)}
        # of two live audits: which sorts first, or what the longer one adds to the shorter
        self.order: dict[tuple[int, int], int | tuple[str, str]] = {(START, START): ("", "")}
        self.first = self.last = self.role = None
        self.turns = self.illegal = 0
        self.faults = [0] * len(FAULTS)

    def add(self, facts: tuple, ways: list[Way], rows: list[tuple[str, str]]) -> None:
        first, last, turns, *faults, illegal, first_role, last_role = facts
        if first_role is None:
            return
        if self.role is not None:
            illegal += self.role + first_role not in LEGAL
        self.turns += turns - (first is not None and first == self.last)
        self.first = first if self.first is None else self.first
        self.last = self.last if last is None else last
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]
        self.illegal, self.role = self.illegal + illegal, last_role
        chosen: dict[int, tuple[int, int, str]] = {}
        for begin, end, cost, audit in ways:
            if begin not in self.live:
                continue
            held, total = chosen.get(end), self.live[begin].cost + cost
            if held is not None:
                known = self.live[held[0]].cost + held[1]
                if known < total or (known == total and self._compared(held[0], held[2], begin, audit) != 1):
                    continue
            chosen[end] = begin, cost, audit
        order = {}
        for one, other in product(chosen, chosen):
            order[one, other] = self._compared(chosen[one][0], chosen[one][2], chosen[other][0], chosen[other][2])
        self.live = {
            end: self.live[begin].extended(cost, audit, list(apply_audit(audit, begin, rows)))
            for end, (begin, cost, audit) in chosen.items()
        }
        self.order = order

    def _compared(self, one: int, audit: str, other: int, audit2: str) -> int | tuple[str, str]:
        """-1 or 1 where the first or the second sorts first; what each adds where one begins the other."""
        known = self.order[one, other]
        if not isinstance(known, tuple):
            return known
        left, right = known[0] + audit, known[1] + audit2
        if left.startswith(right):
            return left[len(right) :], ""
        if right.startswith(left):
            return "", right[len(left) :]
        return -1 if left < right else 1

    def result(self) -> tuple:
        best = None
        for state in FINAL:
            if state in self.live:
                cost = self.live[state].cost
                if best is None or cost < self.live[best].cost or (cost == self.live[best].cost and self.order[state, best] == -1):
                    best = state
        live = self.live[best]
        letters, audit = [], live.audit
        while audit:
            audit, piece = audit
            letters.append(piece)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults, self.illegal, live.cost, "".join(reversed(letters)), live.hasher.hexdigest()


def _ways(piece: Piece) -> list[Way]:
    narrow = [(role[:1], fault) for _, role, _, fault in piece.rows]
    return [
        (begin, end, cost, audit.letters())
        for begin in STATES
        for end, (cost, audit) in repair(narrow, begin).items()
    ]


def _whole(piece: Piece) -> tuple:
    """The result of a conversation that is one piece."""
    best = None
    found = repair([(role[:1], fault) for _, role, _, fault in piece.rows], START)
    for cost, audit in (found[state] for state in FINAL if state in found):
        if best is None or cost < best[0] or (cost == best[0] and sorts_before(audit, best[1])):
            best = cost, audit
    letters = best[1].letters()
    left = "\n".join(apply_audit(letters, START, [(role, text) for _, role, text, _ in piece.rows]))
    first, last, turns, *faults, illegal, _, _ = piece.facts()
    gaps = 0 if first is None else last - first + 1 - turns
    digest = hashlib.sha256(left.encode("utf-8", "replace")).hexdigest()
    return gaps, *faults, illegal, best[0], letters, digest


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to whole conversations, and to pieces where other tasks may hold more of one."""
    part = TaskContext.get().partitionId()
    piece: Piece | None = None
    number, inner = 0, False  # pieces of this conversation so far; past the partition's first one
    done: list[tuple] = []
    size = 0

    def cut() -> tuple:
        rows = [(role, text) for _, role, text, _ in piece.rows]
        return piece.conv_id, part, number, *piece.facts(), _ways(piece), rows, None

    for batch in batches:
        texts = batch.column(3)
        narrow = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6)]
        for k, (conv_id, turn, role, copies, fault, first) in enumerate(zip(*narrow, strict=True)):
            text = texts[k].as_py()
            if piece is None or conv_id != piece.conv_id:
                if piece is not None:
                    size += piece.size
                    whole = inner and number == 0
                    done.append((piece.conv_id, *[None] * 13, _whole(piece)) if whole else cut())
                    inner = True
                piece, number = Piece(conv_id), 0
            for copy in range(copies):
                if len(piece.rows) >= most or piece.size >= PIECE_BYTES:
                    size += piece.size
                    done.append(cut())
                    piece, number = Piece(conv_id), number + 1
                again = fault or ("duplicate" if copy or not first else None)
                piece.rows.append((turn, role, text, again or ("truncated" if _truncated(text) else "")))
                piece.size += len(text)
                if size >= PIECE_BYTES:
                    yield _batch(done)
                    done, size = [], 0
        if done:
            yield _batch(done)
            done, size = [], 0
    if piece is not None:
        yield _batch([cut()])


_GAPS = " \t\n\v\f\r"


def _truncated(text: str) -> bool:
    return text.rstrip(_GAPS)[-1:] not in (".", "!", "?")


_KEYS = ["conv_id", "part", "piece", *(f.split()[0] for f in FACTS.split(", "))]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string()]
_WAY = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_ROW = pa.struct([("role", pa.string()), ("text", pa.string())])
_RESULT = [(f.split()[0], pa.int64() if f.endswith("bigint") else pa.string()) for f in RESULT.split(", ")]
_DONE = pa.struct(_RESULT[1:])


def _structs(values: list, kind: pa.StructType) -> list | None:
    return [None if v is None else dict(zip(kind.names, v, strict=True)) for v in values]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(list(values), kind) for values, kind in zip(columns[:12], _KINDS, strict=True)]
    for values, kind in zip(columns[12:14], (_WAY, _ROW), strict=True):
        arrays.append(pa.array([None if v is None else _structs(v, kind) for v in values], pa.list_(kind)))
    arrays.append(pa.array(_structs(columns[14], _DONE), _DONE))
    return pa.RecordBatch.from_arrays(arrays, [*_KEYS, "ways", "rows", "done"])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to whole conversations."""
    current, state = None, None

    def out() -> pa.RecordBatch:
        values = [current, *state.result()]
        arrays = [pa.array([v], kind) for v, (_, kind) in zip(values, _RESULT, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [name for name, _ in _RESULT])

    for batch in batches:
        for k in range(batch.num_rows):  # one piece at a time: it may hold much text
            row = [column[k].as_py() for column in batch.columns]
            if state is None or row[0] != current:
                if state is not None:
                    yield out()
                current, state = row[0], Repair()
            ways = [tuple(way.values()) for way in row[12]]
            state.add(tuple(row[3:12]), ways, [(r["role"], r["text"]) for r in row[13]])
    if state is not None:
        yield out()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: the rows as the query has them; dropped ones count 0.

    By ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3
    repeats it, 4 makes it a user's.
    """
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv_id, F.lit(":"), turn)) % 20
    plain = _plain(conversations)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    gone = kind == 0
    return plain.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, F.lit(" ")).when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(gone, F.lit("")).otherwise(text).alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _plain(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def _blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(_GAPS)) == ""


def repair_rows(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Repairs rows of ``conv_id, turn, role, text, copies``, none of them null but ids and turns."""
    # equal rows meet before the shuffle, however many there are
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    content = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    counted = cut_lineage(counted.withColumn("_content", content))
    # what several turns say: where it was said first
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = counted.where("copies > 0").groupBy("conv_id", "_content").agg(F.min(place).alias("_first"), F.count("*").alias("_turns"))
    said = said.where("_turns > 1").select(F.col("conv_id").alias("_conv"), F.col("_content").alias("_said"), "_first")
    joined = counted.join(
        said, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_content") == F.col("_said")), "left"
    )
    first = F.col("_first").isNull() | F.col("_first.turn").eqNullSafe(F.col("turn"))
    facts = joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        F.when(_blank(F.col("text")), F.lit("blank")).alias("fault"),
        first.alias("first"),
    )
    dealt = facts.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, DEALT_BY))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = tidy(lambda batches: _pieces(batches, piece_rows))
    pieces = cut_lineage(ordered.mapInArrow(cut, f"{PIECE}, {DONE}"))
    whole = pieces.where("done IS NOT NULL").select("conv_id", "done.*")
    parts = pieces.where("done IS NULL").drop("done").repartition("conv_id")
    stitched = parts.sortWithinPartitions("conv_id", "part", "piece").mapInArrow(tidy(_stitch), RESULT)
    return whole.unionByName(stitched)


def damaged_and_repaired(conversations: DataFrame, **options: int) -> DataFrame:
    return repair_rows(damaged(conversations), **options)


def repair_conversations(conversations: DataFrame, **options: int) -> DataFrame:
    """The operator without damage: faults, cheapest audit and digest of each conversation."""
    return repair_rows(_plain(conversations).withColumn("copies", F.lit(1).cast("bigint")), **options)
