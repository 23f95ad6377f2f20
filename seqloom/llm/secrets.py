"""Secret scans: three base formats, and formats inferred from them as probabilistic automata.

Base matches (leftmost, non-overlapping per kind; failing ones drop out without retry):
``assign`` (a keyword, ``:`` or ``=``, a value of 8 or more characters), ``access`` (``AKIA`` and
capitals or digits, 16 or more characters), ``hex`` (32 or more lower-case hex digits).

Their values are labelled credentials. Of each kind a bounded sample becomes a prefix tree whose
states merge where their statistics are compatible (Hoeffding bound), red and blue states in the
usual order; the result is a probabilistic automaton of the format. Every other token of 8 or more
characters of the labelled alphabet is a candidate, and so are a token that reaches beyond the base
spans it holds, as a whole, and its parts beside them (reported where the whole is none). It is a
``format`` span where an automaton and
its kind's lengths make it likelier by ``GAIN`` bits than the background does, and its bits per
character are among those of the labelled values. The background (pairs of symbols, lengths; for
tokens of one class of characters, as runs of digits are, also how frequent the class is) is learned from the candidates that are not typical of a kind: of another length, mix of character
classes or score than its labelled values.

Spans are code points, end exclusive. Null text counts as empty; repeated rows are scanned each; an
empty table gives an empty result, and without credentials there are no automata and no such spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import cut_lineage, lowest, tidy

ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
#: The maximal runs of ``[0-9a-f]+`` that are long enough.
HEX = re.compile(r"[0-9a-f]{32,}", re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}", re.A)
SHORTEST = 8
KINDS = ("assign", "access", "hex", "format")

#: Bounds of the training sample: values of each kind, and their longest length.
PER_KIND = 1000
LONGEST = 256
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
ALPHABET = len(SYMBOLS)
#: Bits by which an automaton must be likelier than the background.
GAIN = 20.0
#: What the labelled values' highest bits per character may be exceeded by.
SLACK = 1.1
#: A mix of character classes is typical of a kind from this share of its values on.
TYPICAL = 0.01
#: Weights of the background's priors: single symbols for pairs, all alike for single symbols.
PRIOR_PAIR, PRIOR_SYMBOL = 200.0, 1000.0
#: Tokens up to this length are scored together, position by position.
TOGETHER = 1024

_CODE = np.zeros(256, dtype=np.uint8)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(ALPHABET)
_CLASS = np.array([1 if c.isupper() else 2 if c.islower() else 4 if c.isdigit() else 8 for c in SYMBOLS], np.uint8)

Span = tuple[int, int, int]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of base matches, by start and kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


#: How a candidate lies to base spans.
APART, WHOLE, PART = range(3)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, int]]:
    """Tokens with how they lie to base spans; dots at their ends are not part of them."""
    out: list[tuple[int, int, str, int]] = []

    def add(start: int, end: int, place: int) -> None:
        token = text[start:end]
        start += len(token) - len(token.lstrip("."))
        token = token.strip(".")
        if len(token) >= SHORTEST:
            out.append((start, start + len(token), token, place))

    k, held = 0, []  # base spans that may reach into the token
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][0] < end:
            held.append((base[k][0], base[k][2]))
            k += 1
        held = [span for span in held if span[1] > start]
        if not held:
            add(start, end, APART)
            continue
        parts, at = [], start
        for first, last in sorted(held):
            parts.append((at, max(at, first)))
            at = max(at, min(last, end))
        parts = [part for part in [*parts, (at, end)] if part[1] > part[0]]
        if parts:  # else base spans cover it
            add(start, end, WHOLE)
            for part in parts:
                add(*part, PART)
    return out


class Tokens:
    """Many tokens as codes of their symbols, one after another."""

    def __init__(self, values: pa.Array):
        values = values.cast(pa.large_string())
        at = np.frombuffer(values.buffers()[1], np.int64)[values.offset :][: len(values) + 1]
        data = values.buffers()[2]
        self.codes = _CODE[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data else np.zeros(0, np.uint8)
        self.starts, self.lengths = at[:-1] - at[0], np.diff(at)

    def __len__(self) -> int:
        return len(self.lengths)

    def classes(self) -> np.ndarray:
        """The character classes of each token, as bits."""
        return np.bitwise_or.reduceat(_CLASS[self.codes], self.starts) if len(self) else np.zeros(0, np.uint8)

    def bits(self, cost: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Sum of ``cost[state, symbol]`` along each token, from state 0 by ``following``."""
        total, state = np.zeros(len(self)), np.zeros(len(self), dtype=np.int64)
        order = np.argsort(-self.lengths, kind="stable")
        sorted_ = -self.lengths[order]
        first = int(np.searchsorted(sorted_, -TOGETHER))
        for k in order[:first]:
            at, here = 0.0, 0
            for symbol in self.codes[self.starts[k] : self.starts[k] + self.lengths[k]].tolist():
                at += cost[here, symbol]
                here = following[here, symbol]
            total[k] = at
        for place in range(int(-sorted_[first]) if first < len(order) else 0):
            held = order[first : int(np.searchsorted(sorted_, -place))]
            symbol, here = self.codes[self.starts[held] + place], state[held]
            total[held] += cost[here, symbol]
            state[held] = following[here, symbol]
        return total


class Lengths:
    """Bits of a length: counted up to ``LONGEST``, smoothed by one falling geometrically.

    Longer ones share the last count and fall geometrically from there.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(float)

    @staticmethod
    def counted(lengths: np.ndarray) -> np.ndarray:
        return np.bincount(np.minimum(lengths, LONGEST + 1), minlength=LONGEST + 2)

    def bits(self, lengths: np.ndarray) -> np.ndarray:
        beyond = np.maximum(lengths - LONGEST, 0)
        held = self.counts[np.minimum(lengths, LONGEST + 1)]
        held = np.where(beyond > 0, held * 0.05 * 0.95 ** np.minimum(beyond, 4 * LONGEST), held)
        falling = 0.05 * 0.95 ** np.minimum(np.maximum(lengths - SHORTEST, 0), 4 * LONGEST)
        return -np.log2((held + falling) / (self.counts.sum() + 1))


class Format:
    """A kind's automaton with the lengths, classes and scores of its labelled values."""

    def __init__(self, values: list[str]):
        self.cost, self.following = Automaton(values).tables()
        known = Tokens(pa.array(values, pa.string()))
        counts = Lengths.counted(known.lengths)
        self.seen = counts > 0
        self.lengths = Lengths(counts)
        self.mixes = np.bincount(known.classes(), minlength=16) >= TYPICAL * len(values)
        self.most = SLACK * float((known.bits(self.cost, self.following) / known.lengths).max())

    def score(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits, whether the score is one of labelled values, and whether all else is, too."""
        bits = tokens.bits(self.cost, self.following)
        fits = bits <= self.most * tokens.lengths
        seen = (tokens.lengths <= LONGEST) & self.seen[np.minimum(tokens.lengths, LONGEST)]
        return bits + self.lengths.bits(tokens.lengths), fits, fits & seen & self.mixes[tokens.classes()]


class Background:
    """Pairs of symbols and lengths of tokens; state 0 is a token's start, ``k + 1`` follows ``k``."""

    def __init__(self, counts: np.ndarray):
        pairs = counts[: (ALPHABET + 1) * ALPHABET].reshape(ALPHABET + 1, ALPHABET).astype(float)
        single = (pairs.sum(axis=0) + PRIOR_SYMBOL / ALPHABET) / (pairs.sum() + PRIOR_SYMBOL)
        self.cost = -np.log2((pairs + PRIOR_PAIR * single) / (pairs.sum(axis=1, keepdims=True) + PRIOR_PAIR))
        self.following = np.tile(np.arange(1, ALPHABET + 1), (ALPHABET + 1, 1))
        rest = counts[(ALPHABET + 1) * ALPHABET :]
        self.lengths = Lengths(rest[: LONGEST + 2])
        mixes = rest[LONGEST + 2 :].astype(float)
        self.classes = -np.log2((mixes + 1) / (mixes.sum() + 16))
        # symbols of each class, in bits; 0 for mixes
        self.sizes = np.log2(np.maximum(1, np.array([(_CLASS == m).sum() for m in range(16)])))

    @staticmethod
    def counted(tokens: Tokens) -> np.ndarray:
        """Counts of pairs, then of lengths, then of mixes of classes."""
        codes = tokens.codes.astype(np.int64)
        before = np.concatenate([[0], codes[:-1] + 1]) if len(codes) else codes
        before[tokens.starts] = 0
        pairs = np.bincount(before * ALPHABET + codes, minlength=(ALPHABET + 1) * ALPHABET)
        mixes = np.bincount(tokens.classes(), minlength=16)
        return np.concatenate([pairs, Lengths.counted(tokens.lengths), mixes])

    def score(self, tokens: Tokens) -> np.ndarray:
        """Bits by pairs of symbols; of a run of one class as that class's symbols, if that is less."""
        bits, mix = tokens.bits(self.cost, self.following), tokens.classes()
        alike = self.classes[mix] + self.sizes[mix] * tokens.lengths
        bits = np.where(self.sizes[mix] > 0, np.minimum(bits, alike), bits)
        return bits + self.lengths.bits(tokens.lengths)


class Automaton:
    """A probabilistic automaton: per state arrivals, endings and counted moves."""

    def __init__(self, values: list[str], confidence: float = 0.05):
        self.seen, self.ends, self.moves = [0], [0], [{}]
        for value in values:
            state = 0
            self.seen[0] += 1
            for symbol in value:
                following = self.moves[state].get(symbol)
                if following is None:
                    following = [len(self.seen), 0]
                    self.moves[state][symbol] = following
                    self.seen.append(0)
                    self.ends.append(0)
                    self.moves.append({})
                following[1] += 1
                state = following[0]
                self.seen[state] += 1
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / confidence))
        self._merge()

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(f / n - g / m) >= self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m, left, right = self.seen[a], self.seen[b], self.moves[a], self.moves[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for symbol in left.keys() | right.keys():
                to_a, to_b = left.get(symbol), right.get(symbol)
                if self._differ(to_a[1] if to_a else 0, n, to_b[1] if to_b else 0, m):
                    return False
                if to_a and to_b:
                    todo.append((to_a[0], to_b[0]))
        return True

    def _fold(self, into: int, other: int) -> None:
        """Adds the tree below ``other`` to ``into``."""
        todo = [(into, other)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for symbol, (target, count) in self.moves[b].items():
                have = self.moves[a].get(symbol)
                if have is None:
                    self.moves[a][symbol] = [target, count]
                else:
                    have[1] += count
                    todo.append((have[0], target))

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [
                (state, symbol, move[0])
                for state in red
                for symbol, move in sorted(self.moves[state].items())
                if move[0] not in red
            ]
            if not blue:
                break
            state, symbol, target = max(blue, key=lambda x: self.seen[x[2]])
            for merged in red:
                if self._compatible(merged, target):
                    self.moves[state][symbol][0] = merged
                    self._fold(merged, target)
                    break
            else:
                red.append(target)
        number = {state: k for k, state in enumerate(red)}
        self.seen = [self.seen[s] for s in red]
        self.ends, self.moves = (
            [self.ends[s] for s in red],
            [{c: [number[t], n] for c, (t, n) in self.moves[s].items()} for s in red],
        )

    def bits(self, token: str, smooth: float = 0.02) -> float:
        """Code length of a token; what no sample showed costs as a smoothed count."""
        total, state = 0.0, 0
        for symbol in token:
            move = self.moves[state].get(symbol)
            count = (move[1] if move else 0) + smooth
            total -= math.log2(count / (self.seen[state] + smooth * (ALPHABET + 1)))
            state = move[0] if move else 0
        return total - math.log2(
            (self.ends[state] + smooth) / (self.seen[state] + smooth * (ALPHABET + 1))
        )


    def tables(self, smooth: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each symbol where a token goes on, and the state it leads to."""
        counts = np.full((len(self.seen), ALPHABET), smooth)
        following = np.zeros((len(self.seen), ALPHABET), dtype=np.int64)
        for state, moves in enumerate(self.moves):
            for symbol, (target, count) in moves.items():
                code = _CODE[ord(symbol)]
                counts[state, code] += count
                following[state, code] = target
        return -np.log2(counts / counts.sum(axis=1, keepdims=True)), following


def typical(tokens: Tokens, formats: list[Format]) -> np.ndarray:
    """Tokens that nothing but the text before them tells from labelled values."""
    return np.any([f.score(tokens)[2] for f in formats], axis=0)


def credentials(tokens: Tokens, formats: list[Format], background: Background) -> np.ndarray:
    if not (formats and len(tokens)):
        return np.zeros(len(tokens), dtype=bool)
    plain = background.score(tokens)
    return np.any([fits & (plain - bits >= GAIN) for bits, fits, _ in (f.score(tokens) for f in formats)], axis=0)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans with values, and candidates of every text; texts are read once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, others, ends = [], [], [0]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                bases.append([{"start": s, "kind": k, "end": e, "value": v} for s, k, e, v in base])
                others += candidates(text, base)
                ends.append(len(others))
            start, end, value, place = zip(*others, strict=True) if others else ((), (), (), ())
            parts = [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(value, pa.string())]
            parts.append(pa.array(place, pa.int32()))
            listed = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "end", "value", "place"])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bases, _BASE), listed],
                ["doc_id", "base", "candidates"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        tidy(find),
        "doc_id bigint, base array<struct<start:bigint, kind:int, end:bigint, value:string>>,"
        " candidates array<struct<start:bigint, end:bigint, value:string, place:int>>",
    )


_BASE = pa.list_(
    pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())])
)


def infer(scanned: DataFrame, per_kind: int = PER_KIND) -> list[Format]:
    """One format per kind, from the values of the smallest hash."""
    known = scanned.select(F.explode("base").alias("b")).select("b.kind", "b.value")
    known = known.where(F.length("value") <= LONGEST).distinct()
    values = lowest(known, "kind", F.xxhash64("value"), per_kind).collect()
    by_kind: dict[int, list[str]] = {}
    for r in sorted(values, key=lambda r: (r["kind"], r["_place"], r["value"])):
        by_kind.setdefault(r["kind"], []).append(r["value"])
    kept = ([v for value in by_kind[kind] if (v := value.strip("."))] for kind in sorted(by_kind))
    return [Format(values) for values in kept if values]


def learn_background(scanned: DataFrame, formats: list[Format]) -> Background:
    """From all candidates that are not typical of a format; one row of counts a task and number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Background.counted(Tokens(pa.array([], pa.string())))
        for batch in batches:
            flat = batch.column(0).flatten()
            values = flat.field("value").filter(pc.equal(flat.field("place"), APART))
            if len(values):
                other = values.filter(pa.array(~typical(Tokens(values), formats)))
                total += Background.counted(Tokens(other))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["k", "n"])

    counts = Background.counted(Tokens(pa.array([], pa.string())))
    if formats:
        sums = scanned.select("candidates").mapInArrow(tidy(count), "k int, n bigint")
        for r in sums.groupBy("k").agg(F.sum("n").alias("n")).collect():
            counts[r["k"]] = r["n"]
    return Background(counts)


def find_secrets(docs: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format``."""
    scanned = cut_lineage(scan(docs))
    formats = infer(scanned, per_kind)
    background = learn_background(scanned, formats)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            others, flat = batch.column(2), batch.column(2).flatten()
            chosen = credentials(Tokens(flat.field("value")), formats, background)
            row = np.repeat(np.arange(len(others)), others.value_lengths().to_numpy())[chosen]
            fields = (flat.field(name).to_numpy()[chosen].tolist() for name in ("start", "end", "place"))
            by_row: dict[int, list[Span]] = {}
            edge = (-1, 0)  # where the last whole token among the chosen ends
            for k, b, e, place in zip(row.tolist(), *fields, strict=True):
                if place == PART and edge[0] == k and b < edge[1]:
                    continue
                edge = (k, e) if place == WHOLE else edge
                by_row.setdefault(k, []).append((b, 3, e))
            for k, base in enumerate(batch.column(1)):
                found = [(b["start"], b["kind"], b["end"]) for b in base.as_py()]
                digest = hashlib.sha256(_listed(found).encode()).hexdigest()
                found += by_row.get(k, [])
                for kind in range(4):
                    counts[kind].append(sum(k == kind for _, k, _ in found))
                digests.append(digest)
                spans.append(_listed(sorted(found)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts[:3]),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(counts[3], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"],
            )

    return scanned.mapInArrow(
        tidy(score),
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string,"
        " spans string, n_format bigint",
    )


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)
