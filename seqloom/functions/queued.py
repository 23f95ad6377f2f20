"""Arithmetic coding of many records at once, each under one table of its own.

Records stand one behind another in the lanes of numpy arrays, so that a lane that is through with
one goes on with the next and nearly all lanes take a symbol at every step, however the lengths
differ. Each record gives exactly the bits ``rangecoder`` gives with 64-bit states.

A lane holds ``low`` and the complement of ``high``, which a step shifts alike: the leading bits
that agree are settled, the run of ``01..`` over ``10..`` behind them is pending, and what stays is
shifted by both at once. A decoder holds how far its code lies above ``low``.
"""

import heapq
from collections.abc import Iterator, Sequence

import numpy as np

from seqloom.functions.lockstep import packed_runs
from seqloom.functions.rangecoder import check_cdf, decode_run, encode_run

#: Symbols that are worked on together, and the most lanes they are dealt over.
CELLS = 1 << 23
WIDEST = 1024
#: With fewer lanes a step costs more than their symbols one by one.
LEAST = 16
#: Largest total of a table: a step then shifts by less than 32 bits.
TOTAL = 1 << 24
_STEPS = 512
_U = np.uint64
_ONE, _BELOW, _ALL = _U(1), _U((1 << 63) - 1), _U((1 << 64) - 1)
_MANTISSA, _BIAS = _U(52), _U(1023)


class _Tables:
    """Marks of all records, a leading 0 before each, and the total in every cell of ``totals``."""

    def __init__(self, cdfs: Sequence[Sequence[int]]):
        self.symbols = np.array([len(cdf) for cdf in cdfs], np.int64)
        self.width = int(self.symbols.max())
        self.marks = np.zeros((len(cdfs), self.width + 1), _U)
        for row, cdf in zip(self.marks, cdfs, strict=True):
            row[1 : len(cdf) + 1] = cdf
            row[len(cdf) + 1 :] = cdf[-1]
        self.totals = np.repeat(self.marks[:, -1], self.width + 1)


def _dealt(sizes: np.ndarray, lanes: bool) -> Iterator[tuple[list[int], list[list[int]]]]:
    """Records to code one by one, and records of each lane, longest lane first; group by group."""
    order = [k for k in np.argsort(-sizes, kind="stable").tolist() if sizes[k]]
    begin = 0
    while begin < len(order):
        end, total = begin, 0
        while end < len(order) and (end == begin or total + sizes[order[end]] <= CELLS):
            total += int(sizes[order[end]])
            end += 1
        group, begin = order[begin:end], end
        alone = 0
        while alone < len(group) and (not lanes or sizes[group[alone]] * LEAST > total):
            total -= int(sizes[group[alone]])
            alone += 1
        queues: list[list[int]] = []
        if alone < len(group):
            height = max(int(sizes[group[alone]]), -(-total // WIDEST))
            queues = [[] for _ in range(-(-total // height))]
            loads = [(0, k) for k in range(len(queues))]
            for k in group[alone:]:  # always behind the shortest queue
                load, queue = heapq.heappop(loads)
                queues[queue].append(k)
                heapq.heappush(loads, (load + int(sizes[k]), queue))
            queues.sort(key=lambda queue: -int(sizes[queue].sum()))
        yield group[:alone], queues


class _Lanes:
    """States of the lanes that still have a symbol to take."""

    def __init__(self, sizes: np.ndarray, queues: list[list[int]]):
        self.heights = np.array([sizes[queue].sum() for queue in queues], np.int64)
        self.steps = int(self.heights[0])
        self.active = np.searchsorted(-self.heights, -np.arange(self.steps), side="left")
        self.begins: dict[int, list[tuple[int, int]]] = {}
        for lane, queue in enumerate(queues):
            at = 0
            for k in queue:
                self.begins.setdefault(at, []).append((lane, k))
                at += int(sizes[k])
        self.state = np.zeros((2, len(queues)), _U)
        self.keep(len(queues))

    def keep(self, lanes: int) -> None:
        self.lanes = lanes
        self.state = np.ascontiguousarray(self.state[:, :lanes])
        self.low, self.over = self.state
        self.rest, self.q, self.r, self.a, self.b = np.empty((5, lanes), _U)
        self.real = np.empty(lanes)
        self.power = self.real.view(_U)

    def begun(self, at: int) -> tuple[list[int], list[int]] | None:
        """Lanes that begin a record at this step, and the records."""
        if at not in self.begins:
            return None
        lanes, records = zip(*self.begins[at], strict=True)
        self.state[:, lanes] = 0
        return list(lanes), list(records)

    def spans(self, totals: np.ndarray) -> None:
        """``q`` and ``r``: a mark ``c`` lies ``c * q + c * r // total`` above ``low``."""
        np.add(self.low, self.over, out=self.rest)
        np.invert(self.rest, out=self.rest)
        np.floor_divide(self.rest, totals, out=self.q)
        np.multiply(self.q, totals, out=self.r)
        np.subtract(self.rest, self.r, out=self.r)
        np.add(self.r, _ONE, out=self.r)

    def _powers(self, x: np.ndarray) -> None:
        """``power``: the exponent of each number; its lower bits cannot round it up."""
        np.right_shift(x, _ONE, out=self.b)
        np.invert(self.b, out=self.b)
        np.bitwise_and(x, self.b, out=self.b)
        self.real[:] = self.b
        np.right_shift(self.power, _MANTISSA, out=self.power)

    def shift(self, agree: np.ndarray | None = None, shifts: np.ndarray | None = None) -> np.ndarray:
        """Shift out what is settled and pending; ``63 -`` the shift of each lane comes back.

        ``agree`` takes how many low bits are not settled, ``shifts`` the whole shift.
        """
        np.bitwise_xor(self.low, self.over, out=self.a)
        np.invert(self.a, out=self.a)
        self._powers(self.a)
        np.subtract(self.power, _BIAS, out=self.q)
        if agree is not None:
            np.add(self.q, _ONE, out=agree, casting="unsafe")
        np.left_shift(_ONE, self.q, out=self.q)
        np.subtract(self.q, _ONE, out=self.q)
        np.bitwise_and(self.low, self.over, out=self.a)
        np.invert(self.a, out=self.a)
        np.bitwise_and(self.a, self.q, out=self.a)
        self._powers(self.a)
        np.subtract(self.power, _BIAS - _ONE, out=self.a)
        np.subtract(_U(63), self.a, out=self.q)
        if shifts is not None:
            np.copyto(shifts, self.q, casting="unsafe")
        np.left_shift(self.state, self.q, out=self.state)
        np.bitwise_and(self.state, _BELOW, out=self.state)
        return self.a


def _encoded(tokens: Sequence[np.ndarray], sizes: np.ndarray, tables: _Tables, queues: list[list[int]]):
    """``(record, payload, bit length)`` of the records of some lanes."""
    lanes = _Lanes(sizes, queues)
    places = np.zeros((len(queues), lanes.steps), np.int32)
    for row, queue in zip(places, queues, strict=True):
        row[: lanes.heights[0]][: sum(int(sizes[k]) for k in queue)] = np.concatenate(
            [tokens[k].astype(np.int32) + k * (tables.width + 1) for k in queue]
        )
    low = np.zeros((lanes.steps, len(queues)), _U)
    agree, shifts = np.zeros((2, lanes.steps, len(queues)), np.uint8)
    marks = tables.marks.ravel()
    for begin in range(0, lanes.steps, _STEPS):
        some = np.ascontiguousarray(places[:, begin : begin + _STEPS].T)
        ends = np.stack((marks[some], marks[some + 1]), axis=1)
        totals = tables.totals[some]
        for at in range(begin, begin + len(some)):
            n = int(lanes.active[at])
            if n != lanes.lanes:
                lanes.keep(n)
            lanes.begun(at)
            total, end = totals[at - begin, :n], ends[at - begin, :, :n]
            lanes.spans(total)
            share = end * lanes.r
            np.floor_divide(share, total, out=share)
            share += end * lanes.q
            share += lanes.low
            low[at, :n] = lanes.low[:] = share[0]
            np.negative(share[1], out=lanes.over)
            lanes.shift(agree[at, :n], shifts[at, :n])
    # bits of some lanes at a time
    step = max(1, (1 << 19) // lanes.steps)
    for begin in range(0, len(queues), step):
        part = slice(begin, begin + step)
        there = np.arange(lanes.steps) < lanes.heights[part, None]
        records = [k for queue in queues[part] for k in queue]
        bits, shift, value = (np.ascontiguousarray(x[:, part].T)[there] for x in (agree, shifts, low))
        settled = 64 - bits
        value = np.where(settled > 0, value >> np.minimum(bits, 63).astype(_U), _U(0))
        cells = packed_runs(value, settled, shift.astype(np.int64) - settled, sizes[records])
        for k, (payload, length) in zip(records, cells, strict=True):
            yield k, payload, length


def encode_records(
    tokens: Sequence[np.ndarray], cdfs: Sequence[Sequence[int]]
) -> list[tuple[bytes, int]]:
    """Payload and bit length of each record under its own table; of no tokens, those of none."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    for k, (listed, cdf) in enumerate(zip(tokens, cdfs, strict=True)):
        if sizes[k]:
            check_cdf(cdf)  # once a record, not at every symbol
            if int(listed.min()) < 0 or int(listed.max()) >= len(cdf):
                raise ValueError("the CDF has no such symbol")
    out = [encode_run([], 0, lambda _: (), lambda s, _: s)] * len(tokens)
    held = [cdf if size else [1] for cdf, size in zip(cdfs, sizes, strict=True)]
    for alone, queues in _dealt(sizes, all(cdf[-1] <= TOTAL for cdf in held)):
        for k in alone:
            out[k] = encode_run(tokens[k].tolist(), 0, lambda _, t=cdfs[k]: t, lambda s, _: s, trusted=True)
        if queues:
            some = sorted(k for queue in queues for k in queue)
            at = {k: i for i, k in enumerate(some)}
            own = [[at[k] for k in queue] for queue in queues]
            for i, payload, bits in _encoded([tokens[k] for k in some], sizes[some], _Tables([held[k] for k in some]), own):
                out[some[i]] = payload, bits
    return out


class _Payloads:
    """The 64 bits from every byte of the payloads on; zeros after each payload."""

    def __init__(self, cells: Sequence[tuple[bytes, int]]):
        parts, begins, at = [], [], 0
        for payload, size in cells:
            if not 0 <= size <= 8 * len(payload):
                raise ValueError("the payload does not hold that bit length")
            data = bytearray(payload[: -(-size // 8)])
            if size % 8:
                data[-1] &= 0xFF << (8 - size % 8) & 0xFF
            parts += data, bytes(16)
            begins.append(8 * at)
            at += len(data) + 16
        data = np.frombuffer(b"".join(parts), np.uint8)
        views = np.lib.stride_tricks.sliding_window_view(data, 8)
        self.words = np.ascontiguousarray(views).view(">u8").ravel().astype(_U)
        self.begins = np.array(begins, np.int64)
        self.ends = self.begins + np.array([(size + 7) // 8 * 8 for _, size in cells], np.int64)


def _decoded(cells: Sequence[tuple[bytes, int]], sizes: np.ndarray, tables: _Tables, queues: list[list[int]]):
    """``(record, tokens)`` of the records of some lanes."""
    lanes, payloads, width = _Lanes(sizes, queues), _Payloads(cells), tables.width
    found = np.zeros((lanes.steps, len(queues)), np.uint8 if width <= 256 else np.int64)
    marks = np.zeros((width, len(queues)), _U)
    above = np.zeros(len(queues), _U)  # how far the code lies above low
    place, last = np.zeros((2, len(queues)), np.int64)
    wrong = np.zeros(len(queues), bool)
    shares, lane = np.full((width + 1, len(queues)), _ALL), np.arange(len(queues))
    for at in range(lanes.steps):
        n = int(lanes.active[at])
        if n != lanes.lanes:
            lanes.keep(n)
            marks, shares = (np.ascontiguousarray(x[:, :n]) for x in (marks, shares))
            above, place, last, lane = above[:n], place[:n], last[:n], lane[:n]
        if begun := lanes.begun(at):
            some, records = begun
            marks[:, some] = tables.marks[records, 1:].T
            above[some] = payloads.words[payloads.begins[records] >> 3]
            last[some] = payloads.ends[records]
            place[some] = payloads.begins[records] + 64
        total = marks[-1]
        lanes.spans(total)
        wrong[:n] |= above > lanes.rest
        # one less than each share, as the last may be 2 ** 64
        one = marks * lanes.r
        np.floor_divide(one, total, out=one)
        one += marks * lanes.q
        np.subtract(one, _ONE, out=shares[1:])
        token = (shares[1:-1] < above).sum(axis=0)
        found[at, :n] = token
        cell = token * n + lane
        bottom = shares.take(cell) + _ONE
        np.add(lanes.low, shares.take(cell + n), out=lanes.over)
        np.invert(lanes.over, out=lanes.over)
        lanes.low += bottom
        above -= bottom
        left = lanes.shift()
        np.left_shift(above, lanes.q, out=above)
        np.minimum(place, last, out=place)
        word = payloads.words.take(place >> 3)
        np.left_shift(word, (place & 7).view(_U), out=word)
        np.right_shift(word, _ONE, out=word)
        np.right_shift(word, left, out=word)
        above |= word
        place += lanes.q.view(np.int64)
    if wrong.any():
        raise ValueError("payload does not match the model")
    for column, queue in enumerate(queues):
        at = 0
        for k in queue:
            yield k, found[at : at + sizes[k], column]
            at += int(sizes[k])


def decode_records(
    cells: Sequence[tuple[bytes, int]], counts: Sequence[int], cdfs: Sequence[Sequence[int]]
) -> list[np.ndarray]:
    """Tokens of each record from its payload and bit length, under its own table."""
    sizes = np.array(counts, np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(cells)
    for cdf, size in zip(cdfs, sizes, strict=True):
        if size:
            check_cdf(cdf)
    held = [cdf if size else [1] for cdf, size in zip(cdfs, sizes, strict=True)]
    for alone, queues in _dealt(sizes, all(cdf[-1] <= TOTAL for cdf in held)):
        for k in alone:
            tokens = decode_run(*cells[k], int(sizes[k]), 0, lambda _, t=cdfs[k]: t, lambda s, _: s, trusted=True)
            out[k] = np.array(tokens, np.int64)
        if queues:
            some = sorted(k for queue in queues for k in queue)
            at = {k: i for i, k in enumerate(some)}
            own = [[at[k] for k in queue] for queue in queues]
            for i, tokens in _decoded([cells[k] for k in some], sizes[some], _Tables([held[k] for k in some]), own):
                out[some[i]] = tokens
    return out
