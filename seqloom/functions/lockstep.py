"""Arithmetic coding of many symbol streams at once.

Streams are the lanes of numpy arrays and all take their next symbol together; each lane gives
exactly the bits ``rangecoder`` gives. States are 64-bit numbers: with ``span = total * q + r`` a
share ``c * span // total`` is ``c * q + c * r // total``, and neither product passes 64 bits.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np

from seqloom.functions.rangecoder import check_state_bits

#: Cells of a matrix of lanes and symbols.
CELLS = 1 << 22
_U = np.uint64
_ONE, _32, _LOW32 = _U(1), _U(32), _U(0xFFFFFFFF)

#: ``states -> rows``: cumulative frequencies of each lane's state, with a leading 0.
Tables = Callable[[np.ndarray], np.ndarray]
#: ``states, tokens -> states``
Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = np.frexp((x >> _32).astype(np.float64))[1]
    low = np.frexp((x & _LOW32).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(_U)


class _Intervals:
    """``[low, high]`` of every lane."""

    def __init__(self, lanes: int, state_bits: int):
        check_state_bits(state_bits)
        if state_bits > 64:
            raise ValueError("lanes hold states of at most 64 bits")
        self.width = _U(state_bits)
        self.mask = _U((1 << state_bits) - 1)
        self.top = _U(1 << (state_bits - 1))
        self.below = self.top - _ONE
        self.low = np.zeros(lanes, _U)
        self.high = np.full(lanes, self.mask, _U)

    def keep(self, lanes: int) -> None:
        self.low, self.high = self.low[:lanes], self.high[:lanes]

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """How far above ``low`` each mark of the rows lies."""
        total = rows[:, -1:]
        rest = (self.high - self.low)[:, None]
        q, r = rest // total, rest % total + _ONE
        full = r == total
        q, r = q + full, np.where(full, _U(0), r)
        return rows * q + rows * r // total

    def narrow(self, bottom: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, ...]:
        """Settled bits, their count, and new pending bits of each lane."""
        with np.errstate(over="ignore"):
            high, low = self.low + ceiling - _ONE, self.low + bottom
            settled = self.width - _bit_length((low ^ high) & self.mask)
            value = np.where(settled > 0, low >> (self.width - settled), _U(0))
            low = (low << settled) & self.mask
            high = ((high << settled) & self.mask) | ((_ONE << settled) - _ONE)
            all_bits = settled >= _U(64)  # a shift by 64 is no shift
            low, high = np.where(all_bits, _U(0), low), np.where(all_bits, self.mask, high)
            apart = ~(low & ~high) & self.below
            pending = self.width - _ONE - _bit_length(apart)
            self.low = (low << pending) & self.below
            self.high = self.top | ((high << pending) & self.below) | ((_ONE << pending) - _ONE)
        return value, settled, pending


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Lanes, longest first, in groups whose matrix stays small."""
    order = np.argsort(-sizes, kind="stable")
    begin = 0
    while begin < len(order):
        lanes = max(1, CELLS // max(1, int(sizes[order[begin]])))
        yield order[begin : begin + lanes]
        begin += lanes


def _packed(value: np.ndarray, settled: np.ndarray, pending: np.ndarray) -> list[tuple[bytes, int]]:
    """Payloads of lanes from what each step settled and left pending."""
    lanes, steps = value.shape
    return packed_runs(*(np.ascontiguousarray(x).ravel() for x in (value, settled, pending)), np.full(lanes, steps))


def packed_runs(
    value: np.ndarray, settled: np.ndarray, pending: np.ndarray, lengths: np.ndarray
) -> list[tuple[bytes, int]]:
    """Payloads of lanes whose steps, ``lengths`` of them, stand one lane after another."""
    lanes = len(lengths)
    before = np.cumsum(pending) - pending
    before -= np.repeat(before[np.cumsum(lengths) - lengths], lengths)
    step = np.flatnonzero(settled)
    lane = np.repeat(np.arange(lanes), lengths)[step]
    count, waiting = settled[step].astype(np.int64), before[step]
    first = np.ones(len(lane), bool)
    first[1:] = lane[1:] != lane[:-1]
    held = waiting.copy()
    held[1:] -= np.where(first[1:], 0, waiting[:-1])
    sizes = count + held
    totals = np.bincount(lane, weights=sizes, minlength=lanes).astype(np.int64) + 1
    begins = np.concatenate([[0], np.cumsum((totals + 7) // 8)]) * 8
    ends = np.cumsum(sizes)
    lane_starts = np.zeros(lanes, np.int64)
    lane_starts[lane[first]] = (ends - sizes)[first]
    at = begins[lane] + ends - sizes - lane_starts[lane]
    bits = np.zeros(begins[-1], np.uint8)
    numbers = value[step]
    for k in range(int(count.max(initial=0))):
        some = count > k
        place = at[some] + k + (held[some] if k else 0)
        bits[place] = (numbers[some] >> (count[some] - 1 - k).astype(_U)) & _ONE
    late = np.flatnonzero(held)
    if len(late):  # pending bits are the opposite of the bit that settles them
        run = held[late]
        inner = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        bits[np.repeat(at[late] + 1, run) + inner] = 1 - np.repeat(bits[at[late]], run)
    bits[begins[:-1] + totals - 1] = 1
    data = np.packbits(bits).tobytes()
    return [
        (data[begins[k] // 8 : begins[k + 1] // 8], int(totals[k])) for k in range(lanes)
    ]


def encode_lanes(
    tokens: Sequence[np.ndarray], states: np.ndarray, tables: Tables, step: Step, state_bits: int = 64
) -> list[tuple[bytes, int]]:
    """Payload and bit length of each lane; lanes have at least one token."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    out: list[tuple[bytes, int]] = [(b"", 0)] * len(tokens)
    for group in _groups(sizes):
        longest = int(sizes[group[0]])
        matrix = np.zeros((len(group), longest), np.int64)
        for k, lane in enumerate(group):
            matrix[k, : sizes[lane]] = tokens[lane]
        matrix = np.ascontiguousarray(matrix.T)  # a step reads and writes one stretch of memory
        value = np.zeros((longest, len(group)), _U)
        settled = np.zeros((longest, len(group)), np.uint8)
        pending = np.zeros((longest, len(group)), np.int64)
        intervals, state = _Intervals(len(group), state_bits), states[group]
        active = np.searchsorted(-sizes[group], -np.arange(longest), side="left").tolist()
        for at in range(longest):
            n = active[at]
            intervals.keep(n)
            state, chosen = state[:n], matrix[at, :n]
            rows = tables(state)
            lane = np.arange(n)
            ends = np.stack((rows[lane, chosen], rows[lane, chosen + 1], rows[:, -1]), axis=1)
            shares = intervals.shares(ends)
            value[at, :n], settled[at, :n], pending[at, :n] = intervals.narrow(shares[:, 0], shares[:, 1])
            state = step(state, chosen)
        for lane, cell in zip(group, _packed(value.T, settled.T, pending.T), strict=True):
            out[lane] = cell
    return out


class _Bits:
    """Payloads of all lanes end to end, zeros after each."""

    def __init__(self, payloads: list[bytes], sizes: np.ndarray):
        parts, begins, at = [], [], 0
        for payload, size in zip(payloads, sizes.tolist(), strict=True):
            data = bytearray(payload[: -(-size // 8)])
            if size % 8:
                data[-1] &= 0xFF << (8 - size % 8) & 0xFF
            parts.append(bytes(data) + bytes(24))
            begins.append(8 * at)
            at += len(data) + 24
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.words = np.lib.stride_tricks.sliding_window_view(self.data, 8)
        self.at = np.array(begins, np.int64)
        self.ends = self.at + (sizes + 7) // 8 * 8

    def keep(self, lanes: int) -> None:
        self.at, self.ends = self.at[:lanes], self.ends[:lanes]

    def take(self, count: np.ndarray) -> np.ndarray:
        """The next bits of each lane as a number."""
        place = np.minimum(self.at, self.ends)
        byte, shift = place >> 3, (place & 7).astype(_U)
        word = np.ascontiguousarray(self.words[byte]).view(">u8").ravel().astype(_U)
        more = self.data[byte + 8].astype(_U)
        word = (word << shift) | (more >> (_U(8) - shift))
        self.at = self.at + count.astype(np.int64)
        return np.where(count > 0, word >> (_U(64) - np.maximum(count, _ONE)), _U(0))


def decode_lanes(
    payloads: Sequence[bytes],
    bit_lengths: Sequence[int],
    counts: Sequence[int],
    states: np.ndarray,
    tables: Tables,
    step: Step,
    state_bits: int = 64,
) -> list[np.ndarray]:
    """Tokens of each lane; lanes have at least one."""
    sizes = np.array(counts, np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(payloads)
    for group in _groups(sizes):
        longest = int(sizes[group[0]])
        bits = _Bits([payloads[k] for k in group], np.array([bit_lengths[k] for k in group], np.int64))
        intervals, state = _Intervals(len(group), state_bits), states[group]
        code = bits.take(np.full(len(group), intervals.width))
        found = np.zeros((longest, len(group)), np.int64)
        active = np.searchsorted(-sizes[group], -np.arange(longest), side="left").tolist()
        for at in range(longest):
            n = active[at]
            intervals.keep(n)
            bits.keep(n)
            state, code = state[:n], code[:n]
            shares = intervals.shares(tables(state))
            if ((code < intervals.low) | (code > intervals.high)).any():
                raise ValueError("payload does not match the model")
            # the last share is the span itself, which may be 2**64
            token = (shares[:, 1:-1] <= (code - intervals.low)[:, None]).sum(axis=1)
            lane = np.arange(n)
            _, settled, pending = intervals.narrow(shares[lane, token], shares[lane, token + 1])
            code = np.where(settled >= _U(64), _U(0), (code << settled) & intervals.mask) | bits.take(settled)
            code = (code & intervals.top) | ((code << pending) & intervals.below) | bits.take(pending)
            found[at, :n] = token
            state = step(state, token)
        for k, lane in enumerate(group):
            out[lane] = found[: sizes[lane], k]
    return out
