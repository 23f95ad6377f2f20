"""Integer arithmetic coding of one symbol stream.

States are plain Python integers because ``frequency * range`` passes 64 bits. Whole runs of
settled or pending bits are shifted at once, found by the bit length of ``low ^ high`` and of
``low & ~high``, so a symbol costs a constant number of integer operations.
"""

from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate, pairwise
from typing import Any


def integer_cdf(weights: Sequence[float], scale: int) -> list[int]:
    """Strictly increasing integer cumulative frequencies; halves round to even."""
    if not weights or min(weights) < 0:
        raise ValueError("weights are needed, and none may be below zero")
    mass = sum(weights)
    if mass <= 0:
        raise ValueError("weights add up to nothing")
    if scale <= 0:
        raise ValueError("the scale has to be above zero")
    marks: list[int] = []
    floor = 1
    for share in accumulate(weight / mass for weight in weights):
        marks.append(max(floor, round(share * scale)))
        floor = marks[-1] + 1
    return marks


def check_cdf(cdf: Sequence[int]) -> None:
    if not cdf or cdf[0] <= 0:
        raise ValueError("a CDF begins above zero")
    if not all(a < b for a, b in pairwise(cdf)):
        raise ValueError("every mark of a CDF lies above the one before")


def check_state_bits(state_bits: int) -> None:
    if state_bits < 16:
        raise ValueError("a coder state needs 16 bits or more")


class _Interval:
    """The current ``[low, high]`` and the two renormalisation shifts."""

    def __init__(self, state_bits: int) -> None:
        check_state_bits(state_bits)
        self.width = state_bits
        self.mask = (1 << state_bits) - 1
        self.top = 1 << (state_bits - 1)
        self.below = self.top - 1
        self.low, self.high = 0, self.mask

    def narrow(self, bottom: int, ceiling: int, total: int) -> tuple[int, int, int]:
        """Take a symbol's share. Returns (settled bits, their count, new pending bits)."""
        # These two roundings must be those of the format, or bits would differ.
        span = self.high - self.low + 1
        self.high = self.low + ceiling * span // total - 1
        self.low += bottom * span // total
        settled = self.width - (self.low ^ self.high).bit_length()
        value = self.low >> (self.width - settled) if settled else 0
        if settled:
            self.low = (self.low << settled) & self.mask
            self.high = ((self.high << settled) & self.mask) | ((1 << settled) - 1)
        # low = 01.., high = 10..: the run of such pairs under the top bit stays undecided
        apart = ~(self.low & ~self.high) & self.below
        pending = self.width - 1 - apart.bit_length()
        if pending:
            self.low = (self.low << pending) & self.below
            self.high = self.top | ((self.high << pending) & self.below) | ((1 << pending) - 1)
        return value, settled, pending


class Encoder:
    def __init__(self, state_bits: int = 64) -> None:
        self._interval = _Interval(state_bits)
        self._pending = 0
        self._parts: list[str] = []

    def put(self, symbol: int, cdf: Sequence[int], checked: bool = False) -> None:
        if not checked:
            check_cdf(cdf)
        if not 0 <= symbol < len(cdf):
            raise ValueError("the CDF has no such symbol")
        bottom = cdf[symbol - 1] if symbol else 0
        value, settled, pending = self._interval.narrow(bottom, cdf[symbol], cdf[-1])
        if settled:
            bits = format(value, f"0{settled}b")
            if self._pending:
                other = "0" if bits[0] == "1" else "1"
                bits = bits[0] + other * self._pending + bits[1:]
                self._pending = 0
            self._parts.append(bits)
        self._pending += pending

    def finish(self) -> tuple[bytes, int]:
        """Payload and its bit length; one closing bit selects a point inside the interval."""
        bits = "".join(self._parts) + "1"
        size = -(-len(bits) // 8)
        return int(bits.ljust(8 * size, "0"), 2).to_bytes(size, "big"), len(bits)


class Decoder:
    """Reads zeros beyond the end of the payload."""

    def __init__(self, payload: bytes, bit_length: int, state_bits: int = 64) -> None:
        if not 0 <= bit_length <= 8 * len(payload):
            raise ValueError("the payload does not hold that bit length")
        self._interval = _Interval(state_bits)
        self._payload = payload
        self._size = bit_length
        self._at = 0
        self._code = self._take(state_bits)

    def _take(self, count: int) -> int:
        first, last = self._at, min(self._at + count, self._size)
        self._at += count
        if first >= last:
            return 0
        window = self._payload[first // 8 : -(-last // 8)]
        value = int.from_bytes(window, "big") >> (-last % 8)
        value &= (1 << (last - first)) - 1
        return value << (count - (last - first))

    def get(self, cdf: Sequence[int], checked: bool = False) -> int:
        if not checked:
            check_cdf(cdf)
        interval = self._interval
        span = interval.high - interval.low + 1
        place = ((self._code - interval.low + 1) * cdf[-1] - 1) // span
        symbol = bisect_right(cdf, place)
        if symbol >= len(cdf):
            raise ValueError("payload does not match the model")
        bottom = cdf[symbol - 1] if symbol else 0
        _, settled, pending = interval.narrow(bottom, cdf[symbol], cdf[-1])
        if settled:
            self._code = ((self._code << settled) & interval.mask) | self._take(settled)
        if pending:
            kept = self._code & interval.top
            shifted = (self._code << pending) & interval.below
            self._code = kept | shifted | self._take(pending)
        return symbol


def encode_run(
    tokens: Sequence[int],
    state: Any,
    frequencies: Callable[[Any], Sequence[int]],
    step: Callable[[Any, int], Any],
    state_bits: int = 64,
    trusted: bool = False,
) -> tuple[bytes, int]:
    """Payload and bit length of tokens whose frequencies follow from a walk of states.

    ``trusted`` tables are valid by construction and not checked again.
    """
    coder = Encoder(state_bits)
    put = coder.put
    for token in tokens:
        put(token, frequencies(state), trusted)
        state = step(state, token)
    return coder.finish()


def decode_run(
    payload: bytes,
    bit_length: int,
    count: int,
    state: Any,
    frequencies: Callable[[Any], Sequence[int]],
    step: Callable[[Any, int], Any],
    state_bits: int = 64,
    trusted: bool = False,
) -> list[int]:
    coder, tokens = Decoder(payload, bit_length, state_bits), []
    for _ in range(count):
        token = coder.get(frequencies(state), trusted)
        tokens.append(token)
        state = step(state, token)
    return tokens
