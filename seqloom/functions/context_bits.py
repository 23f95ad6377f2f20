"""Code lengths of a record's gaps under the record's own order-n model, in one cell."""

from functools import lru_cache

import numpy as np

from seqloom.formats import ALPHABET

ABSENT = len(ALPHABET)  # stands for symbols before the start of a text
MAX_ORDER = 22  # context and symbol must fit one 64-bit key

_CODES = np.full(256, 255, dtype=np.uint8)
_CODES[list(ALPHABET.encode())] = np.arange(len(ALPHABET))


def _contexts(codes: np.ndarray, order: int) -> np.ndarray:
    """Each position's up to ``order`` preceding symbols as one number."""
    padded = np.concatenate([np.full(order, ABSENT, dtype=np.int64), codes])
    keys = np.zeros(len(codes), dtype=np.int64)
    for shift in range(order):
        keys = keys * (ABSENT + 1) + padded[shift : shift + len(codes)]
    return keys


def _coded(text: bytes) -> np.ndarray:
    codes = _CODES[np.frombuffer(text, dtype=np.uint8)].astype(np.int64)
    if (codes == 255).any():
        unknown = "".join(sorted(set(text.decode("utf-8", "replace")).difference(ALPHABET)))
        raise ValueError(f"symbols outside the model's alphabet: {unknown}")
    return codes


#: Numbers of contexts and symbols up to which they are counted in place, not sorted.
_IN_PLACE = 1 << 22


def following_counts(text: bytes, order: int, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the positions from ``lead`` on, as numbers, and what follows each of them."""
    codes = _coded(text)
    return _counted((_contexts(codes, order) * ABSENT + codes)[lead:])


def following_counts_of_all(texts: list[bytes], order: int, leads: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same of many texts together; each begins without symbols before it."""
    codes = _coded(b"".join(texts))
    sizes = np.array([len(text) for text in texts])
    number = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(codes)) + order * (number + 1)
    padded = np.full(len(codes) + order * len(texts), ABSENT, dtype=np.int64)
    padded[at] = codes
    keys = np.zeros(len(codes), dtype=np.int64)
    for shift in range(order, 0, -1):
        keys = keys * (ABSENT + 1) + padded[at - shift]
    keys = keys * ABSENT + codes
    if any(leads):
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = keys[inside >= np.array(leads)[number]]
    return _counted(keys, (ABSENT + 1) ** order * ABSENT)


def _counted(keys: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    if most and most <= _IN_PLACE:
        found = np.bincount(keys)
        pairs = np.flatnonzero(found)
        times = found[pairs]
    else:
        pairs, times = np.unique(keys, return_counts=True)
    contexts, place = np.unique(pairs // ABSENT, return_inverse=True)
    counts = np.zeros((len(contexts), ABSENT), dtype=np.int64)
    counts[place, pairs % ABSENT] = times
    return contexts, counts


@lru_cache(maxsize=100_000)
def context_text(context: int, order: int) -> str:
    """The symbols of a context's number, without those before the start."""
    symbols = []
    for _ in range(order):
        context, digit = divmod(context, ABSENT + 1)
        symbols.append("" if digit == ABSENT else ALPHABET[digit])
    return "".join(reversed(symbols))


def _tally(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted value occurs in ``values``."""
    known, counts = np.unique(values, return_counts=True)
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[place] == wanted, counts[place], 0)


#: Code lengths are summed in whole units of this part of a bit, so no order of summing matters.
UNITS = 10**12


def unit_bits(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Code lengths of probabilities ``seen / total``, in units."""
    return np.rint(-np.log2(seen / total) * float(UNITS)).astype(np.int64)


def _sums(units: np.ndarray, edges: np.ndarray) -> list[int]:
    """Exact sums from each edge to the next, also past 64 bits."""
    high = np.add.reduceat(units >> 20, edges).tolist()
    low = np.add.reduceat(units & ((1 << 20) - 1), edges).tolist()
    return [(h << 20) + rest for h, rest in zip(high, low, strict=True)]


def gap_bits(seq: str, gaps: list[tuple[int, int]], order: int, pseudocount: float) -> list[float]:
    """Bits of each ``(start, length)`` gap; contexts restart at the beginning of a gap."""
    codes = _coded(seq.encode("utf-8"))
    if not gaps:
        return []
    contexts = _contexts(codes, order)
    pieces = []
    for start, length in gaps:
        piece = contexts[start : start + length].copy()
        head = min(order, length)
        piece[:head] = _contexts(codes[start : start + head], order)
        pieces.append(piece)
    used = np.concatenate(pieces)
    symbols = np.concatenate([codes[start : start + length] for start, length in gaps])
    seen = _tally(contexts * ABSENT + codes, used * ABSENT + symbols) + pseudocount
    total = _tally(contexts, used) + pseudocount * len(ALPHABET)
    edges = np.concatenate([[0], np.cumsum([length for _, length in gaps])[:-1]])
    return [float(bits) / UNITS for bits in _sums(unit_bits(seen, total), edges)]
