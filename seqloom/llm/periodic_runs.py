"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words in which words ``q`` apart are identical, ``q`` being its
smallest such period, of at least ``max(LEAST, 2 q)`` words, that no neighbouring word extends.

* A run of period ``p`` holds ``max(p, LEAST - p)`` consecutive words that come again ``p`` later.
  So it holds a block of ``B`` words, ``B`` the largest power of two with
  ``2 B - 1 <= max(p, LEAST - p)``, that begins at a multiple of ``B``. These are the scales.
* At each scale every block is laid over the window that follows it. The sum of squared differences
  at each distance comes from exact integer transforms (NTT modulo a prime); where it is zero the
  block occurs. Words enter as codes of so few bits that no sum reaches the prime. Blocks longer
  than ``LONGEST`` take part with their first ``LONGEST`` words, over the window in pieces, so
  transforms stay small in a text of any length.
* Before that, blocks drop out whose first words (two or four, by exact names) do not come again
  within the window at all: no zero can lie there.
* Each zero is the seed of an extension to both sides over the words themselves, which also
  decides whether words are equal where codes are. Of the periods of one stretch the least stays.

Documents of a batch are laid end to end, apart by words of their own, and go through the scales
together. Nothing is shuffled. Null text has no words; empty and blank texts give no run. Repeated
rows are searched each; a null id is as good as any. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import tidy

#: Words a run has at least.
LEAST = 12
#: Words of a block that take part in a transform.
LONGEST = 1024
#: Bytes of text laid end to end at a time, and cells of a transform's matrix.
TOGETHER = 1 << 22
CELLS = 1 << 20

# A prime with roots of unity of order 2**23, and a generator of its group.
PRIME = 998244353
GENERATOR = 3


@cache
def _twiddles(size: int) -> list[np.ndarray]:
    """Powers of the root of unity for every level of a transform of ``size`` cells."""
    levels = []
    while size > 1:
        root, powers = pow(GENERATOR, (PRIME - 1) // size, PRIME), np.ones(size // 2, np.int64)
        step = 1
        while step < len(powers):
            powers[step : 2 * step] = powers[:step] * pow(root, step, PRIME) % PRIME
            step *= 2
        levels.append(powers)
        size //= 2
    return levels


def _forward(cells: np.ndarray) -> np.ndarray:
    """Transform of each row, results in bit-reversed order."""
    rows, size = cells.shape
    for powers in _twiddles(size):
        half = len(powers)
        pairs = cells.reshape(rows, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        cells = np.stack(((low + high) % PRIME, (low - high) * powers % PRIME), axis=2)
    return cells.reshape(rows, size)


def _backward(cells: np.ndarray) -> np.ndarray:
    """Inverse of :func:`_forward`."""
    rows, size = cells.shape
    for powers in reversed(_twiddles(size)):
        half = len(powers)
        inverse = np.concatenate([powers[:1], (PRIME - powers[:0:-1]) % PRIME])
        pairs = cells.reshape(rows, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1] * inverse % PRIME
        cells = np.stack(((low + high) % PRIME, (low - high) % PRIME), axis=2)
    return cells.reshape(rows, size) * pow(size, -1, PRIME) % PRIME


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block and its window, at each offset in the window.

    Exact as long as ``width * max(code)**2`` is below the prime, as all sums then are.
    """
    width, span = blocks.shape[1], windows.shape[1]
    size = 1 << (span - 1).bit_length()
    padded = np.zeros((2, len(blocks), size), np.int64)
    padded[0, :, :width] = blocks[:, ::-1]
    padded[1, :, :span] = windows
    crossed = _backward(_forward(padded[0]) * _forward(padded[1]) % PRIME)[:, width - 1 : span]
    squares = np.zeros((len(blocks), span + 1), np.int64)
    np.cumsum(windows * windows, axis=1, out=squares[:, 1:])
    return (blocks * blocks).sum(axis=1)[:, None] + squares[:, width:] - squares[:, :-width] - 2 * crossed


def scales(longest: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(block, first, last)``: the distances each block length answers for, up to ``longest``."""
    found: dict[int, list[int]] = {}
    period = 1
    while period <= longest:
        block = 1 << (max(period, least - period) + 1).bit_length() - 2
        # from `least` on a block length answers for distances without gaps
        last = period if period < least else min(longest, 4 * block - 2)
        found.setdefault(block, []).extend((period, last))
        period = last + 1
    return [(block, min(ends), max(ends)) for block, ends in sorted(found.items())]


def _names(words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers of the stretches of 2 and 4 words from each place, equal where they are; all places by number."""
    names = {}
    current, width = words, 1
    while width < 4:
        after = np.full(len(current), -1, np.int64)
        after[: len(current) - width] = current[width:]
        current = np.unique((current << 32) + after + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
        names[width] = current, np.sort((current << 32) + np.arange(len(current)))
    return names


def _seeds(words: np.ndarray, codes: np.ndarray, scale: tuple[int, int, int], names: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and distances at which a block of this scale occurs again, by its codes."""
    block, first, last = scale
    width = min(block, LONGEST)
    bits = min(16, (29 - (width - 1).bit_length()) // 2)
    codes = codes & ((1 << bits) - 1)
    name, keys = names[2 if width < 4 else 4]
    begins = np.arange(0, len(words) - width - first + 1, block)
    step = min(last - first + 1, 3 * width if width == LONGEST else last)
    for near in range(first, last + 1, step):  # the window in pieces
        far = min(last, near + step - 1)
        place = np.searchsorted(keys, (name[begins] << 32) + begins + near)
        there = keys[np.minimum(place, len(keys) - 1)]
        fits = (place < len(keys)) & (there >> 32 == name[begins])
        starts = begins[fits & ((there & 0xFFFFFFFF) <= begins + far)]
        span = far - near + width
        rows = max(1, CELLS // (1 << (span - 1).bit_length()))
        for k in range(0, len(starts), rows):
            some = starts[k : k + rows, None]
            reach = some + near + np.arange(span)
            inside = reach < len(words)
            window = np.where(inside, codes[np.minimum(reach, len(words) - 1)], 0)
            zero = mismatches(codes[some + np.arange(width)], window) == 0
            zero &= inside[:, width - 1 :]
            row, offset = np.nonzero(zero)
            yield starts[k : k + rows][row], offset + near


def _equal_stretch(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on are equal, going by ``step`` (1 or -1)."""
    length, chunk = 0, 16
    most = len(words) - b if step > 0 else a + 1
    while length < most:
        chunk = min(chunk, most - length)
        if step > 0:
            same = words[a + length : a + length + chunk] == words[b + length : b + length + chunk]
        else:
            same = (words[a - length - chunk + 1 : a - length + 1] == words[b - length - chunk + 1 : b - length + 1])[::-1]
        if not same.all():
            return length + int(same.argmin())
        length += chunk
        chunk *= 4
    return length


class _Known:
    """Runs found so far, and which seeds they already explain."""

    def __init__(self):
        self.periods: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        held = self.periods.get((start, end))
        self.periods[start, end] = period if held is None else min(held, period)

    def unexplained(self, places: np.ndarray, distances: np.ndarray, width: int) -> np.ndarray:
        """Seeds that no known run holds together with their copy, at a multiple of its period."""
        new = np.ones(len(places), bool)
        order = np.argsort(places, kind="stable")
        sorted_places = places[order]
        for (start, end), period in self.periods.items():
            near, far = np.searchsorted(sorted_places, (start, end))
            some = order[near:far]
            new[some] &= (distances[some] % period != 0) | (places[some] + distances[some] + width > end)
        return new


def find_runs(words: np.ndarray, longest: int, least: int = LEAST) -> dict[tuple[int, int], int]:
    """``(start, end) -> period`` of all runs; ``longest`` bounds the periods."""
    known = _Known()
    if len(words) < least:
        return known.periods
    names = _names(words)
    codes = (words * 0x9E3779B1 >> 13) & 0xFFFF
    for scale in scales(longest, least):
        width = min(scale[0], LONGEST)
        for places, distances in _seeds(words, codes, scale, names):
            # blocks in a row at one distance lie in one stretch: its first one is enough
            order = np.lexsort((places, distances))
            places, distances = places[order], distances[order]
            follows = (np.diff(places) == scale[0]) & (np.diff(distances) == 0) if width == scale[0] else np.zeros(max(0, len(places) - 1), bool)
            lead = np.concatenate([[True], ~follows])[: len(places)]
            places, distances = places[lead], distances[lead]
            fresh = known.unexplained(places, distances, width)
            reached: dict[int, int] = {}
            for place, distance in zip(places[fresh].tolist(), distances[fresh].tolist(), strict=True):
                if reached.get(distance, -1) >= place + width:
                    continue
                ahead = _equal_stretch(words, place, place + distance, 1)
                if ahead < width:
                    continue  # equal codes, other words
                start = place - _equal_stretch(words, place - 1, place + distance - 1, -1) if place else 0
                reached[distance] = place + ahead
                end = place + distance + ahead
                if end - start >= max(least, 2 * distance):
                    known.add(start, end, distance)
    return known.periods


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query has them: in a tenth of the documents a tail that repeats itself."""
    if doc_id is None or not words:
        return words
    crc = zlib.crc32(str(doc_id).encode())
    if crc % 10:
        return words
    n, g = len(words), crc // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + period]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The query's columns for one document; ``runs`` of ``(start, length, period)``, sorted."""
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    kept = words
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        kept = [word for word, gone in zip(words, np.cumsum(dropped).tolist(), strict=False) if not gone]
        start, length, period = min(runs, key=lambda run: (-run[1], run[0], run[2]))
        best = (start, length, period, 1000 * length // period)
    else:
        best = (None, None, None, None)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def runs_of(listed: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each list of words, sorted."""
    numbers: dict[bytes, int] = {}
    parts, begins, at = [], [], 0
    for words in listed:
        begins.append(at)
        for word in words:
            if word not in numbers:
                numbers[word] = len(numbers)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([-1]))
        at += len(words) + 1
    line = np.concatenate([*parts, np.zeros(0, np.int64)])
    apart = line < 0
    line[apart] = len(numbers) + np.arange(apart.sum())  # equal to no word and to one another
    found: list[list[tuple[int, int, int]]] = [[] for _ in listed]
    longest = max(map(len, listed), default=0) // 2
    owners = np.array(begins)
    for (start, end), period in sorted(find_runs(line, longest, least).items()):
        owner = int(np.searchsorted(owners, start, side="right")) - 1
        found[owner].append((start - begins[owner], end - start, period))
    return found


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of documents of about ``TOGETHER`` bytes, of similar length where that is large."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end


SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, *, repeat_tails: bool = False, least: int = LEAST) -> DataFrame:
    """Runs of each document, their digests and the digest of the text without the repeats.

    ``repeat_tails`` makes the tail of a tenth of the documents repeat itself first.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(text.as_py() or "").encode("utf-8", "replace") for text in batch.column(1)]
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for begin, end in _groups(texts):
                listed = [text.split() for text in texts[begin:end]]
                if repeat_tails:
                    listed = [repeated_tail(w, key) for w, key in zip(listed, ids[begin:end], strict=True)]
                rows += map(_digest, listed, runs_of(listed, least))
            columns = [pa.array(ids, pa.int64())]
            columns += [pa.array(list(c), pa.int64()) for c in list(zip(*rows, strict=True))[:5]] if rows else [pa.array([], pa.int64())] * 5
            columns += [pa.array(list(c), pa.string()) for c in list(zip(*rows, strict=True))[5:]] if rows else [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(tidy(search), SCHEMA)


def list_runs(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """One row per run: ``doc_id, start, length, period``, in words of the text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(text.as_py() or "").encode("utf-8", "replace") for text in batch.column(1)]
            ids = batch.column(0).to_pylist()
            rows = []
            for begin, end in _groups(texts):
                found = runs_of([text.split() for text in texts[begin:end]], least)
                rows += [(key, *run) for key, runs in zip(ids[begin:end], found, strict=True) for run in runs]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            arrays = [pa.array(list(column), pa.int64()) for column in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "period"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(tidy(search), "doc_id bigint, start bigint, length bigint, period bigint")
