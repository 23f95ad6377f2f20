"""Best-fit packing of documents into sequences of at most 4096 tokens, by linear grouping.

A document is its token ids and a closing id 1; only longer ones are cut, into full pieces and a
rest. Lengths lie in 1..4096, so their histogram has a fixed size whatever the input's, and the
plan is made from it alone:

1. Large lengths, sorted, form groups of equal cardinality and are rounded up to the largest of
   their group: few sizes remain.
2. Configurations of those sizes are chosen one at a time, each the fullest that holds the
   largest size still open (bounded knapsack), and used as often as the demand allows.
3. Actual lengths take the rounded ones' places, which leaves gaps.
4. Small lengths, longest first, go where the gap that stays is smallest; new sequences open
   only when none fits.

The plan says, for each length and rank among the pieces of that length, which sequence and
offset it gets. Pieces get their ranks from counts per (bucket, length), so no task sees all
pieces of a frequent length.

Null text is an empty document (one piece, id 1). Repeated rows are packed each. Empty table:
empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import cut_lineage, tidy
from seqloom.llm.tokens import DEFAULT, REMEMBERED, word_ids

CAPACITY = 4096
GROUPS = 48
#: Lengths above the capacity divided by this are grouped; the rest is best-fitted. Every value is
#: planned, which costs the driver little, and the plan of the fewest sequences is taken.
LARGE = (2, 3, 4, 8)
CLOSING = (1).to_bytes(4, "little")
#: Pieces ranked together in one bucket, on average.
BUCKET_ROWS = 200_000


def pieces(
    docs: DataFrame,
    tokenizer: str = DEFAULT,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids`` as little-endian u32.

    A worker remembers the ids of so many words: fewer take less memory and more time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer, remembered)
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for n, found in enumerate(encoder.encode(texts)):
                    found += CLOSING
                    for k, begin in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[begin : begin + 4 * capacity]
                        row.append(at + n)
                        piece.append(k)
                        start.append(begin // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [
                    keys.take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        encoder.forget()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(cut), schema + (", ids binary" if with_ids else ""))


class Plan:
    """Sequences in runs: ``times`` sequences that hold the same lengths."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[tuple[int, list[int]]] = []

    def table(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: first rank, first sequence and offset of each place, by rank."""
        places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        base = 0
        for times, lengths in self.runs:
            offset = 0
            for length in lengths:
                places[length].append((ranks[length], base, offset))
                ranks[length] += times
                offset += length
            base += times
        return {k: tuple(np.array(v, dtype=np.int64).T) for k, v in places.items()}

    @property
    def sequences(self) -> int:
        return sum(times for times, _ in self.runs)


def _groups(counts: dict[int, int], number: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping: ``(rounded size, [(length, count), ...])``, largest first."""
    total = sum(counts.values())
    each = max(1, math.ceil(total / number))
    groups, held, room = [], [], each
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, room)
            held.append((length, take))
            left -= take
            room -= take
            if not room:
                groups.append((held[0][0], held))
                held, room = [], each
    if held:
        groups.append((held[0][0], held))
    return groups


def _fullest(sizes: list[int], demand: list[int], first: int, capacity: int) -> list[int]:
    """Places per size of the fullest configuration that holds ``first``."""
    chosen = [0] * len(sizes)
    chosen[first] = 1
    room = capacity - sizes[first]
    # came[v]: index of the size that first reached fill v, or -1
    came = np.full(room + 1, -1, dtype=np.int64)
    reached = np.zeros(room + 1, dtype=bool)
    reached[0] = True
    for i, size in enumerate(sizes):
        most = min(demand[i] - chosen[i], room // size)
        before = reached.copy()
        for _ in range(most):
            new = np.zeros_like(reached)
            new[size:] = before[:-size] if size else before
            new &= ~reached
            if not new.any():
                break
            came[new] = i
            reached |= new
            before = new
    fill = int(np.flatnonzero(reached)[-1])
    while fill:
        chosen[came[fill]] += 1
        fill -= sizes[came[fill]]
    return chosen


def _configurations(groups, capacity: int) -> Iterator[tuple[int, list[int]]]:
    """``(times, group of each place)`` until every group's demand is met."""
    sizes = [size for size, _ in groups]
    demand = [sum(n for _, n in members) for _, members in groups]
    for first in range(len(groups)):
        while demand[first]:
            chosen = _fullest(sizes, demand, first, capacity)
            times = min(demand[i] // n for i, n in enumerate(chosen) if n)
            for i, n in enumerate(chosen):
                demand[i] -= n * times
            yield times, [i for i, n in enumerate(chosen) for _ in range(n)]


def _substitute(groups, capacity: int) -> list[tuple[int, list[int]]]:
    """Actual lengths in the places of rounded ones, as runs of equal sequences."""
    pools = [list(reversed(members)) for _, members in groups]
    runs = []
    for times, places in _configurations(groups, capacity):
        taken, cuts = [], {0, times}
        for group in places:
            got, need = [], times
            while need:
                length, count = pools[group].pop()
                take = min(count, need)
                if count > take:
                    pools[group].append((length, count - take))
                got.append((times - need, length))
                cuts.add(times - need)
                need -= take
            taken.append(got)
        edges = sorted(cuts)
        at = [0] * len(taken)
        for begin, end in zip(edges, edges[1:], strict=False):
            lengths = []
            for i, got in enumerate(taken):
                while at[i] + 1 < len(got) and got[at[i] + 1][0] <= begin:
                    at[i] += 1
                lengths.append(got[at[i]][1])
            runs.append((end - begin, lengths))
    return runs


def make_plan(
    histogram: dict[int, int],
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    thresholds: tuple[int, ...] = LARGE,
) -> Plan:
    plans = [_plan(histogram, capacity, groups, part) for part in thresholds]
    return min(plans, key=lambda plan: plan.sequences)


def _plan(histogram: dict[int, int], capacity: int, groups: int, part: int) -> Plan:
    plan = Plan(capacity)
    large = {n: c for n, c in histogram.items() if n * part > capacity}
    plan.runs = _substitute(_groups(large, groups), capacity)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, (_, lengths) in enumerate(plan.runs):
        gap = capacity - sum(lengths)
        open_at[gap].append(i)
        mask |= 1 << gap

    def put(i: int, gap: int) -> None:
        nonlocal mask
        open_at[gap].append(i)
        mask |= 1 << gap

    for length in sorted((n for n in histogram if n * part <= capacity), reverse=True):
        left = histogram[length]
        while left:
            fitting = mask >> length
            if not fitting:
                per = capacity // length
                full, rest = divmod(left, per)
                for times, held in ((full, per), (1, rest)):
                    if times and held:
                        plan.runs.append((times, [length] * held))
                        put(len(plan.runs) - 1, capacity - held * length)
                break
            gap = length + (fitting & -fitting).bit_length() - 1
            i = open_at[gap].pop()
            if not open_at[gap]:
                mask &= ~(1 << gap)
            times, lengths = plan.runs[i]
            if times > left:
                plan.runs.append((times - left, list(lengths)))
                put(len(plan.runs) - 1, gap)
                times = left
            plan.runs[i] = (times, [*lengths, length])
            put(i, gap - length)
            left -= times
    return plan


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, without gathering a length."""
    count = rows.count()
    buckets = max(1, math.ceil(count / BUCKET_ROWS))
    keyed = rows.withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    )
    held = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = held.select(
        "length",
        "bucket",
        F.expr(
            "coalesce(sum(held) OVER (PARTITION BY length ORDER BY bucket"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        ).alias("before"),
    )
    local = keyed.withColumn(
        "local",
        F.expr(
            "row_number() OVER (PARTITION BY length, bucket"
            " ORDER BY doc_id, piece, ids_crc32) - 1"
        ),
    )
    return (
        local.join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("local"))
        .drop("bucket", "before", "local")
    )


def pack(rows: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``rows`` has ``doc_id, piece, length, ids_crc32``."""
    counted = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # 4096 at most
    places = make_plan({r["length"]: r["n"] for r in counted}, capacity, groups).table()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence = np.zeros(len(length), dtype=np.int64)
            offset = np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, edges):
                if len(part):
                    first, base, at = places[int(length[part[0]])]
                    found = np.searchsorted(first, rank[part], side="right") - 1
                    sequence[part] = base[found] + rank[part] - first[found]
                    offset[part] = at[found]
            kept = batch.drop_columns(["rank"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column(
                "offset", pa.array(offset)
            )

    numbered = ranked(rows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("rank").schema]
    return numbered.mapInArrow(tidy(place), ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack_documents(
    docs: DataFrame, tokenizer: str = DEFAULT, remembered: int = REMEMBERED
) -> DataFrame:
    """Every piece of every document with its place; token ids are computed once."""
    placed = pack(cut_lineage(pieces(docs, tokenizer, remembered=remembered)))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def sequences(docs: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (little-endian u32), ``doc_ids``."""
    placed = pack(cut_lineage(pieces(docs, tokenizer, with_ids=True)))
    held = placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("held")
    )
    return held.select(
        "sequence_id",
        F.expr("aggregate(held, cast('' AS binary), (a, x) -> concat(a, x.ids))").alias("ids"),
        F.col("held.doc_id").alias("doc_ids"),
    )
