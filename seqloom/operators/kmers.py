"""Positions, k-mers and chunked access to long sequences."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import is_empty, rebalance

# Sequences are cut into pieces of this many positions before they are exploded.
CHUNK_POSITIONS = 1 << 16
# Records up to this size are worked on where they lie; longer ones are dealt out in pieces.
LOCAL_RECORD = 1 << 20


def route(records: DataFrame, limit: int = LOCAL_RECORD) -> tuple[DataFrame, DataFrame]:
    """Records that fit one task, and the others; each record by its own size, in every plan.

    ``size_bound``, where the source has one, is a narrow column that prunes row groups, so the
    second part costs next to nothing where there is none. An unknown size counts as long.
    """
    size = F.col("size_bound") if "size_bound" in records.columns else F.length("seq")
    short = F.coalesce(size <= limit, F.lit(False))
    return records.where(short), records.where(~short)


def split_by_id(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Records whose id no other row has, and the others (``None`` when there are none).

    What is gathered by record needs no shuffle for the first; one narrow column tells.
    """
    ids = records.groupBy(F.col("record_id").alias("_shared")).agg(F.count(F.lit(1)).alias("_rows"))
    shared = ids.where("_rows > 1").select("_shared")
    if is_empty(shared):
        return records, None
    same = F.col("record_id").eqNullSafe(F.col("_shared"))
    return records.join(shared, same, "left_anti"), records.join(shared, same, "left_semi")


def piece_offsets(width: int, positions: int = CHUNK_POSITIONS) -> Column:
    """Where the pieces of ``seq`` begin; none when it is shorter than ``width``.

    An empty list, not a filter on the length: a filter would be pushed under the projection
    that cleans the text, and the cleaning would run twice per row.
    """
    return F.expr(
        f"""IF(length(seq) >= {width}, sequence(0, length(seq) - {width}, {positions}),
        CAST(array() AS ARRAY<INT>))"""
    )


def chunks(records: DataFrame, width: int, *, positions: int = CHUNK_POSITIONS) -> DataFrame:
    """``(record_id, offset, bases)``: pieces that overlap by ``width - 1`` symbols, dealt out.

    Every window of ``width`` symbols lies in exactly one piece. ``bases`` is binary:
    slicing binary is constant-time, slicing a string scans from its start. Each symbol moves
    once, and no task is left with a whole long record.
    """
    pieces = (
        records.select(
            "record_id",
            F.col("seq").cast("binary").alias("bases"),
            F.explode(piece_offsets(width, positions)).alias("offset"),
        )
        .select(
            "record_id",
            F.col("offset").cast("long").alias("offset"),
            F.expr(f"substring(bases, offset + 1, {positions + width - 1})").alias("bases"),
        )
    )
    return rebalance(pieces, "record_id", "offset")


def explode_kmers(records: DataFrame, k: int, *, positions: int = CHUNK_POSITIONS) -> DataFrame:
    """``(record_id, pos, kmer)`` for every position; records shorter than ``k`` give no rows.

    ``kmer`` stays binary, which hashes and compares like the string but needs no decoding.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    return (
        chunks(records, k, positions=positions)
        .select(
            "record_id",
            "offset",
            "bases",
            F.explode(F.expr(f"sequence(0, octet_length(bases) - {k})")).alias("step"),
        )
        .select(
            "record_id",
            (F.col("offset") + F.col("step")).alias("pos"),
            F.expr(f"substring(bases, step + 1, {k})").alias("kmer"),
        )
    )


def count_windows(text: bytes, k: int) -> tuple[np.ndarray, ...]:
    """Different windows of ``k`` bytes, how often, and where first and last."""
    return count_parts([(0, text)], k)


def count_parts(parts: list[tuple[int, bytes]], k: int) -> tuple[np.ndarray, ...]:
    """The same of a record in pieces with their offsets, which overlap by ``k - 1`` symbols."""
    parts = sorted((offset, text) for offset, text in parts if text and len(text) >= k)
    if not parts:
        return np.zeros((0, k), np.uint8), *(np.zeros(0, np.int64) for _ in range(3))
    views = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(t, np.uint8), k) for _, t in parts]
    windows = views[0] if len(views) == 1 else np.concatenate(views)
    at = np.concatenate([np.arange(o, o + len(v)) for (o, _), v in zip(parts, views, strict=True)])
    if (np.diff(at) < 0).any():  # pieces that overlap by more
        order = np.argsort(at, kind="stable")
        windows, at = windows[order], at[order]
    if k <= 8:  # as one number each, in the same order
        numbers = as_numbers(windows)
        _, first, group, counts = np.unique(
            numbers, return_index=True, return_inverse=True, return_counts=True
        )
    else:
        whole = np.ascontiguousarray(windows).view(f"V{k}").ravel()
        # hashes group equal windows; runs of one hash that differ are settled by the bytes
        mixed = np.zeros(len(windows), dtype=np.uint64)
        for i in range(k):
            mixed = (mixed ^ windows[:, i]) * np.uint64(0x100000001B3)
            mixed ^= mixed >> np.uint64(29)
        _, first, group, counts = np.unique(
            mixed, return_index=True, return_inverse=True, return_counts=True
        )
        if (whole[first][group] != whole).any():
            listed = np.ascontiguousarray(windows).view(f"S{k}").ravel()
            _, first, group, counts = np.unique(
                listed, return_index=True, return_inverse=True, return_counts=True
            )
    last = np.zeros(len(counts), dtype=np.int64)
    last[group] = np.arange(len(windows))  # of a repeated place the last value stays
    return np.ascontiguousarray(windows[first]), counts, at[first], at[last]


def as_numbers(windows: np.ndarray) -> np.ndarray:
    """Windows of up to 8 bytes as one number each, in the same order."""
    numbers = np.zeros(len(windows), dtype=np.uint64)
    for i in range(windows.shape[1]):
        numbers = (numbers << np.uint64(8)) | windows[:, i].astype(np.uint64)
    return numbers


def as_strings(windows: np.ndarray) -> pa.Array:
    """Windows, a row of bytes each, as Arrow strings."""
    number, k = windows.shape
    places = pa.py_buffer((np.arange(number + 1) * k).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.string(), number, [None, places, pa.py_buffer(windows.tobytes())])


def by_record(found: Callable, built: Callable, names: list[str]) -> Callable:
    """For ``mapInArrow`` over ``(record_id, cell, ...)``: rows of each record, in short batches.

    ``found`` gives a record's rows as numpy columns, ``built`` makes Arrow columns of many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = batch.column(0), [column.to_pylist() for column in batch.columns[1:]]
            rows, parts, held = [], [], 0

            def emit() -> pa.RecordBatch:
                columns = built(*(np.concatenate(column) for column in zip(*parts, strict=True)))
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate(rows))), *columns], ["record_id", *names]
                )

            for i, cell in enumerate(zip(*cells, strict=True)):
                columns = found(*cell)
                rows.append(np.full(len(columns[0]), i))
                parts.append(columns)
                held += len(columns[0])
                if held > 200_000:
                    yield emit()
                    rows, parts, held = [], [], 0
            if held:
                yield emit()

    return run


def _counter(k: int, found: Callable) -> Callable:
    def built(kmers: np.ndarray, *others: np.ndarray) -> list[pa.Array]:
        listed = pa.Array.from_buffers(pa.binary(k), len(kmers), [None, pa.py_buffer(kmers.tobytes())])
        return [listed.cast(pa.binary()), *map(pa.array, others)]

    return by_record(found, built, ["kmer", "occurrences", "first_pos", "last_pos"])


def _counted_schema(rows: DataFrame) -> str:
    kind = dict(rows.dtypes)["record_id"]
    return f"record_id {kind}, kmer binary, occurrences bigint, first_pos bigint, last_pos bigint"


def window_counts(records: DataFrame, k: int) -> DataFrame:
    """``(record_id, kmer BINARY, occurrences, first_pos, last_pos)``.

    A record that fits one task is counted there and is final: no position is shuffled. Pieces
    of longer ones are counted on their own, and only their sums meet.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    short, long = route(records)
    bases = F.col("seq").cast("binary").alias("bases")
    one = short.select("record_id", bases).mapInArrow(
        _counter(k, lambda text: count_windows(text, k)), _counted_schema(records)
    )
    return one.unionByName(piece_window_counts(chunks(long, k), k))


def piece_window_counts(pieces: DataFrame, k: int) -> DataFrame:
    """The same from pieces that overlap by ``k - 1`` symbols.

    Where pieces tell the size of their record (``size_bound``), those of a record that fits one
    task meet there, a byte a symbol, and are final; else the counts of each piece meet.
    """
    if "size_bound" not in pieces.columns:
        return _summed_counts(pieces, k)
    short, long = route(pieces)
    # at most the symbols of one short record, and what its pieces overlap
    whole = short.groupBy("record_id").agg(F.collect_list(F.struct("offset", "bases")).alias("parts"))
    one = whole.mapInArrow(
        _counter(k, lambda parts: count_parts([(p["offset"], p["bases"]) for p in parts], k)),
        _counted_schema(pieces),
    )
    return one.unionByName(_summed_counts(long, k))


def _summed_counts(pieces: DataFrame, k: int) -> DataFrame:
    return (
        pieces.select("record_id", "bases", "offset")
        .mapInArrow(
            _counter(k, lambda text, offset: count_parts([(offset, text)], k)), _counted_schema(pieces)
        )
        .groupBy("record_id", "kmer")
        .agg(
            F.sum("occurrences").alias("occurrences"),
            F.min("first_pos").alias("first_pos"),
            F.max("last_pos").alias("last_pos"),
        )
    )


def kmer_counts(records: DataFrame, k: int) -> DataFrame:
    """``(record_id, kmer, occurrences, first_pos)``."""
    return window_counts(records, k).select(
        "record_id", as_text("kmer").alias("kmer"), "occurrences", "first_pos"
    )


def as_text(column: str) -> Column:
    return F.col(column).cast("string")
