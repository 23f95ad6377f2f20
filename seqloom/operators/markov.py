"""Order-n symbol models: fit, score and per-residual code length."""

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.formats import ALPHABET
from seqloom.functions.context_bits import (
    MAX_ORDER,
    UNITS,
    context_text,
    following_counts,
    following_counts_of_all,
    gap_bits,
    unit_bits,
)
from seqloom.functions.slices import by_slices
from seqloom.operators.kmers import CHUNK_POSITIONS, piece_offsets, route
from seqloom.session import rebalance


def check_order(order: int, pseudocount: float) -> None:
    if order <= 0:
        raise ValueError("a model needs an order above zero")
    if pseudocount <= 0:
        raise ValueError("a model needs a pseudocount above zero")


def checked_alphabet(records: DataFrame, column: str = "seq") -> DataFrame:
    """Fail on symbols outside the model's alphabet."""
    return records.withColumn(
        column,
        F.when(F.col(column).rlike(f"^[{ALPHABET}]*$"), F.col(column)).otherwise(
            F.raise_error(
                F.concat(
                    F.lit("symbols outside the model's alphabet: "),
                    F.array_join(
                        F.array_sort(
                            F.array_distinct(F.split(F.translate(column, ALPHABET, ""), ""))
                        ),
                        "",
                    ),
                )
            )
        ),
    )


def _exploded_counts(sequences: DataFrame, keys: list[str], order: int) -> DataFrame:
    """:func:`context_counts` for orders whose contexts do not fit one number: a row a position."""
    pieces = sequences.select(
        *keys,
        F.col("seq").cast("binary").alias("bases"),
        F.explode(piece_offsets(1)).alias("offset"),
    ).select(
        *keys,
        F.expr(f"least({order}, offset)").alias("lead"),
        F.expr(
            f"""substring(bases, offset - least({order}, offset) + 1,
            {CHUNK_POSITIONS} + least({order}, offset))"""
        ).alias("bases"),
    )
    return (
        pieces.select(
            *keys,
            "bases",
            F.explode(F.expr("sequence(lead, octet_length(bases) - 1)")).alias("at"),
        )
        .select(
            *keys,
            F.expr(f"substring(bases, at - least({order}, at) + 1, least({order}, at))").alias(
                "ctx"
            ),
            F.expr("substring(bases, at + 1, 1)").alias("sym"),
        )
        .groupBy(*keys, "ctx")
        .agg(*[F.count_if(F.col("sym") == F.lit(s.encode())).alias(s) for s in ALPHABET])
        .select(
            *keys, F.col("ctx").cast("string").alias("ctx"), F.array(*ALPHABET).alias("counts")
        )
    )


def _runs(texts: list[bytes | None], leads: list[int], size: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Texts with their leads in runs of about ``size`` symbols."""
    some: list[bytes] = []
    before: list[int] = []
    held = 0
    for text, lead in zip(texts, leads, strict=True):
        some.append(text or b"")
        before.append(lead)
        held += len(some[-1])
        if held >= size:
            yield some, before
            some, before, held = [], [], 0
    if some:
        yield some, before


def _counter(order: int, keys: list[str], fields: str, with_lead: bool):
    """Counts every row's contexts; without ``keys``, those of a batch together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("bases").to_pylist()
            leads = batch.column("lead").to_pylist() if with_lead else [0] * len(texts)
            rows, contexts, counts = [], [], []
            for i, (text, lead) in enumerate(zip(texts, leads, strict=True) if keys else ()):
                found, times = following_counts(text or b"", order, lead)
                rows.append(np.full(len(found), i))
                contexts.append(found)
                counts.append(times)
            for some, before in _runs(texts, leads) if not keys else ():
                found, times = following_counts_of_all(some, order, before)
                contexts.append(found)
                counts.append(times)
            if not texts:
                continue
            context, times = np.concatenate(contexts), np.concatenate(counts)
            if not keys:
                context, place = np.unique(context, return_inverse=True)
                summed = np.zeros((len(context), len(ALPHABET)), dtype=np.int64)
                np.add.at(summed, place, times)
                times = summed
            names = pa.array([context_text(int(c), order) for c in context], pa.string())
            ends = pa.array(np.arange(len(context) + 1, dtype=np.int32) * len(ALPHABET))
            lists = pa.ListArray.from_arrays(ends, pa.array(times.reshape(-1), pa.int64()))
            at = pa.array(np.concatenate(rows)) if keys else None
            columns = [batch.column(key).take(at) for key in keys]
            yield pa.RecordBatch.from_arrays([*columns, names, lists], [*keys, "ctx", "counts"])

    return count


def context_counts(sequences: DataFrame, keys: list[str], order: int) -> DataFrame:
    """``(*keys, ctx, counts)``: what follows each context, counted in alphabet order.

    A context is the up to ``order`` symbols before a position. Texts that fit one task are
    counted there, and where ``keys`` name one text each that is final. Pieces of longer texts
    begin ``lead`` symbols early, which leaves every position its full context; their counts,
    and those of all texts where there are no keys, are summed by context.
    """
    if order > MAX_ORDER:
        return _exploded_counts(sequences, keys, order)
    kinds = dict(sequences.dtypes)
    schema = "".join(f"{key} {kinds[key]}, " for key in keys) + "ctx string, counts array<bigint>"
    short, long = route(sequences)
    bases = F.col("seq").cast("binary").alias("bases")
    one = short.select(*keys, bases).mapInArrow(_counter(order, keys, schema, False), schema)
    offset = F.explode(piece_offsets(1)).alias("offset")
    pieces = rebalance(
        long.select(*keys, bases, offset).select(
            *keys,
            F.expr(
                f"""substring(bases, offset - least({order}, offset) + 1,
                {CHUNK_POSITIONS} + least({order}, offset))"""
            ).alias("bases"),
            F.expr(f"least({order}, offset)").alias("lead"),
            "offset",
        ),
        *keys,
        "offset",
    ).drop("offset")
    many = pieces.mapInArrow(_counter(order, keys, schema, True), schema)

    def summed(rows: DataFrame) -> DataFrame:
        sums = [F.sum(F.col("counts")[i]).alias(s) for i, s in enumerate(ALPHABET)]
        return rows.groupBy(*keys, "ctx").agg(*sums).select(
            *keys, "ctx", F.array(*ALPHABET).alias("counts")
        )

    return one.unionByName(summed(many)) if keys else summed(one.unionByName(many))


def fit(records: DataFrame, order: int = 3, pseudocount: float = 1.0) -> DataFrame:
    """``(record_id, ctx, counts)``; :func:`count_rows` lists it by symbol."""
    check_order(order, pseudocount)
    return context_counts(checked_alphabet(records), ["record_id"], order)


def count_rows(model: DataFrame) -> DataFrame:
    """``(record_id, ctx, sym, n)`` for the pairs that occur."""
    return (
        model.select("record_id", "ctx", F.posexplode("counts").alias("place", "n"))
        .where(F.col("n") > 0)
        .select(
            "record_id",
            "ctx",
            F.substring(F.lit(ALPHABET), F.col("place") + 1, F.lit(1)).alias("sym"),
            "n",
        )
    )


def gap_bits_column(order: int = 3, pseudocount: float = 1.0):
    """UDF ``(seq, starts, lengths, sources) -> ARRAY<DOUBLE>``: :func:`score` for gaps of one record.

    Spans with a source are copies and get null.
    Model and gaps lie in the same cell, so nothing is exploded or shuffled. For records that
    fit one task; :func:`score` has no such limit.
    """
    check_order(order, pseudocount)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    @by_slices
    def bits(seqs: pa.Array, starts: pa.Array, lengths: pa.Array, sources: pa.Array) -> pa.Array:
        cells = []
        for seq, *spans in zip(*(c.to_pylist() for c in (seqs, starts, lengths, sources)), strict=True):
            spans = list(zip(*spans, strict=True))
            gaps = [(start, length) for start, length, source in spans if source is None]
            scored = iter(gap_bits(seq or "", gaps, order, pseudocount))
            cells.append([next(scored) if source is None else None for _, _, source in spans])
        return pa.array(cells, type=pa.list_(pa.float64()))

    return bits.asNondeterministic()


def record_bits(records: DataFrame, order: int = 3, pseudocount: float = 1.0) -> DataFrame:
    """``(record_id, bits)``: code length of each whole record under its own model; 0 if empty."""
    check_order(order, pseudocount)
    if order > MAX_ORDER:
        short, long = records.limit(0), records
    else:
        short, long = route(records)
    ends = F.expr("IF(length(seq) = 0, array(), array(CAST(length(seq) AS BIGINT)))")
    starts = F.expr("IF(length(seq) = 0, array(), array(0L))")
    nothing = F.expr("IF(length(seq) = 0, array(), array(CAST(NULL AS BIGINT)))").cast("array<bigint>")
    cell = gap_bits_column(order, pseudocount)(
        "seq", starts.cast("array<bigint>"), ends.cast("array<bigint>"), nothing
    )
    one = short.select("record_id", F.coalesce(F.get(cell, F.lit(0)), F.lit(0.0)).alias("bits"))
    whole = long.select("record_id", F.lit(0).cast("long").alias("start"), "seq")
    scored = score(fit(long, order, pseudocount), whole, order, pseudocount).drop("start")
    many = long.select("record_id").join(scored, "record_id", "left")
    return one.unionByName(many.select("record_id", F.coalesce("bits", F.lit(0.0)).alias("bits")))


def score(
    model: DataFrame,
    fragments: DataFrame,
    order: int = 3,
    pseudocount: float = 1.0,
    *,
    fragment_key: str = "start",
) -> DataFrame:
    """``(record_id, <fragment_key>, bits)`` for ``fragments(record_id, <fragment_key>, seq)``.

    Contexts restart at the beginning of every fragment. Fragments are counted by context before
    the join, so a fragment sends at most one row per distinct context however long it is.
    Unseen contexts cost log2 of the alphabet size.
    """
    check_order(order, pseudocount)
    used = context_counts(
        checked_alphabet(fragments), ["record_id", fragment_key], order
    ).withColumnRenamed("counts", "times")
    known = F.coalesce("counts", F.expr(f"array_repeat(0L, {len(ALPHABET)})"))
    # whole numbers: the sum is the same in any order, and in one task or many
    bits = """aggregate(zip_with(times, units, (used, u) -> CAST(used AS DECIMAL(19, 0)) *
        CAST(u AS DECIMAL(19, 0))), CAST(0 AS DECIMAL(38, 0)), (t, b) -> CAST(t + b AS DECIMAL(38, 0)))"""
    return (
        used.join(model, ["record_id", "ctx"], "left")
        .withColumn("units", _symbol_units(pseudocount)(known))
        .groupBy("record_id", fragment_key)
        .agg(F.sum(F.expr(bits)).alias("units"))
        .select(
            "record_id",
            fragment_key,
            (F.col("units").cast("double") / F.lit(float(UNITS))).alias("bits"),
        )
    )


def _symbol_units(pseudocount: float):
    """Code length in units of each symbol after a context with these counts."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def units(lists: pa.Array) -> pa.Array:
        counts = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(ALPHABET))
        total = counts.sum(axis=1, keepdims=True) + pseudocount * len(ALPHABET)
        ends = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * len(ALPHABET))
        cells = unit_bits(counts + pseudocount, total)
        return pa.ListArray.from_arrays(ends, pa.array(cells.reshape(-1)))

    return units.asNondeterministic()


class Scorer(Protocol):
    """Anything that learns from records and gives code lengths of fragments of them."""

    def fit(self, records: DataFrame) -> "Scorer": ...

    def bits(self, fragments: DataFrame, fragment_key: str = "start") -> DataFrame: ...


@dataclass
class MarkovScorer:
    """:class:`Scorer` of an order-n model per record; fitting again forgets the last fit."""

    order: int = 3
    pseudocount: float = 1.0
    model: DataFrame | None = None

    def __post_init__(self) -> None:
        check_order(self.order, self.pseudocount)

    def fit(self, records: DataFrame) -> "MarkovScorer":
        self.model = fit(records, self.order, self.pseudocount)
        return self

    def bits(self, fragments: DataFrame, fragment_key: str = "start") -> DataFrame:
        if self.model is None:
            raise ValueError("fit the scorer first")
        return score(
            self.model, fragments, self.order, self.pseudocount, fragment_key=fragment_key
        )
