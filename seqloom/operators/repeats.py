"""Repeat discovery: the best earlier copy at each position, and the greedy selection.

Records up to ``LOCAL_BASES`` symbols are solved where they lie: one scan of one cell, no
shuffle. Longer records go through :mod:`seqloom.operators.long_repeats`, which spreads the
positions of one record over the cluster. Both give the same rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.formats import COPY_LIST
from seqloom.functions.matching import every_copy, greedy_copies
from seqloom.functions.slices import by_slices
from seqloom.operators import long_repeats
from seqloom.operators.kmers import LOCAL_RECORD, route
from seqloom.session import is_empty

# A Python worker keeps one index entry per position of the record it works on.
LOCAL_BASES = LOCAL_RECORD


def check_lengths(k: int, min_length: int) -> None:
    if k <= 0 or min_length < k:
        raise ValueError("copies are at least as long as their seed, and a seed has a symbol or more")


def split_by_length(records: DataFrame, local_bases: int) -> tuple[DataFrame, DataFrame | None]:
    """Records one task can hold, and the others (``None`` when there are none).

    Long records take iterations, each a job of its own, so whether there are any is asked first;
    ``size_bound`` answers that from a narrow column. Each record goes by its own size.
    """
    short, long = route(records, local_bases)
    return short, None if is_empty(long.select(F.lit(1))) else long


def _list_udf(search):
    kind = to_arrow_type(COPY_LIST)

    @F.arrow_udf(COPY_LIST)
    @by_slices
    def copies(seqs: pa.Array) -> pa.Array:
        found = [np.array(list(search(seq or "")), np.int64).reshape(-1, 3) for seq in seqs.to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        columns = np.concatenate(found).T if found else np.zeros((3, 0), np.int64)
        cells = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends), cells, type=kind)

    # keeps the optimizer from copying the call into the filters it derives from explode()
    return copies.asNondeterministic()


def with_copies(
    records: DataFrame,
    k: int = 15,
    min_length: int = 40,
    *,
    allow_overlap: bool = False,
    local_bases: int = LOCAL_BASES,
) -> DataFrame:
    """Records plus ``copies ARRAY<STRUCT<start, source, length>>`` in start order.

    ``allow_overlap`` reproduces the bare-seed overlap that exists only for
    ``min_length == k``. Such copies cannot be restored, so no codec asks for them.
    """
    check_lengths(k, min_length)
    short, long = split_by_length(records, local_bases)
    short = copies_in_place(short, k, min_length, allow_overlap)
    if long is None:
        return short
    return short.unionByName(copies_by_joins(long, k, min_length, allow_overlap))


def copies_in_place(
    records: DataFrame, k: int, min_length: int, allow_overlap: bool = False
) -> DataFrame:
    """:func:`with_copies` of records that fit one task each."""
    return records.withColumn(
        "copies", _list_udf(lambda seq: greedy_copies(seq, k, min_length, allow_overlap))("seq")
    )


def copies_by_joins(
    records: DataFrame, k: int, min_length: int, allow_overlap: bool = False
) -> DataFrame:
    """:func:`with_copies` of records of any length."""
    found = long_repeats.greedy_copies(records, k, min_length, allow_overlap=allow_overlap)
    # the list of one record is a fraction (at most 1/min_length) of its own cell
    lists = found.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "source", "length"))).alias("copies")
    )
    return long_repeats.merged(records, lists, ["record_id"], "left").withColumn(
        "copies", F.coalesce(F.col("copies"), F.array().cast(COPY_LIST))
    )


def graph_repeats(records: DataFrame, k: int = 15, min_length: int = 40, **options) -> DataFrame:
    """``(record_id, start, source, length)``: non-overlapping copies from earlier positions."""
    return (
        with_copies(records, k, min_length, **options)
        .select("record_id", F.explode("copies").alias("copy"))
        .select("record_id", "copy.start", "copy.source", "copy.length")
    )


def best_sources(
    records: DataFrame,
    k: int = 15,
    min_length: int = 40,
    *,
    allow_overlap: bool = False,
    local_bases: int = LOCAL_BASES,
) -> DataFrame:
    """``(record_id, start, source, length)`` for every position with a copy of ``min_length``."""
    check_lengths(k, min_length)
    local = _list_udf(lambda seq: every_copy(seq, k, min_length, allow_overlap))
    short, long = split_by_length(records, local_bases)
    rows = short.select("record_id", F.explode(local("seq")).alias("copy")).select(
        "record_id", "copy.start", "copy.source", "copy.length"
    )
    if long is None:
        return rows
    return rows.unionByName(
        long_repeats.best_copies(long, k, min_length, allow_overlap=allow_overlap)
    )


def spans(copies: str = "copies", length: str = "length(seq)") -> Column:
    """Ordered tiling of a record: copies and the gaps around them.

    ``ARRAY<STRUCT<start, length, source>>``; ``source`` is null for a gap.
    """
    def end(index: str) -> str:
        return f"{copies}[{index}].start + {copies}[{index}].length"

    tail = f"IF(size({copies}) = 0, 0L, {end(f'size({copies}) - 1')})"
    return F.expr(
        f"""filter(flatten(concat(
        transform({copies}, (c, i) -> array(
          named_struct('start', IF(i = 0, 0L, {end('i - 1')}),
                       'length', c.start - IF(i = 0, 0L, {end('i - 1')}),
                       'source', CAST(NULL AS BIGINT)),
          named_struct('start', c.start, 'length', c.length, 'source', c.source))),
        array(array(named_struct('start', {tail},
                                 'length', CAST({length} AS BIGINT) - {tail},
                                 'source', CAST(NULL AS BIGINT)))))), s -> s.length > 0)"""
    )
