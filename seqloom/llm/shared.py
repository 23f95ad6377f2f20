"""What the operators of this package share: table access, text rules and bounded lookups."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import cut_lineage, scratch_folder

__all__ = ["SPACE", "cut_lineage", "free_name", "id_text", "keep_ids", "lowest", "scratch_folder", "table", "text_of", "tidy", "without_ids", "word_blocks"]

#: White space of the text contracts: space and the controls 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"
#: A list of ids up to this length (16 MB) goes to every executor; a longer one is joined by key.
BROADCAST_IDS = 1_000_000


def without_ids(rows: DataFrame, ids: DataFrame, names: list[str], count: int) -> DataFrame:
    """Rows whose ``names`` are not in ``ids`` (distinct), ``count`` of them."""
    if count <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, names, "left_anti")


def tidy(work: Callable) -> Callable:
    """``work`` over Arrow batches, which gives unused memory back when a task ends.

    Workers outlive their tasks, and an allocator that keeps the largest batch of each stage would
    count against the stages that follow: Arrow's pool, and the C library's heap with numpy's arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            gc.collect()
            trim(0)

    return run


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """``data`` in blocks of about ``size`` bytes that end between words."""
    begin = 0
    while begin < len(data):
        gap = _GAP.search(data, begin + size)
        end = gap.start() if gap else len(data)
        yield data[begin:end]
        begin = end


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``rows`` has it."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(column: str = "doc_id") -> Column:
    """An id as text, so that null ids are equal to one another in joins."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lowest(rows: DataFrame, key: str, place: Column, most: int) -> DataFrame:
    """At most ``most`` rows of each ``key``, those of the smallest ``place``, a uniform hash.

    How many rows a key has tells which hashes can be among the smallest, so a frequent key sends
    about twice as many rows as are kept, however many tasks it is spread over.
    """
    spread = rows.withColumn("_place", place)
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * most + 100) / F.col("_n"))
    edge = F.lit(float(-(2**63))) + share * float(2**64)
    near = spread.join(counts, F.col(key) == F.col("_key")).where(F.col("_place") <= edge)
    rank = F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY _place, {key})")
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_key", "_n", "_rank")


def keep_ids(rows: DataFrame, ids: DataFrame, name: str, count: int) -> DataFrame:
    """Rows whose ``name`` is in ``ids`` (one column ``name``, distinct), ``count`` of them."""
    if count <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, name, "left_semi")
