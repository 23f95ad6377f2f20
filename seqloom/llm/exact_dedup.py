"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.

1. One scan gives an entry per row: 64-bit key of the normalised bytes, length, SHA-256.
2. Copies combine before the shuffle into one chain head per key, so no bucket holds more than
   one element per distinct key, however many copies a text has.
3. The directory has one cell per key prefix of the global depth. A bucket that holds more than
   its capacity splits by one more bit; the local depth of a cell is the first depth at which its
   prefix fits, which is what doubling step by step arrives at.
4. Owner tasks take ranges of buckets and write them, sorted by key, to the shared folder.
5. A row finds its bucket in the directory and its chain head within that bucket. Tasks take
   ``(bucket, key)``, and those of a hot key are split, as a bucket with it would fill one owner.
6. Bytes decide: every row of a key with several rows is compared with the head of its chain.
   Rows that differ (two texts with one 64-bit key) form the next link, until none is left.

Of equal texts the row with the most code points in its own text stays, then the smallest
``doc_id`` (a null one last). Null text counts as empty; rows that repeat a ``doc_id`` with one text
count each in ``group_size`` and carry the same flags. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import (
    BROADCAST_IDS,
    SPACE,
    cut_lineage,
    free_name,
    keep_ids,
    text_of,
    without_ids,
)

#: Chain heads a bucket holds before it splits.
CAPACITY = 50_000
#: The deepest directory, and how often one is doubled before its cells are counted anew.
ALL_BITS, DOUBLINGS = 63, 8


def body() -> Column:
    return F.regexp_replace(text_of(), SPACE, "")


def content_key(text: Column, key_bits: int = 64) -> Column:
    """64-bit key of the bytes; fewer bits only to provoke collisions in tests."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits) if key_bits < 64 else F.xxhash64(text)


def entries(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """One narrow row per document, written once."""
    rows = docs.select("doc_id", F.length(text_of()).alias("n_chars"), body().alias("body"))
    return cut_lineage(
        rows.select(
            "doc_id",
            "n_chars",
            content_key(F.col("body"), key_bits).alias("key"),
            F.sha2("body", 256).alias("text_sha256"),
        )
    )


def chain_heads(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the row that stays and the number of rows; combines in the map tasks."""
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("order")))
    return (
        rows.groupBy(*keys)
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(*keys, F.bitwise_not("best.order").alias("keep_id"), "group_size")
    )


def directory(heads: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``(cell, bucket)`` for every used cell, and the global depth.

    ``bucket`` is the first cell of the bucket's prefix, so buckets are ranges of keys in order.
    The directory starts at the depth that keys spread evenly would need and doubles while a cell
    is too full; at ``ALL_BITS`` no cell can hold more than two keys.
    """
    total = heads.count()
    depth = min(ALL_BITS, max(0, math.ceil(math.log2(max(1, total / capacity)))) + 2)
    while True:
        cells = heads.groupBy(cell_of(depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        if depth == ALL_BITS or cells.where(F.col("n") > capacity).isEmpty():
            break
        depth = min(ALL_BITS, depth + DOUBLINGS)
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {depth} - level)")
    )
    held = levels.groupBy("level", "prefix").agg(F.sum("n").alias("held"))
    fits = levels.join(held, ["level", "prefix"]).where(
        (F.col("held") <= capacity) | (F.col("level") == depth)
    )
    local = fits.groupBy("cell").agg(F.min("level").alias("level"))
    bucket = F.expr(f"shiftleft(shiftright(cell, {depth} - level), {depth} - level)")
    return local.select("cell", bucket.alias("bucket")), depth


def cell_of(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


class Index(NamedTuple):
    """Chain heads in bucket files, ``(bucket, key, keep_id, group_size)``, and their directory."""

    heads: DataFrame
    cells: DataFrame
    depth: int

    def located(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket of their ``key``; the directory goes to them within its bound."""
        cells = self.cells
        if cells.count() <= BROADCAST_IDS:
            cells = F.broadcast(cells)
        return rows.withColumn("cell", cell_of(self.depth)).join(cells, "cell").drop("cell")


def build_index(heads: DataFrame, capacity: int = CAPACITY) -> Index:
    """Owner tasks take ranges of buckets and write them sorted by key."""
    heads = cut_lineage(heads)
    cells, depth = directory(heads, capacity)
    index = Index(heads, cut_lineage(cells), depth)
    owned = index.located(heads).repartitionByRange("bucket").sortWithinPartitions("bucket", "key")
    return index._replace(heads=cut_lineage(owned))


def differing(docs: DataFrame, index: Index, key_bits: int = 64) -> list[DataFrame]:
    """Rows that share a key with other bytes, as ``(doc_id, key, link)``, one table per link.

    Only texts of keys with several rows travel, to meet the head of their chain; the list of
    those keys goes to the texts as far as its checked size allows.
    """
    wanted = index.heads.where("group_size > 1").select("key")
    bodies = docs.select("doc_id", F.length(text_of()).alias("n_chars"), body().alias("body"))
    bodies = bodies.withColumn("key", content_key(F.col("body"), key_bits))
    left = cut_lineage(index.located(keep_ids(bodies, wanted, "key", wanted.count())))
    links: list[DataFrame] = []
    heads = index.heads.select("bucket", "key", "keep_id")
    while True:
        first = (
            left.join(heads, ["bucket", "key"])
            .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .groupBy("bucket", "key")
            .agg(F.min("body").alias("head"))
        )
        # the head is one row per key: written, so that the join sees two plain sides
        first = cut_lineage(first)
        left = cut_lineage(left.join(first, ["bucket", "key"]).where("body <> head").drop("head"))
        if left.isEmpty():
            return links
        links.append(
            left.select("doc_id", "key", F.lit(len(links) + 1).alias("link"), "n_chars")
        )
        heads = chain_heads(left, "bucket", "key").select("bucket", "key", "keep_id")


def exact_groups(
    docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row."""
    return _groups(docs, capacity, key_bits).drop("key")


def _groups(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    rows = entries(docs, key_bits)
    index = build_index(chain_heads(rows, "key"), capacity)
    links = differing(docs, index, key_bits)
    if links:
        last = links[0]
        for later in links[1:]:
            last = last.unionByName(later)
        last = last.groupBy("doc_id", "key").agg(F.max("link").alias("link"))
        rows = rows.alias("r").join(
            last.alias("l"),
            F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.key") == F.col("l.key")),
            "left",
        ).select("r.*", F.coalesce("link", F.lit(0)).alias("link"))
        rows = cut_lineage(rows)
        chained = cut_lineage(chain_heads(rows, "key", "link"))
        joined = rows.join(chained, ["key", "link"])
    else:
        joined = index.located(rows).join(index.heads, ["bucket", "key"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "key",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one stays.

    Texts do not move: the list of rows to drop, by hashes of id and text, goes to them as far as
    its checked size allows.
    """
    mark, key = free_name(docs, "mark"), free_name(docs, "key")
    found = _groups(docs).select(F.xxhash64("doc_id").alias(mark), F.col("key").alias(key), "kept")
    found = cut_lineage(found)
    gone = cut_lineage(found.where("NOT kept").select(mark, key).distinct())
    again = cut_lineage(
        found.where("kept").groupBy(mark, key).count().where("count > 1").select(mark, key)
    )
    rows = docs.withColumn(mark, F.xxhash64("doc_id")).withColumn(key, content_key(body()))
    rows = without_ids(rows, gone, [mark, key], gone.count())
    if not again.isEmpty():  # rows that repeat an id and its text
        repeated = rows.join(again, [mark, key], "left_semi").dropDuplicates([mark, key])
        rows = rows.join(again, [mark, key], "left_anti").unionByName(repeated)
    return rows.select(*docs.columns)
