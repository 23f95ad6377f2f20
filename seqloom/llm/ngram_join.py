"""Exact n-gram Jaccard join by vertical partitioning.

A document is the set of its different word shingles. Two documents link when
``100 * |A n B| >= least * |A u B|``.

1. *Classes.* Equal sets combine before the shuffle; one document stands for each class.
2. *First cut.* In hash order, linked sets share ``l`` of their first ``d + l`` shingles, where ``d``
   is how many a partner may lack. Counting those shingles alone shows which sets have too few that
   any other set holds; they have no partner. Only the others go on.
3. *Global order.* Over what is left, shingles are ordered by how many sets hold them, rarest
   first, then by hash. Linked sets share one of their first ``d + 1``, so passages that many
   documents hold, which come last, bring no candidates.
4. *Candidates.* Sets that share a prefix shingle meet in its bucket. A linked pair passes, at
   the first shingle it shares, the bound on what can still be common from there on; no other
   pair is looked at. Each bucket first compares its members with one pivot, which is linear;
   links merge components. Then pairs of different components, one of them outside the pivot's,
   are compared where they pass the bound. Pairs within a group of near copies are not listed.
5. *Overlaps.* A set is cut into fragments of the global hash order. Each fragment of a pair is
   counted on its own, and the counts are summed per pair: no task needs a whole long document.
6. *Components* by hooking to the smallest neighbour and pointer jumping, cut with written tables.

Null and empty texts have an empty set and link with nothing. Rows are compared by their texts, also
where they repeat a ``doc_id``. Null ids take part; a component of nothing else has a null id. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import BROADCAST_IDS, cut_lineage, free_name, id_text, keep_ids, tidy, without_ids, word_blocks

WORDS = 4
LEAST = 85
#: Share of a set (in percent) by which the first cut looks further than one common shingle.
DEEPER = 5
FRAGMENTS = 8

_A, _B, _C, _D = (
    np.uint64(x)
    for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; A-Z are lower-cased, nothing else."""
    data = (text or "").encode("utf-8", "replace").lower()
    parts = []
    for block in word_blocks(data):
        split = block.split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split)))
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    number = len(hashes) - size + 1
    mixed = np.full(number, np.uint64(size), np.uint64)
    for k in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _A
        mixed = (mixed ^ hashes[k : k + number]) * _B
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _C
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def lacking(size: np.ndarray, least: int) -> np.ndarray:
    """Most shingles of a set of ``size`` that a linked set may lack."""
    return size - -(-least * size // 100)


def depth(size: np.ndarray) -> np.ndarray:
    return np.maximum(1, DEEPER * size // 100)


def _sets(rows: DataFrame, id_type: str, words: int, least: int) -> DataFrame:
    """``doc_id, n, digest, head``: size, 128-bit digest and first shingles in hash order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                sets = [shingle_set(t.as_py(), words) for t in batch.column(1).slice(at, 1024)]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                heads = lacking(sizes, least) + depth(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 1024),
                        pa.array(sizes),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([s[:h].view(np.int64) for s, h in zip(sets, heads, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "digest", "head"],
                )

    return rows.mapInArrow(
        tidy(build), f"doc_id {id_type}, n bigint, digest binary, head array<bigint>"
    )


def _fragments(rows: DataFrame, words: int) -> DataFrame:
    """``digest, fragment, part``: sorted shingles of each set, cut at fixed places of the order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                digests, number, parts = [], [], []
                for text in batch.column(0).slice(at, 256):
                    held = shingle_set(text.as_py(), words)
                    digest = xxhash.xxh3_128_digest(held.tobytes())
                    for f, part in enumerate(np.split(held, np.searchsorted(held, edges))):
                        if len(part):
                            digests.append(digest)
                            number.append(f)
                            parts.append(part.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digests, pa.binary()),
                        pa.array(number, pa.int32()),
                        pa.array(parts, pa.binary()),
                    ],
                    ["digest", "fragment", "part"],
                )

    return rows.mapInArrow(tidy(build), "digest binary, fragment int, part binary")


def _unpacked(fragments: DataFrame) -> DataFrame:
    """``rep, shingle`` of every fragment."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lengths = pc.divide(pc.binary_length(part.column(1)), 8).to_numpy()
                hashes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                owners = np.repeat(part.column(0).to_numpy(), lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners), pa.array(hashes)], ["rep", "shingle"]
                )

    return fragments.select("rep", "part").mapInArrow(tidy(unpack), "rep bigint, shingle bigint")


def _left_after_first_cut(base: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Classes that have enough first shingles another set holds as well."""
    heads = base.groupBy("digest").agg(F.min("row").alias("rep"), F.first("head").alias("head"))
    alone = (
        heads.select("rep", F.explode("head").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("rep").alias("rep"))
        .where("holders = 1")
        .groupBy("rep")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    smallest = f"({least} * n + 99) DIV 100"
    seen = F.expr(f"n - {smallest} + greatest(1L, {DEEPER} * n DIV 100)")
    needed = F.expr(f"greatest(1L, {DEEPER} * ({smallest}) DIV 100)")
    return (
        classes.join(alone, "rep", "left")
        .where(F.least(seen, "n") - F.coalesce("alone", F.lit(0)) >= needed)
        .drop("alone")
    )


def _prefixes(fragments: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """``shingle, rep, n, reach`` of the first shingles, rarest first, that several sets hold.

    ``reach`` counts the shingles of the set from this one on: what it can have in common with a
    set that it meets here first.
    """
    listed = _unpacked(fragments)
    counted = listed.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("holders"), F.min("rep").alias("rep")
    )
    counted = cut_lineage(counted)
    alone = counted.where("holders = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    allowed = F.expr(f"n - ({least} * n + 99) DIV 100")
    # shingles of one set come first in the order: where they fill the prefix, nothing is left
    open_ = cut_lineage(
        sizes.join(alone, "rep", "left")
        .withColumn("alone", F.coalesce("alone", F.lit(0)))
        .select("rep", "n", "alone", (allowed + 1 - F.col("alone")).alias("room"))
        .where("room > 0")
    )
    shared = counted.where("holders > 1").select("shingle", "holders")
    rows = keep_ids(fragments, open_.select("rep"), "rep", open_.count())
    # both sides are plain, so a shingle that very many sets hold is split over tasks
    met = _unpacked(rows).join(shared, "shingle").join(open_, "rep")
    return (
        met.withColumn("place", F.expr("row_number() OVER (PARTITION BY rep ORDER BY holders, shingle)"))
        .where("place <= room")
        .select("shingle", "rep", "n", (F.col("n") - F.col("alone") - F.col("place") + 1).alias("reach"))
    )


def _overlaps(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """``a, b, both``: the fragments' overlaps, summed per pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                len(
                    np.intersect1d(
                        np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True
                    )
                )
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(both, pa.int64())], ["a", "b", "part"]
            )

    left = fragments.select(F.col("rep").alias("a"), "fragment", F.col("part").alias("left"))
    right = fragments.select(F.col("rep").alias("b"), "fragment", F.col("part").alias("right"))
    met = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
    parts = met.select("a", "b", "left", "right").mapInArrow(tidy(count), "a bigint, b bigint, part bigint")
    return parts.groupBy("a", "b").agg(F.sum("part").alias("both"))


def _compared(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """``a, b, na, nb, both`` of distinct pairs."""
    pairs = cut_lineage(pairs)
    counted = _overlaps(pairs, fragments)
    return cut_lineage(
        pairs.join(counted, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    )


def components(links: DataFrame) -> DataFrame:
    """``rep, label`` with the smallest node of each component, for the nodes that have links.

    Each round every node takes the smallest label around it and then its label's label.
    """
    edges = cut_lineage(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(
        edges.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("rep"), F.least("a", "low").alias("label")
        )
    )
    while True:
        around = (
            edges.join(labels, edges["b"] == labels["rep"])
            .groupBy("a")
            .agg(F.min("label").alias("low"))
        )
        hooked = labels.join(around, labels["rep"] == around["a"], "left").select(
            "rep", "label", F.least("label", F.coalesce("low", "label")).alias("next")
        )
        hooked = cut_lineage(hooked)
        jump = hooked.select(F.col("rep").alias("next"), F.col("next").alias("far"))
        moved = cut_lineage(
            hooked.join(jump, "next", "left").select(
                "rep", "label", F.least("next", F.coalesce("far", "next")).alias("next")
            )
        )
        changed = moved.where("next <> label").limit(1).count()
        labels = moved.select("rep", F.col("next").alias("label"))
        if not changed:
            return labels


def linked(pairs: DataFrame, least: int) -> DataFrame:
    return pairs.where(100 * F.col("both") >= least * (F.col("na") + F.col("nb") - F.col("both")))


def class_links(prefixes: DataFrame, fragments: DataFrame, least: int) -> DataFrame:
    """``a, b``: links between classes, at least enough of them to give every component."""

    def fits(n: str, reach: str, other: str, other_reach: str) -> Column:
        size = 100 * F.least(n, other) >= least * F.greatest(n, other)
        common = (100 + least) * F.least(reach, other_reach) >= least * (F.col(n) + F.col(other))
        return size & common

    def in_order(pairs: DataFrame) -> DataFrame:
        first = F.col("rep") < F.col("rep2")
        swapped = [F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("rep", "rep2"), ("rep2", "rep"), ("n", "n2"), ("n2", "n"))]
        return pairs.select(*(c.alias(k) for c, k in zip(swapped, ("a", "b", "na", "nb"), strict=True))).distinct()

    best = F.max(F.struct((F.col("reach") / F.col("n")).alias("share"), F.bitwise_not("rep").alias("order"), "n", "reach"))
    pivots = (
        prefixes.groupBy("shingle")
        .agg(best.alias("p"), F.count(F.lit(1)).alias("members"), F.max("reach").alias("top"), F.min("n").alias("low"))
        .where("members > 1")
        .select("shingle", F.bitwise_not("p.order").alias("rep2"), F.col("p.n").alias("n2"), F.col("p.reach").alias("reach2"), "top", "low")
    )
    pivots = cut_lineage(pivots)
    # what no member of the bucket can be near enough to does not go on
    smallest = F.greatest(F.col("low"), F.expr(f"({least} * n + 99) DIV 100"))
    able = (100 + least) * F.least("reach", "top") >= least * (F.col("n") + smallest)
    met = cut_lineage(prefixes.join(pivots, "shingle").where(able))
    star = in_order(met.where("rep <> rep2").where(fits("n", "reach", "n2", "reach2")))
    star = _compared(star, fragments)
    first = linked(star, least)
    labels = components(first)
    homes = labels.select(F.col("rep").alias("rep2"), F.col("label").alias("home"))
    members = (
        met.select("shingle", "rep", "n", "reach", "rep2")
        .join(labels, "rep", "left")
        .join(homes, "rep2", "left")
        .select("shingle", "rep", "n", "reach", F.coalesce("label", "rep").alias("label"), F.coalesce("home", "rep2").alias("home"))
    )
    members = cut_lineage(members)
    # pairs within the pivot's component have nothing left to say: one side is outside it
    outside = members.where("label <> home").select(
        "shingle", F.col("rep").alias("rep2"), F.col("n").alias("n2"),
        F.col("reach").alias("reach2"), F.col("label").alias("label2"),
    )
    rest = members.join(outside, "shingle").where("label <> label2").where(fits("n", "reach", "n2", "reach2"))
    rest = in_order(rest).join(star.select("a", "b"), ["a", "b"], "left_anti")
    second = linked(_compared(rest, fragments), least)
    return first.select("a", "b").unionByName(second.select("a", "b"))


def near_copies(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_size``, one row per input row.

    A class goes by the number its first row got when the sets were written.
    """
    rows = docs.select("doc_id", "text")
    sets = _sets(rows, dict(rows.dtypes)["doc_id"], words, least)
    base = cut_lineage(sets.withColumn("row", F.monotonically_increasing_id()))
    full = base.where("n > 0")
    classes = full.groupBy("digest").agg(
        F.min("row").alias("rep"),
        F.first("n").alias("n"),
        F.min("doc_id").alias("doc_id"),
        F.min_by(F.xxhash64("doc_id"), "row").alias("key"),
        F.count(F.lit(1)).alias("class_size"),
    )
    classes = cut_lineage(classes)
    left = cut_lineage(_left_after_first_cut(full, classes, least))
    number = left.count()
    # texts by a key of their id, then by digest: repeated or null ids bring no other set in
    texts = docs.select("text", F.xxhash64("doc_id").alias("key"))
    texts = keep_ids(texts, left.select("key").distinct(), "key", number).select("text")
    named = left.select("digest", "rep")
    named = F.broadcast(named) if number <= BROADCAST_IDS // 4 else named
    fragments = (
        _fragments(texts, words)
        .join(named, "digest")
        .groupBy("rep", "fragment")
        .agg(F.first("part").alias("part"))
    )
    fragments = cut_lineage(fragments)
    prefixes = cut_lineage(_prefixes(fragments, left.select("rep", "n"), least))
    labels = components(class_links(prefixes, fragments, least))
    joined = classes.join(labels, "rep", "left").withColumn(
        "label", F.coalesce("label", "rep")
    )
    joined = cut_lineage(joined.select("digest", "label", "doc_id", "class_size"))
    smallest = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = cut_lineage(joined.join(smallest, "label").select("digest", "component_id", "class_size"))
    some = full.select("doc_id", "n", "digest").join(named, "digest")
    none = base.where("n = 0").select(
        "doc_id",
        "n",
        F.col("doc_id").alias("component_id"),
        F.lit(1).cast("bigint").alias("class_size"),
    )
    return (
        some.select("doc_id", "n", "component_id", "class_size")
        .unionByName(none)
        .withColumnRenamed("n", "n_shingles")
    )


def one_of_each(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The rows, with all their columns, of one document of each component: the smallest id.

    Documents without words stay. Rows that repeat an id with one text count as one document.
    """
    found = near_copies(docs, words, least)
    name = free_name(docs, "id")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)
    gone = (
        found.groupBy(id_text().alias(name)).agg(F.max(stays).alias("_stays")).where("NOT _stays")
    )
    gone = cut_lineage(gone.select(name))
    # texts do not move: the list of ids that go is sent to them as far as its checked size allows
    rows = without_ids(docs.withColumn(name, id_text()), gone, [name], 4 * gone.count())
    return rows.select(*docs.columns)
