"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources, in code point order with null last, weigh 1, 2, 3, 1, ... and share 100 % of all words;
no target exceeds three times its source's words, and the excess goes to the others by weight.

1. Every document falls into one of its source's blocks by a hash, so blocks are disjoint and
   permuted. Blocks per source are fixed in number, so their table does not grow with the corpus.
2. A source takes all its blocks as often as the target holds the source whole, and then blocks
   in their order while they fit: its exact quota. One more block is opened into parts by a
   second hash, and the last part into documents, each the longest that still fits.
3. The tree of output shards is split top down. Each node's quotas per source are divided by one
   multivariate hypergeometric draw, so each shard gets an exact number of blocks of each source
   in proportion, and every block copy lands in one shard.
4. A shard orders its documents by a keyed hash.

Every draw is keyed by ``seed`` and the node, so reruns agree. A null text has 0 words. Repeated
rows are documents of their own. A source without words has target 0. Empty table: empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import BROADCAST_IDS, cut_lineage, free_name, text_of

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Blocks a source is cut into; the precision of a quota before the edge block is opened.
BLOCKS = 1024
SHARDS = 64


def words_of(column: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text_of(column), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> dict:
    """Target words per source: shares by weight, held to ``most`` times each source's size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    left, open_, result = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[name] for name in open_)
        over = [n for n in names if n in open_ and left * weight[n] / total > most * sizes[n]]
        if not over:
            return result | {n: left * weight[n] / total for n in open_}
        for name in over:
            result[name] = float(most * sizes[name])
            open_.discard(name)
        left -= sum(result[name] for name in over)
    return result


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard, ``(shards, sources)``; columns sum to ``quotas``."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(low: int, high: int, held: np.ndarray) -> None:
        if high - low == 1:
            out[low] = held
            return
        middle = (low + high) // 2
        total = int(held.sum())
        share = total * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, low, high])
        left = (
            draw.multivariate_hypergeometric(held, share, method="marginals")
            if total
            else np.zeros_like(held)
        )
        split(low, middle, left)
        split(middle, high, held - left)

    if len(quotas):
        split(0, shards, quotas.astype(np.int64))
    return out


def draw_of(seed: int) -> Column:
    """The hash that places a row; rows without an id are spread by their text."""
    return F.when(
        F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "source", "text")
    ).otherwise(F.xxhash64(F.lit(seed), "doc_id", "source"))


def place_of(shard: Column, draw: Column, copy: Column) -> Column:
    """Key of a copy's position within its shard."""
    return F.xxhash64(shard, draw, copy)


def sized(docs: DataFrame, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, source, size, draw, block, fine``, written once; texts are not read again."""
    rows = docs.select(
        "doc_id", "source", words_of().alias("size"), draw_of(seed).alias("draw")
    )
    return cut_lineage(
        rows
        .withColumn("block", F.pmod("draw", F.lit(blocks)))
        .withColumn("fine", F.pmod(F.xxhash64("draw"), F.lit(blocks)))
    )


def _fill(
    words: dict[int, int], rest: float, again: int, goal: float
) -> tuple[Counter, int | None, float]:
    """Copies of blocks taken in their order while they fit, the shortest block left over, words
    missing. Where those are over 1 % of the goal, blocks are taken up to ``again`` times."""
    taken = []
    for block in sorted(words):
        if words[block] <= rest:
            rest -= words[block]
            taken.append(block)
    for _ in range(3):  # exchange one block for another where that comes closer
        out = sorted(set(words).difference(taken))
        if not (taken and out):
            break
        more = np.array([words[b] for b in out]) - np.array([[words[b]] for b in taken])
        more = np.where((more > 0) & (more <= rest), more, 0)
        i, k = np.unravel_index(more.argmax(), more.shape)
        if not more[i, k]:
            break
        rest -= int(more[i, k])
        taken[i] = out[k]
    left = sorted(set(words).difference(taken), key=lambda b: (words[b], b))
    copies = Counter(taken)
    for _ in range(again - 1):
        for block in sorted(copies, key=lambda b: (-words[b], b)):
            if 0 < words[block] <= rest and rest > goal / 100:
                rest -= words[block]
                copies[block] += 1
    return copies, left[0] if left else None, rest


def _summed(rows: DataFrame, cell: str) -> DataFrame:
    return rows.groupBy("source", F.col(cell).cast("long").alias("cell")).agg(
        F.sum("size").alias("words")
    )


FILLED = "source string, cell long, kind int, copies int, edge boolean, rest double"


def _filled(cells: DataFrame, goals: DataFrame, kind: int) -> DataFrame:
    """Copies of each cell of a source, a group being the at most ``BLOCKS`` cells of one source.

    ``rest`` is what the source misses after this; ``edge`` marks the cell that is opened for it.
    """

    def fill(held: pa.Table) -> pa.Table:
        held = held.sort_by("cell")
        words = dict(zip(held["cell"].to_pylist(), held["words"].to_pylist(), strict=True))
        whole, goal = held["whole"][0].as_py(), held["target"][0].as_py()
        more, edge, rest = _fill(words, held["missing"][0].as_py(), MOST_REPEATS - whole, goal)
        n = len(words)
        return pa.table(
            {
                "source": held["source"],
                "cell": held["cell"],
                "kind": pa.array([kind] * n, pa.int32()),
                "copies": pa.array([whole + more[c] for c in words], pa.int32()),
                "edge": pa.array([c == edge for c in words], pa.bool_()),
                "rest": pa.array([rest] * n, pa.float64()),
            }
        )

    same = F.col("c.source").eqNullSafe(F.col("g.source"))
    joined = cells.alias("c").join(goals.alias("g"), same).select("c.*", "whole", "target", "missing")
    return cut_lineage(joined.groupBy("source").applyInArrow(fill, FILLED))


def _dealt(cells: DataFrame, quotas: DataFrame) -> DataFrame:
    """The shard of each copy: a source's quota per shard runs over first copies, then second ones."""

    def deal(held: pa.Table) -> pa.Table:
        held = held.sort_by("cell")
        copies = held["copies"].to_numpy()
        quota = np.array(held["quota"][0].as_py(), dtype=np.int64)
        shard_of, at = np.repeat(np.arange(len(quota)), quota), 0
        given: list[list[int]] = [[] for _ in copies]
        for copy in range(MOST_REPEATS):
            for k in np.flatnonzero(copies > copy).tolist():
                given[k].append(int(shard_of[at]))
                at += 1
        return held.drop_columns(["quota", "copies"]).append_column(
            "shards", pa.array(given, pa.list_(pa.int32()))
        )

    same = F.col("c.source").eqNullSafe(F.col("q.source")) & (F.col("c.kind") == F.col("q.kind"))
    joined = cells.alias("c").join(quotas.alias("q"), same).select("c.*", "quota")
    schema = (
        "source string, cell long, kind int, source_size long, target double, rest double, "
        "shards array<int>"
    )
    return joined.groupBy("source", "kind").applyInArrow(deal, schema).drop("kind")


def block_plan(rows: DataFrame, seed: int, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Per source its edge block; per source and cell the shards of its copies.

    A cell is a block or, at ``blocks + fine`` and above, a part of the edge block. ``rest`` is
    set where documents decide: what the last part of the edge block still has to give. The driver
    sees a row or two per source, for the targets and the tree; cells stay in tables.
    """
    spark = rows.sparkSession
    cells = cut_lineage(_summed(rows, "block"))
    sizes = {
        r["source"]: r["size"]
        for r in cells.groupBy("source").agg(F.sum("words").alias("size")).collect()
    }
    goals = targets(sizes)
    whole = {n: min(int(goals[n] // s), MOST_REPEATS) if s else 0 for n, s in sizes.items()}
    missing = {
        n: goals[n] - whole[n] * s if whole[n] < MOST_REPEATS else 0.0 for n, s in sizes.items()
    }
    wanted = cut_lineage(
        spark.createDataFrame(
            [(n, sizes[n], goals[n], whole[n], missing[n]) for n in sizes],
            "source string, source_size long, target double, whole int, missing double",
        )
    )
    filled = _filled(cells, wanted, 0)
    edges = cut_lineage(filled.groupBy("source").agg(F.max(F.when(F.col("edge"), F.col("cell"))).alias("edge")))
    still = filled.groupBy("source").agg(F.max("rest").alias("missing")).alias("f")
    still = wanted.drop("missing").alias("w").join(
        still, F.col("w.source").eqNullSafe(F.col("f.source"))
    ).select("w.*", "f.missing")
    parts = _summed(_with_cells(rows, edges, blocks).where(F.col("cell") >= blocks), "fine")
    opened = _filled(parts, still, 1).withColumn("cell", F.col("cell") + blocks)
    kept = filled.where("NOT edge").withColumn("rest", F.lit(None).cast("double"))
    # with all copies taken whole no document has to decide
    opened = opened.alias("o").join(
        wanted.select("source", "whole").alias("v"), F.col("o.source").eqNullSafe(F.col("v.source"))
    )
    opened = opened.withColumn(
        "rest", F.expr(f"IF(edge AND whole < {MOST_REPEATS}, rest, NULL)")
    ).select([f"o.{c}" for c in filled.columns if c != "rest"] + ["rest"])
    both = cut_lineage(kept.unionByName(opened).drop("edge"))
    counted = both.groupBy("source", "kind").agg(F.sum("copies").alias("n")).collect()
    counted.sort(key=lambda r: (r["source"] is None, r["source"] or "", r["kind"]))
    quota = split_quotas(np.array([r["n"] for r in counted], dtype=np.int64), shards, seed)
    quotas = spark.createDataFrame(
        [(r["source"], r["kind"], quota[:, i].tolist()) for i, r in enumerate(counted)],
        "source string, kind int, quota array<long>",
    )
    sized_cells = both.alias("b").join(
        wanted.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source"))
    ).select("b.source", "cell", "kind", "source_size", "target", "rest", "copies")
    return edges, cut_lineage(_dealt(sized_cells, quotas))


def _with_cells(rows: DataFrame, edges: DataFrame, blocks: int) -> DataFrame:
    same = F.col("r.source").eqNullSafe(F.col("e.source"))
    cell = F.when(F.col("block") == F.col("edge"), F.col("fine") + blocks).otherwise(F.col("block"))
    return rows.alias("r").join(edges.alias("e"), same).select("r.*", cell.alias("cell"))


def mixture(
    docs: DataFrame, seed: int = 7, shards: int = SHARDS, blocks: int = BLOCKS
) -> DataFrame:
    """``doc_id, source, size, draw, source_size, target, shards, places``.

    ``shards`` holds the shard of each taken copy, ``places`` the key it is ordered by there.
    """
    rows = sized(docs, seed, blocks)
    edges, plan = block_plan(rows, seed, shards, blocks)
    joined = _placed(rows, edges, plan, blocks)
    edge = _fit_edge(joined.where("rest IS NOT NULL"), seed, shards)
    both = joined.where("rest IS NULL").unionByName(edge).drop("rest")
    places = F.transform("shards", lambda shard, copy: place_of(shard, F.col("draw"), copy))
    return both.withColumn("places", places)


def _placed(rows: DataFrame, edges: DataFrame, plan: DataFrame, blocks: int) -> DataFrame:
    placed = _with_cells(rows, edges, blocks)
    same = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.cell") == F.col("p.cell"))
    return placed.alias("r").join(plan.alias("p"), same).select(
        "r.doc_id", "r.source", "r.size", "r.draw",
        "p.source_size", "p.target", "p.shards", "p.rest",
    )


def _fit_edge(rows: DataFrame, seed: int, shards: int) -> DataFrame:
    """One more copy of the documents that still fit, longest first.

    A group is one part of one block: a source's documents divided by ``BLOCKS`` twice.
    """

    def fit(held: pa.Table) -> pa.Table:
        order = [("size", "descending"), ("draw", "ascending"), ("doc_id", "ascending")]
        held = held.sort_by(order)
        sizes, draws = held["size"].to_pylist(), held["draw"].to_pylist()
        given, left, open_ = held["shards"].to_pylist(), held["rest"][0].as_py(), []
        for i, size in enumerate(sizes):
            if 0 < size <= left:
                left -= size
                given[i].append((draws[i] // 7919 + seed) % shards)
            elif size:
                open_.append(i)
        # what no whole document fits into goes to the shortest one, where that comes closer
        if open_ and sizes[open_[-1]] - left < left:
            given[open_[-1]].append((draws[open_[-1]] // 7919 + seed) % shards)
        at = held.schema.get_field_index("shards")
        return held.set_column(at, held.schema.field(at), pa.array(given, pa.list_(pa.int32())))

    return rows.groupBy("source").applyInArrow(fit, rows.schema)


def shard_rows(mixed: DataFrame) -> DataFrame:
    """The mixture as rows ``shard, position key, doc_id``, shuffled within each shard."""
    return (
        mixed.select("doc_id", "places", F.posexplode("shards").alias("copy", "shard"))
        .withColumn("place", F.element_at("places", F.col("copy") + 1))
        .repartitionByRange("shard", "place")
        .sortWithinPartitions("shard", "place", "doc_id")
        .select("shard", "place", "doc_id", "copy")
    )


def mixed_documents(
    docs: DataFrame, seed: int = 7, shards: int = SHARDS, blocks: int = BLOCKS
) -> DataFrame:
    """The columns of ``docs``, each document as often as the mixture takes it, shard by shard.

    A document's block follows from a hash, and the plan, ``2 * blocks`` rows a source, goes to it
    as far as its checked size allows. Documents of the edge part come by their hash, so rows that
    repeat a ``doc_id`` within a source are taken equally often. Texts move once, to their place: range partitions
    hold the shards in order, and a shard is read in the order of its shuffle.
    """
    rows = sized(docs, seed, blocks)
    edges, plan = block_plan(rows, seed, shards, blocks)
    held, draw = free_name(docs, "held"), free_name(docs, "draw")
    sources = edges.withColumnRenamed("source", "of")
    cells = plan.select(F.col("source").alias("in"), "cell", "shards", "rest")
    last = _fit_edge(_placed(rows, edges, plan, blocks).where("rest IS NOT NULL"), seed, shards)
    last = cut_lineage(
        last.groupBy(F.col("draw").alias("one")).agg(
            F.max_by("shards", F.struct(F.size("shards"), "shards")).alias("more")
        )
    )
    if cells.count() <= BROADCAST_IDS // 4:
        sources, cells = F.broadcast(sources), F.broadcast(cells)
    if last.count() <= BROADCAST_IDS:
        last = F.broadcast(last)
    # the document as one column, so that no name of its own can meet one of the plan's
    whole = docs.select(
        F.struct(*docs.columns).alias(held),
        F.col("source").alias("_source"),
        draw_of(seed).alias(draw),
    )
    block, fine = F.pmod(F.col(draw), F.lit(blocks)), F.pmod(F.xxhash64(draw), F.lit(blocks))
    cell = F.when(block == F.col("edge"), fine + blocks).otherwise(block)
    met = whole.join(sources, F.col("_source").eqNullSafe(F.col("of"))).withColumn("_cell", cell)
    met = met.join(cells, F.col("_source").eqNullSafe(F.col("in")) & (F.col("_cell") == F.col("cell")))
    met = met.join(last, F.col(draw) == F.col("one"), "left")
    given = F.when(F.col("rest").isNull(), F.col("shards")).otherwise(F.col("more"))
    each = met.select(held, draw, F.posexplode(given).alias("_copy", "_shard"))
    each = each.withColumn("_place", place_of(F.col("_shard"), F.col(draw), F.col("_copy")))
    ordered = each.repartitionByRange("_shard", "_place").sortWithinPartitions("_shard", "_place")
    return ordered.select(f"{held}.*")
