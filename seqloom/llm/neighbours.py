"""Approximate nearest neighbours on shifted space-filling curves.

1. Each of ``CURVES`` orderings projects the unit vectors onto ``AXES`` random orthogonal
   directions, shifts the grid, and takes the Hilbert number of the cell. Scale and middle of each
   axis come from a bounded sample (``SAMPLE`` vectors); every vector is indexed.
2. Spark range-partitions and sorts each ordering; ranks come from counts per partition. Neighbours
   in rank make a block, packed into one row: about ``BLOCKS`` blocks an ordering, of ``SMALLEST``
   to ``BLOCK`` vectors, so that the orderings decide in small tables as in large ones.
3. A query looks at its own block and ``radius`` blocks to either side in some orderings. Both are
   measured: for ``PROBES`` queries the true neighbours are found among all vectors; of the numbers
   of orderings, each with the smallest radius that reaches ``RECALL``, the one with the fewest
   vectors to look at is taken. Clustered vectors need few; those without structure up to all, in one
   ordering, and then the search is exact and costs what brute force in blocks costs.
4. Each pair of a query block and a candidate block is one matrix product; its best go on, and the
   merged best of all orderings are reranked by the exact cosine of the original vectors.

Nearness is cosine in double precision, largest first, ties to the smaller ``vec_id``. Vectors that
are null, zero, or hold null or non-finite components take no part, nor do rows without ``vec_id``.
Vectors are near only to vectors of their own length. Of rows that repeat a ``vec_id`` the smallest
vector counts. Fewer candidates than asked for give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import cut_lineage

CURVES = 8
AXES = 8
BITS = 7
#: Blocks of an ordering, and the least and most vectors in one.
BLOCKS, SMALLEST, BLOCK = 128, 8, 4096
#: Query blocks that one row brings to a block.
TOGETHER = 32
SAMPLE = 4096
PROBES = 96
RECALL = 0.96
NEAREST = 5
QUERY_STEP = 50


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert numbers of integer grid cells ``(rows, axes)``; ``axes * bits`` is at most 63."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(axes):
            high = (x[i] & step) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn ^= np.where((x[-1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= turn
    number = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            number = (number << 1) | ((x[i] >> bit) & 1)
    return number


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, vector``: the rows that take part, one per id."""
    good = F.expr(
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    rows = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    )
    rows = rows.where(good).groupBy("vec_id").agg(F.min("embedding").alias("vector"))
    return cut_lineage(rows.select("vec_id", F.size("vector").alias("dim"), "vector"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(held: np.ndarray) -> np.ndarray:
    held = held.astype(np.float64)
    held = held / np.abs(held).max(axis=1, keepdims=True)  # no overflow in the squares
    return held / np.linalg.norm(held, axis=1, keepdims=True)


class Curves:
    """Directions, scales and shifts of every ordering for one vector length."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 11):
        dim = sample.shape[1]
        axes = min(AXES, dim)
        draw = np.random.default_rng([seed, dim])
        self.curves = []
        for _ in range(curves):
            directions = np.linalg.qr(draw.standard_normal((dim, dim)))[0][:, :axes]
            seen = sample @ directions
            middle, scale = seen.mean(axis=0), seen.std(axis=0) + 1e-9
            self.curves.append((directions, middle, scale, draw.random(axes)))

    def keys(self, curve: int, units: np.ndarray) -> np.ndarray:
        directions, middle, scale, shift = self.curves[curve]
        # three deviations to either side, and a cell's width of shift
        spread = ((units @ directions - middle) / scale + 3) / 6.2 * (1 << BITS) + shift * 8
        cells = np.clip(spread, 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert(cells, BITS)


def _fit(rows: DataFrame, curves: int) -> dict[int, Curves]:
    """Orderings per vector length, from at most ``SAMPLE`` vectors."""
    listed = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in listed:
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    return {dim: Curves(_unit(np.array(v)), curves) for dim, v in by_dim.items()}


def _ordered(rows: DataFrame, fitted: dict[int, Curves], curves: int) -> DataFrame:
    """``curve, dim, vec_id, vector, block``: each ordering cut into blocks of equal number."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                units = _unit(matrix(part.column("vector"), dim))
                # lengths that the sample has not met get orderings without its scales
                held = fitted.get(int(dim)) or Curves(np.eye(dim), curves)
                for curve in range(curves):
                    keyed = part.append_column("key", pa.array(held.keys(curve, units)))
                    yield keyed.append_column(
                        "curve", pa.array(np.full(len(units), curve, np.int32))
                    )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    keyed = rows.mapInArrow(key, f"{fields}, key bigint, curve int")
    order = ["curve", "dim", "key", "vec_id"]
    placed = (
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .drop("key")
    )
    placed = cut_lineage(placed)
    counted = placed.groupBy("curve", "dim", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first")
    )
    before = counted.select(
        "curve", "dim", "part",
        (F.expr("sum(n) OVER (PARTITION BY curve, dim ORDER BY part)") - F.col("n") - F.col("first")).alias("shift"),
        F.expr(f"greatest({SMALLEST}, least({BLOCK}, sum(n) OVER (PARTITION BY curve, dim) DIV {BLOCKS}))").alias("size"),
    )
    return placed.join(before, ["curve", "dim", "part"]).select(
        "curve", "dim", "vec_id", "vector",
        F.expr("(at + shift) DIV size").alias("block"),
    )


def _best(queries: np.ndarray, query_ids, held: np.ndarray, ids, nearest: int):
    """Exact best of each query among ``held``: query ids, candidate ids and scores."""
    a, b = queries.astype(np.float64), held.astype(np.float64)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    rough = (a / na[:, None]) @ (b / nb[:, None]).T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    out_q, out_c, out_s = [], [], []
    for k in range(len(a)):
        line = rough[k]
        if len(line) > nearest:
            least = np.partition(line, len(line) - nearest)[len(line) - nearest]
            found = np.flatnonzero((line >= least - 1e-9) & (line > -np.inf))
        else:
            found = np.flatnonzero(line > -np.inf)
        # one formula, row by row, so that equal vectors get equal scores in every block
        exact = (b[found] * a[k]).sum(axis=1) / (nb[found] * na[k])
        order = np.lexsort((ids[found], -exact))[:nearest]
        out_q.append(np.full(len(order), query_ids[k]))
        out_c.append(ids[found][order])
        out_s.append(exact[order])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def brute_force(rows: DataFrame, probes: dict[int, tuple[np.ndarray, np.ndarray]], nearest: int):
    """``(query_id, vec_id)`` of the true neighbours of a bounded set of queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in set(np.unique(dims).tolist()) & set(probes):
                part = batch.filter(pa.array(dims == dim))
                query_ids, queries = probes[dim]
                found = _best(
                    queries, query_ids, matrix(part.column("vector"), dim), part.column("vec_id").to_numpy(), nearest
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in found], ["query_id", "vec_id", "score"]
                )

    found = rows.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    return _top(found, nearest).select("query_id", "vec_id").collect()


def _top(found: DataFrame, nearest: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return one.withColumn("rank", place).where(F.col("rank") <= nearest)


def search_plan(
    rows: DataFrame, blocks: DataFrame, nearest: int, step: int, recall: float
) -> tuple[int, int]:
    """How many orderings to look into, and how many blocks to either side."""
    listed = (
        rows.where(F.col("vec_id") % step == 0)
        .orderBy(F.xxhash64(F.lit("probe"), "vec_id"), "vec_id")
        .limit(PROBES)
        .collect()
    )
    probes: dict[int, tuple] = {}
    for dim in {r["dim"] for r in listed}:
        of = [r for r in listed if r["dim"] == dim]
        probes[dim] = (np.array([r["vec_id"] for r in of]), np.array([r["vector"] for r in of]))
    truth = brute_force(rows, probes, nearest)
    if not truth:
        return 1, 0
    # PROBES * (nearest + 1) ids at most
    wanted = sorted({x for r in truth for x in (r["query_id"], r["vec_id"])})
    ids = rows.sparkSession.createDataFrame([(x,) for x in wanted], "vec_id bigint")
    where: dict[tuple[int, int], int] = {
        (r["curve"], r["vec_id"]): r["block"]
        for r in blocks.join(F.broadcast(ids), "vec_id").select("curve", "vec_id", "block").collect()
    }
    curves = sorted({curve for curve, _ in where})
    most = blocks.agg(F.max("block")).first()[0] + 1
    found, best = np.full(len(truth), most), None
    for used, curve in enumerate(curves, 1):
        apart = [abs(where[curve, r["query_id"]] - where[curve, r["vec_id"]]) for r in truth]
        found = np.minimum(found, apart)
        radius = int(np.sort(found)[min(len(found), int(np.ceil(recall * len(found)))) - 1])
        looked_at = used * min(2 * radius + 1, most)
        if best is None or looked_at < best[0]:
            best = looked_at, used, radius
    if best[0] >= most:  # no less than all: then all, once
        return 1, int(most)
    return best[1], best[2]


def _packs(blocks: DataFrame, step: int, wide: str) -> DataFrame:
    """One row per block: ids and vectors of all its rows and of its queries."""
    kind = "<f4" if wide == "float" else "<f8"

    def pack(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        group = group.sort_by("vec_id")
        ids, held = group["vec_id"].to_numpy(), matrix(group["vector"], dim).astype(kind)
        asks = ids % step == 0
        cells = [held.tobytes(), ids.astype("<i8").tobytes(), held[asks].tobytes(), ids[asks].astype("<i8").tobytes()]
        return pa.table(
            {"curve": group["curve"][:1], "dim": group["dim"][:1], "block": group["block"][:1]}
            | {n: pa.array([c], pa.binary()) for n, c in zip(("held", "ids", "asked", "asked_ids"), cells, strict=True)}
        )

    schema = "curve int, dim int, block bigint, held binary, ids binary, asked binary, asked_ids binary"
    return blocks.groupBy("curve", "dim", "block").applyInArrow(pack, schema)


def nearest_neighbours(
    vectors: DataFrame,
    nearest: int = NEAREST,
    step: int = QUERY_STEP,
    curves: int = CURVES,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose id is divisible by ``step``."""
    rows = usable(vectors)
    wide = rows.schema["vector"].dataType.elementType.simpleString()
    blocks = cut_lineage(_ordered(rows, _fit(rows, curves), curves))
    used, radius = search_plan(rows, blocks, nearest, step, recall)
    packs = cut_lineage(_packs(blocks.where(F.col("curve") < used), step, wide))
    last = packs.groupBy("curve", "dim").agg(F.max("block").alias("last"))
    from_, to = F.greatest(F.lit(0), F.col("block") - radius), F.least("last", F.col("block") + radius)
    asked = (
        packs.where("octet_length(asked_ids) > 0")
        .join(last, ["curve", "dim"])
        .select(
            "curve", "dim", F.explode(F.sequence(from_, to)).alias("to"),
            F.expr(f"block DIV {TOGETHER}").alias("some"), "asked", "asked_ids",
        )
        .withColumnRenamed("to", "block")
        # a block's vectors travel once for this many query blocks
        .groupBy("curve", "dim", "block", "some")
        .agg(F.collect_list("asked").alias("asked"), F.collect_list("asked_ids").alias("asked_ids"))
    )
    met = packs.select("curve", "dim", "block", "held", "ids").join(asked, ["curve", "dim", "block"])
    kind = "<f4" if wide == "float" else "<f8"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, held, ids, asked, asked_ids = (c[r].as_py() for c in batch.columns)
                found = _best(
                    np.frombuffer(b"".join(asked), kind).reshape(-1, dim),
                    np.frombuffer(b"".join(asked_ids), "<i8"),
                    np.frombuffer(held, kind).reshape(-1, dim),
                    np.frombuffer(ids, "<i8"),
                    nearest,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in found], ["query_id", "vec_id", "score"]
                )

    found = met.select("dim", "held", "ids", "asked", "asked_ids").mapInArrow(
        search, "query_id bigint, vec_id bigint, score double"
    )
    return _top(found, nearest).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
