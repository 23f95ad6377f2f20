"""Best earlier copies by joins and groupings over positions.

No step lists pairs of equal k-mers and no step gathers a record in one task.

1. *Names.* Positions whose ``width``-symbol window occurs more than once in the record get
   a name: the first position of that window. Positions with a unique window drop out.
2. *Peeling.* All positions with one name share their first occurrence as representative;
   each is compared with it alone. Positions that leave the representative at the same place
   with the same next symbol form the next, smaller group, whose first position is its
   representative. The representatives that a position meets are exactly the sources that
   improve on each other, so the best copy is the best of them.
   Neighbours whose representatives are neighbours too leave them at one place: they are one row,
   a run, and compared once, at its last position. A run mostly ends where the next windows
   differ, or where a run that was compared before goes on.
   Levels settle the others: windows of 2, 4, 8, ... consecutive steps are named from two names of
   the level below, so level t compares ``width + 2**t - 1`` symbols by one integer. They are made
   as far as some run needs them, and only those of its records are compared.
3. *Selection.* The next copy after one at ``start`` is the first candidate at or after its
   end. These pointers are followed from the first candidate of each record by doubling.

Every grouping combines before its shuffle (min and count only). Joins are equi-joins on
(record, position) between written tables, so that adaptive skew handling can split a window that
fills much of a record. They sort and merge: tables of positions compress so well that one of a few
MB on disk takes hundreds as a broadcast, and the driver would hold two of them a level.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.kmers import CHUNK_POSITIONS, piece_offsets
from seqloom.session import cut_lineage, drop, is_empty, keep, settled

BLOCK = 4096


def merged(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts nothing."""
    return left.join(right.hint("merge"), keys, how)


def sized_pieces(records: DataFrame, width: int, positions: int = CHUNK_POSITIONS) -> DataFrame:
    """``(record_id, offset, n, bases)``: pieces like those of ``kmers.chunks``, and the record's length.

    A row that repeats a record gives no second piece.
    """
    size = F.length("seq").cast("long").alias("n")
    cut = records.select(
        "record_id", size, F.col("seq").cast("binary").alias("bases"), F.explode(piece_offsets(1, positions)).alias("offset")
    )
    pieces = cut.select(
        "record_id",
        F.col("offset").cast("long").alias("offset"),
        F.struct("n", F.expr(f"substring(bases, offset + 1, {positions + width - 1})").alias("bases")).alias("piece"),
    )
    whole = pieces.groupBy("record_id", "offset").agg(F.max("piece").alias("piece"))
    return whole.select("record_id", "offset", "piece.n", "piece.bases")


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A number for each window, put together from those of windows of 1, 2, 4, ... symbols."""
    part, size, base = data.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    whole, done = None, 0
    while True:
        if width & size:
            if whole is None:
                whole, done = part, size
            else:
                count = len(data) - done - size + 1
                whole = whole[:count] * np.uint64(base) + part[done : done + count]
                done += size
        if done == width:
            return whole
        part = part[: len(part) - size] * np.uint64(base) + part[size:]
        size, base = 2 * size, base * base & 0xFFFFFFFFFFFFFFFF


def _recurring(width: int, positions: int):
    """Rows ``(record_id, pos, kmer)``; of a record in one piece only windows that come again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows, places, kmers, held = [], [], [], 0

            def emit() -> pa.RecordBatch:
                data = pa.py_buffer(np.concatenate(kmers).tobytes())
                listed = pa.Array.from_buffers(pa.binary(width), held, [None, data]).cast(pa.binary())
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                return pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.concatenate(places)), listed], ["record_id", "pos", "kmer"]
                )

            for k, cell in enumerate(batch.column(3)):
                data = np.frombuffer(cell.as_buffer(), dtype=np.uint8)
                count = min(len(data) - width + 1, positions)
                if count <= 0:
                    continue
                found = np.arange(count)
                if sizes[k] <= positions:
                    # windows that only share their hash drop out in the grouping
                    _, group, times = np.unique(
                        _hashes(data, width), return_inverse=True, return_counts=True
                    )
                    found = np.flatnonzero(times[group] > 1)
                if not len(found):
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(data, width)
                rows.append(np.full(len(found), k))
                places.append(offsets[k] + found)
                kmers.append(windows[found].reshape(-1))
                held += len(found)
                if held > 100_000:
                    yield emit()
                    rows, places, kmers, held = [], [], [], 0
            if held:
                yield emit()

    return cut


def recurring_kmers(records: DataFrame, width: int, *, positions: int = CHUNK_POSITIONS) -> DataFrame:
    """``(record_id, pos, kmer)``, all positions whose window may come again in the record.

    A window that a piece holds once is final where the piece is its whole record; of longer
    records every position counts.
    """
    kind = dict(records.dtypes)["record_id"]
    schema = f"record_id {kind}, pos bigint, kmer binary"
    return sized_pieces(records, width, positions).mapInArrow(_recurring(width, positions), schema)


def _named(positions: DataFrame, keys: list[str]) -> DataFrame:
    """First position of every group with at least two members, joined back to the members."""
    positions = cut_lineage(positions)
    groups = (
        positions.groupBy("record_id", *keys)
        .agg(F.min("pos").alias("name_"), F.count("*").alias("members_"))
        .where(F.col("members_") > 1)
        .drop("members_")
    )
    # written: between two plain scans Spark splits a group that fills a third of all rows
    return merged(positions, cut_lineage(groups), ["record_id", *keys])


def first_windows(records: DataFrame, width: int) -> DataFrame:
    """``(record_id, pos, name)``: each position whose window comes again, and the window's first position."""
    return settled(
        records.sparkSession,
        lambda: _named(recurring_kmers(records, width), ["kmer"]).select(
            "record_id", "pos", F.col("name_").alias("name")
        ),
    )


def _doubled(level: DataFrame, step: int) -> DataFrame:
    """The names of windows of ``2 * step`` steps, from those of ``step`` steps."""
    tail = level.select(
        "record_id", (F.col("pos") - step).alias("pos"), F.col("name").alias("tail")
    )
    return settled(
        level.sparkSession,
        lambda: _named(merged(level, tail, ["record_id", "pos"]), ["name", "tail"]).select(
            "record_id", "pos", F.col("name_").alias("name")
        ),
    )


def _names_at(level: DataFrame, pairs: DataFrame, how: str = "left") -> DataFrame:
    """Adds ``here_name`` and ``there_name``, the names at ``here`` and at ``there``."""
    for place in ("here", "there"):
        names = level.select("record_id", F.col("pos").alias(place), F.col("name").alias(f"{place}_name"))
        pairs = merged(pairs, names, ["record_id", place], how)
    return pairs


def _levels(pairs: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """Names of doubled length, of the records of ``pairs`` and up to where no pair agrees.

    ``levels`` are those of all records, and grow as far as some pair needs them.
    """
    ids = cut_lineage(pairs.select("record_id").distinct())
    alive = pairs.select("record_id", F.col("pos").alias("here"), F.col("rep").alias("there"))
    own: list[DataFrame] = []
    while True:
        if len(own) == len(levels):
            levels.append(keep(_doubled(levels[-1], 1 << (len(levels) - 1))))
        level = cut_lineage(levels[len(own)].join(ids, "record_id", "left_semi"))
        alive = cut_lineage(
            _names_at(level, alive, "inner").where("here_name = there_name").select("record_id", "here", "there")
        )
        if is_empty(alive):
            return own
        own.append(level)


def _agreeing_steps(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Adds ``steps``: how many consecutive windows agree from ``pos`` and from ``rep`` on."""
    kept = pairs.columns
    pairs = pairs.withColumn("steps", F.lit(0).cast("long"))
    for level in range(len(levels) - 1, -1, -1):
        pairs = pairs.withColumn("here", F.col("pos") + F.col("steps")).withColumn(
            "there", F.col("rep") + F.col("steps")
        )
        agree = F.when(F.col("here_name") == F.col("there_name"), 1 << level).otherwise(0)
        further = _names_at(levels[level], pairs).select(*kept, (F.col("steps") + agree).alias("steps"))
        # written: a level's names are shuffled for this join alone, and go with it
        earlier, pairs = pairs, settled(further.sparkSession, lambda now=further: now)
        drop(earlier)
    return pairs


def _runs(members: DataFrame) -> DataFrame:
    """``(record_id, apart, start, last)``: neighbours that lie as far behind their representatives.

    Each run ends with its piece, so none is longer than that.
    """
    rows = members.select(
        "record_id",
        (F.col("pos") - F.col("rep")).alias("apart"),
        F.expr(f"pos DIV {CHUNK_POSITIONS}").alias("piece"),
        "pos",
    )
    order = F.row_number().over(Window.partitionBy("record_id", "apart", "piece").orderBy("pos"))
    runs = rows.withColumn("run", F.col("pos") - order).groupBy("record_id", "apart", "piece", "run")
    return runs.agg(F.min("pos").alias("start"), F.max("pos").alias("last")).select(
        "record_id", "apart", "start", "last"
    )


def _compared(runs: DataFrame, known: DataFrame | None, levels: list[DataFrame]) -> DataFrame:
    """Adds ``steps`` to runs: how many windows agree from ``last`` and from its representative on.

    All positions of a run leave their representatives at one place, so one comparison does for all.
    Most runs end where the next window is another one. Behind some lies a run of an earlier
    round, which is as far behind its representatives and was compared. Only what is left goes
    through the levels.
    """
    columns, windows = ["record_id", "apart", "start", "last"], levels[0]
    if known is None:
        runs = runs.withColumn("ahead", F.lit(None).cast("long"))
    else:
        behind = known.select(
            "record_id", "apart", (F.col("start") - 1).alias("last"), F.expr("steps + last - start").alias("ahead")
        )
        runs = merged(runs, behind, ["record_id", "apart", "last"], "left")
    onward = windows.select("record_id", (F.col("pos") - 1).alias("last"), F.col("name").alias("next"))
    # a window that agrees with the representative's has its first place there or before
    there = F.expr("IF(ahead IS NULL AND next <= last + 1 - apart, last + 1 - apart, NULL)")
    met = merged(runs, onward, ["record_id", "last"], "left").withColumn("there", there)
    names = windows.select("record_id", F.col("pos").alias("there"), F.col("name").alias("there_name"))
    goes_on = F.coalesce(F.col("there_name") == F.col("next"), F.lit(False)).alias("goes_on")
    met = cut_lineage(merged(met, names, ["record_id", "there"], "left").select(*columns, "ahead", goes_on))
    done = met.where("NOT goes_on").select(*columns, (F.coalesce("ahead", F.lit(0)) + 1).alias("steps"))
    left = met.where("goes_on").select(
        *columns, (F.col("last") + 1).alias("pos"), F.expr("last + 1 - apart").alias("rep")
    )
    if is_empty(left):
        return done
    more = _agreeing_steps(left, _levels(left.select("record_id", "pos", "rep"), levels)).select(*columns, (F.col("steps") + 1).alias("steps"))
    return done.unionByName(more)


def _positions(runs: DataFrame, *columns: str) -> DataFrame:
    """``(record_id, pos, rep, steps)`` of every position of the runs, and ``columns`` of its run."""
    rows = runs.select(
        "record_id", "apart", "last", "steps", *columns, F.explode(F.sequence("start", "last")).alias("pos")
    )
    return rows.select(
        "record_id",
        "pos",
        (F.col("pos") - F.col("apart")).alias("rep"),
        F.expr("steps + last - pos").alias("steps"),
        *columns,
    )


def _next_members(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Positions that leave one representative at one place with one next window, and the first of them."""
    branch = windows.select("record_id", F.col("pos").alias("leaves"), F.col("name").alias("branch"))
    leaving = cut_lineage(
        merged(runs.withColumn("leaves", F.expr("last + steps")), branch, ["record_id", "leaves"]).withColumn(
            "left", F.expr("leaves - apart")
        )
    )
    # positions of one run never meet
    key = ["record_id", "left", "branch"]
    several = leaving.groupBy(*key).agg(F.count("*").alias("runs")).where("runs > 1").drop("runs")
    met = merged(leaving, cut_lineage(several), key)
    return (
        _named(_positions(met, "branch"), ["rep", "steps", "branch"])
        .where(F.col("pos") != F.col("name_"))
        .select("record_id", "pos", F.col("name_").alias("rep"))
    )


def best_copies(
    records: DataFrame, k: int, min_length: int, *, allow_overlap: bool = False
) -> DataFrame:
    """``(record_id, start, source, length)``, the best copy at every start that has one."""
    windows = first_windows(records, min_length)
    members = windows.where(F.col("pos") != F.col("name")).select(
        "record_id", "pos", F.col("name").alias("rep")
    )
    fitting = F.least(F.col("steps") + (min_length - 1), F.col("pos") - F.col("rep"))
    if allow_overlap and min_length == k:
        fitting = F.greatest(F.lit(min_length), fitting)
    levels, found = [windows], None
    spark = records.sparkSession
    while not is_empty(members):
        runs = settled(spark, lambda now=members: _runs(now))
        compared = settled(spark, lambda now=runs, known=found: _compared(now, known, levels))
        earlier = members
        members = settled(spark, lambda now=compared: _next_members(now, windows))
        drop(runs, earlier)
        # one table a round: the plan does not grow with the number of rounds
        if found is not None:
            earlier = found, compared
            compared = settled(spark, lambda both=earlier: both[0].unionByName(both[1]))
            drop(*earlier)
        found = compared
    if found is None:
        return members.select(
            "record_id", F.col("pos").alias("start"), F.col("rep").alias("source"),
            F.lit(0).cast("long").alias("length"),
        )
    drop(members, *levels)
    offers = _positions(found).select(
        "record_id", F.col("pos").alias("start"), F.col("rep").alias("source"), fitting.alias("length")
    )
    return _better(offers.where(F.col("length") >= min_length)).select("record_id", "start", "source", "length")


def _better(offers: DataFrame) -> DataFrame:
    """The longest copy at every start, the smallest source among equal ones."""
    best = F.max(F.struct("length", (-F.col("source")).alias("first"))).alias("best")
    return offers.groupBy("record_id", "start").agg(best).select(
        "record_id",
        "start",
        (-F.col("best.first")).alias("source"),
        F.col("best.length").alias("length"),
    )


def _pointers(best: DataFrame) -> DataFrame:
    """``(record_id, start, next)``: first candidate at or after the end of the copy at start."""
    block = f"DIV {BLOCK}"
    starts = best.select("record_id", F.expr(f"start {block}").alias("block"), F.col("start").alias("place"))
    # the running frame sees one number per BLOCK positions
    firsts = starts.groupBy("record_id", "block").agg(F.min("place").alias("first"))
    every = (
        firsts.groupBy("record_id")
        .agg(F.max("block").alias("last"))
        .select("record_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
        .join(firsts.hint("merge"), ["record_id", "block"], "left")
    )
    backwards = (
        Window.partitionBy("record_id")
        .orderBy(F.desc("block"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    later = every.select(
        "record_id", "block", F.last("first", ignorenulls=True).over(backwards).alias("later")
    )
    ends = best.select("record_id", "start", (F.col("start") + F.col("length")).alias("end"))
    asked = ends.select("record_id", F.expr(f"end {block}").alias("block"), F.col("end").alias("place")).distinct()
    # at most BLOCK candidates and BLOCK ends a window; of equal places the candidate comes first
    null = F.lit(None).cast("long")
    both = starts.withColumn("candidate", F.col("place")).unionByName(asked.withColumn("candidate", null))
    onward = (
        Window.partitionBy("record_id", "block")
        .orderBy(F.desc("place"), F.col("candidate").isNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = both.withColumn("next", F.last("candidate", ignorenulls=True).over(onward)).where("candidate IS NULL")
    # written: many copies may end at one place, and between plain scans Spark splits them
    places = cut_lineage(
        merged(found, later, ["record_id", "block"], "left")
        .select("record_id", F.col("place").alias("end"), F.coalesce("next", "later").alias("next"))
        .where(F.col("next").isNotNull())
    )
    return merged(ends, places, ["record_id", "end"]).select("record_id", "start", "next")


def select_greedily(best: DataFrame) -> DataFrame:
    """Keep the copies met when going left to right and jumping by each copy's length."""
    spark = best.sparkSession
    best = cut_lineage(best)
    pointers = settled(spark, lambda: _pointers(best))
    reached = best.groupBy("record_id").agg(F.min("start").alias("start"))
    # only first candidates and places some pointer leads to can be met
    met = pointers.select("record_id", F.col("next").alias("start")).distinct().unionByName(reached)
    jumps = settled(spark, lambda: merged(pointers, met, ["record_id", "start"], "left_semi"))
    while not is_empty(jumps):
        ahead = merged(reached, jumps, ["record_id", "start"]).select(
            "record_id", F.col("next").alias("start")
        )
        onward = jumps.select(
            "record_id", F.col("start").alias("next"), F.col("next").alias("after")
        )
        doubled = merged(jumps, onward, ["record_id", "next"]).select(
            "record_id", "start", F.col("after").alias("next")
        )
        earlier = reached, jumps
        reached = settled(spark, lambda both=(reached, ahead): both[0].unionByName(both[1]))
        jumps = settled(spark, lambda now=doubled: now)
        drop(*earlier)
    drop(pointers, jumps)
    return merged(best, reached, ["record_id", "start"], "left_semi")


def greedy_copies(
    records: DataFrame, k: int, min_length: int, *, allow_overlap: bool = False
) -> DataFrame:
    return select_greedily(
        best_copies(records, k, min_length, allow_overlap=allow_overlap)
    ).select("record_id", "start", "source", "length")
