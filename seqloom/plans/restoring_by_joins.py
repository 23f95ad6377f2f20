"""Sequences from tiles of any number, spread over the cluster.

The tiles of a record, literal ones and copies of what lies before them, are rows. A copy points
into other tiles; each round replaces what a copy points to by what that points to in turn, cut
where tiles meet, so the length of every chain of copies halves and no task follows one. When all
copies point into literal tiles, the text is put together in pieces.

Tiles are kept in pieces that lie within one stretch of ``BLOCK`` symbols, on both sides of a copy:
what a piece points to is then an equi-join on (record, stretch). A stretch that a third of all
copies point to is split by adaptive skew handling, as both sides are written tables.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut_lineage, is_empty

BLOCK = 4096

_OUTSIDE = "copy reference reaches outside the text before it"


def _checked(tiles: DataFrame, records: DataFrame) -> DataFrame:
    """The tiles, or an error where those of a record do not tile its length.

    Each begins where some other ends, the first at 0 and the last ends at the length: compared by
    joins and sums, not in the order of one record's list.
    """
    start, length, source = F.col("start"), F.col("length"), F.col("source")
    wrong_place = start.isNull() | length.isNull() | (length < 0) | (start < 0)
    wrong_copy = source.isNotNull() & ((source < 0) | (length == 0) | (source + length > start))
    neither = source.isNull() & F.col("literal").isNull()
    wrong_size = source.isNull() & (F.octet_length("literal") != length)
    checked = tiles.withColumn(
        "length",
        F.when(wrong_place, F.raise_error(F.lit("a block has no valid place")).cast("long"))
        .when(wrong_copy, F.raise_error(F.lit(_OUTSIDE)).cast("long"))
        .when(neither, F.raise_error(F.lit("unknown or empty block")).cast("long"))
        .when(wrong_size, F.raise_error(F.lit("a literal does not fill its block")).cast("long"))
        .otherwise(length),
    )
    written = cut_lineage(checked)
    real = written.where("length > 0").select("record_id", "start", (start + length).alias("end"))
    # every place where tiles meet is an end and a start; 0 and the length are one of them only
    ends = (
        real.select("record_id", F.col("start").alias("at"), F.lit(1).alias("opens"))
        .unionByName(real.select("record_id", F.col("end").alias("at"), F.lit(-1).alias("opens")))
        .groupBy("record_id", "at")
        .agg(F.sum("opens").alias("open"), F.count("*").alias("n"))
        .where("open <> 0 OR n <> 2")
    )
    edges = ends.groupBy("record_id").agg(
        F.sum(F.when((F.col("at") == 0) & (F.col("open") == 1) & (F.col("n") == 1), 1)).alias("first"),
        F.max(F.when((F.col("open") == -1) & (F.col("n") == 1), F.col("at"))).alias("last"),
        F.count("*").alias("odd"),
    )
    bad = (
        records.select("record_id", "length")
        .join(edges, "record_id", "full")
        .where("NOT ((coalesce(length, -1) = 0 AND odd IS NULL)"
               " OR coalesce(odd = 2 AND first = 1 AND last = length, false))")
    )
    if not is_empty(bad):
        raise ValueError("blocks are not contiguous from 0 to the stored length")
    return written.where("length > 0")


def _cut(pieces: DataFrame, at: str) -> DataFrame:
    """Pieces cut where column ``at`` passes from one stretch to the next.

    A piece has ``start``, ``root`` and ``length``; both move along with the cut.
    """
    first, last = f"{at} DIV {BLOCK}", f"({at} + length - 1) DIV {BLOCK}"
    begin = f"greatest({at}, place * {BLOCK}L) - {at}"
    end = f"least({at} + length, (place + 1) * {BLOCK}L) - {at}"
    return (
        pieces.withColumn("place", F.explode(F.expr(f"sequence({first}, {last})")))
        .withColumn("skip", F.expr(begin))
        .withColumn("size", F.expr(end) - F.col("skip"))
        .select(
            "record_id",
            (F.col("start") + F.col("skip")).alias("start"),
            (F.col("root") + F.col("skip")).alias("root"),
            F.col("size").alias("length"),
            "literal",
        )
    )


def literal_places(tiles: DataFrame) -> DataFrame:
    """``(record_id, start, length, root)``: where in literal tiles the text of each piece lies.

    ``tiles`` are ``(record_id, start, length, source)``; ``root`` of a literal is its own place.
    """
    pieces = tiles.select(
        "record_id",
        "start",
        F.coalesce("source", "start").alias("root"),
        "length",
        F.col("source").isNull().alias("literal"),
    )
    pieces = cut_lineage(_cut(_cut(pieces, "start"), "root"))
    done, open_ = pieces.where("literal"), pieces.where("NOT literal")
    while not is_empty(open_):
        # what the open pieces point to, by stretches
        targets = pieces.select(
            "record_id",
            F.expr(f"start DIV {BLOCK}").alias("place"),
            F.col("start").alias("t_start"),
            F.col("root").alias("t_root"),
            F.col("length").alias("t_length"),
            F.col("literal").alias("t_literal"),
        )
        met = (
            open_.withColumn("place", F.expr(f"root DIV {BLOCK}"))
            .drop("literal")
            .join(targets, ["record_id", "place"])
            .where("root < t_start + t_length AND t_start < root + length")
        )
        begin, end = F.greatest("root", "t_start"), F.least(F.expr("root + length"), F.expr("t_start + t_length"))
        # every chain of copies is half as long after the round
        moved = met.select(
            "record_id",
            (F.col("start") + begin - F.col("root")).alias("start"),
            (F.col("t_root") + begin - F.col("t_start")).alias("root"),
            (end - begin).alias("length"),
            F.col("t_literal").alias("literal"),
        )
        pieces = cut_lineage(done.unionByName(_cut(moved, "root")))
        done, open_ = pieces.where("literal"), pieces.where("NOT literal")
    return pieces.select("record_id", "start", "length", "root")


def restored_pieces(tiles: DataFrame, records: DataFrame) -> DataFrame:
    """``(record_id, offset, bases)``, pieces of at most ``BLOCK`` symbols, from tiles.

    ``tiles`` are ``(record_id, start, length, source, literal)`` in any order, ``records``
    ``(record_id, length)``.
    """
    checked = _checked(tiles, records)
    places = cut_lineage(literal_places(checked.select("record_id", "start", "length", "source")))
    literals = checked.where("source IS NULL").select(
        "record_id", F.col("start").alias("l_start"), "length", F.col("literal").cast("binary").alias("text")
    )
    # a long literal tile comes in stretches, so that a row of text stays small
    first, last = f"l_start DIV {BLOCK}", f"(l_start + length - 1) DIV {BLOCK}"
    begin = f"greatest(l_start, place * {BLOCK}L)"
    texts = (
        literals.withColumn("place", F.explode(F.expr(f"sequence({first}, {last})")))
        .select(
            "record_id",
            "place",
            F.expr(begin).alias("l_start"),
            F.expr(
                f"""substring(text, CAST({begin} - l_start + 1 AS INT), CAST(
                least(l_start + length, (place + 1) * {BLOCK}L) - {begin} AS INT))"""
            ).alias("text"),
        )
    )
    found = places.withColumn("place", F.expr(f"root DIV {BLOCK}")).join(
        cut_lineage(texts), ["record_id", "place"]
    )
    inside = found.where("root >= l_start AND root < l_start + octet_length(text)")
    cut = "substring(text, CAST(root - l_start + 1 AS INT), CAST(length AS INT))"
    parts = inside.select(
        "record_id", "start", F.expr(f"start DIV {BLOCK}").alias("place"), F.expr(cut).alias("bases")
    )
    # a stretch holds at most ``BLOCK`` symbols, however many pieces it is made of
    joined = parts.groupBy("record_id", "place").agg(
        F.array_sort(F.collect_list(F.struct("start", "bases"))).alias("parts")
    )
    text = "CAST(array_join(transform(parts, p -> CAST(p.bases AS STRING)), '') AS BINARY)"
    return joined.select(
        "record_id", F.expr(f"place * {BLOCK}L").alias("offset"), F.expr(text).alias("bases")
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    """``(record_id, length, sha256)`` of records in pieces, whatever their length.

    A checksum reads its text in order, so a record's pieces pass through one task, one at a time.
    """
    kind = dict(pieces.dtypes)["record_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, size, hasher = None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [current, pa.array([size], pa.int64()), pa.array([hasher.hexdigest()])],
                ["record_id", "length", "sha256"],
            )

        for batch in batches:
            ids = batch.column(0)
            for k, bases in enumerate(batch.column(1)):
                if hasher is None or not ids[k].equals(current[0]):
                    if hasher is not None:
                        yield out()
                    current, size, hasher = ids.slice(k, 1), 0, hashlib.sha256()
                hasher.update(bases.as_buffer())
                size += bases.as_buffer().size
        if hasher is not None:
            yield out()

    ordered = pieces.repartition("record_id").sortWithinPartitions("record_id", "offset")
    return ordered.select("record_id", "bases").mapInArrow(
        digest, f"record_id {kind}, length bigint, sha256 string"
    )


def verified(pieces: DataFrame, records: DataFrame) -> DataFrame:
    """``(record_id, header, length, sha256)``; an error where a text is not what was stored."""
    found = piece_digests(pieces).select("record_id", F.col("sha256").alias("found"))
    empty = hashlib.sha256(b"").hexdigest()
    same = F.coalesce("found", F.lit(empty)) == F.col("sha256")
    return records.join(found, "record_id", "left").select(
        "record_id",
        "header",
        "length",
        F.when(same, F.col("sha256"))
        .otherwise(F.raise_error(F.lit("restored text does not match its checksum")))
        .alias("sha256"),
    )
