"""FASTA files of any size, read in pieces by byte ranges.

A range of a file is cleaned and checked where it is read: line ends and the blanks beside them go,
anything else that is no symbol is an error. What lies at a range's edge is settled by looking
beyond it, so a piece depends on its file alone and not on how lines and ranges meet, and no piece
is ever as long as a record. Pieces get their place in the record from the sums of the lengths
before them, a table of one narrow row a piece.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from seqloom.formats import ALPHABET
from seqloom.operators.kmers import CHUNK_POSITIONS
from seqloom.session import cut_lineage
from seqloom.sources.files import qualified
from seqloom.sources.ranges import RangeFile, RangeGroup, dealt_ranges, file_sizes, opened

PIECE_BYTES = 1 << 22
TASK_BYTES = 1 << 26

# what ends a line of text, as bytes of UTF-8 and as characters
_BREAK_BYTES = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c-\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_BLANKS = re.compile(r"\s+")
_LOOK = 256


def read_header(file: RangeFile) -> tuple[str, int]:
    """The header line, and where the line after it begins."""
    head, size = b"", 1 << 12
    while True:
        head = file.read(0, size)
        # a break at the very end may be the first half of one
        end = _BREAK_BYTES.search(head)
        if (end and end.end() < len(head)) or len(head) == file.size:
            break
        size *= 4
    text = head[: end.start()] if end else head
    header = text.decode("utf-8")
    if header[:1] != ">" or not header[1:].strip():
        raise ValueError("a FASTA file begins with > and a name")
    return header, end.end() if end else len(head)


def _whole_characters(file: RangeFile, start: int, end: int, first: int) -> tuple[str, int, int]:
    """The characters that begin within ``[start, end)``, and the bytes they take."""
    data = file.read(start, min(end + 3, file.size))
    begin, stop = 0, end - start
    while start > first and begin < stop and 0x80 <= data[begin] < 0xC0:
        begin += 1
    while begin < stop < len(data) and 0x80 <= data[stop] < 0xC0:
        stop += 1
    return data[begin:stop].decode("utf-8"), start + begin, start + stop


def _before(file: RangeFile, start: int, first: int) -> str:
    """Blanks in front of ``start`` and the character before them, as far back as needed."""
    size = _LOOK
    while True:
        begin = max(first, start - size)
        text = file.read(begin, start).decode("utf-8", "ignore")
        if begin == first or text.strip() or any(c in _BREAKS for c in text):
            return text
        size *= 4


def _after(file: RangeFile, end: int) -> str:
    size = _LOOK
    while True:
        text = file.read(end, end + size).decode("utf-8", "ignore")
        if end + size >= file.size or text.strip() or any(c in _BREAKS for c in text):
            return text
        size *= 4


def _clean(file: RangeFile, start: int, end: int, first: int) -> str:
    """The symbols of the body within a range; ``first`` is where the body begins."""
    start = max(start, first)
    if start >= end:
        return ""
    text, start, end = _whole_characters(file, start, end, first)
    before = _before(file, start, first)
    at_start = start == first or before[-1:] in _BREAKS
    for place in re.finditer(">", text):
        if text[place.start() - 1] in _BREAKS if place.start() else at_start:
            raise ValueError("a FASTA file must hold a single record")

    def kept(blank: re.Match) -> str:
        run = blank[0]
        if blank.start() == 0:
            lead = before[len(before.rstrip()) :]
            if start == first or lead == before:  # nothing but blanks, back to the body's start
                return ""
            run = lead + run
        if blank.end() == len(text):
            rest = _after(file, end)
            if not rest.strip() and not any(c in _BREAKS for c in rest):
                return ""  # blanks to the end of the file
            run += rest[: len(rest) - len(rest.lstrip())]
        return "" if any(c in _BREAKS for c in run) else blank[0]

    symbols = _BLANKS.sub(kept, text).upper()
    unknown = sorted(set(symbols).difference(ALPHABET))
    if unknown:
        raise ValueError("symbols that FASTA input may not have: " + "".join(unknown))
    return symbols


class FastaPieces(DataSource):
    """``(path, piece, header, bases, error)``: a row per byte range, ``header`` on the first.

    Options: ``path``, ``pieceBytes``, ``taskBytes`` (ranges of a task), ``mode``.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return "path STRING, piece BIGINT, header STRING, bases BINARY, error STRING"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FastaReader(dict(self.options))


class _FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.piece = int(options.get("pieceBytes".lower(), options.get("pieceBytes", PIECE_BYTES)))
        self.task = int(options.get("taskBytes".lower(), options.get("taskBytes", TASK_BYTES)))
        self.fail_fast = options.get("mode", "FAILFAST") == "FAILFAST"

    def partitions(self) -> list[RangeGroup]:
        return dealt_ranges(file_sizes(self.path), self.piece, self.task)

    def read(self, partition: RangeGroup) -> Iterator[pa.RecordBatch]:
        names = ["path", "piece", "header", "bases", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        heads: dict[str, tuple[str, int]] = {}
        for part, file in opened(partition.ranges):
            try:
                if part.path not in heads:
                    heads = {part.path: read_header(file)}
                header, first = heads[part.path]
                bases = _clean(file, part.start, part.end, first).encode("ascii")
                row = (part.path, part.number, None if part.number else header, bases, None)
            except ValueError as problem:
                if self.fail_fast:
                    raise
                row = (part.path, part.number, None, None, str(problem))
            arrays = [pa.array([value], kind) for value, kind in zip(row, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def scan_pieces(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The rows of the ``fasta_pieces`` source for a file or folder."""
    spark.dataSource.register(FastaPieces)
    source = spark.read.format("fasta_pieces").options(**{k: str(v) for k, v in options.items()})
    return source.load(qualified(spark, path))


def read_pieces(spark: SparkSession, path: str, **options: str | int) -> tuple[DataFrame, DataFrame]:
    """``(record_id, header, length)`` and ``(record_id, offset, bases, size_bound)`` of a file or folder.

    ``size_bound`` is the length of the piece's record. The files are read once. A file without
    symbols fails here, any other error where it is read.
    """
    rows = cut_lineage(scan_pieces(spark, path, **options).drop("error"))
    size = F.octet_length("bases").cast("long")
    earlier = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # one number a piece: a record of 100 GB has some 25,000 of them
    places = rows.select(
        "path",
        "piece",
        F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("offset"),
        F.sum(size).over(Window.partitionBy("path")).alias("size_bound"),
    )
    pieces = rows.join(places, ["path", "piece"]).where(size > 0)
    whole = rows.groupBy("path").agg(F.max("header").alias("header"), F.sum(size).alias("length"))
    empty = F.raise_error(F.lit("a FASTA sequence must not be empty"))
    return (
        whole.select(
            F.col("path").alias("record_id"),
            "header",
            F.when(F.col("length") > 0, F.col("length")).otherwise(empty.cast("long")).alias("length"),
        ),
        pieces.select(F.col("path").alias("record_id"), "offset", "bases", "size_bound"),
    )


def recut(pieces: DataFrame, width: int = 1, positions: int = CHUNK_POSITIONS) -> DataFrame:
    """``(record_id, offset, bases)`` at multiples of ``positions``, each ``width - 1`` longer.

    Every window of ``width`` symbols of a record lies in exactly one piece, as in
    ``kmers.chunks``; here the record itself is in no cell. A piece goes to the few places it
    touches, so no row grows with the record. A ``size_bound`` goes with its pieces.
    """
    bound = [name for name in ("size_bound",) if name in pieces.columns]
    reach = f"(offset - {width - 1})"
    touched = F.expr(
        f"""IF(octet_length(bases) = 0, array(), sequence(
        greatest(0L, {reach} DIV {positions}), (offset + octet_length(bases) - 1) DIV {positions}))"""
    )
    at = F.expr(f"place * {positions}L")
    parts = (
        pieces.select("record_id", "offset", "bases", *bound, F.explode(touched).alias("place"))
        .withColumn("from", F.greatest(F.col("offset"), at))
        .withColumn("to", F.least(F.expr("offset + octet_length(bases)"), at + (positions + width - 1)))
        .where("`from` < `to`")
        .select(
            "record_id",
            "place",
            "from",
            F.expr("substring(bases, CAST(`from` - offset + 1 AS INT), CAST(`to` - `from` AS INT))").alias("bases"),
            *bound,
        )
    )
    # at most ``positions + width`` symbols a group
    joined = parts.groupBy("record_id", "place").agg(
        F.array_sort(F.collect_list(F.struct("from", "bases"))).alias("parts"),
        *[F.max(name).alias(name) for name in bound],
    )
    text = "CAST(array_join(transform(parts, p -> CAST(p.bases AS STRING)), '') AS BINARY)"
    return joined.select("record_id", at.alias("offset"), F.expr(text).alias("bases"), *bound).where(
        F.octet_length("bases") >= width
    )
