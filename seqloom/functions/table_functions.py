"""Functions that take tables, for ``spark.sql``.

``LATERAL decode_blocks(table)`` lists the entries of a block table. ``repeats_of(TABLE(t), k, n)``
takes any table with a ``record_id`` and a ``seq`` and gives its copies; the type of the id is the
table's. ``digest_of(TABLE(t) PARTITION BY record_id ORDER BY offset)`` reads the pieces of each
record in order, one at a time.
"""

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from seqloom.functions.matching import greedy_copies
from seqloom.plans.archive_v2 import decode_table

BLOCK_COLUMNS = (
    "type STRING, start BIGINT, length BIGINT, source BIGINT, symbol_count BIGINT, "
    "bit_length BIGINT, payload_offset BIGINT, payload_length BIGINT, use_context BOOLEAN"
)
_BLOCK_NAMES = [column.split()[0] for column in BLOCK_COLUMNS.split(", ")]


class DecodeBlocks:
    def eval(self, table: bytes) -> Iterator[tuple]:
        for block in decode_table(bytes(table)):
            yield tuple(block.get(name) for name in _BLOCK_NAMES)


def _column(argument: AnalyzeArgument, name: str) -> StructField:
    if not argument.isTable or name not in argument.dataType.names:
        raise ValueError(f"a table with a column {name} is needed")
    return argument.dataType[name]


class RepeatsOf:
    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument, shortest: AnalyzeArgument) -> AnalyzeResult:
        _column(table, "seq")
        numbers = [StructField(name, LongType()) for name in ("start", "source", "length")]
        return AnalyzeResult(StructType([_column(table, "record_id"), *numbers]))

    def eval(self, row: Row, k: int, shortest: int) -> Iterator[tuple]:
        for start, source, length in greedy_copies(row["seq"] or "", k, shortest, False):
            yield row["record_id"], int(start), int(source), int(length)


class DigestOf:
    def __init__(self) -> None:
        self.key, self.length, self.pieces, self.hasher = None, 0, 0, hashlib.sha256()

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _column(table, "offset")
        _column(table, "bases")
        columns = [_column(table, "record_id"), StructField("pieces", LongType()), StructField("length", LongType())]
        return AnalyzeResult(StructType([*columns, StructField("sha256", StringType())]))

    def eval(self, row: Row) -> None:
        if row["offset"] != self.length:
            raise ValueError("the pieces of a record do not follow one another")
        self.key = row["record_id"]
        self.length += len(row["bases"])
        self.pieces += 1
        self.hasher.update(bytes(row["bases"]))

    def terminate(self) -> Iterator[tuple]:
        if self.pieces:
            yield self.key, self.pieces, self.length, self.hasher.hexdigest()


def register(spark: SparkSession) -> list[str]:
    spark.udtf.register("decode_blocks", udtf(DecodeBlocks, returnType=BLOCK_COLUMNS))
    spark.udtf.register("repeats_of", udtf(RepeatsOf))
    spark.udtf.register("digest_of", udtf(DigestOf))
    return ["decode_blocks", "repeats_of", "digest_of"]
