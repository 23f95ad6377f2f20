"""Binary archives as a table of blocks, read by range.

Header and block table are read, the payload is not: a block's part of it only where the schema
asks for ``payload``, and then only for the blocks that pass the pushed filters. Filters on
``path`` leave files unopened.
"""

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seqloom.plans.archive_v2 import read_front
from seqloom.sources.files import qualified
from seqloom.sources.ranges import RangeFile, RangeGroup, dealt_ranges, file_sizes, opened

BLOCK_COLUMNS = """path STRING, block_no BIGINT, type STRING, start BIGINT, length BIGINT,
    source BIGINT, symbol_count BIGINT, bit_length BIGINT, payload_offset BIGINT,
    payload_length BIGINT, use_context BOOLEAN"""
WITH_PAYLOAD = f"{BLOCK_COLUMNS}, payload BINARY"
TASK_BYTES = 1 << 26
_BATCH = 4096
_WHOLE = 1 << 62

_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    ds.EqualTo: lambda held, value: held is not None and held == value,
    ds.EqualNullSafe: lambda held, value: held == value,
    ds.GreaterThan: lambda held, value: held is not None and held > value,
    ds.GreaterThanOrEqual: lambda held, value: held is not None and held >= value,
    ds.LessThan: lambda held, value: held is not None and held < value,
    ds.LessThanOrEqual: lambda held, value: held is not None and held <= value,
    ds.In: lambda held, value: held is not None and held in value,
    ds.IsNull: lambda held, _: held is None,
    ds.IsNotNull: lambda held, _: held is not None,
    ds.StringStartsWith: lambda held, value: held is not None and held.startswith(value),
    ds.StringEndsWith: lambda held, value: held is not None and held.endswith(value),
}


def _passes(row: dict[str, Any], filters: Iterable[ds.Filter]) -> bool:
    return all(
        _TESTS[type(f)](row.get(f.attribute[0]), getattr(f, "value", None)) for f in filters
    )


class ArchiveBlocks(ds.DataSource):
    """A row per block. Options: ``path``, ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "archive_blocks"

    def schema(self) -> str:
        return BLOCK_COLUMNS

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return ArchiveReader(dict(self.options), schema)


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.task = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))
        self.of_path: list[ds.Filter] = []
        self.of_block: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for one in filters:
            name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if type(one) in _TESTS and name in self.schema.names and name != "payload":
                (self.of_path if name == "path" else self.of_block).append(one)
            else:
                yield one

    def partitions(self) -> list[RangeGroup]:
        files = (f for f in file_sizes(self.path) if _passes({"path": f[0]}, self.of_path))
        # an archive is one range: what is read of it is its front
        return dealt_ranges(files, _WHOLE, self.task)

    def read(self, partition: RangeGroup) -> Iterator[pa.RecordBatch]:
        rows: list[dict[str, Any]] = []
        for part, file in opened(partition.ranges):
            for row in self.rows(part.path, file):
                rows.append(row)
                if len(rows) >= _BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict[str, Any]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(self.schema))

    def rows(self, path: str, file: RangeFile) -> Iterator[dict[str, Any]]:
        """The rows of one archive that pass the pushed filters."""
        _, blocks, payload = read_front(file.read)
        names = self.schema.names
        for number, block in enumerate(blocks):
            row = {"path": path, "block_no": number, **block}
            row["use_context"] = bool(block.get("use_context"))
            if not _passes(row, self.of_block):
                continue
            if "payload" in names:
                start, size = block.get("payload_offset", 0), block.get("payload_length", 0)
                part = file.read(payload + start, payload + start + size)
                if len(part) < size:
                    raise ValueError(f"truncated archive: block {number} reaches past its end")
                row["payload"] = part
            yield {name: row.get(name) for name in names}


def scan_blocks(spark: SparkSession, path: str, *, payload: bool = False, **options: Any) -> DataFrame:
    """Block rows of a file or folder of binary archives.

    Filters reach the source where ``spark.sql.python.filterPushdown.enabled`` is set; it is set
    here for the session, as without it the source still gives the same rows.
    """
    spark.dataSource.register(ArchiveBlocks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("archive_blocks").schema(WITH_PAYLOAD if payload else BLOCK_COLUMNS)
    return source.options(**{k: str(v) for k, v in options.items()}).load(qualified(spark, path))
