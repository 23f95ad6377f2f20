"""One file per row, and archives read back from such files.

Large tables of archives belong in Parquet (a BINARY column); this is for exchange with tools
that expect one file per record.
"""

import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from seqloom.functions.catalog import expr


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and host, as Spark itself would resolve it; unknown schemes fail."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    text = system.makeQualified(place).toString()
    return text.replace("file:/", "file:///", 1) if text.startswith("file:/") else text


def is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isFile()


class RecordFiles(DataSource):
    """Sink for ``(name STRING, content BINARY)``: writes ``<path>/<name>``.

    ``path`` is a URI of a file system that every executor can reach. Files appear under their
    final name only when complete, so a retried task replaces equal content.
    """

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "name STRING, content BINARY"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _RecordFilesWriter(self.options["path"])


class _RecordFilesWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root, recursive=True)
        for row in iterator:
            if "/" in row["name"] or row["name"] in ("", ".", ".."):
                raise ValueError(f"not a plain file name: {row['name']}")
            partial = f"{root}/.{uuid.uuid4().hex}.partial"
            try:
                with system.open_output_stream(partial) as target:
                    target.write(row["content"])
                system.move(partial, f"{root}/{row['name']}")
            except BaseException:
                # nothing of a failed task stays behind
                if system.get_file_info(partial).type != fs.FileType.NotFound:
                    system.delete_file(partial)
                raise
        return WriterCommitMessage()


def write_files(files: DataFrame, folder: str) -> None:
    """Writes every row as a file of its own; fails before the first write if two names are equal."""
    spark = files.sparkSession
    shared = files.groupBy("name").count().where("count > 1").limit(5).collect()
    if shared:
        listed = ", ".join(sorted(row["name"] for row in shared))
        raise ValueError(f"several inputs would be written to the same file: {listed}")
    spark.dataSource.register(RecordFiles)
    rows = files.select("name", "content")
    rows.write.format("record_files").mode("append").save(qualified(spark, folder))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, path, archive BINARY)``, ``record_id`` being the path, for a file, folder or glob of archives."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(F.col("path").alias("record_id"), "path", F.col("content").alias("archive"))
    )


def stem(path: str = "path") -> Column:
    """File name without folder and last extension."""
    return expr("file_stem", path)
