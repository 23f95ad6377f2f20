"""FASTA files, one record each: scan with strict validation, and text for the sink."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.formats import ALPHABET
from seqloom.functions.catalog import expr

PARSED = T.StructType(
    [
        T.StructField("header", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def parse_fasta(content: bytes) -> tuple[str, str]:
    """``(header, sequence)``; the header keeps its ``>``, the sequence is upper-cased."""
    head, *body = content.decode("utf-8").splitlines() or [""]
    if head[:1] != ">" or not head[1:].strip():
        raise ValueError("a FASTA file begins with > and a name")
    if any(line[:1] == ">" for line in body):
        raise ValueError("a FASTA file must hold a single record")
    seq = "".join(map(str.strip, body)).upper()
    if not seq:
        raise ValueError("a FASTA sequence must not be empty")
    unknown = sorted(set(seq).difference(ALPHABET))
    if unknown:
        raise ValueError("symbols that FASTA input may not have: " + "".join(unknown))
    return head, seq


def _parse_column(fail_fast: bool):
    kind = to_arrow_type(PARSED)

    def one(content: bytes) -> dict:
        try:
            header, seq = parse_fasta(content)
        except ValueError as problem:
            if fail_fast:
                raise
            return {"header": None, "seq": None, "error": str(problem)}
        return {"header": header, "seq": seq, "error": None}

    @F.arrow_udf(PARSED)
    def parse(contents: pa.Array) -> pa.Array:
        return pa.array([one(content) for content in contents.to_pylist()], type=kind)

    return parse.asNondeterministic()


def parse_files(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Records from ``(path, length, content)`` rows; batch or streaming."""
    if mode not in ("FAILFAST", "QUARANTINE"):
        raise ValueError("mode must be FAILFAST or QUARANTINE")
    parsed = files.select(
        "path", "length", _parse_column(mode == "FAILFAST")("content").alias("parsed")
    )
    rows = parsed.select(
        F.col("path").alias("record_id"),
        "path",
        "parsed.*",
        F.col("length").alias("size_bound"),
    )
    return rows.drop("error") if mode == "FAILFAST" else rows


def read_fasta(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """``(record_id, path, header, seq, size_bound)``, ``record_id`` being the path, for a file, folder or glob.

    A bad file fails the job, or with ``QUARANTINE`` becomes a row with its ``error``.
    """
    return parse_files(spark.read.format("binaryFile").load(path), mode)


def fasta_files(records: DataFrame, name: str = "name", line_width: int = 80) -> DataFrame:
    """``(name, content)`` rows for the file sink."""
    if line_width <= 0:
        raise ValueError("lines need a width above zero")
    text = expr("fasta_text", "header", "seq", str(line_width))
    return records.select(F.col(name).alias("name"), text.cast("binary").alias("content"))
