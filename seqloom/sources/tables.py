"""Sequence tables derived from ordinary text tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.formats import ALPHABET, PACKED_ALPHABET
from seqloom.session import rebalance


def keep_symbols(text: Column, alphabet: str) -> Column:
    """Upper-case and drop everything outside the alphabet."""
    return F.regexp_replace(F.upper(text), f"[^{alphabet}]+", "")


def records_from_text(
    df: DataFrame,
    id_column: str,
    text_column: str,
    *,
    alphabet: str = ALPHABET,
    size_column: str | None = None,
    dealt_out: bool = False,
) -> DataFrame:
    """``(record_id, header, seq, size_bound)``, one record per row of a text table.

    ``size_bound`` bounds the length of ``seq`` without cleaning the text (no character gives
    more than one symbol): the table's own character count where it has one, so that looking
    for long records reads one narrow column and skips row groups by their statistics.

    ``dealt_out`` moves the rows once, by size, before the text is cleaned: for tables stored in
    fewer splits than there are cores. Other tables need no shuffle.
    """
    size = F.col(size_column) if size_column else F.octet_length(text_column)
    source = df.select(
        id_column, text_column, *([size_column] if size_column else [])
    )
    return (rebalance(source, id_column) if dealt_out else source).select(
        F.col(id_column).cast("long").alias("record_id"),
        F.concat(F.lit(f">{id_column}_"), F.col(id_column).cast("string")).alias("header"),
        keep_symbols(F.col(text_column), alphabet).alias("seq"),
        size.cast("long").alias("size_bound"),
    )


def documents(spark: SparkSession, folder: str, *, alphabet: str = ALPHABET) -> DataFrame:
    return records_from_text(
        spark.read.parquet(f"{folder}/documents.parquet"),
        "doc_id",
        "text",
        alphabet=alphabet,
        size_column="n_chars",
        dealt_out=True,
    )


def documents_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents restricted to the four packable symbols."""
    return documents(spark, folder, alphabet=PACKED_ALPHABET)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/pages.parquet")
    return records_from_text(table, "page_id", "html", dealt_out=True)
