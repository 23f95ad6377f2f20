"""Per-record complexity measures."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.formats import ALPHABET
from seqloom.functions.catalog import expr
from seqloom.functions.matching import lz76_phrases


@F.pandas_udf(T.LongType())
def lz76(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """LZ76 phrase count. Each phrase starts where the last one ended, so a record is one pass."""
    for seqs in batches:
        yield seqs.map(lz76_phrases, na_action="ignore")


def composition(records: DataFrame) -> DataFrame:
    """Length, GC fraction and Shannon entropy, without leaving the scan stage."""
    return records.select(
        "record_id",
        F.length("seq").cast("long").alias("length"),
        expr("gc_fraction", "seq").alias("gc_fraction"),
        expr("shannon_bits", "seq").alias("shannon_bits_per_base"),
    )


def complexity(records: DataFrame, bits_per_base: Column | None = None) -> DataFrame:
    bpb = F.lit(None) if bits_per_base is None else bits_per_base
    rows = records.select("record_id", "seq", bpb.cast("double").alias("bits_per_base"))
    return rows.select(
        "record_id",
        F.length("seq").cast("long").alias("length"),
        expr("gc_fraction", "seq").alias("gc_fraction"),
        expr("shannon_bits", "seq").alias("shannon_bits_per_base"),
        lz76("seq").alias("lz76_complexity"),
        "bits_per_base",
    )


def composition_of_pieces(records: DataFrame, pieces: DataFrame) -> DataFrame:
    """:func:`composition` of records that lie in pieces: each is counted where it lies.

    ``records`` names the records, as one without symbols has no piece. A piece sends one number
    per symbol of the alphabet and nothing else.
    """
    text = F.col("bases").cast("string")
    counts = [F.sum(F.length("t") - F.length(F.replace("t", F.lit(s), F.lit("")))).alias(s) for s in ALPHABET]
    sums = pieces.select("record_id", text.alias("t")).groupBy("record_id").agg(
        F.sum(F.length("t")).alias("length"), *counts
    )
    share = [F.try_divide(F.col(s).cast("double"), F.col("length").cast("double")) for s in ALPHABET]
    bits = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0))
    return records.select("record_id").join(sums, "record_id", "left").select(
        "record_id",
        F.coalesce("length", F.lit(0)).cast("long").alias("length"),
        F.coalesce(F.try_divide((F.col("G") + F.col("C")).cast("double"), F.col("length").cast("double")), F.lit(0.0)).alias("gc_fraction"),
        F.coalesce(bits, F.lit(0.0)).alias("shannon_bits_per_base"),
    )
