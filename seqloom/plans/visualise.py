"""Markdown report with the strongest de Bruijn edges of each record."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import graph


def report_files(
    records: DataFrame, *, k: int = 15, max_edges: int = 50, min_count: int = 1
) -> DataFrame:
    """``(record_id, content)``; a record with at most ``k`` symbols fails the job."""
    edges = graph.debruijn_edges(records, k, strict=True)
    charts = graph.mermaid(records, edges, max_edges, min_count)
    source = F.element_at(F.split("path", "/"), -1) if "path" in records.columns else F.col(
        "record_id"
    ).cast("string")
    facts = records.select(
        "record_id", source.alias("source"), "header", F.length("seq").alias("length")
    )
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("# de Bruijn graph for "), F.col("source")),
        F.lit(""),
        F.concat(F.lit("- header: `"), F.col("header"), F.lit("`")),
        F.concat(F.lit("- sequence length: `"), F.col("length").cast("string"), F.lit("`")),
        F.lit(f"- k: `{json.dumps(k)}`"),
        F.lit(f"- min edge count shown: `{min_count}`"),
        F.lit(f"- max edges shown: `{max_edges}`"),
        F.lit(""),
        F.lit("```mermaid"),
        F.col("chart"),
        F.lit("```"),
        F.lit(""),
    )
    return facts.join(charts, "record_id").select(
        "record_id", lines.cast("binary").alias("content")
    )
