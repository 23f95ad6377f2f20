"""Counted de Bruijn edges, their ranking, degrees and Mermaid text."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.catalog import expr
from seqloom.operators.kmers import (
    as_numbers,
    as_strings,
    as_text,
    by_record,
    count_windows,
    piece_window_counts,
    route,
    split_by_id,
    window_counts,
)


def check_graph_input(records: DataFrame, k: int) -> DataFrame:
    """Fail the job on a record too short for ``k`` (the strict, single-record behaviour)."""
    if k <= 0:
        raise ValueError("a k-mer needs a length from 1 to below the record's")
    return records.withColumn(
        "seq",
        F.when(F.length("seq") > k, F.col("seq")).otherwise(
            F.raise_error(F.lit("a k-mer needs a length from 1 to below the record's"))
        ),
    )


def debruijn_edges(
    records: DataFrame,
    k: int = 15,
    *,
    strict: bool = False,
    by_source: bool = False,
    first_uses: bool = False,
) -> DataFrame:
    """``(record_id, source, target, cnt)``.

    An edge joins the k-mers at positions i and i+1, so it is the (k+1)-mer at i.
    Records with at most ``k`` symbols have no edges, or fail the job when ``strict``.

    ``by_source`` gives a row per source instead, ``(record_id, source, targets)`` with a list of
    ``(target, cnt)``. ``first_uses`` adds ``new_source`` and ``new_target``: whether the edge is
    the first of its record's chart to use that node; null where a record's edges are spread.
    Both come without a shuffle for a record that fits one task and shares its id with no other.
    """
    if k <= 0:
        raise ValueError("a k-mer needs a length from 1 to below the record's")
    if by_source and first_uses:
        raise ValueError("edges are listed by source or marked by first uses, not both")
    if strict:
        records = check_graph_input(records, k)
    if not (by_source or first_uses):
        return _as_edges(window_counts(records, k + 1), k)
    own, shared = split_by_id(records)
    short, spread = route(own)
    # of these the edges come as rows, and meet by key
    rows = debruijn_edges(spread, k)
    if shared is not None:
        rows = rows.unionByName(debruijn_edges(shared, k))
    cells = short.select("record_id", F.col("seq").cast("binary").alias("bases"))
    if by_source:
        return _listed_by_source(cells, k).unionByName(
            rows.groupBy("record_id", "source").agg(
                F.collect_list(F.struct("target", "cnt")).alias("targets")
            )
        )
    unknown = F.lit(None).cast("boolean")
    return _marked_by_use(cells, k).unionByName(
        rows.withColumns({"new_source": unknown, "new_target": unknown})
    )


def _edges_of(text: bytes | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A record's (k+1)-mers in order, and how often each occurs."""
    found, counts, _, _ = count_windows(text or b"", k + 1)
    if k + 1 > 8:
        order = np.argsort(found.view(f"S{k + 1}").ravel(), kind="stable")
        found, counts = found[order], counts[order]
    return found, counts


def _listed_by_source(cells: DataFrame, k: int) -> DataFrame:
    def found(text: bytes | None) -> tuple[np.ndarray, ...]:
        edges, counts = _edges_of(text, k)
        begins = np.flatnonzero(np.concatenate([[True], (edges[1:, :k] != edges[:-1, :k]).any(axis=1)]))
        begins = begins[: len(edges)]
        return edges[begins, :k], np.diff(begins, append=len(edges)), edges[:, 1:], counts

    def built(sources: np.ndarray, sizes: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> list:
        items = pa.StructArray.from_arrays([as_strings(targets), pa.array(counts)], ["target", "cnt"])
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return [as_strings(sources), pa.ListArray.from_arrays(pa.array(ends), items)]

    kind = dict(cells.dtypes)["record_id"]
    schema = f"record_id {kind}, source string, targets array<struct<target: string, cnt: bigint>>"
    return cells.mapInArrow(by_record(found, built, ["source", "targets"]), schema)


def _marked_by_use(cells: DataFrame, k: int) -> DataFrame:
    def found(text: bytes | None) -> tuple[np.ndarray, ...]:
        edges, counts = _edges_of(text, k)
        order = np.argsort(-counts, kind="stable")  # as in a chart
        edges, counts = edges[order], counts[order]
        # the nodes as a chart names them: source and target of each edge
        nodes = np.stack([edges[:, :k], edges[:, 1:]], axis=1).reshape(-1, k)
        keys = as_numbers(nodes) if k <= 8 else nodes.view(f"S{k}").ravel()
        first = np.zeros(len(nodes), dtype=bool)
        first[np.unique(keys, return_index=True)[1]] = True
        return edges, counts, first[0::2], first[1::2]

    def built(edges: np.ndarray, counts: np.ndarray, *marks: np.ndarray) -> list:
        ends = (as_strings(edges[:, :k]), as_strings(edges[:, 1:]))
        return [*ends, pa.array(counts), *map(pa.array, marks)]

    kind = dict(cells.dtypes)["record_id"]
    names = ["source", "target", "cnt", "new_source", "new_target"]
    schema = f"record_id {kind}, source string, target string, cnt bigint, new_source boolean, new_target boolean"
    rows = cells.mapInArrow(by_record(found, built, names), schema)
    # never null, so that whoever asks for rows without marks does not run this
    return rows.withColumns({name: F.coalesce(name, F.lit(False)) for name in names[3:]})


def piece_edges(pieces: DataFrame, k: int = 15) -> DataFrame:
    """The edges of records that lie in pieces overlapping by ``k`` symbols, of any length."""
    if k <= 0:
        raise ValueError("a k-mer needs a length from 1 to below the record's")
    return _as_edges(piece_window_counts(pieces, k + 1), k)


def _as_edges(windows: DataFrame, k: int) -> DataFrame:
    return windows.select(
        "record_id",
        F.expr(f"CAST(substring(kmer, 1, {k}) AS STRING)").alias("source"),
        F.expr(f"CAST(substring(kmer, 2, {k}) AS STRING)").alias("target"),
        F.col("occurrences").alias("cnt"),
    )


def edges_as_map(edges: DataFrame) -> DataFrame:
    """Nested adjacency of each source: ``(record_id, source, targets MAP<STRING, BIGINT>)``.

    A source has at most one target per alphabet symbol, so the map is small. Edges that are
    listed by source stay where they are.
    """
    if "targets" not in edges.columns:
        edges = edges.groupBy("record_id", "source").agg(
            F.collect_list(F.struct("target", "cnt")).alias("targets")
        )
    return edges.select(
        "record_id", "source", F.map_from_entries(F.array_sort("targets")).alias("targets")
    )


def edges_from_map(adjacency: DataFrame) -> DataFrame:
    return adjacency.select(
        "record_id", "source", F.explode("targets").alias("target", "cnt")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``(record_id, source, out_degree, weight)``; edges listed by source stay where they are."""
    if "targets" in edges.columns:
        return edges.select(
            "record_id",
            "source",
            F.size("targets").cast("long").alias("out_degree"),
            F.expr("aggregate(targets, 0L, (n, t) -> n + t.cnt)").alias("weight"),
        )
    return edges.groupBy("record_id", "source").agg(
        F.count("*").alias("out_degree"), F.sum("cnt").alias("weight")
    )


def top_edges(
    edges: DataFrame, max_edges: int | None = None, min_count: int = 1
) -> DataFrame:
    """Edges of each record by count descending, then source, then target.

    With ``max_edges`` the rows carry ``edge_rank``, and Spark keeps only that many rows per
    record in every map task before it shuffles (window group limit), so a record with very
    many edges stays cheap. Without it the result is one global sort, which splits such a
    record over many ranges instead of ranking it in one task.
    """
    if min_count <= 0:
        raise ValueError("edges occur once or more: min_count is too small")
    if max_edges is not None and max_edges <= 0:
        raise ValueError("a limit on edges starts at 1: max_edges is too small")
    shown = edges.where(F.col("cnt") >= min_count)
    order = (F.desc("cnt"), F.col("source"), F.col("target"))
    if max_edges is None:
        return shown.orderBy("record_id", *order)
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(*order))
    return shown.withColumn("edge_rank", rank).where(F.col("edge_rank") <= max_edges)


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """``(record_id, cnt, source, target, slot, line)``, a line of the chart each.

    Sorted by ``cnt`` descending, ``source``, ``target`` and ``slot``, a record's lines are its
    chart: a node is declared in front of the first edge that uses it. Nothing is gathered by
    record, so a chart without a limit on its edges is a table like any other. ``edges`` are all
    of a record; with their ``first_uses`` a line is written where its edge lies.
    """
    if "new_source" not in edges.columns:
        return _lines_by_joins(edges)
    marked = edges.where("new_source IS NOT NULL").select(
        "record_id", "cnt", "source", "target",
        F.posexplode(F.array("new_source", "new_target", F.lit(True))).alias("slot", "shown"),
    )
    marked = marked.where("shown").withColumn("node", F.expr("IF(slot = 0, source, target)"))
    lines = marked.select(
        "record_id", "cnt", "source", "target", "slot",
        F.when(F.col("slot") < 2, _node_line("node")).otherwise(_arrow_line()).alias("line"),
    )
    return lines.unionByName(_lines_by_joins(edges.where("new_source IS NULL")))


def _node_line(node: str) -> Column:
    # The texts of nodes and edges are those of published charts.
    return F.concat(F.lit("    "), expr("mermaid_id", node), F.lit('["'), F.col(node), F.lit('"]'))


def _arrow_line() -> Column:
    return F.concat(
        F.lit("    "),
        expr("mermaid_id", "source"),
        F.lit(" -->|"),
        F.col("cnt").cast("string"),
        F.lit("| "),
        expr("mermaid_id", "target"),
    )


def _lines_by_joins(edges: DataFrame) -> DataFrame:
    """:func:`mermaid_lines` of edges without marks: nodes of a record meet by key."""
    place = F.struct((-F.col("cnt")).alias("order"), "source", "target")
    ends = edges.select(
        "record_id", place.alias("place"), F.posexplode(F.array("source", "target")).alias("slot", "node")
    )
    nodes = (
        ends.groupBy("record_id", "node")
        .agg(F.min(F.struct("place", "slot")).alias("first"))
        .select(
            "record_id",
            (-F.col("first.place.order")).alias("cnt"),
            F.col("first.place.source").alias("source"),
            F.col("first.place.target").alias("target"),
            F.col("first.slot").alias("slot"),
            _node_line("node").alias("line"),
        )
    )
    arrows = edges.select(
        "record_id", "cnt", "source", "target", F.lit(2).alias("slot"), _arrow_line().alias("line")
    )
    return nodes.unionByName(arrows)


def mermaid(records: DataFrame, edges: DataFrame, max_edges: int, min_count: int = 1) -> DataFrame:
    """``(record_id, chart)``; ``max_edges`` bounds the text. :func:`mermaid_lines` has no bound."""
    # marks are those of all edges, and do not hold for some of them
    shown = top_edges(edges, max_edges, min_count).drop("edge_rank", "new_source", "new_target")
    order = F.struct((-F.col("cnt")).alias("order"), "source", "target", "slot", "line")
    text = (
        mermaid_lines(shown)
        .groupBy("record_id")
        .agg(F.array_sort(F.collect_list(order)).alias("parts"))
        .select("record_id", F.array_join(F.col("parts.line"), "\n").alias("body"))
    )
    return records.select("record_id").join(text, "record_id", "left").select(
        "record_id",
        F.concat(
            F.lit("flowchart LR\n"),
            F.coalesce(F.col("body"), F.lit('    empty["No edges to display"]')),
        ).alias("chart"),
    )


def seed_index(records: DataFrame, k: int) -> DataFrame:
    """Repeated k-mers: first position, occurrences and how many (earlier, later) pairs they make.

    The pair count is arithmetic; pairs are never listed, so a k-mer that fills a third of a
    record costs as much as any other.
    """
    return (
        window_counts(records, k)
        .where(F.col("occurrences") > 1)
        .select(
            "record_id",
            as_text("kmer").alias("kmer"),
            "first_pos",
            "last_pos",
            "occurrences",
            F.expr("occurrences * (occurrences - 1) DIV 2").alias("pairs"),
        )
    )
