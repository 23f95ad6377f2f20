"""

All queries run over whole tables and whole texts.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_queries
from seqloom.formats import COPY, PACKED_ALPHABET, RAW, VARIANTS
from seqloom.functions import table_functions
from seqloom.functions.catalog import expr, register, sql
from seqloom.functions.queued import CELLS, decode_records, encode_records
from seqloom.operators import blocks, complexity, graph, kmers, lz76_joins, markov, repeats
from seqloom.operators.residual import ModelCodec, PlainCodec
from seqloom.operators.token_models import UniformModel, train_markov, train_stretches
from seqloom.plans import archive_v1, archive_v2, benchmark, restoring_by_joins
from seqloom.session import cut_lineage, rebalance, scratch_folder, ship_package
from seqloom.sources import archive_blocks, fasta, files, tables
from seqloom.sources import fasta_pieces as fasta_pieces_source

try:  # the package for training data and its pipeline may be left out
    import corpus_pipeline
    from seqloom.llm import queries as llm_queries
except ModuleNotFoundError as error:
    if not (error.name == "corpus_pipeline" or str(error.name).startswith("seqloom.llm")):
        raise
    corpus_pipeline = llm_queries = None

SMALL = "/root/testdata/sf0.001"
CONTEXT = 1024
Query = Callable[[SparkSession, str], DataFrame]


def model_codec() -> ModelCodec:
    """For plans and sizes, which depend on the codec's chunks and not on its frequencies."""
    return ModelCodec(UniformModel(CONTEXT))


def trained_codec(records: DataFrame, order: int, context: int = CONTEXT) -> ModelCodec:
    return ModelCodec(train_markov(records, order, context_length=context))


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder)


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents_packed(spark, folder)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder)


# --- text ------------------------------------------------------------------


def fasta_text(spark, folder):
    """Records written as FASTA text and read back."""
    return (
        docs(spark, folder)
        .withColumn("text", expr("fasta_text", "header", "seq", "80"))
        .withColumn("body", F.expr("substring(text, length(header) + 2)"))
        .select(
            "record_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.length("text").cast("long").alias("text_length"),
            F.sha2(expr("normalise_sequence", "body"), 256).alias("seq_sha256"),
        )
    )


def fasta_normalise(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    return rows.select(
        F.col("doc_id").alias("record_id"), expr("normalise_sequence", "text").alias("seq")
    )


def alphabet_violations(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    return rows.select(
        F.col("doc_id").alias("record_id"), expr("alphabet_violations", "text").alias("symbols")
    )


def seq_checksum(spark, folder):
    return docs(spark, folder).select(
        "record_id",
        F.length("seq").cast("long").alias("length"),
        expr("sequence_checksum", "seq").alias("sha256"),
    )


def context_tails(spark, folder):
    """The symbols before each chunk of 100."""
    rows = docs(spark, folder).select(
        "record_id", "seq", F.explode(F.expr("sequence(0L, length(seq), 100L)")).alias("start")
    )
    return rows.select(
        "record_id", "start", expr("context_tail", "seq", "start", "64L").alias("context")
    )


FASTA_PIECE = 1000  # bytes a range, so that ranges meet lines and headers in every way


def _fasta_pieces(spark, folder):
    """All documents with symbols, written as FASTA files and read back by byte ranges."""
    target = f"{scratch_folder(spark).rstrip('/')}/fasta-{uuid.uuid4().hex}"
    named = docs(spark, folder).where("seq <> ''").withColumn("name", F.expr("concat(record_id, '.fa')"))
    files.write_files(fasta.fasta_files(named), target)
    key = F.expr("CAST(regexp_extract(record_id, '([0-9]+)[.]fa$', 1) AS BIGINT)")
    heads, pieces = fasta_pieces_source.read_pieces(spark, target, pieceBytes=FASTA_PIECE)
    return heads.withColumn("record_id", key), pieces.withColumn("record_id", key)


def fasta_pieces(spark, folder):
    """Where each piece lies in its record, and its symbols."""
    heads, pieces = _fasta_pieces(spark, folder)
    return pieces.join(heads, "record_id").select(
        "record_id",
        "header",
        F.col("length").alias("record_length"),
        "offset",
        F.octet_length("bases").cast("long").alias("length"),
        F.sha2("bases", 256).alias("sha256"),
    )


def fasta_piece_edges(spark, folder):
    """Edges of records that are in no cell as a whole."""
    _, pieces = _fasta_pieces(spark, folder)
    return graph.piece_edges(fasta_pieces_source.recut(pieces, 16, 512), 15)


# --- k-mers and graph ------------------------------------------------------


def kmer_counts(spark, folder):
    return kmers.kmer_counts(docs(spark, folder), 6)


def kmer_sql(spark, folder):
    """The same k-mers through the registered SQL function."""
    register(spark)
    docs(spark, folder).createOrReplaceTempView("sequence_records")
    return spark.sql(
        """SELECT record_id, kmer, count(*) AS occurrences
        FROM (SELECT record_id, kmers(seq, 4) AS listed FROM sequence_records)
        LATERAL VIEW explode(listed) AS kmer
        GROUP BY record_id, kmer"""
    )


def debruijn_edges(spark, folder):
    return graph.debruijn_edges(docs(spark, folder), 15)


def debruijn_adjacency(spark, folder):
    """Nested adjacency and back."""
    nested = graph.edges_as_map(graph.debruijn_edges(docs(spark, folder), 5, by_source=True))
    return graph.edges_from_map(nested)


def debruijn_degrees(spark, folder):
    return graph.degrees(graph.debruijn_edges(docs(spark, folder), 6, by_source=True))


def edges_topk(spark, folder):
    edges = graph.debruijn_edges(docs(spark, folder), 6)
    return graph.top_edges(edges, 50, 2).withColumn("edge_rank", F.col("edge_rank").cast("long"))


def mermaid_charts(spark, folder):
    records = docs(spark, folder)
    return graph.mermaid(records, graph.debruijn_edges(records, 6), 20, 2)


def mermaid_all_lines(spark, folder):
    """Charts without a limit on their edges, as ordered lines."""
    edges = graph.debruijn_edges(docs(spark, folder), 4, first_uses=True)
    return graph.mermaid_lines(edges).select(
        "record_id", "cnt", "source", "target", F.col("slot").cast("long").alias("slot"), "line"
    )


def output_names(spark, folder):
    """File names for records of all documents, and how many records would share each."""
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    path = F.concat(F.lit("in/"), "source", F.lit("/doc.v"), F.col("doc_id") % 1000, F.lit(".fa"))
    named = rows.select("doc_id", F.concat(path).alias("path")).select(
        "doc_id", F.concat(expr("file_stem", "path"), F.lit(".ghdna")).alias("name")
    )
    shared = named.groupBy("name").agg(F.count("*").alias("inputs"))
    return named.join(shared, "name")


def mermaid_node_ids(spark, folder):
    parts = spark.read.parquet(f"{folder}/part.parquet")
    return parts.select(
        "p_partkey",
        expr("mermaid_id", "p_name").alias("name_id"),
        expr("mermaid_id", "CAST(p_size AS STRING)").alias("size_id"),
    )


# --- repeats ---------------------------------------------------------------


def seed_index(spark, folder):
    return graph.seed_index(docs(spark, folder), 15)


def best_sources(spark, folder):
    return repeats.best_sources(docs(spark, folder), 15, 40)


def graph_repeats(spark, folder):
    return repeats.graph_repeats(docs(spark, folder), 15, 40)


def graph_repeats_pages(spark, folder):
    return repeats.graph_repeats(pages(spark, folder), 12, 24)


def graph_repeats_overlap(spark, folder):
    """Seeds as long as the shortest copy: a bare seed may overlap its source."""
    return repeats.graph_repeats(docs(spark, folder), 15, 15, allow_overlap=True)


def graph_repeats_by_joins(spark, folder):
    """Every record through the position-parallel search meant for long records."""
    return repeats.graph_repeats(docs(spark, folder), 15, 40, local_bases=0)


# --- blocks and planner ----------------------------------------------------


def v1_blocks(spark, folder):
    return archive_v1.blocks(docs(spark, folder)).select(
        "record_id",
        F.col("block_no").cast("long").alias("block_no"),
        "type",
        "start",
        "length",
        "source",
        "seq",
        F.round("lm_bits", 6).alias("lm_bits"),
    )


def _block_rows(coded):
    return coded.select(
        "record_id",
        F.col("block_no").cast("long").alias("block_no"),
        "type",
        "start",
        "length",
        "source",
        "symbol_count",
        "bit_length",
        "payload_offset",
        "payload_length",
        "use_context",
        F.hex("payload").alias("payload"),
    )


def v2_blocks_plain(spark, folder):
    planned = blocks.plan(repeats.with_copies(docs(spark, folder)), PlainCodec())
    return _block_rows(archive_v2.encoded_blocks(planned, PlainCodec()).where("type IS NOT NULL"))


def v2_raw_blocks(spark, folder):
    """Short residuals of the model family: packed bytes and their length."""
    codec = model_codec()
    planned = blocks.plan(repeats.with_copies(packed(spark, folder)), codec, "force_graph")
    return (
        blocks.explode_blocks(planned, codec)
        .where(F.col("type") == RAW)
        .select(
            "record_id",
            "start",
            "length",
            F.hex(expr("pack_bases", "text")).alias("payload"),
        )
    )


def chunk_plan(spark, folder):
    codec = model_codec()
    planned = blocks.plan(repeats.with_copies(packed(spark, folder)), codec, "force_graph")
    return (
        blocks.explode_blocks(planned, codec)
        .where("type IS NOT NULL")
        .select(
            "record_id",
            F.col("block_no").cast("long").alias("block_no"),
            "type",
            "start",
            "length",
            "source",
            "use_context",
            F.when(F.col("type") != COPY, F.sha2("text", 256)).alias("text_sha256"),
            F.sha2("context", 256).alias("context_sha256"),
        )
    )


def prune_repeats(spark, folder):
    copied = repeats.with_copies(packed(spark, folder))
    return (
        copied.select("record_id", blocks.pruned_column().alias("kept"))
        .select("record_id", F.explode("kept").alias("copy"))
        .select("record_id", "copy.*")
    )


def plan_cost(spark, folder):
    """Estimated size and fragmentation of keeping every copy."""
    rows = blocks.with_blocks(
        repeats.with_copies(packed(spark, folder)), model_codec(), "copies", "blocks"
    )
    return rows.select(
        "record_id",
        F.expr(blocks.estimated_bytes("blocks")).alias("estimated_bytes"),
        F.expr(blocks.too_fragmented("blocks", "length(seq)")).alias("fragmented"),
    )


def candidate_choice(spark, folder):
    planned = blocks.plan(repeats.with_copies(packed(spark, folder)), model_codec(), "auto")
    return planned.select(
        "record_id",
        F.col("candidate_count").cast("long").alias("candidate_count"),
        "selected_candidate",
        "selected_estimated_bytes",
        F.size("kept").cast("long").alias("selected_repeat_count"),
    )


def diagnostics_plain(spark, folder):
    return archive_v2.compress(docs(spark, folder)).select(
        "record_id",
        "length",
        *[name for name in archive_v2.DIAGNOSTICS if name != "graph_copy_fraction"],
        F.round("graph_copy_fraction", 9).alias("graph_copy_fraction"),
    )


# --- statistics ------------------------------------------------------------


def markov_counts(spark, folder):
    return markov.count_rows(markov.fit(docs(spark, folder), 3))


def markov_bits(spark, folder):
    bits = markov.record_bits(docs(spark, folder), 3)
    return bits.select("record_id", F.round("bits", 6).alias("bits"))


def markov_trained(spark, folder):
    """One model over all records (the model of the arithmetic codec)."""
    rows = docs(spark, folder)
    counts = markov.context_counts(markov.checked_alphabet(rows), [], 2)
    return markov.count_rows(counts.withColumn("record_id", F.lit(0))).drop("record_id")


def composition(spark, folder):
    rows = complexity.composition(docs(spark, folder))
    return rows.select(
        "record_id",
        "length",
        F.round("gc_fraction", 9).alias("gc_fraction"),
        F.round("shannon_bits_per_base", 6).alias("shannon_bits_per_base"),
    )


def lz76(spark, folder):
    return docs(spark, folder).select("record_id", complexity.lz76("seq").alias("lz76_complexity"))


def lz76_by_joins(spark, folder):
    """Phrases of all documents without a record in any task."""
    return lz76_joins.lz76_by_joins(docs(spark, folder))


def sequence_complexity(spark, folder):
    records = docs(spark, folder)
    rows = complexity.complexity(records, F.lit(8.0) / (F.length("seq") + 1))
    return rows.select(
        "record_id",
        "length",
        F.round("gc_fraction", 9).alias("gc_fraction"),
        F.round("shannon_bits_per_base", 6).alias("shannon_bits_per_base"),
        "lz76_complexity",
        F.round("bits_per_base", 9).alias("bits_per_base"),
    )


def block_metrics(spark, folder):
    """Blocks by kind and bits per base of the block table and payload."""
    rows = archive_v2.compress(docs(spark, folder))
    return rows.select(
        "record_id",
        "graph_copy_blocks",
        (F.col("llm_residual_blocks") + F.col("raw_residual_blocks")).alias("residual_blocks"),
        F.expr(
            """round((13 * graph_copy_blocks + 26 * llm_residual_blocks
            + 17 * raw_residual_blocks + payload_bytes) * 8D / nullif(length, 0), 6)"""
        ).alias("body_bits_per_base"),
    )


# --- bits and coding -------------------------------------------------------


def _in_pieces(records, width=1, positions=4096):
    """Records in aligned pieces, none of them in a cell."""
    return fasta_pieces_source.recut(kmers.chunks(records, 1, positions=1000), width, positions)


def composition_by_pieces(spark, folder):
    records = docs(spark, folder)
    rows = complexity.composition_of_pieces(records, _in_pieces(records))
    return rows.select(
        "record_id",
        "length",
        F.round("gc_fraction", 9).alias("gc_fraction"),
        F.round("shannon_bits_per_base", 6).alias("shannon_bits_per_base"),
    )


def pack_by_pieces(spark, folder):
    """Two bits a symbol and one bit a symbol, each piece at its own byte of the record."""
    pieces = _in_pieces(packed(spark, folder))
    text = "CAST(bases AS STRING)"
    return pieces.select(
        "record_id",
        F.expr("offset DIV 4").alias("byte_offset"),
        F.hex(expr("pack_bases", text)).alias("payload"),
        F.expr("offset DIV 8").alias("bit_byte_offset"),
        F.hex(expr("pack_bit_text", f"translate({text}, 'ACGT', '1010')")).alias("purines"),
    )


def pack_2bit(spark, folder):
    return packed(spark, folder).select(
        "record_id", F.hex(expr("pack_bases", "seq")).alias("payload")
    )


def roundtrip_2bit(spark, folder):
    rows = packed(spark, folder).select(
        "record_id", F.length("seq").alias("n"), expr("pack_bases", "seq").alias("payload")
    )
    return rows.select("record_id", expr("unpack_bases", "payload", "n").alias("seq"))


def roundtrip_bits(spark, folder):
    """One bit per symbol (purine or not), packed and unpacked."""
    bits = sql("unpack_bits", sql("pack_bits", "bits"), "size(bits)")
    rows = docs(spark, folder).select(
        "record_id",
        F.expr(
            """transform(filter(split(seq, ''), c -> c <> ''),
            c -> IF(c IN ('A', 'G'), 1, 0))"""
        ).alias("bits"),
    )
    return rows.select(
        "record_id",
        F.hex(expr("pack_bits", "bits")).alias("payload"),
        F.expr(f"array_join({bits}, '')").alias("bits"),
    )


def block_table_hex(spark, folder):
    planned = blocks.plan(repeats.with_copies(docs(spark, folder)), PlainCodec())
    rows = archive_v2.encoded_blocks(planned, PlainCodec()).where("type IS NOT NULL")
    return rows.select(
        "record_id",
        F.col("block_no").cast("long").alias("block_no"),
        F.expr(archive_v2.block_entry_hex()).alias("entry"),
    )


def block_table_model(spark, folder):
    """Block tables of model archives, read back: copies, coded and packed residuals, contexts."""
    cells = archive_v2.compress(packed(spark, folder), model_codec(), policy="force_graph")
    rows = archive_v2.scan(cells).select("record_id", F.posexplode("blocks").alias("block_no", "b"))
    return rows.select(
        "record_id",
        F.col("block_no").cast("long").alias("block_no"),
        "b.type",
        "b.start",
        "b.length",
        "b.source",
        F.coalesce("b.use_context", F.lit(False)).alias("use_context"),
        "b.symbol_count",
        F.expr(f"IF(b.type = '{RAW}', b.payload_length, NULL)").alias("raw_bytes"),
    )


def _symbol_weights(spark, folder):
    counts = ", ".join(
        f"CAST(length(seq) - length(replace(seq, '{s}', '')) AS DOUBLE)" for s in "ACGTN"
    )
    return docs(spark, folder).select(
        "record_id", "seq", F.expr(f"IF(seq = '', NULL, array({counts}))").alias("weights")
    )


def _own_cdf(rows):
    """Integer frequencies of each record's symbols; null for an empty record."""
    cdf = sql("integer_cdf", "weights", "32768")
    return rows.withColumn("cdf", F.expr(f"CASE WHEN weights IS NOT NULL THEN {cdf} END"))


def integer_cdf(spark, folder):
    rows = _own_cdf(_symbol_weights(spark, folder))
    raw = "transform(sequence(1, 5), i -> CAST(aggregate(slice(weights, 1, i), 0D, (t, w) -> t + w) AS BIGINT))"
    return rows.select(
        "record_id",
        F.array_join(F.col("cdf").cast("array<string>"), ",").alias("cdf"),
        F.expr(f"IF(cdf IS NULL, NULL, {sql('cdf_is_valid', 'cdf')})").alias("valid"),
        F.expr(f"IF(cdf IS NULL, NULL, {sql('cdf_is_valid', raw)})").alias("raw_valid"),
    )


def ideal_bits(spark, folder):
    """Code length of each record under its own symbol frequencies."""
    rows = _own_cdf(_symbol_weights(spark, folder))
    bits = " + ".join(
        f"IF(weights[{i}] = 0, 0D, weights[{i}] * {sql('interval_bits', 'cdf', str(i))})"
        for i in range(5)
    )
    return rows.select("record_id", F.expr(f"round(IF(cdf IS NULL, 0D, {bits}), 3)").alias("bits"))


def coder_bits(spark, folder):
    """Whole records through the arithmetic coder under their own order-0 frequencies.

    ``near_ideal``: the code is at most two bits longer than the ideal and decodes to the record.
    """
    rows = _own_cdf(_symbol_weights(spark, folder))
    ids = bytes.maketrans(b"ACGTN", bytes(range(5)))

    def sizes(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(batches).combine_chunks()
        tokens = [np.frombuffer(seq.translate(ids), np.uint8) for seq in held["bases"].to_pylist()]
        tables = held["cdf"].to_pylist()
        cells = encode_records(tokens, tables)
        backs = decode_records(cells, [len(t) for t in tokens], tables)
        found = [
            (bits if len(t) else 0) if np.array_equal(t, back) else None
            for t, (_, bits), back in zip(tokens, cells, backs, strict=True)
        ]
        columns = [held["record_id"].combine_chunks(), held["ideal"].combine_chunks(), pa.array(found, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["record_id", "ideal", "bit_length"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, symbols = [], 0
        for batch in batches:  # records of many batches are coded together
            held.append(batch)
            symbols += batch.column(2).nbytes
            if symbols >= CELLS:
                yield sizes(held)
                held, symbols = [], 0
        if held:
            yield sizes(held)

    bits = " + ".join(
        f"IF(weights[{i}] = 0, 0D, weights[{i}] * {sql('interval_bits', 'cdf', str(i))})"
        for i in range(5)
    )
    rows = rows.select(
        "record_id",
        F.expr(f"IF(cdf IS NULL, 0D, {bits})").alias("ideal"),
        F.col("seq").cast("binary").alias("bases"),
        "cdf",
    )
    # texts are a few times as long as their symbols: dealt out again, a task has more of these
    kind = dict(rows.dtypes)["record_id"]
    rows = rebalance(rows, "record_id").mapInArrow(coded, f"record_id {kind}, ideal double, bit_length bigint")
    return rows.select(
        "record_id",
        F.expr("round(ideal, 3)").alias("ideal_bits"),
        F.expr("bit_length <= floor(ideal + 0.000001D) + 2").alias("near_ideal"),
    )


def roundtrip_plain(spark, folder):
    """Plain framing of whole records."""
    coded = docs(spark, folder).select(
        "record_id", PlainCodec().encode_column(F.col("seq"), F.lit("")).alias("coded")
    )
    return coded.select(
        "record_id",
        F.col("coded.payload").cast("string").alias("seq"),
        F.col("coded.bit_length").alias("bit_length"),
        F.col("coded.symbol_count").alias("symbol_count"),
    )


def _restored(rows):
    return rows.select(
        "record_id", "header", F.sha2("seq", 256).alias("sha256"),
        F.length("seq").cast("long").alias("length"),
    )


def roundtrip_model(spark, folder):
    """Adaptive plan, arithmetic coding with context, binary archive and back."""
    records = packed(spark, folder)
    codec = trained_codec(records, 3)
    return _restored(archive_v2.decompress(archive_v2.compress(records, codec), codec))


def roundtrip_model_forced(spark, folder):
    """All copies kept; residuals in short chunks under a model of high order."""
    records = packed(spark, folder)
    codec = trained_codec(records, 7, 256)
    return _restored(
        archive_v2.decompress(archive_v2.compress(records, codec, policy="force_graph"), codec)
    )


STRETCH = 4  # symbols a token


def _stretch_codec(records):
    return ModelCodec(train_stretches(records, STRETCH, context_length=100))


def token_chunk_plan(spark, folder):
    """Chunks of at most so many tokens of several symbols, and where context may be used."""
    records = packed(spark, folder)
    codec = _stretch_codec(records)
    planned = blocks.plan(repeats.with_copies(records), codec, "force_graph")
    return (
        blocks.explode_blocks(planned, codec)
        .where("type IS NOT NULL")
        .select(
            "record_id",
            F.col("block_no").cast("long").alias("block_no"),
            "type",
            "start",
            "length",
            "source",
            "use_context",
            F.sha2("context", 256).alias("context_sha256"),
        )
    )


def roundtrip_tokens(spark, folder):
    """Binary archives under a model whose tokens are several symbols."""
    records = packed(spark, folder)
    codec = _stretch_codec(records)
    return _restored(archive_v2.decompress(archive_v2.compress(records, codec, policy="force_graph"), codec))


def roundtrip_v1(spark, folder):
    return _restored(archive_v1.decompress(archive_v1.compress(docs(spark, folder))))


def roundtrip_v2(spark, folder):
    return _restored(archive_v2.decompress(archive_v2.compress(docs(spark, folder))))


def roundtrip_any(spark, folder):
    """Every record in both archive formats, in one column, told apart by the first bytes."""
    records = docs(spark, folder)
    json_cells = archive_v1.compress(records).select(
        "record_id", F.col("archive").cast("binary").alias("archive")
    )
    binary_cells = archive_v2.compress(records).select("record_id", "archive")
    return _restored(archive_v1.decompress_any(json_cells.unionByName(binary_cells)))


def _archive_folder(spark, folder):
    """All documents as binary archives, a file each."""
    target = f"{scratch_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    cells = archive_v2.compress(docs(spark, folder))
    named = cells.select(F.expr("concat(record_id, '.ghdna')").alias("name"), F.col("archive").alias("content"))
    files.write_files(named, target)
    return target


_ARCHIVE_ID = "CAST(regexp_extract(path, '([0-9]+)[.]ghdna$', 1) AS BIGINT)"


def archive_files_scan(spark, folder):
    """Block rows of archive files, of which only header and block table are read."""
    rows = archive_blocks.scan_blocks(spark, _archive_folder(spark, folder))
    return rows.select(F.expr(_ARCHIVE_ID).alias("record_id"), *[
        "block_no", "type", "start", "length", "source", "symbol_count", "bit_length",
        "payload_offset", "payload_length",
    ])


def archive_files_payloads(spark, folder):
    """Payloads of the longer residuals that are not their archive's first block."""
    rows = archive_blocks.scan_blocks(spark, _archive_folder(spark, folder), payload=True)
    long = rows.where("type = 'llm_residual' AND length >= 20 AND block_no > 0")
    return long.select(
        F.expr(_ARCHIVE_ID).alias("record_id"), "block_no", "start", "length", F.hex("payload").alias("payload")
    )


def roundtrip_by_joins(spark, folder):
    """Both archive formats restored without a record in any cell."""
    records = docs(spark, folder)
    written = archive_v1.compress(records)
    json_tiles = archive_v1.tile_rows(written)
    binary_tiles = archive_v2.tile_rows(archive_v2.compress(records))
    both = []
    for about, tiles in (json_tiles, binary_tiles):
        about, tiles = cut_lineage(about), cut_lineage(tiles)
        pieces = restoring_by_joins.restored_pieces(tiles, about)
        both.append(restoring_by_joins.verified(pieces, about))
    return both[0].unionByName(both[1])


def archive_scan(spark, folder):
    """Block rows read back from binary archives."""
    opened = archive_v2.scan(archive_v2.compress(docs(spark, folder)))
    return opened.select("record_id", F.posexplode("blocks").alias("block_no", "b")).select(
        "record_id",
        F.col("block_no").cast("long").alias("block_no"),
        "b.type",
        "b.start",
        "b.length",
        "b.source",
        "b.symbol_count",
        "b.bit_length",
        "b.payload_offset",
        "b.payload_length",
    )


def archive_metadata(spark, folder):
    """What the metadata of both formats says, asked for by path."""
    records = docs(spark, folder)
    json_cells = archive_v1.compress(records).select(
        "record_id", F.lit("json").alias("format"), F.try_parse_json("archive").alias("metadata")
    )
    binary = archive_v2.front(archive_v2.compress(records)).select(
        "record_id", F.lit("binary").alias("format"), "metadata"
    )
    wanted = {
        "magic": "string", "length": "bigint", "sha256": "string", "parameters.k": "bigint",
        "parameters.lm_order": "bigint", "residual_codec": "string", "diagnostics.payload_bytes": "bigint",
        "block_table_count": "bigint",
    }
    return json_cells.unionByName(binary).select(
        "record_id",
        "format",
        *[F.try_variant_get("metadata", f"$.{path}", kind).alias(path.split(".")[-1]) for path, kind in wanted.items()],
        F.expr("schema_of_variant(variant_get(metadata, '$.parameters')) LIKE 'OBJECT<%'").alias("has_parameters"),
    )


def blocks_by_lateral(spark, folder):
    """Block tables cut out of archives and listed by a table function."""
    table_functions.register(spark)
    archive_v2.front(archive_v2.compress(docs(spark, folder))).createOrReplaceTempView("archive_fronts")
    return spark.sql(
        """SELECT record_id, b.type, b.start, b.length, b.source, b.symbol_count, b.bit_length,
            b.payload_offset, b.payload_length
        FROM archive_fronts, LATERAL decode_blocks(block_table) AS b"""
    )


def repeats_by_table_function(spark, folder):
    table_functions.register(spark)
    docs(spark, folder).createOrReplaceTempView("sequence_records")
    return spark.sql("SELECT * FROM repeats_of(TABLE(sequence_records), 15, 40)")


def digest_by_table_function(spark, folder):
    """Pieces of each record read in order by a table function."""
    table_functions.register(spark)
    _in_pieces(docs(spark, folder), positions=500).createOrReplaceTempView("sequence_pieces")
    return spark.sql("SELECT * FROM digest_of(TABLE(sequence_pieces) PARTITION BY record_id ORDER BY offset)")


def archive_scan_v1(spark, folder):
    """Block rows parsed from JSON archives."""
    return archive_v1.parse_blocks(archive_v1.compress(docs(spark, folder))).select(
        "record_id",
        F.col("block_no").cast("long").alias("block_no"),
        "type",
        "start",
        "length",
        "source",
        "seq",
    )


# --- benchmark -------------------------------------------------------------


def bench_variants(spark, folder):
    """What each variant does with each record."""
    rows = benchmark.variant_sizes(packed(spark, folder), VARIANTS, model_codec())
    return rows.select(
        "name",
        "record_id",
        "candidate_count",
        "selected_candidate",
        "selected_estimated_bytes",
        "selected_repeat_count",
        "graph_copy_blocks",
        "residual_blocks",
        "graph_copy_bases",
        "residual_bases",
        "llm_residual_blocks",
        "raw_residual_blocks",
        "context_residual_blocks",
        "raw_residual_payload_bytes",
    )


def variant_sizes_measured(spark, folder):
    """Archive and payload bytes of each variant, measured in the job that writes the archives."""
    target = f"{scratch_folder(spark).rstrip('/')}/variants-{uuid.uuid4().hex}"
    # the model learns from the table that the variants read, so texts are cleaned once
    records = cut_lineage(repeats.with_copies(packed(spark, folder)))
    rows = benchmark.measured_variants(records, VARIANTS, trained_codec(records, 3), target)
    names = ("records", "compressed_size", "payload_bytes", *(n for n in benchmark.SUMMED if n != "payload_bytes"))
    schema = "name string, " + ", ".join(f"{name} bigint" for name in names)
    return spark.createDataFrame([(r["name"], *(r[n] for n in names)) for r in rows], schema)


def bench_variant_totals(spark, folder):
    """Blocks, bases and raw bytes of each variant over all records."""
    rows = benchmark.variant_sizes(packed(spark, folder), VARIANTS, model_codec())
    return benchmark.totals(rows).drop("variant_no", "compressed_size")


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark, folder):
        ship_package(spark)
        return query(spark, folder)

    return run


def queries() -> dict[str, Query]:
    listed = (
        fasta_text, fasta_pieces, fasta_piece_edges, fasta_normalise, alphabet_violations, seq_checksum, context_tails,
        kmer_counts, kmer_sql, debruijn_edges, debruijn_adjacency, debruijn_degrees, edges_topk,
        mermaid_charts, mermaid_all_lines, mermaid_node_ids, output_names,
        seed_index, best_sources, graph_repeats, graph_repeats_pages, graph_repeats_overlap,
        graph_repeats_by_joins,
        v1_blocks, v2_blocks_plain, v2_raw_blocks, chunk_plan, prune_repeats, plan_cost,
        candidate_choice, diagnostics_plain,
        markov_counts, markov_bits, markov_trained, composition, lz76, lz76_by_joins, sequence_complexity,
        block_metrics,
        composition_by_pieces, pack_by_pieces, pack_2bit, roundtrip_2bit, roundtrip_bits, block_table_hex, block_table_model, integer_cdf, ideal_bits, coder_bits,
        roundtrip_plain, roundtrip_model, roundtrip_model_forced, token_chunk_plan, roundtrip_tokens, roundtrip_v1, roundtrip_v2,
        roundtrip_any, roundtrip_by_joins, archive_scan, archive_scan_v1,
        archive_files_scan, archive_files_payloads, archive_metadata,
        blocks_by_lateral, repeats_by_table_function, digest_by_table_function,
        bench_variants, bench_variant_totals, variant_sizes_measured,
    )
    named = {query.__name__: query for query in listed}
    if llm_queries:
        named |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return {name: _shipped(query) for name, query in named.items()}


def oracle_sql() -> dict[str, str]:
    named = oracle_queries.all_queries()
    if llm_queries:
        named |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            named["pipeline"] = corpus_pipeline.ORACLE_SQL
    return named


def entry(spark: SparkSession) -> DataFrame:
    """Most frequent de Bruijn edges of every record."""
    ship_package(spark)
    edges = graph.debruijn_edges(docs(spark, SMALL), 15)
    return graph.top_edges(edges, 10).orderBy("record_id", "edge_rank")
