"""Sizes, timings and reports of the compression variants."""

import gzip
import json
import time
from collections.abc import Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.formats import VARIANTS
from seqloom.functions.catalog import expr
from seqloom.operators.residual import PlainCodec, ResidualCodec
from seqloom.plans import archive_v1, archive_v2
from seqloom.operators.repeats import with_copies
from seqloom.session import cut_lineage
from seqloom.sources.fasta import fasta_files
from seqloom.sources.files import write_files


PACKED = T.StructType(
    [
        T.StructField("size", T.LongType()),
        T.StructField("compress_seconds", T.DoubleType()),
        T.StructField("decompress_seconds", T.DoubleType()),
    ]
)


@F.arrow_udf(PACKED)
def gzipped(contents: pa.Array) -> pa.Array:
    """Size under gzip -9 of each cell and the seconds both ways took; checks the round trip."""
    rows = []
    for data in contents.to_pylist():
        begin = time.perf_counter()
        packed = gzip.compress(data, compresslevel=9)
        middle = time.perf_counter()
        if gzip.decompress(packed) != data:
            raise RuntimeError("gzip gave back other bytes")
        end = time.perf_counter()
        rows.append(
            {
                "size": len(packed),
                "compress_seconds": middle - begin,
                "decompress_seconds": end - middle,
            }
        )
    return pa.array(rows, to_arrow_type(PACKED))


def gzip_baseline(files: DataFrame) -> DataFrame:
    """gzip -9 of the bytes of each file, from ``(path, content)`` rows."""
    return files.select(
        "path",
        F.octet_length("content").cast("long").alias("original_size"),
        gzipped("content").alias("gzip"),
    ).select("path", "original_size", "gzip.*")


def as_files(records: DataFrame) -> DataFrame:
    """Records of a table that is no set of files, as the FASTA text they would be."""
    text = expr("fasta_text", "header", "seq", "80")
    return records.select(F.col("record_id").alias("path"), text.cast("binary").alias("content"))


def variant_archives(
    records: DataFrame, variant: str, codec: ResidualCodec | None, **options: Any
) -> tuple[DataFrame, ResidualCodec]:
    """Archives of one named variant, and the codec that restores them."""
    if variant not in VARIANTS:
        raise ValueError(f"no variant is called {variant}")
    only_graph, no_graph, forced, _ = VARIANTS
    if variant == only_graph:
        codec = PlainCodec()
    elif codec is None or not codec.is_model:
        raise ValueError("this variant needs a codec with a model")
    return (
        archive_v2.compress(
            records,
            codec,
            use_graph_repeats=variant != no_graph,
            policy="force_graph" if variant == forced else "auto",
            **options,
        ),
        codec,
    )


def summary_columns(archives: DataFrame) -> DataFrame:
    """Per record; ``raw_bits_per_base`` is that of FASTA text in lines of 80 symbols."""
    raw = "octet_length(header) + length + (length + 79) DIV 80 + 1"
    return archives.select(
        "record_id",
        F.octet_length("archive").cast("long").alias("compressed_size"),
        F.expr("IF(length = 0, NULL, octet_length(archive) * 8D / length)").alias("bits_per_base"),
        F.expr(f"IF(length = 0, NULL, ({raw}) * 8D / length)").alias("raw_bits_per_base"),
        "graph_copy_blocks",
        (F.col("llm_residual_blocks") + F.col("raw_residual_blocks")).alias("residual_blocks"),
        *archive_v2.DIAGNOSTICS,
    )


def variant_sizes(
    records: DataFrame, variants: Iterable[str], codec: ResidualCodec | None, **options: Any
) -> DataFrame:
    """One row per record and variant, with the planner's diagnostics and no timings.

    Copies are found once and written; every variant plans from them.
    """
    result = None
    found = {"k": options.get("k", 15), "min_length": options.get("min_repeat_len", 40)}
    records = cut_lineage(with_copies(records, **found))
    for place, variant in enumerate(variants):
        archives, _ = variant_archives(records, variant, codec, **options)
        rows = summary_columns(archives).select(
            F.lit(place).alias("variant_no"), F.lit(variant).alias("name"), "*"
        )
        result = rows if result is None else result.unionByName(rows)
    if result is None:
        raise ValueError("name at least one variant")
    return result


def totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("variant_no", "name").agg(
        F.count("*").alias("records"),
        F.sum("compressed_size").alias("compressed_size"),
        F.sum("residual_bases").alias("residual_bases"),
        F.sum("graph_copy_bases").alias("graph_copy_bases"),
        F.sum("graph_copy_blocks").alias("graph_copy_blocks"),
        F.sum("llm_residual_blocks").alias("llm_residual_blocks"),
        F.sum("raw_residual_blocks").alias("raw_residual_blocks"),
        F.sum("raw_residual_payload_bytes").alias("raw_residual_payload_bytes"),
    )


# --- timed runs ------------------------------------------------------------

SUMMED = (
    "graph_copy_blocks",
    "residual_blocks",
    "graph_copy_bases",
    "residual_bases",
    "llm_residual_blocks",
    "raw_residual_blocks",
    "context_residual_blocks",
    "llm_residual_payload_bytes",
    "raw_residual_payload_bytes",
    "payload_bytes",
    "selected_repeat_count",
    "selected_estimated_bytes",
)


def timed_round_trip(
    archives: DataFrame, restore, folder: str, bases: int, original_size: int
) -> dict[str, Any]:
    """Write the archives, then restore them from what was written; time both jobs."""
    spark = archives.sparkSession
    started = time.perf_counter()
    sums = write_measured(archives, f"{folder}/archives")
    compress_seconds = time.perf_counter() - started
    written = spark.read.parquet(f"{folder}/archives")
    started = time.perf_counter()
    restore(written).write.mode("overwrite").parquet(f"{folder}/restored")
    decompress_seconds = time.perf_counter() - started
    size = sums["compressed_size"]
    result: dict[str, Any] = {
        "compressed_size": size,
        "bits_per_base": size * 8 / bases,
        "raw_bits_per_base": original_size * 8 / bases,
        "compression_time": compress_seconds,
        "decompression_time": decompress_seconds,
    }
    if "payload_bytes" in written.columns:
        result.update({name: sums[name] for name in SUMMED})
        result["selected_candidate"] = ",".join(sums["selected_candidate"])
        result["candidate_count"] = sums["candidate_count"]
        result["graph_copy_fraction"] = result["graph_copy_bases"] / bases
    return result


def write_measured(archives: DataFrame, path: str) -> dict[str, Any]:
    """Write archives and measure them in the same job: no second look at what was written."""
    size = F.octet_length("archive").cast("long")
    measures = [F.count(F.lit(1)).alias("records"), F.sum(size).alias("compressed_size")]
    if "payload_bytes" in archives.columns:
        residual = F.col("llm_residual_blocks") + F.col("raw_residual_blocks")
        columns = {name: F.col(name) for name in SUMMED if name != "residual_blocks"}
        columns["residual_blocks"] = residual
        measures += [F.sum(column).alias(name) for name, column in columns.items()]
        measures += [
            F.array_sort(F.collect_set("selected_candidate")).alias("selected_candidate"),
            F.max("candidate_count").alias("candidate_count"),
        ]
    seen = Observation()
    archives.observe(seen, *measures).write.mode("overwrite").parquet(path)
    return {name: 0 if value is None else value for name, value in seen.get.items()}


def measured_variants(
    records: DataFrame, variants: Iterable[str], codec: ResidualCodec | None, folder: str, **options: Any
) -> list[dict[str, Any]]:
    """What each variant's archives take, one written table and one look at it a variant.

    Records that hold their ``copies``, found with the same options, are taken as they are.
    """
    found = {"k": options.get("k", 15), "min_length": options.get("min_repeat_len", 40)}
    if "copies" not in records.columns:
        records = cut_lineage(with_copies(records, **found))
    return [
        {"name": variant, **write_measured(variant_archives(records, variant, codec, **options)[0], f"{folder}/{variant}")}
        for variant in variants
    ]


def run(
    records: DataFrame,
    results_dir: str,
    *,
    files: DataFrame | None = None,
    archive_version: int = 1,
    codec: ResidualCodec | None = None,
    variants: Iterable[str] = (),
    stem: str = "benchmark",
    **options: Any,
) -> dict[str, Any]:
    """Benchmark records; writes archives, restored FASTA and both reports.

    ``files`` are the files the records come from, for sizes and gzip; without them the records'
    FASTA text stands for them. Per record there is ``<name>.ghdna`` and ``<name>.restored.fa``.
    """
    spark = records.sparkSession
    folder = f"{results_dir}/{stem}"
    base = gzip_baseline(as_files(records) if files is None else files)
    first = base.agg(
        F.sum("original_size").alias("original_size"),
        F.sum("size").alias("size"),
        F.sum("compress_seconds").alias("compress_seconds"),
        F.sum("decompress_seconds").alias("decompress_seconds"),
    ).first()
    bases = records.agg(F.sum(F.length("seq"))).first()[0]
    original, packed = first["original_size"], first["size"]
    if archive_version == 1:
        archives = archive_v1.compress(records, **options)
        result = timed_round_trip(archives, archive_v1.decompress, folder, bases, original)
    elif archive_version == 2:
        archives = archive_v2.compress(records, codec, **options)
        result = timed_round_trip(
            archives, lambda a: archive_v2.decompress(a, codec), folder, bases, original
        )
    else:
        raise ValueError("archives have version 1 or 2")
    result.update(
        original_size=original,
        gzip_size=packed,
        gzip_bits_per_base=packed * 8 / bases,
        gzip_compression_time=first["compress_seconds"],
        gzip_decompression_time=first["decompress_seconds"],
    )
    name = expr("file_stem", "CAST(record_id AS STRING)")
    cells = spark.read.parquet(f"{folder}/archives").withColumn("name", F.concat(name, F.lit(".ghdna")))
    write_files(cells.withColumn("content", F.col("archive").cast("binary")), results_dir)
    rows = spark.read.parquet(f"{folder}/restored")
    write_files(fasta_files(rows.withColumn("name", F.concat(name, F.lit(".restored.fa")))), results_dir)
    listed = []
    for variant in variants:
        archives, chosen = variant_archives(records, variant, codec, **options)
        row = timed_round_trip(
            archives,
            lambda a, chosen=chosen: archive_v2.decompress(a, chosen),
            f"{folder}/{variant}",
            bases,
            original,
        )
        listed.append({"name": variant, **row})
    if listed:
        result["variants"] = listed
    texts = [
        (f"{stem}.benchmark.json", json.dumps(result, indent=2, sort_keys=True) + "\n"),
        (f"{stem}.benchmark.txt", report(result) + "\n"),
    ]
    table = spark.createDataFrame(texts, "name string, content string")
    write_files(table.withColumn("content", F.col("content").cast("binary")), results_dir)
    return result


def report(result: dict[str, Any]) -> str:
    """Fixed-width table of sizes and times, then diagnostics and variants when present.

    Fixed values: column heads, method names and labels are those of published reports.
    """

    def line(name: str, width: int, size: Any, bpb: float, *times: Any) -> str:
        first = f"{times[0]:.6f}" if times else "-"
        second = f"{times[1]:.6f}" if len(times) > 1 else "-"
        return f"{name:<{width}}{size:<14}{bpb:<8.2f}{first:<14}{second}"

    def head(width: int) -> str:
        return f"{'Method':<{width}}{'Size(bytes)':<14}{'bpb':<8}{'Compress(s)':<16}Decompress(s)"

    def own(name: str, width: int, row: dict[str, Any]) -> str:
        return line(
            name, width, row["compressed_size"], row["bits_per_base"],
            row["compression_time"], row["decompression_time"],
        )

    lines = [
        head(14),
        own("archive", 14, result),
        line("gzip -9", 14, result["gzip_size"], result["gzip_bits_per_base"],
             result["gzip_compression_time"], result["gzip_decompression_time"]),
        line("raw FASTA", 14, result["original_size"], result["raw_bits_per_base"]),
    ]
    if "selected_candidate" in result:
        lines += [
            "",
            "Diagnostics",
            f"round_trip={result['compression_time'] + result['decompression_time']:.6f}s "
            f"candidate_count={result['candidate_count']} selected={result['selected_candidate']}",
            f"graph_bases={result['graph_copy_bases']} residual_bases={result['residual_bases']} "
            f"llm_blocks={result['llm_residual_blocks']} raw_blocks={result['raw_residual_blocks']}",
        ]
    if result.get("variants"):
        lines += ["", "Variants", head(24)]
        lines += [own(row["name"], 24, row) for row in result["variants"]]
    return "\n".join(lines)
