"""Command line: ``python -m seqloom.cli compress|decompress|benchmark|visualize-graph``.

``input`` is one file, or a folder or glob of files, on any file system Spark reads; with several
files ``output`` is a folder.
"""

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.formats import VARIANTS
from seqloom.operators.residual import ModelCodec, PlainCodec, ResidualCodec
from seqloom.operators.token_models import load_markov, train_markov
from seqloom.plans import archive_v1, archive_v2, benchmark, visualise
from seqloom.session import build_session, drop_scratch
from seqloom.sources.fasta import fasta_files, read_fasta
from seqloom.sources.files import is_file, read_archives, stem, write_files

ARCHIVE, RESTORED, CHART = ".ghdna", ".restored.fa", ".debruijn.md"

# Command names, flags, choices and defaults that scripts written for such archives
# use. The model options are those of models that Spark can train; neural models are not offered.
FLAGS = {
    "--k": {"type": int, "default": 15},
    "--min-repeat-len": {"type": int, "default": 40},
    "--lm-order": {"type": int, "default": 3},
    "--archive-version": {"type": int, "choices": (1, 2), "default": 1},
    "--residual-codec": {"choices": ("plain", "markov"), "default": "plain"},
    "--model": {"help": "folder of the trained Markov model: written by compress, read by decompress"},
    "--model-order": {"type": int, "default": 3},
    "--context-length": {"type": int, "default": 1024},
    "--cdf-scale": {"type": int, "default": 32768},
    "--state-bits": {"type": int, "default": 64},
    "--results-dir": {"default": "results"},
    "--benchmark-variant": {"action": "append", "choices": VARIANTS, "default": []},
    "--max-edges": {"type": int, "default": 50},
    "--min-count": {"type": int, "default": 1},
}
MODEL = ("--residual-codec", "--model", "--model-order", "--context-length", "--cdf-scale", "--state-bits")
CODING = ("--k", "--min-repeat-len", "--lm-order", "--archive-version", *MODEL)
# name, what it does, whether it takes an output, flags
COMMANDS = (
    ("compress", "compress FASTA records", True, CODING),
    ("decompress", "restore archives", True, MODEL),
    ("benchmark", "measure sizes and times", False, ("--results-dir", "--benchmark-variant", *CODING)),
    ("visualize-graph", "write the de Bruijn graph as Mermaid markdown", True,
     ("--k", "--max-edges", "--min-count")),
)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, about, writes, flags in COMMANDS:
        one = commands.add_parser(name, help=about)
        one.add_argument("input")
        if writes:
            one.add_argument("output", nargs="?")
        for flag in flags:
            one.add_argument(flag, **FLAGS[flag])
    return top


def codec_for(spark: SparkSession, args: argparse.Namespace, records: DataFrame | None) -> ResidualCodec:
    """The codec that the flags name. With ``records`` a model is trained on them and saved."""
    if args.residual_codec == "plain":
        return PlainCodec()
    if getattr(args, "archive_version", 2) != 2:
        raise ValueError("a model residual codec needs --archive-version 2")
    if not args.model:
        raise ValueError("a model residual codec needs --model")
    options = {"context_length": args.context_length, "scale": args.cdf_scale}
    if records is None:
        model = load_markov(spark, args.model, args.model_order, **options)
    else:
        model = train_markov(records, args.model_order, **options)
        model.save(spark, args.model)
    return ModelCodec(model, args.state_bits)


def target(spark: SparkSession, args: argparse.Namespace, suffix: str) -> tuple[str, Column]:
    """Folder and file-name column: ``output`` itself for one file, else one name per input.

    Inputs are told apart by their names, so ``record_id`` (the path) is all that is needed.
    """
    if is_file(spark, args.input) and args.output:
        folder, _, name = args.output.rpartition("/")
        return folder or ".", F.lit(name)
    return args.output or "outputs", F.concat(stem("record_id"), F.lit(suffix))


def compress_files(spark: SparkSession, args: argparse.Namespace) -> None:
    records = read_fasta(spark, args.input)
    codec = codec_for(spark, args, records)
    options = {"k": args.k, "min_repeat_len": args.min_repeat_len, "lm_order": args.lm_order}
    if args.archive_version == 1:
        archives = archive_v1.compress(records, **options)
    else:
        archives = archive_v2.compress(records, codec, **options)
    folder, name = target(spark, args, ARCHIVE)
    write_files(archives.select(name.alias("name"), F.col("archive").cast("binary").alias("content")), folder)


def decompress_files(spark: SparkSession, args: argparse.Namespace) -> None:
    cells = read_archives(spark, args.input)
    folder, name = target(spark, args, RESTORED)
    rows = archive_v1.decompress_any(cells, codec_for(spark, args, None))
    write_files(fasta_files(rows.withColumn("name", name)), folder)


def chart_files(spark: SparkSession, args: argparse.Namespace) -> None:
    records = read_fasta(spark, args.input)
    folder, name = target(spark, args, CHART)
    rows = visualise.report_files(
        records, k=args.k, max_edges=args.max_edges, min_count=args.min_count
    )
    write_files(rows.withColumn("name", name), folder)
    print(f"Graph visualization written to {folder}")


def benchmark_files(spark: SparkSession, args: argparse.Namespace) -> None:
    records = read_fasta(spark, args.input)
    result = benchmark.run(
        records,
        args.results_dir,
        files=spark.read.format("binaryFile").load(args.input),
        archive_version=args.archive_version,
        codec=codec_for(spark, args, records),
        variants=args.benchmark_variant,
        stem=args.input.rstrip("/").rpartition("/")[2].rpartition(".")[0] or "benchmark",
        k=args.k,
        min_repeat_len=args.min_repeat_len,
        lm_order=args.lm_order,
    )
    print(benchmark.report(result))
    print(f"Results written to {args.results_dir}")


RUN = {
    "compress": compress_files,
    "decompress": decompress_files,
    "visualize-graph": chart_files,
    "benchmark": benchmark_files,
}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or build_session()
    try:
        RUN[args.command](spark, args)
    finally:
        drop_scratch(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
