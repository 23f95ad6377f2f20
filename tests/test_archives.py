import hashlib
import json

import pytest

from conftest import SAMPLE
from models import NextModel, PairModel
from pyspark.sql import functions as F
from seqloom import cli
from seqloom.operators.residual import ModelCodec, PlainCodec
from seqloom.operators.token_models import UniformModel, train_markov
from seqloom.plans import archive_v1, archive_v2, benchmark
from seqloom.sources import fasta, files
from seqloom.streaming import fasta_stream

OPTIONS = {"k": 3, "min_repeat_len": 8, "lm_order": 2}


# --- JSON archives ---------------------------------------------------------


def test_v1_archive(table):
    cells = archive_v1.compress(table(SAMPLE), **OPTIONS)
    text = cells.first()["archive"]
    archive = json.loads(text)
    assert archive["blocks"] == [
        {"type": "lm_raw", "start": 0, "seq": "ACGTACGTGG", "lm_bits": 12.784305},
        {"type": "graph_copy", "start": 10, "source": 0, "length": 8},
    ]
    assert text == json.dumps(archive, indent=2, sort_keys=True) + "\n"
    assert archive_v1.decompress(cells).first()["seq"] == SAMPLE
    assert archive_v1.parse_blocks(cells).count() == 2


def test_v1_long_records_score_the_same(table):
    records = table("GATTACA" * 12 + "CCNN" * 9 + "GATTACA" * 9, SAMPLE, "ACG")
    options = {"k": 3, "min_repeat_len": 12, "lm_order": 3}
    cells = archive_v1.compress(records, **options)
    local = sorted(tuple(r) for r in archive_v1.blocks(records, **options).collect())
    joined = sorted(
        tuple(r) for r in archive_v1.blocks(records, local_bases=20, **options).collect()
    )
    assert [r[:-1] for r in local] == [r[:-1] for r in joined]
    assert [r[-1] for r in local] == pytest.approx([r[-1] for r in joined], abs=2e-6)
    assert archive_v1.decompress(cells).count() == 3


def test_v1_bytes_do_not_depend_on_neighbours(table):
    seq = "GATTACA" * 12 + "CCNN" * 9 + "GATTACA" * 9
    options = {"k": 3, "min_repeat_len": 12, "lm_order": 3, "local_bases": 200}
    alone = archive_v1.compress(table(seq), **options).first()["archive"]
    among = archive_v1.compress(table(seq, "ACGTTGCA" * 60), **options)
    assert among.where("record_id = 0").first()["archive"] == alone


def test_v1_errors(spark, table):
    text = archive_v1.compress(table(SAMPLE), **OPTIONS).first()["archive"]

    def broken(**changes):
        return json.dumps({**json.loads(text), **changes})

    copy = {"type": "graph_copy", "start": 0, "source": 0, "length": 1}
    for changed, message in [
        ("{", "JSON"), ("[]", "object"), ('{"a": }', "magic"), (broken(magic="x"), "magic"),
        (broken(blocks={}), "list"), (broken(sha256="0"), "checksum"),
        (broken(length=3), "length"), (broken(blocks=[copy]), "reference"),
        (broken(blocks=[{**copy, "start": 4}]), "contiguous"),
        (broken(blocks=[{"type": "other", "start": 0}]), "unknown"),
    ]:
        cells = spark.createDataFrame([(0, changed)], "record_id long, archive string")
        with pytest.raises(Exception, match=message):
            archive_v1.decompress(cells).collect()


# --- binary archives -------------------------------------------------------


def test_v2_blocks(table):
    cell = bytes(archive_v2.compress(table(SAMPLE), **OPTIONS).first()["archive"])
    metadata, blocks, payload = archive_v2.read_container(cell)
    assert blocks == [
        {"type": "llm_residual", "start": 0, "length": 10, "symbol_count": 10, "bit_length": 80,
         "payload_offset": 0, "payload_length": 10},
        {"type": "graph_copy", "start": 10, "source": 0, "length": 8},
    ]
    assert payload == b"ACGTACGTGG"
    assert archive_v2.encode_table(blocks) == cell[-49:-10]
    assert metadata["diagnostics"]["graph_copy_bases"] == 8
    again = bytes(archive_v2.compress(table(SAMPLE), **OPTIONS).first()["archive"])
    assert again == cell


def test_v2_context_blocks(table):
    codec = ModelCodec(NextModel(80))
    cells = archive_v2.compress(table("ACGT" * 43), codec, k=100, min_repeat_len=100)
    _, blocks, payload = archive_v2.read_container(bytes(cells.first()["archive"]))
    assert [(b["type"], b["start"], b["length"], b.get("use_context")) for b in blocks] == [
        ("llm_residual", 0, 80, None),
        ("llm_residual", 80, 80, True),
        ("raw_residual", 160, 12, None),
    ]
    assert payload.endswith(bytes.fromhex("1B1B1B"))
    assert archive_v2.decompress(cells, codec).first()["seq"] == "ACGT" * 43


@pytest.mark.parametrize("policy", ["auto", "force_graph"])
@pytest.mark.parametrize("codec", [None, ModelCodec(UniformModel(100)), ModelCodec(PairModel(50))])
def test_v2_round_trips(table, codec, policy):
    seqs = ["A" * 300, "ACGTTGCA" * 40, SAMPLE, "ACG", "GATTACA" * 30 + "CC" * 70 + "GATTACA" * 30]
    cells = archive_v2.compress(table(*seqs), codec, k=5, min_repeat_len=12, policy=policy)
    restored = archive_v2.decompress(cells, codec).orderBy("record_id").collect()
    assert [r["seq"] for r in restored] == seqs


def test_v2_n_under_model_codec(table):
    with pytest.raises(Exception, match="A/C/G/T"):
        archive_v2.compress(table("ACGTN"), ModelCodec(UniformModel())).collect()


def restore(spark, content, codec=None):
    cells = spark.createDataFrame([(0, bytearray(content))], "record_id long, archive binary")
    row = archive_v2.decompress(cells, codec).first()
    return row["header"], row["seq"]


def test_v2_errors(spark, table):
    cell = bytes(archive_v2.compress(table(SAMPLE), **OPTIONS).first()["archive"])
    for content, message in [
        (b"OTHER!!", "magic"),
        (b"GHDNA2\0" + b"\0\0", "truncated"),
        (b"GHDNA2\0" + (16).to_bytes(4, "big") + b"{}", "truncated"),
        (b"GHDNA2\0" + (1 << 30).to_bytes(4, "big"), "too large"),
        (b"GHDNA2\0" + (2).to_bytes(4, "big") + b"[]", "object"),
        (b"GHDNA2\0" + (2).to_bytes(4, "big") + b"{}", "magic"),
        (b"GHDNA2\0" + (2).to_bytes(4, "big") + b"{x", "invalid"),
        (cell[:-30], "truncated"),
        (cell[:-1] + b"A", "checksum"),
        (cell[:-3], "payload range"),
    ]:
        with pytest.raises(Exception, match=message):
            restore(spark, content)
    with pytest.raises(Exception, match="not available"):
        restore(spark, cell, ModelCodec(UniformModel()))
    coded = archive_v2.compress(table("ACGT" * 40), ModelCodec(UniformModel(100))).first()["archive"]
    with pytest.raises(Exception, match="metadata differs"):
        restore(spark, coded, ModelCodec(UniformModel(90)))
    with pytest.raises(ValueError, match="block type"):
        archive_v2.encode_table([{"type": "x"}])
    with pytest.raises(ValueError, match="block tag"):
        archive_v2.decode_table(b"\x09")
    with pytest.raises(ValueError, match="truncated"):
        archive_v2.decode_table(b"\x01\x00")


def test_v2_json_block_list(spark):
    metadata = {
        "magic": "GHDNA_2", "header": ">a", "length": 3, "residual_codec": "plain_ascii_v1",
        "sha256": hashlib.sha256(b"ACG").hexdigest(),
        "blocks": [{"type": "llm_residual", "start": 0, "length": 3, "symbol_count": 3,
                    "bit_length": 24, "payload_offset": 0, "payload_length": 3}],
    }
    text = json.dumps(metadata).encode()
    cell = b"GHDNA2\0" + len(text).to_bytes(4, "big") + text + b"ACG"
    assert restore(spark, cell) == (">a", "ACG")


# --- files, command line, streaming ----------------------------------------


@pytest.mark.parametrize(
    "text,message",
    [
        ("", "begins with >"), ("ACGT\n", "begins with >"), (">  \nACGT", "begins with >"), (">a\n", "empty"),
        (">a\nACGTX\n", "may not have: X"), (">a\nAC GT", "may not have"),
        (">a\nAC\n>b\nGT\n", "single record"),
    ],
)
def test_bad_fasta(text, message):
    with pytest.raises(ValueError, match=message):
        fasta.parse_fasta(text.encode())


def test_fasta_values():
    assert fasta.parse_fasta(b">chr1 description\nACGTN\nacgt\n") == (
        ">chr1 description", "ACGTNACGT"
    )


def test_failed_writes_leave_no_partial_file(tmp_path):
    (tmp_path / "taken").mkdir()
    (tmp_path / "taken" / "inner").write_text("x")  # a folder that no file can replace
    writer = files._RecordFilesWriter(f"file://{tmp_path}")
    with pytest.raises(OSError):
        writer.write(iter([{"name": "one", "content": b"1"}, {"name": "taken", "content": b"2"}]))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "taken"]


def test_fasta_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\n" + "ACGT" * 50 + "\n")
    (tmp_path / "in" / "bad.fa").write_text("ACGT\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "in"), "QUARANTINE").orderBy("path").collect()
    assert [r["seq"] for r in rows] == ["ACGT" * 50, None] and "begins with >" in rows[1]["error"]
    with pytest.raises(Exception, match="begins with >"):
        fasta.read_fasta(spark, str(tmp_path / "in")).collect()
    good = fasta.read_fasta(spark, str(tmp_path / "in" / "a.fa")).withColumn("name", files.stem())
    files.write_files(fasta.fasta_files(good), str(tmp_path / "out"))
    lines = (tmp_path / "out" / "a").read_text().split("\n")
    assert lines == [">a", "ACGT" * 20, "ACGT" * 20, "ACGT" * 10, ""]


@pytest.mark.parametrize("version", ["1", "2"])
def test_command_line(spark, tmp_path, version):
    source = tmp_path / "s.fa"
    source.write_text(f">s\n{SAMPLE}\n")
    packed, restored = tmp_path / "s.ghdna", tmp_path / "back.fa"
    cli.main(["compress", str(source), str(packed), "--k", "3", "--min-repeat-len", "8",
              "--archive-version", version])
    cli.main(["decompress", str(packed), str(restored)])
    assert restored.read_text() == source.read_text()


def test_command_line_chart_and_errors(spark, tmp_path):
    source = tmp_path / "s.fa"
    source.write_text(f">s\n{SAMPLE}\n")
    chart = tmp_path / "s.md"
    cli.main(["visualize-graph", str(source), str(chart), "--k", "3", "--max-edges", "2"])
    text = chart.read_text()
    assert text.startswith("# de Bruijn graph for s.fa\n\n- header: `>s`\n- sequence length: `18`")
    assert "    ACG -->|4| CGT" in text and text.endswith("```\n")
    with pytest.raises(Exception, match="k-mer"):
        cli.main(["visualize-graph", str(source), str(chart), "--k", "18"])
    with pytest.raises(ValueError, match="archive-version 2"):
        cli.main(["compress", str(source), "--residual-codec", "markov"])
    args = cli.parser().parse_args(["compress", "x.fa"])
    assert (args.k, args.min_repeat_len, args.context_length) == (15, 40, 1024)


def test_command_line_model(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.fa").write_text(f">{name}\n" + "ACGTTGCAAC" * 30 + "\n")
    model = ["--residual-codec", "markov", "--model", str(tmp_path / "m"), "--model-order", "2"]
    cli.main(["compress", str(tmp_path / "in"), str(tmp_path / "out"), "--archive-version", "2", *model])
    cli.main(["decompress", str(tmp_path / "out"), str(tmp_path / "back"), *model])
    back = (tmp_path / "back" / "a.restored.fa").read_text()
    assert back.replace("\n", "") == ">a" + "ACGTTGCAAC" * 30


@pytest.mark.parametrize("command", ["compress", "decompress", "visualize-graph"])
def test_equal_names_fail_before_any_write(spark, tmp_path, command):
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        source = tmp_path / "in" / folder / "x.fa"
        source.write_text(f">x\n{SAMPLE}\n")
        if command == "decompress":
            cli.main(["compress", str(source), str(source.with_suffix(".ghdna"))])
    suffix = "ghdna" if command == "decompress" else "fa"
    with pytest.raises(ValueError, match="same file"):
        cli.main([command, str(tmp_path / "in" / "*" / f"*.{suffix}"), str(tmp_path / "out")])
    assert not (tmp_path / "out").exists()


def test_unknown_file_systems_are_refused(spark):
    rows = spark.createDataFrame([("a", bytearray(b"x"))], "name string, content binary")
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        files.write_files(rows, "nowhere://host/out")


def test_benchmark_command(spark, tmp_path):
    source = tmp_path / "s.fa"
    source.write_text(f">s\n{SAMPLE}\n")
    cli.main(["benchmark", str(source), "--results-dir", str(tmp_path / "r"), "--k", "3",
              "--min-repeat-len", "8", "--archive-version", "2",
              "--benchmark-variant", "graph_only"])
    result = json.loads((tmp_path / "r" / "s.benchmark.json").read_text())
    assert result["graph_copy_blocks"] == 1 and result["residual_blocks"] == 1
    assert [v["name"] for v in result["variants"]] == ["graph_only"]
    assert result["original_size"] == source.stat().st_size
    assert (tmp_path / "r" / "s.restored.fa").read_text() == source.read_text()
    assert (tmp_path / "r" / "s.ghdna").stat().st_size == result["compressed_size"]
    assert "Variants" in (tmp_path / "r" / "s.benchmark.txt").read_text()


def test_benchmark_variants(table):
    codec = ModelCodec(UniformModel())
    names = list(benchmark.VARIANTS)
    rows = benchmark.variant_sizes(table(SAMPLE), names, codec, k=3, min_repeat_len=8)
    got = {r["name"]: r for r in rows.collect()}
    assert set(got) == set(names)
    assert got["graph_plus_dnagpt2"]["selected_candidate"] == "force_graph"
    assert got["adaptive_dnagpt2_hybrid"]["selected_candidate"] == "no_graph"
    assert got["dnagpt2_residual_only"]["graph_copy_blocks"] == 0
    with pytest.raises(ValueError, match="model"):
        benchmark.variant_sizes(table(SAMPLE), names[1:], PlainCodec())
    with pytest.raises(ValueError, match="no variant"):
        benchmark.variant_sizes(table(SAMPLE), ["x"], codec)


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.fa").write_text(f">a\n{SAMPLE}\n")
    (source / "b.fa").write_text("nonsense\n")
    query = fasta_stream.archive_stream(
        spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), k=3, min_repeat_len=8
    )
    query.awaitTermination(120)
    cells = spark.read.parquet(str(tmp_path / "out"))
    assert archive_v2.decompress(cells).first()["seq"] == SAMPLE
    assert "begins with >" in spark.read.json(str(tmp_path / "out_rejected")).first()["error"]


@pytest.mark.parametrize("by_model", [False, True])
def test_restoring_both_formats_makes_each_cell_once(table, by_model):
    records = table(SAMPLE, "ACGT" * 40, "", "TTGACA" * 30)
    codec = ModelCodec(train_markov(records, 2, context_length=16)) if by_model else None
    json_cells = archive_v1.compress(records).select("record_id", F.col("archive").cast("binary").alias("archive"))
    cells = json_cells.unionByName(archive_v2.compress(records, codec).select("record_id", "archive"))
    rows = archive_v1.decompress_any(cells, codec)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("ArrowEvalPython" in line and "pretty_json(" in line for line in plan) == 1
    got = sorted((r["record_id"], r["header"], r["seq"]) for r in rows.collect())
    assert got == sorted(2 * [(r["record_id"], r["header"], r["seq"]) for r in records.collect()])


@pytest.mark.parametrize("bad", [b"", b"{}", b"[1]", b"GHDNA", archive_v2.V2_FILE_MAGIC + b"xx"])
def test_restoring_any_refuses_other_cells(spark, table, bad):
    good = archive_v1.compress(table(SAMPLE)).select("record_id", F.col("archive").cast("binary").alias("archive"))
    broken = spark.createDataFrame([(9, bytearray(bad))], "record_id long, archive binary")
    with pytest.raises(Exception, match="archive"):
        archive_v1.decompress_any(good.unionByName(broken)).collect()
