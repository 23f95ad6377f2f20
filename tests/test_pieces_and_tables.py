"""Table functions, metadata by path, tokens of several symbols, and measures taken while writing."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.formats import VARIANTS
from seqloom.functions import table_functions
from seqloom.functions.catalog import expr
from seqloom.functions.slices import ROWS, by_slices, sliced
from seqloom.operators import complexity, kmers
from seqloom.operators.residual import ModelCodec
from seqloom.operators.token_models import StretchModel, UniformModel, train_stretches
from seqloom.plans import archive_v1, archive_v2, benchmark
from seqloom.sources import fasta_pieces


def random_records(draw, alphabet="ACGT", count=8):
    unit = "".join(draw.choices(alphabet, k=120))
    return ["", unit, *("".join(draw.choices(alphabet, k=draw.randrange(900))) + unit * draw.randrange(3) for _ in range(count))]


def test_table_functions(spark, table):
    table_functions.register(spark)
    table(*random_records(random.Random(1))).createOrReplaceTempView("t")
    assert spark.sql("SELECT * FROM repeats_of(TABLE(t), 15, 40)").columns == ["record_id", "start", "source", "length"]
    with pytest.raises(Exception, match="column seq"):
        spark.sql("SELECT * FROM repeats_of(TABLE(SELECT 1 AS record_id), 15, 40)").collect()
    rows = [("a", 0, b"AC"), ("a", 2, b"GT"), ("b", 0, b"N")]
    spark.createDataFrame(rows, "record_id string, offset long, bases binary").createOrReplaceTempView("p")
    got = spark.sql("SELECT * FROM digest_of(TABLE(p) PARTITION BY record_id ORDER BY offset)")
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == [("a", 2, 4), ("b", 1, 1)]
    assert dict(got.dtypes)["record_id"] == "string"
    with pytest.raises(Exception, match="follow one another"):
        spark.sql("SELECT * FROM digest_of(TABLE(SELECT * FROM p WHERE offset > 0) PARTITION BY record_id ORDER BY offset)").collect()


def test_metadata_of_any_cell(spark, table):
    cells = archive_v2.compress(table("ACGT" * 30, "")).select("record_id", "archive")
    other = spark.createDataFrame([(7, b"no archive"), (8, b"GHDNA2\0\0\0\0\4oops"), (9, None), (10, b"GHDNA2\0")], cells.schema)
    got = {r["record_id"]: r for r in archive_v2.front(cells.unionByName(other)).select(
        "record_id", F.try_variant_get("metadata", "$.length", "bigint").alias("n"), "block_table").collect()}
    assert got[0]["n"] == 120 and len(got[0]["block_table"]) >= 26 and got[1]["n"] == 0
    assert all(got[k]["n"] is None and got[k]["block_table"] is None for k in (7, 8, 9, 10))


@pytest.mark.parametrize("width", [1, 3, 4])
def test_stretch_tokens(spark, table, width):
    draw = random.Random(width)
    seqs = random_records(draw, "ACGTN")
    model = train_stretches(table(*seqs), width, context_length=50)
    for seq in seqs:
        tokens = model.tokenize(seq)
        assert model.detokenize(tokens) == seq and len(tokens) == -(-len(seq) // width)
        assert all(0 <= t < len(model.frequencies(None)) for t in tokens)
    codec = ModelCodec(model)
    for seq in seqs:
        parts = codec.split(seq)
        assert "".join(parts) == seq and all(len(p) == 50 * width for p in parts[:-1])
    assert codec.joins("ACGTACGT", "A" * 2 * width) and not codec.joins("ACGT", "")
    assert codec.joins("ACGTACGT", "A" * (2 * width + 1)) == (width == 1)
    records = table(*[s.replace("N", "A") for s in seqs])
    archives = archive_v2.compress(records, codec, policy="force_graph")
    back = {r["record_id"]: r["seq"] for r in archive_v2.decompress(archives, codec).collect()}
    assert back == {r["record_id"]: r["seq"] for r in records.collect()}
    with pytest.raises(ValueError, match="outside"):
        StretchModel(2, {}).tokenize("AX")
    with pytest.raises(ValueError, match="symbol or more"):
        StretchModel(0, {})


def test_sizes_are_those_of_the_archives(spark, table, tmp_path):
    records = table(*random_records(random.Random(3)))
    codec = ModelCodec(UniformModel(64))
    rows = benchmark.measured_variants(records, VARIANTS, codec, str(tmp_path))
    assert [r["name"] for r in rows] == list(VARIANTS)
    for row in rows:
        archives, _ = benchmark.variant_archives(records, row["name"], codec)
        cells = archives.select("archive", "payload_bytes", "llm_residual_payload_bytes").collect()
        assert row["records"] == len(cells)
        assert row["compressed_size"] == sum(len(c["archive"]) for c in cells)
        assert row["payload_bytes"] == sum(c["payload_bytes"] for c in cells)
        assert row["llm_residual_payload_bytes"] == sum(c["llm_residual_payload_bytes"] for c in cells)
        written = spark.read.parquet(f"{tmp_path}/{row['name']}")
        assert sorted(bytes(r[0]) for r in written.select("archive").collect()) == sorted(bytes(c[0]) for c in cells)


def test_measures_of_pieces(spark, table):
    draw = random.Random(4)
    records = table(*random_records(draw, "ACGTN"), "A" * 50)
    for positions in (7, 64):
        pieces = fasta_pieces.recut(kmers.chunks(records, 1, positions=10), 1, positions)
        got = complexity.composition_of_pieces(records, pieces)
        want = {r["record_id"]: r for r in complexity.composition(records).collect()}
        for r in got.collect():
            assert r["length"] == want[r["record_id"]]["length"]
            for name in ("gc_fraction", "shannon_bits_per_base"):
                assert r[name] == pytest.approx(want[r["record_id"]][name], abs=1e-12)


def test_packed_bit_texts(spark):
    for bits in ("", "1", "10110010111", "01" * 100, "0" * 64):
        want = int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big")
        assert bytes(spark.range(1).select(expr("pack_bit_text", f"'{bits}'")).first()[0]) == want
    with pytest.raises(Exception, match="0 or 1"):
        spark.range(1).select(expr("pack_bit_text", "'012'")).collect()


def test_python_objects_of_few_rows_at_a_time():
    sizes = []

    @by_slices
    def work(left: pa.Array, right: pa.Array) -> pa.Array:
        sizes.append(len(left))
        return pa.array([a + b for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int64())

    for n in (0, 1, ROWS, ROWS + 1, 10_000):
        assert work(pa.array(range(n), pa.int64()), pa.array([1] * n, pa.int64())).to_pylist() == list(range(1, n + 1))
    assert max(sizes) == ROWS
    assert [len(part) for part in sliced([pa.array([0] * 600)])] == [ROWS, ROWS, 88]


def test_batches_of_many_records_are_restored_in_slices(spark):
    rows = [(k, f">r{k}", "ACGTN"[k % 5 :] * (k % 40)) for k in range(700)]
    records = spark.createDataFrame(rows, "record_id long, header string, seq string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        for plan in (archive_v1, archive_v2):
            assert sorted(tuple(r) for r in plan.decompress(plan.compress(records)).collect()) == rows
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
