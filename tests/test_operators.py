import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brute import copies
from conftest import SAMPLE
from models import NextModel, PairModel
from seqloom.functions import matching
from seqloom.operators import blocks, complexity, graph, kmers, long_repeats, markov, repeats
from seqloom.operators.residual import Encoded, ModelCodec, PlainCodec
from seqloom.operators.token_models import (
    MarkovModel,
    UniformModel,
    load_markov,
    train_markov,
)


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


# --- k-mers and graph ------------------------------------------------------


def test_chunked_kmers_equal_whole(table):
    seqs = ["ACGTNACGTTGCA" * 3, "ACG", "AC", ""]
    got = rows(kmers.explode_kmers(table(*seqs), 3, positions=4).select(
        "record_id", "pos", F.col("kmer").cast("string")))
    assert got == sorted(
        (n, i, s[i : i + 3]) for n, s in enumerate(seqs) for i in range(len(s) - 2)
    )


def test_edges(table):
    assert rows(graph.debruijn_edges(table("ATATAT"), 2)) == [(0, "AT", "TA", 2), (0, "TA", "AT", 2)]
    edges = graph.debruijn_edges(table(SAMPLE), 3)
    ranked = [tuple(r)[1:4] for r in graph.top_edges(edges, 50).orderBy("edge_rank").collect()]
    assert [tuple(r)[1:] for r in graph.top_edges(edges).collect()] == ranked
    assert ranked == [
        ("ACG", "CGT", 4), ("CGT", "GTA", 2), ("GTA", "TAC", 2), ("TAC", "ACG", 2),
        ("CGT", "GTG", 1), ("GAC", "ACG", 1), ("GGA", "GAC", 1), ("GTG", "TGG", 1),
        ("TGG", "GGA", 1),
    ]
    assert rows(graph.edges_from_map(graph.edges_as_map(edges))) == rows(edges)
    assert rows(graph.degrees(edges))[0] == (0, "ACG", 1, 4)


def odd_records(spark):
    """Records that share an id, a null id, and one that is said to be long."""
    seqs = [*random_seqs(5, 15), "ACGTNACGNNACGT" * 9, None]
    ids = [*range(len(seqs)), 4, 4, 7, None, None, None]
    seqs += [seqs[4], seqs[9], seqs[11], seqs[8], "ACGTACGT", "ACGTACGT"]
    rows = [(i, f">r{i}", s, 1 << 21 if n in (5, 6) else 500) for n, (i, s) in enumerate(zip(ids, seqs))]
    return spark.createDataFrame(rows, "record_id long, header string, seq string, size_bound long")


@pytest.mark.parametrize("k", [1, 3, 6, 7, 8, 9])
def test_edges_by_source_and_their_degrees(spark, k):
    records = odd_records(spark)
    edges = graph.debruijn_edges(records, k)
    listed = graph.debruijn_edges(records, k, by_source=True)
    assert sorted(map(str, graph.degrees(listed).collect())) == sorted(map(str, graph.degrees(edges).collect()))
    flat = listed.select("record_id", "source", F.inline("targets"))
    assert sorted(map(str, flat.collect())) == sorted(map(str, edges.collect()))
    once = records.dropDuplicates(["record_id"])
    back = graph.edges_from_map(graph.edges_as_map(graph.debruijn_edges(once, k, by_source=True)))
    assert rows(back.na.fill(-1)) == rows(graph.debruijn_edges(once, k).na.fill(-1))


def test_edges_of_short_records_need_no_shuffle_and_are_counted_once(table):
    records = table("ACGTACGT", "ACGGT").withColumn("size_bound", F.lit(8))

    def plan(found):
        return found._jdf.queryExecution().optimizedPlan().toString()

    listed = graph.debruijn_edges(records, 3, by_source=True)
    for found in (graph.degrees(listed), graph.edges_from_map(graph.edges_as_map(listed))):
        # what is shuffled belongs to records that are spread, and there are none
        assert plan(found).count("Aggregate [record_id") <= 2
        assert "LogicalRDD" not in plan(found).split("Aggregate [record_id", 1)[1]
    marked = graph.debruijn_edges(records, 3, first_uses=True)
    assert plan(graph.mermaid_lines(marked)).count("LogicalRDD") == 1
    assert plan(graph.mermaid_lines(graph.debruijn_edges(records, 3))).count("LogicalRDD") == 2


def test_adjacency_query_moves_no_edge_of_short_records(spark, tmp_path):
    draw = random.Random(2)
    texts = [(k, "".join(draw.choices("ACGT", k=90)), 90) for k in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.debruijn_adjacency(spark, str(tmp_path))
    assert sum(r["cnt"] for r in found.collect()) == 30 * 85
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "Exchange hashpartitioning(record_id" not in final


@pytest.mark.parametrize("k", [1, 3, 8, 9])
def test_mermaid_lines_by_first_uses(spark, k):
    records = odd_records(spark)
    want = graph.mermaid_lines(graph.debruijn_edges(records, k))
    marked = graph.debruijn_edges(records, k, first_uses=True)
    got = graph.mermaid_lines(marked)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    shown = graph.mermaid(records, marked, 5, 2)
    assert sorted(map(str, shown.collect())) == sorted(
        map(str, graph.mermaid(records, graph.debruijn_edges(records, k), 5, 2).collect())
    )
    with pytest.raises(ValueError, match="both"):
        graph.debruijn_edges(records, k, by_source=True, first_uses=True)


def test_graph_errors(table):
    with pytest.raises(ValueError, match="k-mer"):
        graph.debruijn_edges(table("ACGT"), 0)
    with pytest.raises(Exception, match="k-mer"):
        graph.debruijn_edges(table("ACGT"), 4, strict=True).collect()
    edges = graph.debruijn_edges(table("ACGTACGT"), 2)
    with pytest.raises(ValueError, match="max_edges"):
        graph.top_edges(edges, 0)
    with pytest.raises(ValueError, match="min_count"):
        graph.top_edges(edges, 1, 0)


def test_mermaid(spark, table):
    edges = spark.createDataFrame(
        [(0, "AAA", "AAT", 5), (0, "AAA", "AAC", 1), (0, "AAT", "ATG", 3)],
        "record_id long, source string, target string, cnt long",
    )
    chart = graph.mermaid(table("AAAT", "A"), edges, 2, 2).orderBy("record_id").collect()
    assert chart[0]["chart"].split("\n") == [
        "flowchart LR",
        '    AAA["AAA"]',
        '    AAT["AAT"]',
        "    AAA -->|5| AAT",
        '    ATG["ATG"]',
        "    AAT -->|3| ATG",
    ]
    assert "No edges to display" in chart[1]["chart"]


def test_top_edges_limit_before_shuffle(table):
    plan = graph.top_edges(graph.debruijn_edges(table("ACGTACGT"), 2), 5)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


# --- repeats ---------------------------------------------------------------


def random_seqs(seed, count):
    pick = random.Random(seed)
    out = ["", "A", "A" * 50, "AC" * 30]
    for _ in range(count):
        seq = "".join(pick.choice(pick.choice(["A", "AC", "ACGT"])) for _ in range(pick.randint(0, 40)))
        out.append(seq + seq[pick.randint(0, len(seq)) :] + seq)
    return out


@pytest.mark.parametrize("k,shortest,overlap", [(2, 4, False), (3, 3, True)])
def test_local_and_join_search_equal_brute_force(table, k, shortest, overlap):
    seqs = random_seqs(11, 25)
    want = sorted((n, *c) for n, s in enumerate(seqs) for c in copies(s, k, shortest))
    local = repeats.graph_repeats(table(*seqs), k, shortest, allow_overlap=overlap)
    joined = repeats.graph_repeats(table(*seqs), k, shortest, allow_overlap=overlap, local_bases=0)
    assert rows(local) == want
    assert rows(joined) == want


def test_records_of_both_sizes(table):
    seqs = ["ACGTTGCA" * 3, SAMPLE, "ACCA" * 20]
    got = rows(repeats.graph_repeats(table(*seqs), 3, 8, local_bases=30))
    assert got == sorted((n, *c) for n, s in enumerate(seqs) for c in copies(s, 3, 8))


def test_hot_seed_lists_no_pairs(table):
    """One seed fills the record: rows stay linear in its length."""
    seq = "A" * 3000
    got = rows(repeats.best_sources(table(seq), 4, 5, local_bases=0))
    assert len(got) == len(seq) - 9 and got[0] == (0, 5, 0, 5)
    index = graph.seed_index(table(seq), 4).collect()
    assert [(r["first_pos"], r["occurrences"], r["pairs"]) for r in index] == [
        (0, 2997, 2997 * 2996 // 2)
    ]


def test_repeat_values(table):
    assert rows(repeats.graph_repeats(table(SAMPLE), 3, 8)) == [(0, 10, 0, 8)]
    assert rows(repeats.graph_repeats(table("ACGTGGACGT"), 3, 5)) == []
    with pytest.raises(ValueError, match="seed"):
        repeats.graph_repeats(table("ACGT"), 3, 2)


# --- statistics ------------------------------------------------------------


def bits(table, model_seq, fragment, order):
    model = markov.fit(table(model_seq), order)
    fragments = table(fragment).select("record_id", F.lit(0).alias("start"), "seq")
    return markov.score(model, fragments, order).first()["bits"]


def test_markov_values(table):
    assert bits(table, "AC" * 6, "ACACAC", 2) == pytest.approx(6.117787, abs=1e-6)
    assert bits(table, "AC" * 6, "AAAAAA", 2) == pytest.approx(13.457637, abs=1e-6)
    assert bits(table, SAMPLE, "ACGTACGTGG", 2) == pytest.approx(12.784305, abs=1e-6)
    assert bits(table, "", "ACGTN", 3) == pytest.approx(11.609640, abs=1e-6)


def test_markov_pieces_and_errors(table, monkeypatch):
    seq = "ACGTNACGGT" * 4
    whole = rows(markov.count_rows(markov.fit(table(seq), 3)))
    monkeypatch.setattr(markov, "CHUNK_POSITIONS", 4)
    monkeypatch.setattr(markov, "piece_offsets", lambda w: kmers.piece_offsets(w, 4))
    assert rows(markov.count_rows(markov.fit(table(seq), 3))) == whole
    with pytest.raises(ValueError, match="order"):
        markov.fit(table("ACGT"), 0)
    with pytest.raises(ValueError, match="pseudocount"):
        markov.fit(table("ACGT"), 1, 0)
    with pytest.raises(Exception, match="outside the model's alphabet: X"):
        markov.fit(table("ACXG"), 2).collect()


def test_complexity(table):
    got = complexity.complexity(
        table("ACGTACGT", SAMPLE, "ACGT" * 50, "ACGTGCAATGCCGTTA" * 12 + "ACGT", "", "AA")
    ).orderBy("record_id").collect()
    assert [r["lz76_complexity"] for r in got] == [5, 7, 10, 13, 0, 2]
    assert got[1]["shannon_bits_per_base"] == pytest.approx(1.974937501)
    assert got[1]["gc_fraction"] == pytest.approx(0.5555555556)
    assert got[4]["length"] == 0 and got[4]["bits_per_base"] is None


# --- codecs ----------------------------------------------------------------


def test_plain_codec():
    coded = PlainCodec().encode("ACGTN")
    assert (coded.payload, coded.bit_length, coded.symbol_count) == (b"ACGTN", 40, 5)
    assert PlainCodec().decode(coded) == "ACGTN"
    with pytest.raises(ValueError, match="unsupported"):
        PlainCodec().encode("ACXGT")
    with pytest.raises(ValueError, match="bit_length"):
        Encoded(b"", 1, 0)


def test_model_codec():
    codec = ModelCodec(NextModel(4))
    assert codec.split("ACGTNAC") == ["ACGT", "NAC"]
    coded = codec.encode("ACGTNACGTACGT")
    assert coded.symbol_count == 13 and coded.bit_length <= 13
    assert codec.decode(coded) == "ACGTNACGTACGT"
    assert codec.decode(codec.encode("")) == ""
    with pytest.raises(ValueError, match="no bits"):
        codec.decode(Encoded(b"\x80", 1, 0))
    alone, after = codec.encode("CGTA"), codec.encode("CGTA", "TTA")
    assert after.used_context and after.bit_length < alone.bit_length
    assert codec.decode(after, "A") == "CGTA"


def test_model_codec_context_and_tokens():
    codec = ModelCodec(PairModel(3))
    assert codec.chunk_symbols is None
    assert codec.split("ACGTACGTA") == ["ACGTAC", "GTA"]
    assert codec.joins("GT", "AC") and not codec.joins("GT", "A")
    coded = codec.encode("GTAC", "AC")
    assert coded.used_context and codec.decode(coded, "AC") == "GTAC"


def test_trained_model(table):
    model = train_markov(table("ACACAC", "ACAC"), 1)
    assert isinstance(model, MarkovModel) and model.counts["A"] == [0, 5, 0, 0, 0]
    codec = ModelCodec(model)
    coded = codec.encode("ACACACACACAC")
    assert codec.decode(coded) == "ACACACACACAC"
    assert coded.bit_length < ModelCodec(UniformModel()).encode("ACACACACACAC").bit_length
    assert ModelCodec(train_markov(table("ACGT" * 9), 9)).encode("ACGTACGT").bit_length < 16
    with pytest.raises(ValueError, match="order"):
        train_markov(table("A"), 0)


def test_saved_model(spark, table, tmp_path):
    model = train_markov(table("ACACAC", "GATTACA"), 2, context_length=8)
    model.save(spark, str(tmp_path / "m"))
    again = load_markov(spark, str(tmp_path / "m"), 2, context_length=8)
    assert again.describe() == model.describe() and len(model.describe()["counts_sha256"]) == 64
    assert ModelCodec(again).decode(ModelCodec(model).encode("GATTACA")) == "GATTACA"


# --- planner ---------------------------------------------------------------


def planned(spark, n, items, policy="auto", codec=None):
    df = spark.createDataFrame(
        [(0, ">x", "A" * n, [dict(zip(("start", "source", "length"), i)) for i in items])],
        "record_id long, header string, seq string, "
        "copies array<struct<start: bigint, source: bigint, length: bigint>>",
    )
    row = blocks.plan(df, codec or ModelCodec(UniformModel()), policy).first()
    kept = [(c["start"], c["source"], c["length"]) for c in row["kept"]]
    return (
        row["selected_candidate"], row["candidate_count"], row["selected_estimated_bytes"], kept
    )


def test_candidate_choice(spark):
    assert planned(spark, 18, [(10, 0, 8)]) == ("no_graph", 2, 22, [])
    assert planned(spark, 1000, [(400, 100, 300)]) == (
        "pruned_graph", 2, 240, [(400, 100, 300)]
    )
    assert planned(spark, 200, [(80, 0, 50), (150, 10, 40)])[:2] == ("no_graph", 1)
    assert planned(spark, 100, []) == ("original", 1, 0, [])
    assert planned(spark, 18, [(10, 0, 8)], codec=PlainCodec()) == (
        "original", 1, 0, [(10, 0, 8)]
    )
    assert planned(spark, 18, [(10, 0, 8)], "force_graph") == (
        "force_graph", 1, 0, [(10, 0, 8)]
    )
    with pytest.raises(ValueError, match="policy"):
        planned(spark, 18, [], "other")


def test_pruning():
    assert blocks.prune_copies(500, [(100, 0, 50), (180, 10, 60)]) == [(180, 10, 60)]
    assert len(blocks.prune_copies(300, [(100, 0, 50), (150, 20, 50)])) == 2
    assert blocks.prune_copies(200, [(80, 0, 50), (150, 10, 40)]) == []
    assert blocks.prune_copies(18, [(10, 0, 8)]) == [(10, 0, 8)]


def test_fragmentation(spark):
    items = [(100 * i, 0, 30) for i in range(1, 11)]
    df = spark.createDataFrame(
        [(0, "A" * 1200, [dict(zip(("start", "source", "length"), i)) for i in items])],
        "record_id long, seq string, "
        "copies array<struct<start: bigint, source: bigint, length: bigint>>",
    )
    made = blocks.with_blocks(df, ModelCodec(UniformModel()), "copies", "b")
    assert made.select(F.expr(blocks.too_fragmented("b", "length(seq)"))).first()[0] is True


def test_token_sized_chunks_match_fixed(spark, table):
    """The tokenizer path and the fixed-width path agree for one-symbol tokens."""
    seq = "ACGT" * 60
    records = repeats.with_copies(table(seq), 300, 300)
    fixed = ModelCodec(NextModel(80))
    by_tokens = ModelCodec(NextModel(80))
    by_tokens.model.one_token_per_symbol = False
    one = blocks.plan(records, fixed).first()["blocks"]
    two = blocks.plan(records, by_tokens).first()["blocks"]
    assert one == two and [b["length"] for b in one] == [80, 80, 80]


def test_scratch_tables_can_be_dropped(spark, table):
    from seqloom import session

    found = repeats.graph_repeats(table("GATTACA" * 12), 3, 8, local_bases=10)
    assert found.count() > 0 and session._written
    paths = list(session._written)
    assert session.drop_scratch(spark) == len(paths)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_hot_window_is_split_over_tasks(spark):
    """A group that fills most rows is read by several tasks of the join that names it."""
    rows = spark.range(200_000).selectExpr(
        "0L AS record_id", "id AS pos", "IF(id % 10 = 0, id, -1L) AS kmer"
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        named = long_repeats._named(rows, ["kmer"])
        parts = named.where("kmer = -1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(r["count"] for r in parts) == 180_000 and len(parts) > 1


def test_counts_do_not_shuffle_positions(table):
    """Records of known small size are final where they are counted."""
    records = table("ACGTACGT").withColumn("size_bound", F.lit(8).cast("long"))
    plan = kmers.kmer_counts(records, 3)._jdf.queryExecution().optimizedPlan().toString()
    first = plan.split("Aggregate")[0]
    assert "MapInArrow" in first and "Generate" not in first


@pytest.mark.parametrize("symbols", ["A", "AC", "ACGTN"])
def test_lz76_by_index(symbols):
    draw = random.Random(len(symbols))
    for _ in range(300):
        seq = "".join(draw.choices(symbols, k=draw.randint(1, 90)))
        assert matching.lz76_phrases(seq, 1) == matching.lz76_phrases(seq, 1000)
    long = "".join(draw.choices(symbols, k=300_000))
    assert matching.lz76_phrases(long) > 10


def test_scorer(table):
    records = table("AC" * 6)
    scorer = markov.MarkovScorer(2)
    with pytest.raises(ValueError, match="fit"):
        scorer.bits(records)
    pieces = records.selectExpr(
        "record_id", "explode(array(struct(0L AS start, 'ACACAC' AS seq), struct(1L AS start, 'AAAAAA' AS seq))) AS p"
    ).select("record_id", "p.start", "p.seq")
    got = {r["start"]: r["bits"] for r in scorer.fit(records).bits(pieces).collect()}
    assert got[0] == pytest.approx(6.117787, abs=1e-6) and got[1] == pytest.approx(13.457637, abs=1e-6)
