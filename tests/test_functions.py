import itertools
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from seqloom.operators import markov
from seqloom.operators.residual import ModelCodec
from seqloom.operators.token_models import MarkovModel, UniformModel
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import coded_bits, copies, every_source, lz76
from conftest import SAMPLE
from seqloom.functions import context_bits, queued
from seqloom.functions.catalog import expr
from seqloom.functions.matching import every_copy, greedy_copies, lz76_phrases
from seqloom.functions.rangecoder import Decoder, Encoder, decode_run, encode_run, integer_cdf
from seqloom.functions.register import register_functions


def value(spark, name, *args):
    return spark.range(1).select(expr(name, *args).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name,args,expected",
    [
        ("pack_bases", ["'ACGTAC'"], bytes.fromhex("1B10")),
        ("pack_bases", ["''"], b""),
        ("unpack_bases", ["X'1B10'", "6L"], "ACGTAC"),
        ("pack_bits", ["array(1,0,1,1,0,0,1,0,1,1,1)"], bytes.fromhex("B2E0")),
        ("unpack_bits", ["X'B2E0'", "11L"], [1, 0, 1, 1, 0, 0, 1, 0, 1, 1, 1]),
        ("integer_cdf", ["array(1D,1D,1D,1D,1D)", "10"], [2, 4, 6, 8, 10]),
        ("integer_cdf", ["array(1D,1D,1D)", "10"], [3, 7, 10]),
        ("integer_cdf", ["array(0D,1D,0D)", "4"], [1, 4, 5]),
        ("integer_cdf", ["array(.5D,.5D)", "5"], [2, 5]),
        ("integer_cdf", ["array(1D,1D,1D,1D,1D)", "3"], [1, 2, 3, 4, 5]),
        ("cdf_is_valid", ["array(1L, 2L)"], True),
        ("cdf_is_valid", ["array(2L, 2L)"], False),
        ("cdf_is_valid", ["array(0L, 2L)"], False),
        ("cdf_is_valid", ["CAST(array() AS ARRAY<BIGINT>)"], False),
        ("kmers", ["'ACGTA'", "3"], ["ACG", "CGT", "GTA"]),
        ("kmers", ["'AC'", "3"], []),
        ("gc_fraction", ["''"], 0.0),
        ("shannon_bits", ["'ACGTACGT'"], 2.0),
        ("mermaid_id", ["'1a-b'"], "node_1a_b"),
        ("mermaid_id", ["''"], "node_"),
        ("mermaid_id", ["'aZ_09'"], "aZ_09"),
        ("mermaid_id", ["'9'"], "node_9"),
        ("mermaid_id", ["'ä b:'"], "__b_"),
        ("mermaid_id", ["CAST(NULL AS STRING)"], None),
        ("context_tail", ["'ACGTAC'", "4L", "3L"], "CGT"),
        ("context_tail", ["'ACGTAC'", "4L", "0L"], ""),
        ("fasta_text", ["'>a'", "'ACGTAC'", "3"], ">a\nACG\nTAC\n"),
        ("alphabet_violations", ["'AZXNA'"], "XZ"),
        ("sequence_checksum", [f"'{SAMPLE}'"],
         "0ee8dc7d5c90730346d1da0b566058a932874a2034b04925b37fe1d40ae04faa"),
    ],
)
def test_scalar_values(spark, name, args, expected):
    got = value(spark, name, *args)
    assert (bytes(got) if isinstance(got, bytearray) else got) == expected


@pytest.mark.parametrize(
    "name,args,message",
    [
        ("pack_bases", ["'ACGTN'"], "A/C/G/T"),
        ("pack_bases", ["'AC0'"], "A/C/G/T"),
        ("unpack_bases", ["X'1B'", "6L"], "do not go together"),
        ("unpack_bases", ["X''", "-1L"], "fewer"),
        ("pack_bits", ["array(0, 1, 2)"], "0 or 1"),
        ("unpack_bits", ["X'00'", "9L"], "bit length"),
        ("integer_cdf", ["array(0D, 0D)", "4"], "add up to nothing"),
        ("integer_cdf", ["array(-1D, 2D)", "4"], "below zero"),
        ("integer_cdf", ["array(1D)", "0"], "scale"),
        ("u32_hex", ["4294967296L"], "32 bits"),
        ("fasta_text", ["'>a'", "'A'", "0"], "width above zero"),
    ],
)
def test_scalar_errors(spark, name, args, message):
    with pytest.raises(Exception, match=message):
        value(spark, name, *args)


def test_sql_registration(spark):
    names = register_functions(spark)
    assert {"kmers", "lz76_complexity", "decode_blocks"} <= set(names)
    row = spark.sql(
        f"SELECT hex(pack_bases('ACGT')) AS p, lz76_complexity('{SAMPLE}') AS c"
    ).first()
    assert (row["p"], row["c"]) == ("1B", 7)
    table = "0200000000000000000A0000000A00000050000000000000000A010000000A0000000000000008"
    rows = spark.sql(f"SELECT * FROM decode_blocks(X'{table}')").collect()
    assert [(r["type"], r["start"], r["length"]) for r in rows] == [
        ("llm_residual", 0, 10),
        ("graph_copy", 10, 8),
    ]


sequences = st.one_of(
    st.text(alphabet="A", max_size=40),
    st.text(alphabet="AC", max_size=60),
    st.text(alphabet="ACGTN", max_size=60),
    st.text(alphabet="ACG", min_size=5, max_size=20).map(lambda s: s + s[2:] + s + s[:4]),
)


@settings(max_examples=300, deadline=None)
@given(sequences, st.integers(1, 5), st.integers(0, 4))
def test_copies_equal_brute_force(seq, k, more):
    assert greedy_copies(seq, k, k + more, True) == copies(seq, k, k + more)
    if more:
        assert greedy_copies(seq, k, k + more) == copies(seq, k, k + more)
    listed = []
    for start in range(len(seq) - k + 1):
        length, source = every_source(seq, k, start)
        if length >= k + more:
            listed.append((start, source, length))
    assert every_copy(seq, k, k + more, True) == listed
    assert lz76_phrases(seq) == lz76(seq)


def test_safe_copies_never_overlap():
    assert greedy_copies("AAAA", 3, 3, True) == [(1, 0, 3)]
    assert greedy_copies("AAAA", 3, 3) == []


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.lists(st.integers(1, 50), min_size=1, max_size=6), st.integers(0, 5)),
        min_size=1, max_size=40,
    ),
    st.sampled_from([16, 32, 64]),
)
def test_coder_round_trip_and_bits(items, width):
    cdfs, symbols = [], []
    for weights, pick in items:
        total, marks = 0, []
        for weight in weights:
            total += weight
            marks.append(total)
        cdfs.append(marks)
        symbols.append(pick % len(marks))
    coder = Encoder(width)
    for symbol, cdf in zip(symbols, cdfs):
        coder.put(symbol, cdf)
    payload, size = coder.finish()
    assert [(payload[i // 8] >> (7 - i % 8)) & 1 for i in range(size)] == coded_bits(
        symbols, cdfs, width
    )
    decoder = Decoder(payload, size, width)
    assert [decoder.get(cdf) for cdf in cdfs] == symbols


def test_coder_edges():
    coder = Encoder()
    for _ in range(5):
        coder.put(0, [1])
    payload, size = coder.finish()
    decoder = Decoder(payload, size)
    assert [decoder.get([1]) for _ in range(5)] == [0] * 5
    with pytest.raises(ValueError, match="16 bits"):
        Encoder(8)
    with pytest.raises(ValueError, match="above the one before"):
        Encoder().put(0, [2, 2])
    with pytest.raises(ValueError, match="no such symbol"):
        Encoder().put(2, [1, 2])
    with pytest.raises(ValueError, match="bit length"):
        Decoder(b"\0", 9)


@given(st.lists(st.floats(0, 100), min_size=1, max_size=8).filter(lambda w: sum(w) > 1e-6),
       st.integers(1, 40000))
@settings(deadline=None)
def test_integer_cdf_is_strict(weights, scale):
    marks = integer_cdf(weights, scale)
    assert marks[0] > 0 and all(a < b for a, b in zip(marks, marks[1:]))



def test_functions_are_built_in_expressions(table):
    plan = table("ACGT").select(expr("pack_bases", "seq"), expr("shannon_bits", "seq"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and F is not None


@pytest.mark.parametrize("state_bits", [64, 63, 40, 24])
@pytest.mark.parametrize("order", [1, 3])
def test_lanes_give_the_bits_of_the_coder(order, state_bits):
    draw = random.Random(order * 100 + state_bits)
    contexts = ["".join(p) for k in range(order + 1) for p in itertools.product("ACGTN", repeat=k)]
    # some contexts are missing, some symbols never follow, some nearly always do
    counts = {c: [draw.choice((0, 0, 1, 9, 10**6)) for _ in "ACGTN"] for c in contexts if draw.random() < 0.8}
    codec = ModelCodec(MarkovModel(order, counts, context_length=1024), state_bits)
    weights = [[draw.random() ** 6 + 1e-3 for _ in "ACGTN"] for _ in range(300)]
    texts = ["".join(draw.choices("ACGTN", w, k=draw.choice((0, 1, 2, 63, 64, 300)))) for w in weights]
    before = ["".join(draw.choices("ACGTN", k=draw.randrange(6))) for _ in texts]
    one = [codec.encode_batch([t], [b])[0] for t, b in zip(texts, before, strict=True)]
    assert codec.in_lanes and codec.encode_batch(texts, before) == one
    assert codec.decode_batch(one, before) == texts
    assert [codec.decode(c, b) for c, b in zip(one, before, strict=True)] == texts


def test_lanes_of_few_symbols_and_wide_scales():
    draw = random.Random(1)
    for model in (UniformModel(64, alphabet="AC", scale=2), UniformModel(64, scale=1 << 30), UniformModel(0)):
        codec = ModelCodec(model)
        texts = ["".join(draw.choices(model.alphabet, k=draw.randrange(200))) for _ in range(100)]
        cells = codec.encode_batch(texts, [""] * 100)
        assert cells == [codec.encode(t) for t in texts] and codec.decode_batch(cells, [""] * 100) == texts
    with pytest.raises(ValueError, match="outside the model"):
        ModelCodec(UniformModel(8)).encode_batch(["ACX"] * 100, [""] * 100)
    broken = [replace(c, bit_length=4, payload=b"\xff") for c in ModelCodec(UniformModel(0)).encode_batch(["AC"] * 70, [""] * 70)]
    assert len(ModelCodec(UniformModel(0)).decode_batch(broken, [""] * 70)) == 70


@pytest.mark.parametrize("order", [0, 1, 3, 9])
def test_contexts_of_many_texts_are_counted_together(order):
    draw = random.Random(order)
    texts = [b"", *("".join(draw.choices("ACGTN", k=draw.randrange(30))).encode() for _ in range(20)), b"A" * 50]
    leads = [min(len(text), draw.randrange(order + 1)) for text in texts]
    want = Counter()
    for text, lead in zip(texts, leads):
        for context, counts in zip(*context_bits.following_counts(text, order, lead)):
            want.update({(int(context), k): int(n) for k, n in enumerate(counts) if n})
    contexts, counts = context_bits.following_counts_of_all(texts, order, leads)
    got = {(int(c), k): int(n) for c, row in zip(contexts, counts) for k, n in enumerate(row) if n}
    assert got == dict(want) and len(set(contexts.tolist())) == len(contexts)
    assert [b"".join(some) for some, _ in markov._runs(texts, leads, 40)] != [b"".join(texts)]
    assert b"".join(b"".join(some) for some, _ in markov._runs(texts, leads, 40)) == b"".join(texts)


def _own_tables(draw, count, longest):
    records, tables = [], []
    for _ in range(count):
        symbols = draw.choice([1, 2, 5, 5])
        weights = [draw.choice([0, 1, 3, 1000]) for _ in range(symbols)]
        weights[draw.randrange(symbols)] += 1
        size = draw.choice([0, 1, 2, 50, draw.randrange(longest)])
        records.append(np.array(draw.choices(range(symbols), [w + 0.01 for w in weights], k=size), np.uint8))
        tables.append(integer_cdf(weights, draw.choice([32768, 7, 1 << 23, 1 << 40])))
    return records, tables


@pytest.mark.parametrize("count, cells", [(1, 1 << 23), (40, 1 << 23), (300, 1 << 23), (300, 4000)])
def test_records_in_queues_take_the_bits_of_the_plain_coder(count, cells, monkeypatch):
    monkeypatch.setattr(queued, "CELLS", cells)
    records, tables = _own_tables(random.Random(count), count, 400)
    if count == 300:  # tables that lanes take, each record one of its own
        tables = [table if table[-1] <= queued.TOTAL else [m * 7 for m in range(1, 6)] for table in tables]
    cells = queued.encode_records(records, tables)
    for tokens, table, cell in zip(records, tables, cells, strict=True):
        assert cell == encode_run(tokens.tolist(), 0, lambda _, t=table: t, lambda s, _: s)
    backs = queued.decode_records(cells, [len(r) for r in records], tables)
    assert all(np.array_equal(*pair) for pair in zip(records, backs, strict=True))


def test_records_of_odd_lengths_share_their_steps(monkeypatch):
    """3,000 symbols of the longest are 3,000 steps, and nothing is coded one by one."""
    draw = random.Random(5)
    sizes = [3000, *(draw.randrange(1, 900) for _ in range(400))]
    records = [np.array(draw.choices(range(5), k=size), np.uint8) for size in sizes]
    tables = [integer_cdf([1 + k % 5, 2, 3, 4, 5], 32768) for k in range(len(sizes))]
    steps, made = [], queued._Lanes.shift
    monkeypatch.setattr(queued._Lanes, "shift", lambda *a: steps.append(1) or made(*a))
    for name in ("encode_run", "decode_run"):
        plain = getattr(queued, name)
        monkeypatch.setattr(queued, name, lambda tokens, *a, f=plain, **b: f(tokens, *a, **b) if len(tokens) == 0 else 1 / 0)
    cells = queued.encode_records(records, tables)
    assert len(steps) == 3000
    backs = queued.decode_records(cells, sizes, tables)
    assert len(steps) == 6000 and all(np.array_equal(*pair) for pair in zip(records, backs, strict=True))


def test_queued_decoder_refuses_what_no_table_gives():
    records = [np.zeros(100, np.uint8)] * 40
    tables = [[1, 32768]] * 40
    cells = queued.encode_records(records, tables)
    with pytest.raises(ValueError):
        queued.decode_records([(payload, 8 * len(payload) + 1) for payload, _ in cells], [100] * 40, tables)
    with pytest.raises(ValueError):
        queued.encode_records([np.array([2], np.uint8)], [[1, 2]])
    with pytest.raises(ValueError):
        queued.encode_records([np.array([0], np.uint8)], [[2, 2]])
