"""Texts of several blocks, and the pipeline on rows of every odd kind."""

import random
import zlib
from collections import Counter

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_documents import FOLDER, check_packing, copy_groups, make, odd_rows, reference_ids

import corpus_pipeline
from seqloom.llm import boilerplate, exact_dedup, language, ngram_join, packing, token_shards, tokens


def long_words():
    draw = random.Random(11)
    return [f"wort{draw.randrange(20_000)}" for _ in range(520_000)]


@pytest.fixture(scope="module")
def rows():
    """Two near copies of more bytes than any block, an exact copy, and a short text."""
    words = long_words()
    text = " ".join(words)
    words[50::100] = ["changed"] * len(words[50::100])
    assert len(text) > 1 << 22
    listed = [(1, text), (2, " ".join(words)), (3, text.replace(" ", "\n")), (4, "short one")]
    return [(k, t, "en", "a") for k, t in listed]


@pytest.fixture(scope="module")
def long_docs(spark, rows):
    return make(spark, rows).repartition(2).cache()


def test_packing_of_long_texts(long_docs, rows):
    few = [r for r in rows if r[0] in (1, 4)]
    check_packing(few, packing.pack_documents(long_docs.where("doc_id IN (1, 4)")).collect())


def test_shards_of_long_texts(long_docs, rows, tmp_path):
    few = [r for r in rows if r[0] in (1, 4)]
    found = token_shards.write_shards(long_docs.where("doc_id IN (1, 4)"), str(tmp_path / "s")).collect()
    size = len(found)
    number = token_shards.numbers_of(np.array([r["slot"] for r in found]), size, 1).tolist()
    held, back = list(token_shards.read_slots(str(tmp_path / "s"), 0, size)), {}
    for _, r in sorted(zip(number, found, strict=True), key=lambda pair: pair[0]):
        ids = held[r["slot"]][: r["n_tokens"]]
        assert zlib.crc32(ids.astype("<u2").tobytes()) == r["ids_crc32"]
        for p in r["parts"]:
            back.setdefault(p["doc_id"], []).append(ids[p["at"] : p["at"] + p["length"]])
    for (key, *_), want in zip(few, reference_ids([t for _, t, *_ in few]), strict=True):
        assert (np.concatenate(back[key]) == np.array(want)).all()


def test_joins_of_long_texts(long_docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(long_docs).collect()}
    assert got == plain.jaccard_components([(k, t) for k, t, *_ in rows])
    assert [got[k][1] for k in (1, 2, 3, 4)] == [1, 1, 1, 4]
    found = exact_dedup.exact_groups(long_docs).collect()
    assert sorted(map(tuple, found), key=str) == copy_groups(rows)


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_features_do_not_depend_on_blocks(monkeypatch, block):
    draw = random.Random(block)
    for _ in range(40):
        text = "".join(draw.choice("aBc é日 .\n1") for _ in range(draw.randrange(200)))
        whole = language.features(text)
        with monkeypatch.context() as patch:
            patch.setattr(language, "BLOCK", block)
            cut = language.features(text)
        assert (whole is None) == (cut is None)
        if whole:
            assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_language_of_long_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.train(docs)
    base = docs.where("lang IS NOT NULL AND length(text) > 200").orderBy("doc_id").limit(4).collect()
    rows = [(r["doc_id"], " ".join([r["text"]] * ((1 << 21) // len(r["text"]))), None, "a") for r in base]
    assert all(len(t) > language.BLOCK for _, t, *_ in rows)
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(make(spark, rows), model).collect()}
    assert found == {r["doc_id"]: r["lang"] for r in base}


def test_boilerplate_of_long_pages_and_small_hosts(spark):
    own = lambda k: "".join(f"<p>own {k} {i}</p>" for i in range(30_000))
    pages = [(k, "https://long.example.org/", f"<p>same</p>{own(k)}<p>same</p>") for k in range(4)]
    # the ratio counts from three pages on: fewer say nothing about a host
    pages += [(10 * n + k, f"https://of{n}.example.org/", "same<br>other") for n in (1, 2, 3) for k in range(n)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = boilerplate.drop_boilerplate(table).collect()
    assert len(found) == len(pages)
    for r in found:
        if r["host"] == "long.example.org":
            assert (r["n_lines"], r["n_dropped"]) == (30_002, 2)
            assert r["text"] == "\n".join(f"own {r['page_id']} {i}" for i in range(30_000))
        else:
            assert (r["n_lines"], r["n_dropped"]) == (2, 2 if r["host"] == "of3.example.org" else 0)
    small = boilerplate.drop_boilerplate(table.where("page_id >= 10"), least_pages=1).collect()
    assert {r["n_dropped"] for r in small} == {2}


def test_pipeline_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage."""
    docs = make(spark, odd_rows())
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = make(spark, [(r["doc_id"] + 1000, r["text"], r["lang"], r["source"]) for r in given.collect()])
    held, stages, kept = docs.unionByName(given), dict(corpus_pipeline.STAGES), []
    for name in list(stages)[:-1]:
        found = stages[name](spark, held, FOLDER)
        assert found.columns == docs.columns
        held = spark.createDataFrame(found.collect(), docs.schema)
        kept.append(held.collect())
    known, single, apart, mixed = kept
    assert not {60, 61, 62, 63} & {r["doc_id"] for r in known}
    body = lambda r: "".join((r["text"] or "").split(" ")).translate(dict.fromkeys(range(9, 14)))
    groups = {}
    for r in known:
        groups.setdefault(body(r), []).append((-len(r["text"]), r["doc_id"] is None, r["doc_id"]))
    assert Counter(r["doc_id"] for r in single) == Counter(min(g)[2] for g in groups.values())
    texts = Counter(r["text"] for r in single)
    assert all(n == 1 for n in texts.values()) and {r["text"] for r in apart} <= set(texts)
    named = [(r["doc_id"], r["text"]) for r in single if r["doc_id"] is not None]
    linked = plain.jaccard_components(named, least=corpus_pipeline.LEAST, words=corpus_pipeline.WORDS)
    roots = {root for _, root in linked.values()}
    assert {r["doc_id"] for r in apart if r["doc_id"] is not None} == roots
    assert set(Counter(r["text"] for r in mixed).values()) <= {1, 2, 3}
    packed = stages["best-fit packing"](spark, held, FOLDER).collect()
    check_packing([(r["doc_id"], r["text"]) for r in mixed], packed)


def test_few_remembered_words_give_the_same_ids():
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdeé.", k=draw.randrange(1, 7))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=40)) for _ in range(200)]
    encoder = tokens.WordIds(public_tokenizers.path(tokens.DEFAULT))
    want = encoder.encode(texts)
    encoder.forget()
    encoder.remembered = 100
    got = []
    for text in texts:
        got += encoder.encode([text])
        assert len(encoder.known) <= 140
        assert set(text.lower().encode().split()) <= encoder.known.keys()
    assert got == want


def test_stages_take_short_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.range(0, 400, 1, 1).select(F.expr("repeat(string(id % 10), 50000)").alias("text"))
    try:
        stage = corpus_pipeline._shipped(lambda docs: docs.mapInArrow(sizes, "size long"))
        found = [r["size"] for r in stage(spark, docs, "").collect()]
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert sum(found) >= 400 * 50_000 and max(found) <= corpus_pipeline.BATCH_BYTES + 200_000
