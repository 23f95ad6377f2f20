"""Operators on documents against brute force: fixtures with every odd row, and a whole table."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from urllib.parse import unquote

import numpy as np
import plain
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import (
    exact_dedup,
    language,
    mixing,
    ngram_join,
    packing,
    privacy,
    secrets,
    token_shards,
)
from seqloom.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sha int, copies int, row int"


def make(spark, rows):
    """Documents of ``(doc_id, text, lang, source)`` with extra columns whose names clash."""
    full = [(*row, len(row[1] or ""), "x", 1, 2, 3) for row in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "omega", "Ünder", "x1", "tion", "é"]
    text = lambda n: " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(n))
    base = [text(n) for n in (3, 4, 5, 30, 60, 200)]
    rows = [(i, t, "en", "a") for i, t in enumerate(base)]
    for k, t in enumerate(base):
        rows.append((20 + k, t, "en", "b"))
        rows.append((30 + k, t.replace(" ", "\n \t"), "de", None))
        changed = t.split(" ")
        changed[len(changed) // 2] = "changed"
        rows.append((40 + k, " ".join(changed), None, "c"))
        rows.append((50 + k, t.upper(), "de", "c"))
    rows += [(60, None, "en", "a"), (61, "", "en", "a"), (62, " \n", None, None), (63, "...", "de", "b")]
    rows += [(None, base[3], "en", "a"), (None, None, None, None), (None, "only here once", "en", "z")]
    rows += [(70, "a b", "en", "a"), (71, "A  B", "en", "a"), (72, "a b c", "en", "a")]
    rows += [(80, text(9000), "en", "long"), (81, "x" * 50_000, "en", "long")]
    rows += [rows[3], rows[3], (90, "tie", "en", "a"), (91, "tie", "en", "a")]
    rows += [(92, "Ab<|endoftext|>c it's DON'T 12,5 \x1c\x85 日本", "en", "a")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(), make(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, []).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def copy_groups(rows):
    groups = {}
    for key, text, *_ in rows:
        body = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(body, []).append((-len(text or ""), key is None, key))
    out = []
    for key, text, *_ in rows:
        body = re.sub("[\x20\x09-\x0d]", "", text or "")
        keep = min(groups[body], key=lambda r: (r[0], r[1], r[2] or 0))[2]
        out.append((key, keep, len(groups[body]), key == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"capacity": 2}, {"key_bits": 3}, {"key_bits": 3, "capacity": 1}])
def test_exact_groups(odd, options):
    rows, docs = odd
    got = exact_dedup.exact_groups(docs, **options)
    assert sorted(map(tuple, got.collect()), key=str) == copy_groups(rows)


def test_directory_splits_overfull_buckets(spark):
    keys = [(k << 56,) for k in range(-128, 128)] + [(7 << 56 | k,) for k in range(1, 40)]
    heads = spark.createDataFrame(keys, "key long")
    cells, depth = exact_dedup.directory(heads, 16)
    placed = heads.withColumn("cell", exact_dedup.cell_of(depth)).join(cells, "cell")
    held = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}
    assert sum(held.values()) == len(keys)
    # 40 keys share the bits of the first directory, which doubles until they fit
    assert max(held.values()) <= 16 and len(held) > 8


def test_buckets_split_until_each_fits(spark):
    """Keys that share their first bits: a depth from their number alone would leave them together."""
    keys = [(k << 20,) for k in range(300)] + [(-(1 << 60) + k,) for k in range(60)]
    heads = spark.createDataFrame(keys, "key long").cache()
    cells, depth = exact_dedup.directory(heads, 4)
    placed = heads.withColumn("cell", exact_dedup.cell_of(depth)).join(cells, "cell")
    assert placed.count() == len(keys)
    held = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert max(held) <= 4 and depth > 40
    with_heads = heads.selectExpr("key", "key AS keep_id", "1L AS group_size")
    index = exact_dedup.build_index(with_heads, 4)
    owned = index.heads.select("bucket", F.input_file_name().alias("file")).collect()
    assert len(owned) == len(keys)
    assert len({(r["bucket"], r["file"]) for r in owned}) == len({r["bucket"] for r in owned})
    # a row meets its head in the bucket that the directory names
    met = index.located(heads).join(index.heads, ["bucket", "key"])
    assert met.where("key = keep_id").count() == len(keys) == met.count()


def test_drop_copies_keeps_columns(odd, empty):
    rows, docs = odd
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    found = [r["doc_id"] for r in kept.collect()]
    bodies = {hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest() for _, t, *_ in rows}
    assert len(found) == len(bodies)
    assert kept.first()["sha"] == 1 and kept.first()["id"] == "x"
    assert exact_dedup.drop_copies(empty).count() == 0


def test_ngram_join(odd, empty):
    rows, docs = odd
    with_id = [(k, t) for k, t, *_ in rows if k is not None]
    want = plain.jaccard_components(dict(with_id).items())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want
    assert ngram_join.near_copies(docs).count() == len(rows)
    assert ngram_join.near_copies(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    roots = {root for k, (n, root) in want.items()}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == roots


@pytest.mark.parametrize("least", [50, 85, 100])
def test_ngram_join_of_families(spark, least):
    """Large groups of near copies, chains, and passages shared by many texts."""
    draw = random.Random(least)
    word = lambda: f"w{draw.randrange(100_000)}"
    rows, passage = [], [word() for _ in range(40)]
    for _ in range(6):
        text = [word() for _ in range(draw.choice((12, 40, 90)))]
        for _ in range(25):
            copy = list(text)
            for _ in range(draw.randrange(6)):
                copy[draw.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
            if draw.random() < 0.3:
                text = copy
    rows += [(500 + k, " ".join([*passage, *(word() for _ in range(draw.choice((1, 3, 9, 60))))])) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs, least=least).collect()}
    assert got == plain.jaccard_components(rows, least)


def test_ngram_join_whole_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(documents).collect()}
    assert got == plain.jaccard_components(rows)


def check_mixture(rows, got, blocks=None):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    target = mixing.targets(sizes)
    assert abs(sum(target.values()) - min(sum(sizes.values()), 3 * sum(sizes.values()))) < 1e-6
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        taken[r["source"]] += r["size"] * len(r["shards"])
        assert len(r["shards"]) <= 3 and all(0 <= s < mixing.SHARDS for s in r["shards"])
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], target[r["source"]])
    assert len(got) == len(rows)
    return target, taken


def test_mixing(odd, empty):
    rows, docs = odd
    got = mixing.mixture(docs).collect()
    target, taken = check_mixture(rows, got)
    largest = {s: max(len((t or "").split()) for _, t, _, src in rows if src == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_whole_table(documents):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()]
    for blocks in (1, 4, mixing.BLOCKS):
        target, taken = check_mixture(rows, mixing.mixture(documents, blocks=blocks).collect())
        near = 0.05 if blocks == mixing.BLOCKS else 0.1
        assert all(abs(taken[s] - target[s]) <= near * target[s] for s in target)
    mixture = mixing.mixture(documents).collect()
    listed = mixing.shard_rows(mixing.mixture(documents)).collect()
    assert len(listed) == sum(len(r["shards"]) for r in mixture)
    # the mixture of the pipeline: shard after shard, each in its shuffled order
    order = sorted((s, p, r["doc_id"]) for r in mixture for s, p in zip(r["shards"], r["places"], strict=True))
    mixed = [r["doc_id"] for r in mixing.mixed_documents(documents).collect()]
    assert mixed == [k for *_, k in order] and mixed != sorted(mixed)


def test_mixing_of_many_sources_and_missing_ids(spark):
    """A source a document, beside one of many rows without an id."""
    rows = [(k, "w " * (1 + k % 5), "en", f"s{k}") for k in range(300)]
    rows += [(None, f"text {k} " * (1 + k % 9), "en", "hot") for k in range(900)]
    docs = make(spark, rows)
    got = mixing.mixture(docs).collect()
    target, taken = check_mixture(rows, got)
    assert abs(taken["hot"] - target["hot"]) <= 0.05 * target["hot"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in target if s != "hot")
    # rows without an id are spread over blocks by their text
    sized = mixing.sized(docs).where("source = 'hot'")
    assert sized.select("block").distinct().count() > 300
    counts = Counter(r["text"] for r in mixing.mixed_documents(docs).collect())
    assert sum(counts.values()) == sum(len(r["shards"]) for r in got)


def test_targets_and_quotas():
    assert mixing.targets({"a": 10, "b": 10, None: 40}) == {"a": 10.0, "b": 20.0, None: 30.0}
    assert mixing.targets({"a": 100, "b": 1}) == {"b": 3.0, "a": 98.0}
    assert mixing.targets({"a": 0}) == {"a": 0.0}
    quotas = np.array([1000, 0, 37, 5])
    split = mixing.split_quotas(quotas, 7, 3)
    assert (split.sum(axis=0) == quotas).all() and (split >= 0).all()
    assert split.sum(axis=1).max() - split.sum(axis=1).min() <= 3
    assert (split == mixing.split_quotas(quotas, 7, 3)).all()


def reference_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*f.ids, 1] for f in found]


def check_packing(rows, got):
    want = []
    for (key, *_), ids in zip(rows, reference_ids([t for _, t, *_ in rows]), strict=True):
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(held), -(-sum(r["length"] for r in got) // 4096)


def test_packing(odd, empty, documents):
    rows, docs = odd
    check_packing(rows, packing.pack_documents(docs).collect())
    assert packing.pack_documents(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    used, least = check_packing(rows, packing.pack_documents(documents).collect())
    assert used <= least * 1.002 + 1
    whole = packing.sequences(docs).collect()
    for r in whole:
        assert len(r["ids"]) % 4 == 0 and len(r["ids"]) <= 4 * 4096


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    draw = random.Random(seed)
    most = draw.choice((100, 1000, 4096))
    histogram = {}
    for _ in range(draw.choice((1, 50, 3000))):
        n = draw.randint(1, most)
        histogram[n] = histogram.get(n, 0) + draw.choice((1, 1, 40))
    options = {"groups": draw.choice((1, 5, 48)), "thresholds": draw.choice(((2,), (8,), (2, 3, 4, 8)))}
    plan = packing.make_plan(histogram, 4096, **options)
    held = {}
    for times, lengths in plan.runs:
        assert sum(lengths) <= 4096 and times > 0
        for n in lengths:
            held[n] = held.get(n, 0) + times
    assert held == histogram
    least = -(-sum(n * c for n, c in histogram.items()) // 4096)
    if most <= 1000 and len(histogram) > 30:
        assert plan.sequences <= least * 1.02 + 1


def test_language(spark, documents, odd, empty):
    model = language.train(documents)
    rows = {r["doc_id"]: r for r in documents.collect()}
    found = language.predict(documents, model).collect()
    right = [rows[r["doc_id"]]["lang"] == r["lang_pred"] for r in found if r["held_out"]]
    assert len(found) == len(rows) and np.mean(right) > 0.97
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    again = language.train(documents.repartition(5))
    assert np.allclose(model.weights, again.weights) and model.temperature == again.temperature
    listed, docs = odd
    unknown = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert {k for k in (60, 61, 62, 63) if unknown[k]["lang_pred"] == "und"} == {60, 61, 62, 63}
    assert language.predict(docs, model).count() == len(listed)
    kept = language.accepted(docs, model, 0.0)
    assert kept.columns == docs.columns and not {60, 61, 62, 63} & {r["doc_id"] for r in kept.collect()}
    nothing = language.train(empty)
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty, nothing).count() == 0


def test_language_takes_one_row_of_a_repeated_id(spark, documents):
    """Rows that repeat one id and language weigh as one in training, however many they are."""
    base = documents.select("doc_id", "text", "lang").where("lang IS NOT NULL")
    hot = base.where("crc32(cast(doc_id AS string)) % 5 <> 0").limit(1).cache()
    many = base.unionByName(hot.crossJoin(spark.range(2000)).drop("id"))
    model, again = language.train(base), language.train(many)
    assert model.labels == again.labels
    assert len(language.sample(many).collect()) == len(language.sample(base).collect())


def test_language_ignores_held_out_labels(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    wrong = documents.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    model, other = language.train(documents), language.train(wrong)
    assert model.labels == other.labels and np.allclose(model.weights, other.weights)


PERSONAL = [
    "a@b.c_d@e.f x.y@z a@b@c.d .@-.- a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3.x 01.2.3.999",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111123 41111111111111111", "+1 (017) 555-7713 +1 ((( ++12345678 +1.2-3 4567890123456789",
    "é" * 5 + "me@host.org é 10.0.0.1 日本+49 30 1234567 ", "+" * 3000 + "1" * 3000, "a" * 40_000 + "@" + "b" * 40_000, "1 " * 20_000, "9" * 60_000, "1." * 30_000,
]


def test_privacy(spark, odd, empty, documents):
    rows = [(i, t, "en", "a") for i, t in enumerate(PERSONAL)] + [(100, None, None, None), (100, None, None, None)]
    found = privacy.find_personal_data(make(spark, rows)).collect()
    texts = {k: t for k, t, *_ in rows}
    assert len(found) == len(rows)
    for r in found:
        spans = plain.personal_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == plain.digest(spans), texts[r["doc_id"]][:60]
        assert r["spans"] == plain.listed(spans)
        assert [r[f"n_{k}"] for k in privacy.PATTERNS] == [sum(s[0] == k for s in spans) for k in privacy.PATTERNS]
    assert privacy.find_personal_data(empty).count() == 0
    assert privacy.find_personal_data(odd[1]).count() == len(odd[0])
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in privacy.find_personal_data(documents).collect():
        assert r["base_sha256"] == plain.digest(plain.personal_spans(texts[r["doc_id"]]))


def test_privacy_terms(spark):
    """A word that appears only beside an address gives it away; common words do not."""
    rows = [(i, f"{i * 7} letters of {i * 5} days the mayor Quillfeather wrote {i} from q@town.org today {i * 3}", "en", "a") for i in range(6)]
    rows += [(100 + i, f"the clerk wrote {i} from town today", "en", "a") for i in range(400)]
    rows += [(900, "a note on Quillfeather", "en", "a")]
    docs = make(spark, rows)
    found = {r["doc_id"]: r for r in privacy.find_personal_data(docs).collect()}
    for k in (2, 900):
        at = dict((r[0], r[1]) for r in rows)[k].index("Quillfeather")
        assert f"term:{at}:{at + 12}" in found[k]["spans"]
    assert "term" not in found[105]["spans"]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(docs).collect()}
    assert set(clean) == {*range(6), 900}
    assert "Quillfeather" not in clean[2] and "[email]" in clean[2] and "today" in clean[2]


def test_privacy_terms_need_more_than_one_text(spark):
    """Rare words beside an address are no evidence, nor are its copies and near copies."""
    draw = random.Random(2)
    body = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    near = lambda k: " ".join([*body[:60], f"n{k}", *body[60:]])
    rows = [(0, "the mayor Quillfeather wrote from q@town.org today", "en", "a")]
    rows += [(1, "the baker Ashgrove wrote from r@other.org today", "en", "a")] * 5
    rows += [(10 + k, f"{near(k)} Larkspur s@third.org", "en", "a") for k in range(8)]
    # one address each, of one domain: the word is held to the domain
    rows += [(30 + k, f"{draw.random()} desk {k} of {draw.random()} Fennimore is p{k}@firm.org {draw.random()}", "en", "a") for k in range(9)]
    rows += [(100 + i, f"the mayor or baker or clerk wrote letter {i} from town today", "en", "a") for i in range(3000)]
    found = {r["doc_id"]: r for r in privacy.find_personal_data(make(spark, rows)).collect()}
    assert [found[k]["n_term"] for k in (0, 1, 10, 17)] == [0, 0, 0, 0]
    assert all("term" in found[30 + k]["spans"] for k in range(9))
    assert sum(r["n_term"] for k, r in found.items() if k >= 100) == 0


def test_privacy_shares_by_brute_force(spark):
    draw = random.Random(6)
    terms = [f"term{chr(97 + k)}x" for k in range(26)]
    rows = []
    for k in range(500):
        people = draw.sample(range(12), draw.choice((0, 0, 1, 2)))
        said = [*draw.sample(terms, 6), *(f"name{chr(97 + p)}x" for p in people if draw.random() < 0.9)]
        said += [f"m{p}@d{p % 3}.org" for p in people] + [f"x{draw.randrange(10**9)}" for _ in range(8)]
        draw.shuffle(said)
        rows.append((k, " ".join(said), "en", "a"))
    rows += rows[:40]
    docs = make(spark, rows)
    got = {(r["entity"], r["term"]): r["share"] for r in privacy.disclosures(docs, privacy.scan(docs)).collect()}
    want = plain.disclosing([text for _, text, *_ in rows], privacy.DEVIATIONS, privacy.GENERALISE)
    assert set(got) == set(want) and want
    assert all(abs(got[pair] - want[pair]) < 1e-9 for pair in want)


def test_privacy_leaves_entity_free_documents_alone(spark):
    """Precision on the given table: hardly a document without personal data is marked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = privacy.find_personal_data(docs).select("n_term", F.expr("n_email + n_ip + n_card + n_phone = 0").alias("free")).collect()
    marked = [r["n_term"] > 0 for r in rows if r["free"]]
    assert sum(marked) < 0.02 * len(marked)


def test_secrets(spark, odd, empty, documents):
    draw = random.Random(8)
    hexes = ["".join(draw.choices("0123456789abcdef", k=40)) for _ in range(300)]
    rows = [(i, f'note token = "{h}" end', "en", "a") for i, h in enumerate(hexes)]
    loose = hexes[7][:24]
    rows += [
        (900, f"see {loose} there", "en", "a"), (901, "plain words 1234567890123456 and internationalisation", "en", "a"),
        (902, "PassWord: 'abcdefgh' api-key=12345678 apikey=\"short\" tokens: aaaaaaaa secret ſecret:12345678", "en", "a"),
        (903, "AKIA0123456789AB AKIAshort AKIA012345678 é" + "f" * 31 + " é " + "f" * 32, "en", "a"),
        (904, None, None, None), (905, "", None, None), (906, "secret" + " " * 30_000, None, None), (906, "a" * 90_000, None, None),
    ]
    found = secrets.find_secrets(make(spark, rows)).collect()
    texts = {k: t for k, t, *_ in rows}
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] != 906:
            spans = plain.secret_spans(texts[r["doc_id"]])
            assert r["base_sha256"] == plain.digest(spans)
            assert [s for s in r["spans"].split(",") if s and not s.startswith("format")] == [s for s in plain.listed(spans).split(",") if s]
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert spans[900] == "format:4:28" and spans[901] == ""
    assert secrets.find_secrets(empty).count() == 0
    assert secrets.find_secrets(odd[1]).count() == len(odd[0])
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in secrets.find_secrets(documents).collect():
        assert r["base_sha256"] == plain.digest(plain.secret_spans(texts[r["doc_id"]]))


UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FORMATS = {
    "ghp": ("ghp_", UPPER + UPPER.lower() + DIGITS, 36), "xoxb": ("xoxb-", UPPER + UPPER.lower() + DIGITS, 48),
    "aiza": ("AIza", UPPER + UPPER.lower() + DIGITS + "_-", 35), "bare": ("", UPPER + UPPER.lower() + DIGITS, 32),
    "capitals": ("", UPPER + DIGITS, 20), "dotted": ("", UPPER + UPPER.lower() + DIGITS + ".", 24),
    "short": ("", UPPER + UPPER.lower() + DIGITS, 12), "letters": ("", UPPER + UPPER.lower(), 24),
}


@pytest.mark.parametrize("name", FORMATS)
def test_secrets_of_any_alphabet(spark, documents, name):
    """Unlabelled values of a labelled format are found, whatever its symbols; other tokens are not."""
    draw = random.Random(4)
    prefix, symbols, size = FORMATS[name]
    value = lambda: prefix + "".join(draw.choices(symbols, k=size - 1)) + draw.choice(DIGITS if "0" in symbols else UPPER)
    rows = [(i, f"set token={value()} now", "en", "a") for i in range(500)]
    loose = [value().lstrip(".") for _ in range(40)]
    rows += [(1000 + i, f"see {v} there", "en", "a") for i, v in enumerate(loose)]
    rows += [(2000 + i, f"user{i:08d} internationalisation 2024-05-{i % 28 + 1:02d} getUserNameById {i:020d}", "en", "a") for i in range(40)]
    rows += [(10_000 + r["doc_id"], r["text"], "en", "b") for r in documents.collect()]
    found = secrets.find_secrets(make(spark, rows)).collect()
    hits = {r["doc_id"]: r["spans"] for r in found if r["n_format"]}
    right = sum(hits.get(1000 + i) == f"format:4:{4 + len(v)}" for i, v in enumerate(loose))
    assert right >= 36
    assert not [k for k in hits if not 1000 <= k < 2000]


def test_candidates_around_base_spans():
    """A token that reaches beyond a base span is scored as a whole and in its parts."""
    left, middle, right = "QWxhZGRpbjpvcGVu", "0123456789abcdef" * 2, "ZGVzYW1lU2VjcmV0"
    text = f"{left}{middle}{right} x {middle} password=abcdefghij {left}"
    found = secrets.candidates(text, secrets.base_spans(text))
    assert [(v, p) for _, _, v, p in found] == [
        (left + middle + right, secrets.WHOLE), (left, secrets.PART), (right, secrets.PART), (left, secrets.APART),
    ]
    assert all(text[s:e] == v for s, e, v, _ in found)
    text = f"{left}{middle[:-4]}.." + middle
    assert [v for *_, v, p in secrets.candidates(text, secrets.base_spans(text)) if p == secrets.PART] == [left + middle[:-4]]


def test_background_counts_every_symbol():
    tokens = secrets.Tokens(pa.array(["a" * 1000, "b" * 300, "c" * 9, "12345678"]))
    counts = secrets.Background.counted(tokens)
    pairs = (secrets.ALPHABET + 1) * secrets.ALPHABET
    assert counts[:pairs].sum() == 1000 + 300 + 9 + 8
    lengths = counts[pairs : pairs + secrets.LONGEST + 2]
    assert lengths.sum() == 4 and lengths[secrets.LONGEST + 1] == 2 and lengths[9] == 1
    background = secrets.Background(counts)
    assert np.isfinite(background.score(tokens)).all()


def test_runs_of_digits_are_no_secrets(spark, documents):
    """Precision on the table: no card-like number is taken for a credential."""
    found = secrets.find_secrets(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    values = []
    for r in found.where("n_format > 0").collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s.startswith("format")]
        values += [texts[r["doc_id"]][int(b) : int(e)] for _, b, e in spans]
    assert not [v for v in values if v.isdigit()]


def test_automaton_merges_and_generalises():
    draw = random.Random(8)
    values = ["id-" + "".join(draw.choices("0123456789", k=12)) for _ in range(400)]
    automaton = secrets.Automaton(values)
    assert len(automaton.seen) < 200
    assert automaton.bits("id-987654321098") < 75 < automaton.bits("zz-qwertyuiopas")


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000, 4097])
def test_slots_are_a_permutation(size):
    numbers = np.arange(size)
    slots = token_shards.slots_of(numbers, size, key=9)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert (token_shards.numbers_of(slots, size, key=9) == numbers).all()
    if size > 100:
        assert (slots != token_shards.slots_of(numbers, size, key=10)).any()


def test_token_shards(odd, empty, tmp_path):
    rows, docs = odd
    options = {"stride": 64, "per_shard": 32}
    found = token_shards.write_shards(docs, str(tmp_path / "s"), **options).collect()
    size = len(found)
    assert sorted(r["slot"] for r in found) == list(range(size))
    held = list(token_shards.read_slots(str(tmp_path / "s"), 0, size, **options))
    back = {}
    number = dict(zip(token_shards.numbers_of(np.arange(size), size, 1).tolist(), range(size), strict=True))
    by_slot = {r["slot"]: r for r in found}
    for n in range(size):
        r = by_slot[number[n]]
        ids = held[r["slot"]][: r["n_tokens"]]
        assert zlib.crc32(ids.astype("<u2").tobytes()) == r["ids_crc32"]
        assert sum(p["length"] for p in r["parts"]) == r["n_tokens"] and not held[r["slot"]][r["n_tokens"] :].any()
        for p in r["parts"]:
            back.setdefault(p["doc_id"], []).extend(ids[p["at"] : p["at"] + p["length"]].tolist())
    want = {}
    for (key, *_), ids in zip(rows, reference_ids([t for _, t, *_ in rows]), strict=True):
        want.setdefault(key, []).append(ids)
    for key, listed in want.items():
        assert sorted(back[key]) == sorted(x for ids in listed for x in ids)
        if len(listed) == 1:
            assert back[key] == listed[0]
    files = sorted(os.listdir(tmp_path / "s"))
    assert files == [token_shards.shard_name(k) for k in range(-(-size // 32))]
    assert all((tmp_path / "s" / f).stat().st_size % 128 == 0 for f in files)
    assert token_shards.write_shards(empty, str(tmp_path / "e"), **options).count() == 0


def test_token_sequences_lie_together_and_shards_are_dealt_out_evenly(spark, tmp_path, monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = [(k, " ".join(draw.choices(words, k=400))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    written = []

    def kept(rows, **options):
        written.append(cut_lineage(rows, **options))
        return written[-1]

    monkeypatch.setattr(token_shards, "cut_lineage", kept)
    found = token_shards.write_shards(docs, str(tmp_path / "s"), per_shard=20)
    ids = [ids.astype("<u2") for ids in token_shards.read_slots(str(tmp_path / "s"), 0, found.count(), per_shard=20)]
    alone = sum(len(zstandard.ZstdCompressor(level=5).compress(x.tobytes())) for x in ids)
    size = sum(os.path.getsize(f.removeprefix("file:")) for f in (unquote(f) for f in written[0].inputFiles()))
    assert size < 0.95 * alone
    # a shard a task, and one file a task
    shards = found.select("shard", F.input_file_name().alias("file")).distinct().collect()
    assert len(shards) == len({r["shard"] for r in shards}) == len({r["file"] for r in shards}) > 3
