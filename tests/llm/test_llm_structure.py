"""Conversation repair, quality by compression and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from seqloom.llm import conversations, periodic_runs, quality

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, copies int, fault string, part int, done int, first int"


def odd_turns():
    draw = random.Random(3)
    texts = (None, "", " \n", "Yes.", "No", "Ok! ", "ab?\n", "x ", "é.", "hm")
    roles = ("user", "assistant", "system", "user", "assistant", None, "", "tool")
    rows = []
    for c in range(80):
        for t in range(draw.randrange(1, 9)):
            key = c if c % 20 else None
            rows.append((key, draw.choice((t, t, t, t + 1, None)), draw.choice(roles), draw.choice(texts)))
    rows += rows[:20]
    for t in range(300):  # one long conversation, a third without turns
        text = draw.choice(("Yes.", "No", f"{draw.randrange(99)}.", f"x{draw.randrange(1000)}!"))
        rows.append((1000, t if t % 3 else None, draw.choice(("user", "assistant")), text))
    rows += [(1001, 5, "user", "again.")] * 40 + [(1002, 1, "user", "a" * 300_000)]
    rows += [(k, 0, "user", "only row.") for k in range(2000, 2060)]  # some of them are dropped
    return rows


def wanted(rows, damage=plain.damage):
    groups = {row[0]: [] for row in rows}
    for row in damage(rows):
        groups[row[0]].append(row)
    return sorted(((key, *plain.conversation(held)) for key, held in groups.items()), key=str)


def spaced(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.fixture(scope="module")
def turns(spark):
    rows = odd_turns()
    full = [(*row, 1, "x", 2, 3, 4) for row in rows]
    return rows, spark.createDataFrame(full, TURNS).repartition(3).cache()


@pytest.mark.parametrize("piece_rows", [1024, 7, 1])
def test_repair(turns, piece_rows):
    rows, table = turns
    got = conversations.damaged_and_repaired(table, piece_rows=piece_rows)
    assert sorted(map(tuple, got.collect()), key=str) == wanted(rows)


def test_repair_without_damage(turns, spark):
    rows, table = turns
    got = conversations.repair_conversations(table, piece_rows=50)
    assert sorted(map(tuple, got.collect()), key=str) == wanted(rows, spaced)
    assert conversations.repair_conversations(table.where("false")).count() == 0
    dropped = {row[0] for row in got.where("audit = ''").collect()}
    assert not dropped & {1000, 1001, 1002}


def test_repair_of_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    got = sorted(map(tuple, conversations.damaged_and_repaired(table).collect()), key=str)
    assert got == wanted([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_cheapest_audits():
    """Every row list of up to four rows: cost and audit as a search over whole strings finds them."""
    draw = random.Random(1)
    for _ in range(3000):
        n = draw.randrange(7)
        rows = [(draw.choice("suaux "), draw.choice(("", "", "truncated", "blank", "duplicate"))) for _ in range(n)]
        best = conversations.repair(rows, conversations.START)
        found = min((best[s][0], best[s][1].letters()) for s in conversations.FINAL if s in best)
        assert found == plain.cheapest_audit(*zip(*rows, strict=True) if rows else ("", ""))


@pytest.mark.parametrize("field", [(1 << 61) - 1, 2])
def test_order_of_audits(monkeypatch, field):
    """Also where hashes collide all the time."""
    monkeypatch.setattr(conversations, "_FIELD", field)
    draw = random.Random(field)
    nodes = [conversations.EMPTY]
    for _ in range(400):
        nodes.append(conversations.Audit(draw.choice(nodes[-20:]), draw.choice("DIKR")))
    for _ in range(2000):
        one, other = draw.choice(nodes), draw.choice(nodes)
        a, b = one.letters(), other.letters()
        shared = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert conversations.common_depth(one, other) == shared
        assert conversations.sorts_before(one, other) == (a < b)


# --- periodic runs ---------------------------------------------------------


def repeating(draw):
    words = [b"w%d" % draw.randrange(draw.choice((1, 2, 3, 30))) for _ in range(draw.randrange(160))]
    if words and draw.random() < 0.6:
        a, period = draw.randrange(len(words)), draw.randrange(1, max(2, len(words) // 3))
        unit = words[a : a + period]
        words = words[:a] + (unit * (len(words) // len(unit) + 1))[: len(words) - a + draw.randrange(5)]
        if draw.random() < 0.4 and len(words) > 5:
            words[draw.randrange(len(words))] = b"other"
    return words


@pytest.mark.parametrize("longest", [1024, 8])
def test_runs(monkeypatch, longest):
    monkeypatch.setattr(periodic_runs, "LONGEST", longest)
    draw = random.Random(longest)
    for _ in range(30):
        listed = [repeating(draw) for _ in range(20)]
        assert periodic_runs.runs_of(listed) == [plain.runs(words) for words in listed]
    assert periodic_runs.runs_of([]) == [] and periodic_runs.runs_of([[], []]) == [[], []]


def test_mismatches_are_exact():
    draw = np.random.default_rng(1)
    for width in (1, 2, 64, 1024):
        bits = min(16, (29 - (width - 1).bit_length()) // 2)
        blocks = draw.integers(0, 1 << bits, (3, width))
        windows = draw.integers(0, 1 << bits, (3, 3 * width))
        windows[1, 1 : width + 1] = blocks[1]
        blocks[2], windows[2] = (1 << bits) - 1, 0  # the largest sum there is
        got = periodic_runs.mismatches(blocks, windows)
        for row in range(3):
            want = [int(((blocks[row] - windows[row, s : s + width]) ** 2).sum()) for s in range(2 * width + 1)]
            assert got[row].tolist() == want
        assert got[1, 1] == 0


def test_scales_cover_all_periods():
    for longest in (1, 6, 7, 100, 5000):
        covered = set()
        for block, first, last in periodic_runs.scales(longest):
            covered |= {p for p in range(first, last + 1) if 2 * block - 1 <= max(p, 12 - p)}
        assert covered >= set(range(1, longest + 1))


def of_document(key, text):
    words = (text or "").encode().split()
    if key is not None and words and zlib.crc32(str(key).encode()) % 10 == 0:
        n, g = len(words), zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain.runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return key, len(found), *facts, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_periodic_documents(spark):
    draw = random.Random(9)
    rows = [(k, b" ".join(repeating(draw)).decode()) for k in range(150)]
    rows += [(None, "a b " * 20), (None, None), (200, ""), (201, " \n"), (202, "x " * 5000), rows[0], rows[0]]
    rows += [(203, ("word " * 9 + "é ü ") * 300 + "end"), (204, "x\x1cy x\x1cy " * 6)]
    full = [(*row, 1, 2, "x", len(row[1] or "")) for row in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, n_runs int, start int, length string, n_chars int")
    got = periodic_runs.periodic_runs(docs.repartition(3), repeat_tails=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((of_document(*row) for row in rows), key=str)
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0
    listed = periodic_runs.list_runs(docs.where("doc_id = 202")).collect()
    assert list(map(tuple, listed)) == [(202, 0, 5000, 1)]


def test_periodic_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r[0]: tuple(r) for r in periodic_runs.periodic_runs(docs, repeat_tails=True).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for key, text in rows:
        if len(text or "") < 6000:
            assert got[key] == of_document(key, text)


def test_very_long_text():
    unit = [b"%d" % k for k in range(9000)]
    assert periodic_runs.runs_of([unit * 12 + [b"tail"]]) == [[(0, 108_000, 9000)]]
    assert periodic_runs.runs_of([[b"same"] * 60_000]) == [[(0, 60_000, 1)]]


# --- quality ---------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs, quality.train(docs, labels)).cache()
    assert got.count() == docs.count()
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    held = got.join(labels.select("doc_id", "quality"), "doc_id").where("held_out")
    right = held.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).collect()
    assert all(share > 0.9 for _, share in right) and len(right) == 2
    # calibrated: scores are as high as labels are frequent
    mean = held.agg(F.avg("score"), F.avg("quality")).first()
    assert abs(mean[0] - mean[1]) < 0.05


def test_quality_learns_from_its_rows_only(spark):
    labelled = [(k, k % 2, 0) for k in range(300)]
    text = lambda k: f"a calm sentence number {k} about rivers. " * 9 if k % 2 else f"BUY!! NOW $$$ {k} ### " * 12
    rows = [(k, text(k), "en", "a", 1) for k in range(300)]
    rows += [(None, None, None, None, 1), (900, "", "en", "a", 1), (901, "long " * 200_000, "en", "a", 1), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality string, predicted int")
    labels = spark.createDataFrame(labelled + labelled[:50], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, per_label=60)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all(got[k]["predicted"] == k % 2 for k in range(300))
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(300))
    assert 0 <= got[900]["score"] <= 1 and got[None]["held_out"] is False
    # labels of held-out rows do not matter
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, turned, per_label=60) == model


@pytest.mark.parametrize("kept", ["quality = 1", "quality = 0", "false", "quality IS NULL"])
def test_quality_without_both_labels(spark, kept):
    docs = spark.createDataFrame([(k, "some text") for k in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k < 5 else 0 if k < 9 else None) for k in range(10)], "doc_id long, quality int").where(kept)
    scores = {r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    assert quality.score(docs.where("false"), quality.train(docs, labels)).count() == 0


def test_difference_reads_whole_texts():
    good, bad = b"the river was calm and the sky was blue. " * 50, b"BUY!! NOW $$$ CLICK ### " * 50
    differ = quality.Difference(good, bad)
    assert differ("the river was calm " * 40) > 0 > differ("CLICK ### BUY!! " * 40)
    assert differ("") == differ(None) == 0
    late = "the river was calm " * 70_000
    assert differ(late + "CLICK ### BUY!! " * 200_000) < 0 < differ(late)
