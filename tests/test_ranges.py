"""Reading by byte ranges, restoring by joins, and both numeric routes of code lengths."""

import pickle
import random
import time
import tracemalloc
from pathlib import Path

import pytest
from brute import restore
from pyspark.sql import functions as F

from seqloom import session
from seqloom.functions.matching import lz76_phrases
from seqloom.operators import graph, kmers, long_repeats, lz76_joins, markov
from seqloom.operators.repeats import best_sources, with_copies
from seqloom.operators.residual import PlainCodec
from seqloom.plans import archive_v1, archive_v2, restoring_by_joins
from seqloom.sources import archive_blocks, fasta, fasta_pieces, files
from seqloom.sources.ranges import RangeFile, dealt_ranges, file_sizes


def odd_fasta(draw):
    """Bytes that are mostly a FASTA file, with every kind of blank and some faults."""
    blanks = ["", "", "", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", " ", "\xa0", "\n \n"]
    words = ["ACGT", "acgtn", "N", "GATTACA" * 9, "é" if draw.random() < 0.1 else "T", ">" if draw.random() < 0.05 else "A"]
    head = draw.choice([">x", "> head é", ">", "x", ">long " + "h" * 90, "> b"])
    body = "".join(draw.choice(words) + draw.choice(blanks) * draw.randrange(3) for _ in range(draw.randrange(12)))
    return (head + draw.choice(["\n", "\r\n", "\r", "\x85", ""]) + draw.choice(["", " ", "\n"]) + body).encode()


def by_ranges(path, piece):
    rows = []
    for group in dealt_ranges(file_sizes(path), piece, 3 * piece):
        reader = fasta_pieces._FastaReader({"path": path})
        for batch in reader.read(group):
            rows += batch.to_pylist()
    bases = b"".join(row["bases"] for row in rows)
    if not bases:
        raise ValueError("empty")
    return rows[0]["header"], bases.decode()


def test_ranges_give_what_whole_files_give(tmp_path):
    draw = random.Random(4)
    for k in range(400):
        data = odd_fasta(draw)
        path = tmp_path / f"{k}.fa"
        path.write_bytes(data)
        try:
            want = fasta.parse_fasta(data)
        except ValueError:
            want = None
        for piece in (1, 2, 3, 7, 50, 10_000):
            try:
                got = by_ranges(f"file://{path}", piece)
            except ValueError:
                got = None
            assert got == want, (data, piece)


def test_fasta_pieces_of_one_large_file(spark, tmp_path):
    draw = random.Random(2)
    seq = "".join(draw.choices("ACGTN", k=300_000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.fa").write_text(">one\n" + "\n".join(seq[i : i + 60] for i in range(0, len(seq), 60)) + "\n")
    (tmp_path / "in" / "line.fa").write_text(">line\n" + seq[:100_000].lower())
    heads, pieces = fasta_pieces.read_pieces(spark, str(tmp_path / "in"), pieceBytes=20_000, taskBytes=1)
    whole = fasta.read_fasta(spark, str(tmp_path / "in"))
    rows = fasta_pieces.scan_pieces(spark, str(tmp_path / "in"), pieceBytes=20_000, taskBytes=1)
    assert rows.rdd.getNumPartitions() > 15  # ranges of one file are tasks of their own
    name = F.element_at(F.split("record_id", "/"), -1)
    texts = {}
    for r in pieces.orderBy("record_id", "offset").collect():
        held = texts.setdefault(r["record_id"], "")
        assert r["offset"] == len(held)
        texts[r["record_id"]] = held + bytes(r["bases"]).decode()
    assert {k.rsplit("/")[-1]: v for k, v in texts.items()} == {
        r["record_id"].rsplit("/")[-1]: r["seq"] for r in whole.collect()
    }
    assert {r["header"]: r["length"] for r in heads.collect()} == {">one": 300_000, ">line": 100_000}
    cut = fasta_pieces.recut(pieces, 13, 1000)
    assert cut.agg(F.max(F.octet_length("bases"))).first()[0] == 1012
    got = graph.piece_edges(cut, 12).withColumn("record_id", name)
    want = graph.debruijn_edges(whole, 12).withColumn("record_id", name)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("k", [3, 12])
def test_pieces_of_short_records_meet_before_they_are_counted(spark, table, k):
    draw = random.Random(k)
    seqs = ["".join(draw.choices("ACG"[: 1 + n % 3], k=draw.randrange(400))) for n in range(12)] + ["A" * 300]
    records = table(*seqs)
    # two records are said to be long, one has a piece twice
    size = F.expr(f"IF(record_id IN (2, 12), {1 << 21}L, 400L)")
    pieces = fasta_pieces.recut(kmers.chunks(records, 1, positions=30).withColumn("size_bound", size), k, 50)
    pieces = pieces.unionByName(pieces.where("record_id = 5 AND offset = 50"))
    assert "size_bound" in pieces.columns
    got = kmers.piece_window_counts(pieces, k)
    want = kmers.piece_window_counts(pieces.drop("size_bound"), k)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    # only the windows of long records are shuffled one by one
    only = kmers.piece_window_counts(pieces.withColumn("size_bound", F.lit(400)), k)
    plan = only._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan.split("Aggregate [record_id")[-1]


@pytest.mark.parametrize("text", ["ACGT\n", ">x\n", ">x\nAC>GT\n", ">x\nAC\n>y\nGT", ">x\nAC GT", ">x\nACX"])
def test_fasta_pieces_report_faults(spark, tmp_path, text):
    (tmp_path / "a.fa").write_text(text)
    with pytest.raises(Exception, match="FASTA"):
        heads, pieces = fasta_pieces.read_pieces(spark, str(tmp_path / "a.fa"), pieceBytes=2)
        heads.collect(), pieces.collect()
    if text != ">x\n":
        rows = fasta_pieces.scan_pieces(spark, str(tmp_path / "a.fa"), pieceBytes=2, mode="QUARANTINE")
        assert rows.where("error IS NOT NULL").count()


# --- archive blocks --------------------------------------------------------


@pytest.fixture(scope="module")
def archive_folder(spark, tmp_path_factory):
    draw = random.Random(8)
    unit = "".join(draw.choices("ACGT", k=400))
    rows = [(k, f">r{k}", "".join(draw.choices("ACGTN", k=3000)) + unit * (k % 4 + 1)) for k in range(20)]
    rows.append((20, ">empty", ""))
    records = spark.createDataFrame(rows, "record_id long, header string, seq string")
    cells = archive_v2.compress(records).cache()
    folder = str(tmp_path_factory.mktemp("archives"))
    named = cells.select(F.expr("concat(record_id, '.ghdna')").alias("name"), F.col("archive").alias("content"))
    files.write_files(named, folder)
    return folder, cells


def test_block_rows_without_payload(spark, archive_folder):
    folder, cells = archive_folder
    want = archive_v2.scan(cells).select("record_id", F.posexplode("blocks").alias("block_no", "b"))
    got = archive_blocks.scan_blocks(spark, folder)
    assert got.count() == want.count()
    reader = archive_blocks.ArchiveReader({"path": f"file://{folder}"}, got.schema)
    for path, whole in file_sizes(f"file://{folder}"):
        with RangeFile(path) as file:
            rows = list(reader.rows(path, file))
            payload = sum(r["payload_length"] or 0 for r in rows)
            assert file.bytes_read == whole - payload


def test_filters_reach_the_archive_reader(spark, archive_folder):
    folder, cells = archive_folder
    rows = archive_blocks.scan_blocks(spark, folder, payload=True)
    picked = rows.where("type = 'llm_residual' AND start > 100 AND path LIKE '%3.ghdna' AND length % 2 >= 0")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if line.strip().lstrip("+- *(1)").startswith("Filter")]
    assert not any("llm_residual" in line for line in filters)  # the source has taken it
    got = {(r["path"].rsplit("/")[-1], r["block_no"]): bytes(r["payload"]) for r in picked.collect()}
    opened = archive_v2.scan(cells).collect()
    want = {}
    for r in opened:
        for number, b in enumerate(r["blocks"]):
            if b["type"] == "llm_residual" and b["start"] > 100 and f"{r['record_id']}.ghdna".endswith("3.ghdna"):
                part = bytes(r["payload"])[b["payload_offset"] : b["payload_offset"] + b["payload_length"]]
                want[f"{r['record_id']}.ghdna", number] = part
    assert got == want
    # only files and payloads that pass are read
    reader = archive_blocks.ArchiveReader({"path": f"file://{folder}"}, rows.schema)
    from pyspark.sql.datasource import EqualTo, StringEndsWith, StringContains

    rest = StringContains(("path",), "x")
    left = list(reader.pushFilters([EqualTo(("type",), "none"), StringEndsWith(("path",), "/3.ghdna"), rest]))
    assert left == [rest] and [len(g.ranges) for g in reader.partitions()] == [1]
    path, whole = next(f for f in file_sizes(f"file://{folder}") if f[0].endswith("/3.ghdna"))
    with RangeFile(path) as file:
        assert list(reader.rows(path, file)) == [] and file.bytes_read < whole / 2


def planned(monkeypatch, module, reader, count, size):
    """Bytes of the driver a file, while a folder is planned and for what it hands to tasks; and the ranges."""
    folder = "file:///somewhere/that/has/a/long/path/0123456789abcdef0123456789abcdef"
    monkeypatch.setattr(module, "file_sizes", lambda _: ((f"{folder}/{k}", size(k)) for k in range(count)))
    tracemalloc.start()
    groups = reader.partitions()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(g.ranges) > 1100 for g in groups) == 0
    return peak / count, sum(len(pickle.dumps(g)) for g in groups) / count, [r for g in groups for r in g.ranges]


def test_the_driver_packs_a_folder_of_many_archives(spark, monkeypatch):
    schema = spark.createDataFrame([], archive_blocks.BLOCK_COLUMNS).schema
    reader = archive_blocks.ArchiveReader({"path": "file:///x"}, schema)
    peak, handed, ranges = planned(monkeypatch, archive_blocks, reader, 60_000, lambda k: k % 900)
    assert peak < 60 and handed < 15
    assert [(r.path.rsplit("/")[-1], r.size, r.number, r.start, r.end) for r in ranges] == [
        (str(k), k % 900, 0, 0, k % 900) for k in range(60_000)
    ]


def test_the_driver_packs_ranges_of_small_fasta_files(monkeypatch):
    """As ``fasta_piece_edges`` reads them: a record in one or two ranges, a file each."""
    reader = fasta_pieces._FastaReader({"path": "file:///x", "pieceBytes": "1000"})
    peak, handed, ranges = planned(monkeypatch, fasta_pieces, reader, 40_000, lambda k: 400 + k % 1600)
    assert peak < 100 and handed < 25
    two = [k for k in range(40_000) if 400 + k % 1600 > 1000]
    assert len(ranges) == 40_000 + len(two)
    assert [(r.number, r.start, r.end) for r in ranges if r.path.endswith("/1599")] == [(0, 0, 1000), (1, 1000, 1999)]


def test_the_driver_packs_ranges_of_a_large_fasta_file(monkeypatch):
    """As ``fasta_pieces`` may read them: ranges of one file, a few to a task."""
    reader = fasta_pieces._FastaReader({"path": "file:///x", "pieceBytes": "1000", "taskBytes": str(1 << 26)})
    peak, handed, ranges = planned(monkeypatch, fasta_pieces, reader, 1, lambda k: 50_000_500)
    assert peak / 50_001 < 60 and handed / 50_001 < 15
    assert [(r.number, r.start, r.end) for r in ranges] == [
        (k, 1000 * k, min(1000 * k + 1000, 50_000_500)) for k in range(50_001)
    ]


def test_folders_are_listed_as_they_are_read(tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.fa", "a.fa", ".x.partial", "_SUCCESS"):
        (tmp_path / "in" / name).write_text("12345")
    (tmp_path / "in" / "folder").mkdir()
    (tmp_path / "in" / "link.fa").symlink_to(tmp_path / "in" / "a.fa")
    uri = f"file://{tmp_path}/in"
    listed = file_sizes(uri)
    assert iter(listed) is listed
    assert sorted(listed) == [(f"{uri}/{name}", 5) for name in ("a.fa", "b.fa", "link.fa")]
    assert sorted(file_sizes(uri + "/")) == [(f"{uri}/{name}", 5) for name in ("a.fa", "b.fa", "link.fa")]
    assert list(file_sizes(f"{uri}/a.fa")) == [(f"{uri}/a.fa", 5)]
    with pytest.raises(FileNotFoundError):
        file_sizes(f"{uri}/none")


# --- restoring by joins ----------------------------------------------------


def tiles_of(draw, literals="ACGT"):
    """Random tiles whose copies reach into copies of copies."""
    tiles, length = [], 0
    while length < draw.choice((0, 50, 30_000)):
        if length == 0 or draw.random() < 0.3:
            text = "".join(draw.choices(literals, k=draw.choice((1, 5, 9000))))
            tiles.append((length, len(text), None, text))
        else:
            source = draw.randrange(length)
            size = draw.randrange(1, length - source + 1)
            tiles.append((length, size, source, None))
        length += tiles[-1][1]
    return tiles


def test_restoring_by_joins(spark):
    draw = random.Random(6)
    listed = {k: tiles_of(draw) for k in range(12)}
    # a chain as long as the record: each tile copies the one before it
    listed[100] = [(0, 7, None, "GATTACA")] + [(7 * k, 7, 7 * k - 7, None) for k in range(1, 700)]
    texts = {key: restore(tiles) for key, tiles in listed.items()}
    rows = [(key, *tile) for key, tiles in listed.items() for tile in tiles]
    tiles = spark.createDataFrame(rows, "record_id long, start long, length long, source long, literal string")
    records = spark.createDataFrame([(k, len(t)) for k, t in texts.items()], "record_id long, length long")
    pieces = restoring_by_joins.restored_pieces(tiles.repartition(4), records).cache()
    got = dict.fromkeys(texts, "")
    for r in pieces.orderBy("record_id", "offset").collect():
        assert r["offset"] == len(got[r["record_id"]])
        got[r["record_id"]] += bytes(r["bases"]).decode()
    assert got == texts
    sizes = {r["record_id"]: r["length"] for r in restoring_by_joins.piece_digests(pieces).collect()}
    assert sizes == {k: len(t) for k, t in texts.items() if t}


@pytest.mark.parametrize(
    "rows",
    [
        [(0, 4, None, "ACGT"), (5, 2, 0, None)],
        [(0, 4, None, "ACGT"), (4, 2, 3, None)],
        [(0, 4, None, "ACGT"), (4, 2, -1, None)],
        [(0, 4, None, "ACG"), (4, 2, 0, None)],
        [(0, 4, None, "ACGT"), (4, 2, None, None)],
        [(0, 4, None, "ACGT"), (2, 4, 0, None)],
        [(0, 6, None, "ACGTAA"), (0, 6, None, "ACGTAA")],
        [(1, 5, None, "ACGTA")],
        [],
    ],
)
def test_bad_tiles_are_refused(spark, rows):
    tiles = spark.createDataFrame(
        [(1, *row) for row in rows], "record_id long, start long, length long, source long, literal string"
    )
    records = spark.createDataFrame([(1, 6)], "record_id long, length long")
    with pytest.raises(Exception, match="block|copy reference"):
        restoring_by_joins.restored_pieces(tiles, records).collect()


def test_wrong_checksum_is_refused(spark, table):
    about, tiles = archive_v1.tile_rows(archive_v1.compress(table("ACGT" * 40, "")))
    pieces = restoring_by_joins.restored_pieces(tiles, about)
    assert restoring_by_joins.verified(pieces, about).count() == 2
    with pytest.raises(Exception, match="checksum"):
        restoring_by_joins.verified(pieces, about.withColumn("sha256", F.lit("0"))).collect()


# --- numeric routes and many blocks ----------------------------------------


def test_code_lengths_do_not_depend_on_the_route(spark, table):
    draw = random.Random(3)
    unit = "".join(draw.choices("ACGT", k=90))
    seqs = ["".join(draw.choices("ACGTN", [5, 1, 3, 2, 1], k=n)) + unit + "AC" * 9 + unit for n in (0, 1, 70, 3000, 20_000)]
    records = table(*seqs)
    one = archive_v1.compress(records).collect()
    other = archive_v1.compress(records, local_bases=0).collect()
    assert sorted(one) == sorted(other)
    scored = markov.score(markov.fit(records, 3), records.withColumn("start", F.lit(0)), 3)
    want = {r["record_id"]: r["bits"] for r in markov.record_bits(records, 3).collect()}
    assert {r["record_id"]: r["bits"] for r in scored.collect()} == want


def test_json_archives_of_short_records_take_one_scan(spark, tmp_path):
    rows = [(k, f">r{k}", "ACGT" * 30, 120) for k in range(9)]
    spark.createDataFrame(rows, "record_id long, header string, seq string, size_bound long").write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r"))
    plan = archive_v1.blocks(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_work_is_linear_in_the_blocks_of_a_record(spark):
    copies = 50_000
    seq = "A" * 20 + "CA" * copies
    listed = f"transform(sequence(1, {copies}), k -> named_struct('start', 19L + 2 * k, 'source', 0L, 'length', 1L))"
    records = spark.createDataFrame([(1, ">x", seq)], "record_id long, header string, seq string")
    planned = records.withColumn("copies", F.expr(listed))
    begin = time.perf_counter()
    cells = archive_v2.compress(planned).select("block_count", "payload_bytes").first()
    assert cells["block_count"] >= 2 * copies and cells["payload_bytes"] == len(seq) - copies
    rows = archive_v2.encoded_blocks(archive_v2.plan(planned, PlainCodec()), PlainCodec())
    total = rows.agg(F.sum("payload_length"), F.max("payload_offset"), F.count("*")).first()
    assert total[0] == cells["payload_bytes"] and total[2] == cells["block_count"]
    assert time.perf_counter() - begin < 60


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 2000):
        values = f"IF({n} = 0, CAST(array() AS ARRAY<BIGINT>), transform(sequence(1, greatest({n}, 1)), x -> CAST(x AS BIGINT)))"
        got = spark.range(1).select(F.expr(archive_v2.running_sums(values))).first()[0]
        assert got == [k * (k + 1) // 2 for k in range(n)]


def test_with_copies_keeps_both_routes(spark, table):
    seq = "ACGTTGCA" * 30
    assert with_copies(table(seq), 8, 16).collect() == with_copies(table(seq), 8, 16, local_bases=0).collect()


@pytest.mark.parametrize("short", [1, 3, 12])
def test_lz76_by_joins(spark, table, short):
    draw = random.Random(short)
    unit = "".join(draw.choices("ACGT", k=60))
    seqs = ["", "A", "AA", "ACGT" * 50, "A" * 200, "N" * 3 + "AC" * 20]
    seqs += ["".join(draw.choices("ACGTN"[: draw.randrange(1, 6)], k=draw.randrange(200))) for _ in range(10)]
    seqs += ["".join(draw.choice((unit, unit[5:40], "G")) for _ in range(9))]
    got = lz76_joins.lz76_by_joins(table(*seqs), short)
    assert {r[0]: r[1] for r in got.collect()} == {k: lz76_phrases(s) for k, s in enumerate(seqs)}


def test_lz76_over_stretches_and_pieces(spark, table):
    draw = random.Random(5)
    seqs = ["".join(draw.choices("ACGT", k=40_000)), "".join(draw.choices("AC", k=9000)) * 2]
    got = lz76_joins.lz76_by_joins(table(*seqs))
    assert {r[0]: r[1] for r in got.collect()} == {k: lz76_phrases(s) for k, s in enumerate(seqs)}


def test_lz76_of_windows_that_meet_over_pieces(spark, table):
    draw = random.Random(8)
    unit = "".join(draw.choices("ACGT", k=40))
    seqs = ["".join(draw.choices("ACGTN", k=9000)) + unit + "".join(draw.choices("AC", k=3000)) + unit, unit, "A" + unit * 2]
    got = lz76_joins.lz76_by_joins(table(*seqs), 24, lz76_joins.BLOCK)
    assert {r[0]: r[1] for r in got.collect()} == {k: lz76_phrases(s) for k, s in enumerate(seqs)}


def test_only_windows_that_may_come_again_are_grouped(spark, table):
    draw = random.Random(9)
    seqs = ["".join(draw.choices("ACGT", k=n)) for n in (0, 10, 39, 5000)]
    seqs.append(seqs[3][:600] + seqs[3])
    records = table(*seqs)
    for positions in (1000, 1 << 16):
        rows = long_repeats.recurring_kmers(records, 40, positions=positions).collect()
        assert {(r[0], r[1]) for r in rows} >= {(4, p) for p in (*range(561), *range(600, 1161))}
        assert all(bytes(r[2]).decode() == seqs[r[0]][r[1] : r[1] + 40] for r in rows)
        if positions > 5600:
            assert len(rows) == 2 * 561


def test_position_tables_are_never_broadcast(spark, table):
    unit = "".join(random.Random(10).choices("ACGT", k=300))
    best = long_repeats.best_copies(table(unit + "G" + unit), 15, 40)
    chosen = long_repeats.select_greedily(best)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert [r["length"] for r in chosen.collect()] == [300]


def test_neighbours_with_neighbouring_sources_are_compared_once(spark, table, monkeypatch):
    draw = random.Random(12)
    unit, other = ("".join(draw.choices("ACGT", k=n)) for n in (300, 90))
    seqs = [unit + "G" + unit, unit + "A" + unit[:200] + other + "C" + unit[:200] + other, other]
    compared, made = [], long_repeats._compared

    def counted(runs, *others):
        compared.append(runs.selectExpr("count(*)", "sum(last - start + 1)").first())
        return made(runs, *others)

    monkeypatch.setattr(long_repeats, "_compared", counted)
    records = table(*seqs)
    got = sorted(map(tuple, long_repeats.best_copies(records, 15, 40).collect()))
    assert compared[0][0] < 10 and compared[0][1] > 500
    assert got == sorted(map(tuple, best_sources(records, 15, 40).collect()))


def test_next_candidate_of_many_copies(spark):
    draw = random.Random(13)
    rows = []
    for record in range(4):
        for start in sorted(draw.sample(range(3 * long_repeats.BLOCK), 1500 if record else 3)):
            # many copies end at one place
            end = draw.choice([(start // 500 + 1) * 500, start + draw.randrange(1, 9000)])
            rows.append((record, start, 0, max(1, end - start)))
    best = spark.createDataFrame(rows, "record_id long, start long, source long, length long")
    pointers = long_repeats._pointers(best)
    want = []
    for record, start, _, length in rows:
        later = [s for r, s, _, _ in rows if r == record and s >= start + length]
        want += [(record, start, min(later))] if later else []
    assert sorted(map(tuple, pointers.collect())) == sorted(want)
    assert "lambda" not in pointers._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_iterations_leave_the_disk(spark, table):
    draw = random.Random(14)
    unit = "".join(draw.choices("ACGT", k=200))
    seqs = [unit + "G" + unit + unit[:70], "AC" * 60, "", "A"]
    before, setting = set(session._written), spark.conf.get(session._CLEANUP, None)
    got = lz76_joins.lz76_by_joins(table(*seqs))
    left = [path for path in session._written if path not in before]
    there = {path.name for path in Path(session.scratch_folder(spark).removeprefix("file://")).iterdir()}
    assert len(left) == 2 and all(path.rsplit("/")[-1] in there for path in left)
    assert {r[0]: r[1] for r in got.collect()} == {k: lz76_phrases(s) for k, s in enumerate(seqs)}
    assert spark.conf.get(session._CLEANUP, None) == setting


def test_a_kept_table_outlives_the_steps_around_it(spark):
    kept = []

    def inner():
        kept.append(session.keep(session.settled(spark, lambda: session.cut_lineage(spark.range(3)))))
        return session.cut_lineage(spark.range(5)).where("id > 1")

    before = set(session._written)
    outer = session.settled(spark, inner)
    assert outer.count() == 3 and kept[0].count() == 3
    assert {path for path in session._written if path not in before} == {outer._seqloom_path, kept[0]._seqloom_path}
    session.drop(*kept, spark.range(1))
    assert kept[0]._seqloom_path not in session._written
