"""Token shards in training order.

1. Documents become token ids and a closing id; the ids of one input split run on without gaps and
   are cut into sequences of ``STRIDE`` tokens, the last one of a split being shorter.
2. Sequences are numbered by split and place in it (counts per split, no global sort).
3. A keyed Feistel network over the next power of four, walked until it lands below the number of
   sequences, maps each number to one slot: a permutation that needs no table and that anyone who
   has the key can compute for any slot.
4. Sequences are dealt out by shard, and tasks write shards of ``PER_SHARD`` records of fixed length (``STRIDE`` ids of
   2 bytes, or 4 for large vocabularies, padded with 0), so slot ``s`` starts at a known byte of a
   known file and reading can resume anywhere. A shard is written aside and renamed, so a task
   that is run twice leaves the same file.

Null text is an empty document. Repeated rows are written each. An empty table writes no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import BROADCAST_IDS, cut_lineage, scratch_folder
from seqloom.llm.tokens import DEFAULT, word_ids

STRIDE = 1024
PER_SHARD = 4096
CLOSING = (1).to_bytes(4, "little")
ROUNDS = 6
#: Tasks that write shards: one a shard, up to this many.
MOST_TASKS = 10_000


def _mix(x: np.ndarray, key: int, round_: int) -> np.ndarray:
    x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + round_ * 0xD1B54A32D192ED03) % (1 << 64))).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(size: int) -> int:
    return max(1, (max(1, size - 1).bit_length() + 1) // 2)


def _walk(numbers: np.ndarray, size: int, key: int, rounds) -> np.ndarray:
    half = np.uint64(_half_bits(size))
    mask = np.uint64((1 << int(half)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in rounds:
            if rounds[0] == 0:
                left, right = right, left ^ (_mix(right, key, r) & mask)
            else:
                left, right = right ^ (_mix(left, key, r) & mask), left
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= size]  # outside: walk the cycle on
    return out.astype(np.int64)


def slots_of(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """Slot of each sequence number below ``size``: a permutation."""
    return _walk(numbers, size, key, list(range(ROUNDS)))


def numbers_of(slots: np.ndarray, size: int, key: int) -> np.ndarray:
    """The inverse of :func:`slots_of`."""
    return _walk(slots, size, key, list(range(ROUNDS - 1, -1, -1)))


def width_of(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_PARTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32()), ("length", pa.int32())]))


def sequences(docs: DataFrame, tokenizer: str = DEFAULT, stride: int = STRIDE) -> DataFrame:
    """``split, place, n_tokens, ids, parts``: gapless sequences of each input split."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        width = width_of(len(encoder.packed))
        rest, parts, filled = [], [], 0

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([n for n, _, _ in rows], pa.int32()),
                    pa.array([ids for _, ids, _ in rows], pa.binary()),
                    pa.array([held for _, _, held in rows], _PARTS),
                ],
                ["n_tokens", "ids", "parts"],
            )

        def closed() -> tuple:
            ids = np.frombuffer(b"".join(rest), "<u4").astype(width)
            return len(ids), ids.tobytes(), parts

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                keys = batch.column(0).slice(at, 256).to_pylist()
                for key, found in zip(keys, encoder.encode(batch.column(1).slice(at, 256).to_pylist()), strict=True):
                    found += CLOSING
                    begin, size = 0, len(found) // 4
                    while begin < size:
                        take = min(stride - filled, size - begin)
                        rest.append(found[4 * begin : 4 * (begin + take)])
                        parts.append({"doc_id": key, "at": filled, "length": take})
                        begin, filled = begin + take, filled + take
                        if filled == stride:
                            rows.append(closed())
                            rest, parts, filled = [], [], 0
                if rows:
                    yield emit(rows)
        if filled:
            yield emit([closed()])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "n_tokens int, ids binary, parts array<struct<doc_id:bigint, at:int, length:int>>"
    return (
        rows.mapInArrow(cut, schema)
        .withColumn("split", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )


def slotted(held: DataFrame, key: int, per_shard: int = PER_SHARD) -> tuple[DataFrame, int]:
    """Sequences with ``slot`` and ``shard``, ids compressed, and their number. ``held`` is a written table."""
    counted = held.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    size = int(counted.agg(F.sum("n")).first()[0] or 0)
    before = counted.select("split", (F.expr("sum(n) OVER (ORDER BY split)") - F.col("n")).alias("before"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slot = slots_of(batch.column("number").to_numpy(), size, key)
            ids = pa.array([pack.compress(cell.as_buffer()) for cell in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("n_tokens"), ids, batch.column("parts"), pa.array(slot), pa.array(slot // per_shard)],
                ["n_tokens", "ids", "parts", "slot", "shard"],
            )

    # a row per input split; the sequences themselves do not move for their numbers
    if before.count() <= BROADCAST_IDS:
        before = F.broadcast(before)
    rows = held.join(before, "split").withColumn("number", F.col("before") + F.col("place"))
    rows = rows.select("n_tokens", "ids", "parts", "number")
    schema = "n_tokens int, ids binary, parts array<struct<doc_id:bigint, at:int, length:int>>, slot bigint, shard bigint"
    return rows.mapInArrow(assign, schema), size


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(
    docs: DataFrame,
    folder: str,
    key: int = 1,
    tokenizer: str = DEFAULT,
    stride: int = STRIDE,
    per_shard: int = PER_SHARD,
) -> DataFrame:
    """Writes the shards and gives ``slot, shard, row, n_tokens, ids_crc32, parts`` per sequence."""
    # many sequences a page are compressed together; each on its own once it moves
    held = cut_lineage(sequences(docs, tokenizer, stride), compression="zstd")
    rows, size = slotted(held, key, per_shard)
    # shards are of one size, so ranges need not be sampled by a pass over all sequences first
    tasks = min(max(1, -(-size // per_shard)), MOST_TASKS)
    placed = rows.repartitionById(tasks, F.expr(f"CAST(shard % {tasks} AS INT)")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, unpack = word_ids(tokenizer), zstandard.ZstdDecompressor()
        record = stride * np.dtype(width_of(len(encoder.packed))).itemsize
        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root, recursive=True)
        current, sink, aside = None, None, None

        def close() -> None:
            sink.close()
            system.move(aside, f"{root}/{shard_name(current)}")

        try:
            for batch in batches:
                crc = []
                shards = batch.column("shard").to_pylist()
                for shard, ids in zip(shards, batch.column("ids").to_pylist(), strict=True):
                    if shard != current:
                        if sink:
                            close()
                        current, aside = shard, f"{root}/_{shard}-{uuid.uuid4().hex}"
                        sink = system.open_output_stream(aside)
                    data = unpack.decompress(ids)
                    crc.append(zlib.crc32(data))
                    sink.write(data + bytes(record - len(data)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("slot"),
                        batch.column("shard"),
                        pa.array(batch.column("slot").to_numpy() % per_shard),
                        batch.column("n_tokens"),
                        pa.array(crc, pa.int64()),
                        batch.column("parts"),
                    ],
                    ["slot", "shard", "row", "n_tokens", "ids_crc32", "parts"],
                )
            if sink:
                close()
                sink = None
        finally:
            if sink and not sink.closed:  # a task that fails leaves no file aside
                sink.close()
                system.delete_file(aside)

    schema = (
        "slot bigint, shard bigint, row bigint, n_tokens int, ids_crc32 bigint,"
        " parts array<struct<doc_id:bigint, at:int, length:int>>"
    )
    # written once: the files follow from the rows, and are not written again when these are read
    return cut_lineage(placed.mapInArrow(write, schema))


def read_slots(
    folder: str, start: int, count: int, stride: int = STRIDE, per_shard: int = PER_SHARD, width: str = "<u2"
) -> Iterator[np.ndarray]:
    """Sequences from slot ``start`` on, by seeking: what a trainer that resumes does."""
    system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    record = stride * np.dtype(width).itemsize
    for slot in range(start, start + count):
        with system.open_input_file(f"{root}/{shard_name(slot // per_shard)}") as file:
            file.seek(slot % per_shard * record)
            yield np.frombuffer(file.read(record), width)


def shard_folder(spark) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
