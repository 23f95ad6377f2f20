"""Quality by compression: which of two dictionaries makes a text smaller.

* Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad.
* A text is cut into blocks of ``BLOCK`` bytes, as a dictionary helps at the start of what it is
  used on, and every block is compressed with each. With ``g`` and ``b`` the summed sizes, the
  normalised difference is ``(b - g) / (b + g)``.
* A logistic curve over it, fitted on labelled texts that no dictionary has seen and weighted to
  the share of each label among all of them, makes the score.

Training reads text and ``quality`` 0 or 1 of rows whose ``crc32(doc_id as text) mod 3`` is not 1
(a row without ``doc_id`` has no label): at most ``PER_LABEL`` rows a label, those of the smallest
hash of their id and text, of them ``BLOCKS`` blocks of ``LEARNED`` bytes evenly spread. A score
reads all of the text and nothing else. Null text counts as empty; an empty text has no difference and gets
the curve's value at 0. Where one label or none was learned every score is the share of label 1
(one of each label added). Rows that repeat are scored each; a ``doc_id`` with several labels counts
with each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import cut_lineage, lowest, text_of, tidy

#: Bound of the training sample: rows per label, and blocks of each.
PER_LABEL = 1000
BLOCKS = 4
#: Bytes of a block that is learned from, and of one that is scored.
LEARNED = 1024
BLOCK = 512
DICTIONARY = 1 << 16
LEVEL = 3
#: Every so many-th row of the sample calibrates and is in no dictionary.
APART = 4


def spread_blocks(data: bytes, size: int = LEARNED, most: int = BLOCKS) -> list[bytes]:
    """At most ``most`` blocks of ``size`` bytes, from the first to the last of the text."""
    count = -(-len(data) // size)
    chosen = range(count) if count <= most else [k * (count - 1) // (most - 1) for k in range(most)]
    return [data[k * size : (k + 1) * size] for k in chosen]


def build_dictionary(blocks: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the blocks themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(data)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False
    )


class Difference:
    """Normalised difference of the sizes of whole texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def __call__(self, text: str | None) -> float:
        text, good, bad = text or "", 0, 0
        # characters at a time, so that a very long text is not held twice
        for begin in range(0, len(text), 1 << 20):
            data = text[begin : begin + (1 << 20)].encode("utf-8", "replace")
            for k in range(0, len(data), BLOCK):
                block = data[k : k + BLOCK]
                good += len(self.good.compress(block))
                bad += len(self.bad.compress(block))
        return (bad - good) / (bad + good) if good else 0.0


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float

    def scorer(self):
        if not (self.good and self.bad):
            return lambda _: _curve(self.shift)
        difference = Difference(self.good, self.bad)
        return lambda text: _curve(self.slope * difference(text) + self.shift)


def _curve(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit_curve(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve, by Newton's method with halved steps."""
    columns = np.stack([x * 100, np.ones(len(x))], axis=1)
    weight = weight / weight.mean()
    held = np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = columns @ w
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + ridge * w @ w / 2)

    for _ in range(100):
        share = 1 / (1 + np.exp(-np.clip(columns @ held, -500, 500)))
        gradient = columns.T @ (weight * (share - label)) + ridge * held
        curvature = (columns * (weight * share * (1 - share))[:, None]).T @ columns + ridge * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        while loss(held - step) > loss(held) and np.abs(step).max() > 1e-9:
            step /= 2
        held = held - step
        if np.abs(step).max() < 1e-9:
            break
    return float(held[0] * 100), float(held[1])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    place = F.xxhash64(F.lit("quality"), "doc_id", text_of())
    # texts stay where they are: only ids and hashes meet the labels
    narrow = cut_lineage(docs.select("doc_id", place.alias("_at")).join(marked.distinct(), "doc_id"))
    totals = {r["quality"]: r["count"] for r in narrow.groupBy("quality").count().collect()}  # two rows
    if len(totals) < 2:
        return Model(b"", b"", 0.0, math.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)))
    chosen = lowest(narrow.distinct(), "quality", F.col("_at"), per_label).select("quality", "doc_id", "_at")
    placed = docs.select("doc_id", text_of().alias("text"), place.alias("_at"))
    # per_label rows a label, repeats of one row counting once
    joined = placed.join(F.broadcast(chosen), ["doc_id", "_at"])
    sample = cut_lineage(joined.dropDuplicates(["quality", "doc_id", "_at"]).select("quality", "_at", "text"))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py().encode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([spread_blocks(text)], pa.list_(pa.binary()))],
                    ["quality", "_at", "blocks"],
                )

    rows = sample.select("quality", "_at", "text").mapInArrow(tidy(learned), "quality int, _at bigint, blocks array<binary>")
    # at most per_label rows of BLOCKS * LEARNED bytes for each of two labels
    blocks: dict[int, list[bytes]] = {0: [], 1: []}
    apart = set()
    listed = sorted(rows.collect(), key=lambda r: (r["quality"], r["_at"], list(map(bytes, r["blocks"]))))
    for k, r in enumerate(listed):
        if k % APART == APART - 1:
            apart.add(r["_at"])
        else:
            blocks[r["quality"]] += map(bytes, r["blocks"])
    good, bad = build_dictionary(blocks[1]), build_dictionary(blocks[0])
    if not (good and bad):
        return Model(b"", b"", 0.0, math.log((totals[1] + 1) / (totals[0] + 1)))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = Difference(good, bad)
        for batch in batches:
            x = [difference(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.float64())], ["quality", "_at", "x"])

    seen = sample.select("quality", "_at", "text").mapInArrow(tidy(differences), "quality int, _at bigint, x double")
    unseen = sorted((r["quality"], r["_at"], r["x"]) for r in seen.collect() if r["_at"] in apart)
    label, x = np.array([r[0] for r in unseen]), np.array([r[2] for r in unseen])
    shares = [totals[q] / max(1, int((label == q).sum())) for q in (0, 1)]
    slope, shift = fit_curve(x, label, np.array(shares)[label]) if len(set(label.tolist())) == 2 else (0.0, math.log((totals[1] + 1) / (totals[0] + 1)))
    return Model(good, bad, slope, shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            found = [scorer(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(p >= 0.5) for p in found], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(tidy(scored), "doc_id bigint, held_out boolean, score double, predicted int")
