"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

* Features: n-grams of 1 to 3 characters of the lower-cased text, everything but letters being
  one space, hashed to ``DIMENSIONS``; term frequencies damped by a logarithm, times inverse
  document frequency over all labelled training rows, scaled to length 1.
* Training: follow-the-regularised-leader (proximal) with elastic-net penalties, on at most
  ``PER_LABEL`` rows of each label, those of the smallest hash of their id.
* Calibration: one temperature, fitted on the fifth of that sample left out of training.

Training reads text and non-null ``lang`` of rows whose ``crc32(doc_id as text) mod 5`` is not 0
(a row without ``doc_id`` is neither held out nor learned from). A prediction sees the text alone.
Null text, text without a letter, and any text where no label was learned give ``und``, score 0.
Repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import cut_lineage, lowest, tidy

DIMENSIONS = 1 << 16
#: Bound of the training sample: rows per label.
PER_LABEL = 500
EPOCHS = 3
#: Characters worked on at a time.
BLOCK = 1 << 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Used dimensions and damped frequencies, or None where the text has no letter."""
    counts, before, seen = np.zeros(DIMENSIONS, dtype=np.int64), np.array([32], np.uint32), False
    text = text or ""
    for begin in range(0, len(text), BLOCK):  # long texts in blocks: memory stays bounded
        block = text[begin : begin + BLOCK].lower()
        codes = np.frombuffer(block.encode("utf-32-le", "replace"), dtype=np.uint32)
        letters = _letter_table()[codes]
        seen |= bool(letters.any())
        codes = np.where(letters, codes, 32).astype(np.uint32)
        # runs of other characters count as one space, and the text has one at each end
        keep = codes != 32
        keep[1:] |= codes[:-1] != 32
        keep[:1] |= before[-1:] != 32
        before = _count_grams(counts, before, codes[keep])
    if not seen:
        return None
    if before[-1] != 32:
        _count_grams(counts, before, np.array([32], np.uint32))
    used = np.flatnonzero(counts)
    return used, np.log1p(counts[used])


def _count_grams(counts: np.ndarray, before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Adds the grams that end in ``codes``; gives the codes that later grams reach back to."""
    line = np.concatenate([before, codes])
    one = line * np.uint32(2654435761)
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(3266489917) + one[2:]
    new = len(codes)
    grams = np.concatenate([g[max(0, len(g) - new) :] for g in (one, two, three)])
    grams ^= grams >> np.uint32(15)
    places = (grams * np.uint32(668265263)) >> np.uint32(16)
    counts += np.bincount(places, minlength=DIMENSIONS)
    return line[-2:]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIMENSIONS + 1, labels); the last row is the bias
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text) if self.labels else None
        if found is None:
            return UNKNOWN, 0.0
        used, values = scaled(found, self.idf)
        logits = (values @ self.weights[used] + self.weights[-1]) / self.temperature
        shares = np.exp(logits - logits.max())
        best = int(shares.argmax())
        return self.labels[best], float(min(1.0, shares[best] / shares.sum()))


def scaled(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, values = found
    values = values * idf[used]
    return used, values / (np.linalg.norm(values) or 1.0)


def follow_leader(
    rows: list[tuple[np.ndarray, np.ndarray]],
    classes: list[int],
    labels: int,
    epochs: int = EPOCHS,
    alpha: float = 0.5,
    beta: float = 1.0,
    lasso: float = 0.02,
    ridge: float = 0.02,
) -> np.ndarray:
    """Weights by FTRL-proximal, one row at a time."""
    z = np.zeros((DIMENSIONS + 1, labels))
    n = np.zeros((DIMENSIONS + 1, labels))

    def weights(at) -> np.ndarray:
        held = z[at]
        shrunk = np.sign(held) * lasso - held
        return np.where(np.abs(held) <= lasso, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + ridge))

    for _ in range(epochs):
        for (used, values), label in zip(rows, classes, strict=True):
            at = np.append(used, DIMENSIONS)
            x = np.append(values, 1.0)
            w = weights(at)
            logits = x @ w
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1.0
            gradient = x[:, None] * error
            more = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of the smallest log loss, over a grid of powers."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), classes]).mean())

    return min((2.0**k for k in np.arange(-4, 4.01, 0.25)), key=lambda t: (round(loss(t), 9), abs(np.log(t))))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _document_counts(training: DataFrame) -> tuple[int, np.ndarray]:
    """Rows with letters and, per dimension, rows that use it: at most ``DIMENSIONS`` sums a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(DIMENSIONS + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (found := features(text.as_py())) is not None:
                    held[found[0]] += 1
                    held[DIMENSIONS] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(held[used])], ["dimension", "rows"]
        )

    sums = training.select("text").mapInArrow(tidy(count), "dimension int, rows bigint")
    total = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in sums.groupBy("dimension").agg(F.sum("rows").alias("rows")).collect():
        total[r["dimension"]] = r["rows"]
    return int(total[-1]), total[:-1]


def usable_rows(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5
    return docs.select("doc_id", "text", "lang").where(
        (held != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )


def sample(docs: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """``doc_id, text, lang, _order``: ``per_label`` rows a label, one for each id it has.

    Of rows that repeat an id and language, the one of the smallest text hash is taken.
    """
    usable = usable_rows(docs)
    order = F.xxhash64(F.lit("language"), "doc_id")
    ids = usable.select("doc_id", "lang").distinct()
    # written, so that its size is known where texts meet it
    chosen = cut_lineage(lowest(ids, "lang", order, per_label).select("doc_id", "lang"))
    one = F.min(F.struct(F.xxhash64("text"), "text")).getField("text")
    rows = usable.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(one.alias("text"))
    return rows.select("doc_id", "text", "lang", order.alias("_order"))


def train(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    usable = usable_rows(docs)
    rows, counts = _document_counts(usable)
    idf = np.log((1 + rows) / (1 + counts)) + 1
    chosen = sample(docs, per_label)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = features(batch.column(1)[k].as_py())
                if found is not None:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(3).slice(k, 1),
                            batch.column(0).slice(k, 1).cast(pa.int64()),
                            batch.column(2).slice(k, 1),
                            pa.array([found[0].astype("<u2").tobytes()], pa.binary()),
                            pa.array([found[1].astype("<f4").tobytes()], pa.binary()),
                        ],
                        ["_order", "doc_id", "lang", "used", "values"],
                    )

    schema = "_order bigint, doc_id bigint, lang string, used binary, values binary"
    listed = sorted(
        chosen.mapInArrow(tidy(extract), schema).collect(),
        key=lambda r: (r["_order"], r["doc_id"], r["lang"], bytes(r["used"])),
    )
    labels = sorted({r["lang"] for r in listed})
    if not labels:
        return Model([], idf, np.zeros((DIMENSIONS + 1, 0)), 1.0)
    vectors = [
        scaled((np.frombuffer(r["used"], "<u2").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float)), idf)
        for r in listed
    ]
    classes = [labels.index(r["lang"]) for r in listed]
    apart = [k % 5 == 4 for k in range(len(listed))]
    weights = follow_leader(
        [v for v, a in zip(vectors, apart, strict=True) if not a],
        [c for c, a in zip(classes, apart, strict=True) if not a],
        len(labels),
    )
    kept = [(v, c) for v, c, a in zip(vectors, classes, apart, strict=True) if a]
    logits = np.array([x @ weights[used] + weights[-1] for (used, x), _ in kept])
    temperature = fit_temperature(logits, np.array([c for _, c in kept], dtype=int))
    return Model(labels, idf, weights.astype(np.float32), temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(tidy(label), "doc_id bigint, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows, with all their columns, whose language is known with ``least`` confidence."""
    place = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(place)]
            kept = [name != UNKNOWN and score >= least for name, score in found]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(tidy(choose), docs.schema)
