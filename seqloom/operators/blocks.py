"""Block planning: which copies to keep, and how the gaps become residual blocks.

All rules work on the per-record arrays made by ``repeats.with_copies``; apart from one small
fold (pruning) they are SQL expressions, so planning adds no shuffle.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.formats import (
    BITS_PER_TOKEN,
    COPY,
    COPY_LIST,
    ENTRY_BYTES,
    MAX_RESIDUAL_BLOCKS,
    MAX_SHORT_FRACTION,
    RAW,
    RESIDUAL,
    SHORT_RESIDUAL,
)
from seqloom.functions.slices import by_slices
from seqloom.operators.repeats import spans
from seqloom.operators.residual import ResidualCodec

PLANNED = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("source", T.LongType()),
            T.StructField("use_context", T.BooleanType()),
        ]
    )
)
UNLIMITED = 1 << 40
NO_COPIES = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, source: BIGINT, length: BIGINT>>)"


# --- pruning ---------------------------------------------------------------


def prune_copies(
    total: int, copies: list[tuple[int, int, int]], shortest: int = SHORT_RESIDUAL
) -> list[tuple[int, int, int]]:
    """Drop ``(start, source, length)`` copies next to a short gap, until none is dropped.

    The gap before is measured from the last copy kept in the pass, the gap after to the next
    copy of the list the pass started with. A copy that is alone in its list stays.
    """

    def short(gap: int) -> bool:
        return 0 < gap < shortest

    while len(copies) > 1:
        edge, kept = 0, []
        following = [copy[0] for copy in copies[1:]] + [total]
        for copy, after in zip(copies, following):
            end = copy[0] + copy[2]
            if not short(copy[0] - edge) and not short(after - end):
                kept.append(copy)
                edge = end
        if len(kept) == len(copies):
            break
        copies = kept
    return copies


def pruned_column(length: str = "length(seq)", copies: str = "copies"):
    kind = to_arrow_type(COPY_LIST)

    @F.arrow_udf(COPY_LIST)
    @by_slices
    def pruned(totals: pa.Array, lists: pa.Array) -> pa.Array:
        fields = ("start", "source", "length")
        return pa.array(
            [
                [
                    dict(zip(fields, copy))
                    for copy in prune_copies(
                        total, [tuple(item[f] for f in fields) for item in items or []]
                    )
                ]
                for total, items in zip(totals.to_pylist(), lists.to_pylist())
            ],
            type=kind,
        )

    return pruned.asNondeterministic()(
        F.expr(f"CAST({length} AS BIGINT)"), F.expr(copies)
    )


# --- residual chunks -------------------------------------------------------


def _fixed_chunks(spans_sql: str, codec: ResidualCodec) -> str:
    """Blocks of a codec whose chunks are a fixed number of symbols."""
    step = codec.chunk_symbols or UNLIMITED
    size = f"least({step}L, s.start + s.length - p)"
    if codec.is_model:
        kind = f"IF({size} < {SHORT_RESIDUAL}, '{RAW}', '{RESIDUAL}')"
        context = f"{size} >= {SHORT_RESIDUAL} AND p > 0" if codec.context_window else "false"
    else:
        kind, context = f"'{RESIDUAL}'", "false"
    return f"""flatten(transform({spans_sql}, s -> IF(s.source IS NOT NULL,
        array(named_struct('type', '{COPY}', 'start', s.start, 'length', s.length,
                           'source', s.source, 'use_context', false)),
        transform(sequence(s.start, s.start + s.length - 1, {step}L), p -> named_struct(
            'type', {kind}, 'start', p, 'length', {size},
            'source', CAST(NULL AS BIGINT), 'use_context', {context})))))"""


def _tokenised_chunks(codec: ResidualCodec):
    """Blocks of a codec whose chunk sizes only its tokenizer knows."""
    kind = to_arrow_type(PLANNED)
    window = codec.context_window

    def plan(seq: str, parts: list[dict]) -> list[dict]:
        blocks = []
        for part in parts:
            if part["source"] is not None:
                blocks.append({**part, "type": COPY, "use_context": False})
                continue
            at = part["start"]
            for text in codec.split(seq[at : at + part["length"]]):
                short = codec.is_model and len(text) < SHORT_RESIDUAL
                before = seq[max(0, at - window) : at]
                blocks.append(
                    {
                        "type": RAW if short else RESIDUAL,
                        "start": at,
                        "length": len(text),
                        "source": None,
                        "use_context": bool(
                            codec.is_model and not short and before
                            and codec.joins(text, before)
                        ),
                    }
                )
                at += len(text)
        return blocks

    @F.arrow_udf(PLANNED)
    @by_slices
    def chunks(seqs: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array(
            [plan(s or "", p or []) for s, p in zip(seqs.to_pylist(), lists.to_pylist())],
            type=kind,
        )

    return chunks.asNondeterministic()


def with_blocks(records: DataFrame, codec: ResidualCodec, copies: str, name: str) -> DataFrame:
    """Adds ``name``: ordered blocks ``(type, start, length, source, use_context)``."""
    tiled = records.withColumn("_spans", spans(copies))
    if codec.chunk_symbols is None:
        column = _tokenised_chunks(codec)("seq", "_spans")
    else:
        column = F.expr(_fixed_chunks("_spans", codec))
    return tiled.withColumn(name, column).drop("_spans")


# --- size model and choice -------------------------------------------------


def estimated_bytes(blocks: str) -> str:
    """Two bits per residual base (at least one bit per block), plus the block table."""
    per_base = int(BITS_PER_TOKEN)
    table = " ".join(f"WHEN '{kind}' THEN {size}" for kind, size in ENTRY_BYTES.items())
    return f"""(aggregate({blocks}, 0L, (t, b) -> t + CASE b.type WHEN '{COPY}' THEN 0L
        WHEN '{RAW}' THEN {per_base} * b.length
        ELSE greatest(1L, {per_base} * b.length) END) + 7) DIV 8
        + aggregate({blocks}, 0L, (t, b) -> t + CASE b.type {table} END)"""


def too_fragmented(blocks: str, total: str) -> str:
    rest = f"filter({blocks}, b -> b.type <> '{COPY}')"
    return f"""CASE WHEN size({rest}) > {MAX_RESIDUAL_BLOCKS} THEN true
        WHEN size({rest}) = 0 THEN false
        ELSE size(filter({rest}, b -> b.length < {SHORT_RESIDUAL})) / size({rest})
             > {MAX_SHORT_FRACTION}D
         AND aggregate({rest}, 0L, (t, b) -> t + b.length) < {total} END"""


def plan(records: DataFrame, codec: ResidualCodec, policy: str = "auto") -> DataFrame:
    """Adds ``blocks``, ``kept`` (the copies used) and the planner's three diagnostics.

    ``auto`` with a model codec weighs coding everything against keeping the pruned copies by
    estimated size; the first wins ties, and a fragmented second is not considered. Other
    codecs keep every copy.
    """
    if policy not in ("auto", "force_graph"):
        raise ValueError("hybrid_graph_policy must be 'auto' or 'force_graph'")
    if policy == "force_graph" or not codec.is_model:
        name = "force_graph" if policy == "force_graph" else "original"
        return with_blocks(records, codec, "copies", "blocks").select(
            "*",
            F.col("copies").alias("kept"),
            F.lit(1).alias("candidate_count"),
            F.lit(name).alias("selected_candidate"),
            F.lit(0).cast("long").alias("selected_estimated_bytes"),
        )
    both = records.withColumn("_pruned", pruned_column()).withColumn("_none", F.expr(NO_COPIES))
    both = with_blocks(both, codec, "_none", "_plain")
    both = with_blocks(both, codec, "_pruned", "_hybrid")
    both = both.withColumn("_plain_size", F.expr(estimated_bytes("_plain"))).withColumn(
        "_hybrid_size",
        F.expr(
            f"""CASE WHEN size(_pruned) = 0 OR {too_fragmented('_hybrid', 'length(seq)')}
            THEN NULL ELSE {estimated_bytes('_hybrid')} END"""
        ),
    )
    none_found = F.size("copies") == 0
    hybrid = F.coalesce(F.col("_hybrid_size") < F.col("_plain_size"), F.lit(False))
    return (
        both.withColumn("blocks", F.when(hybrid, F.col("_hybrid")).otherwise(F.col("_plain")))
        .withColumn("kept", F.when(hybrid, F.col("_pruned")).otherwise(F.col("_none")))
        .withColumn(
            "candidate_count",
            F.when(none_found | (F.size("_pruned") == 0), 1).otherwise(2),
        )
        .withColumn(
            "selected_candidate",
            F.when(none_found, "original")
            .when(hybrid, "pruned_graph")
            .otherwise("no_graph"),
        )
        .withColumn(
            "selected_estimated_bytes",
            F.when(none_found, F.lit(0).cast("long"))
            .when(hybrid, F.col("_hybrid_size"))
            .otherwise(F.col("_plain_size")),
        )
        .drop("_pruned", "_none", "_plain", "_hybrid", "_plain_size", "_hybrid_size")
    )


def explode_blocks(planned: DataFrame, codec: ResidualCodec, *carry: str) -> DataFrame:
    """One row per block with its text and, where used, the symbols before it.

    Columns in ``carry`` stay on the first block only. A record without symbols keeps one row
    with a null ``type``.
    """
    window = codec.context_window
    return (
        planned.select(
            "record_id",
            *carry,
            F.col("seq").cast("binary").alias("_bases"),
            F.posexplode_outer("blocks").alias("block_no", "block"),
        )
        .select(
            "record_id",
            *[F.when(F.coalesce("block_no", F.lit(0)) == 0, F.col(c)).alias(c) for c in carry],
            F.coalesce("block_no", F.lit(0)).alias("block_no"),
            "block.*",
            F.expr(
                f"""IF(block.type = '{COPY}', NULL, CAST(substring(_bases,
                CAST(block.start AS INT) + 1, CAST(block.length AS INT)) AS STRING))"""
            ).alias("text"),
            F.expr(
                f"""IF(block.use_context, CAST(substring(_bases,
                CAST(greatest(0, block.start - {window}) + 1 AS INT),
                CAST(least({window}, block.start) AS INT)) AS STRING), '')"""
            ).alias("context"),
        )
    )
