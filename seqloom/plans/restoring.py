"""From the tiles of an archive back to its sequence; shared by both formats.

Formats differ in how tiles are stored. Whether they make a sequence is relational: every check is
one SQL expression over the record's tile array, made before any tile is read. Python only follows
the copies, and the result is held against the stored length and checksum in SQL.
"""

from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.catalog import apart
from seqloom.functions.slices import sliced
from seqloom.operators.residual import TOGETHER, Encoded, ResidualCodec, together

# A tile has a literal text, or a source, or a code. ``length`` is what it adds to the sequence.
TILE = {
    "start": "bigint",
    "length": "bigint",
    "source": "bigint",
    "literal": "string",
    "code": "binary",
    "bits": "bigint",
    "symbols": "bigint",
    "context": "boolean",
}

# What is wrong with the tiles ``t``, first match first; null if nothing is.
_ENDS = "t[i - 1].start + t[i - 1].length"
PROBLEMS = (
    ("exists(t, x -> x.start IS NULL OR x.length IS NULL OR x.length < 0)",
     "a block has no valid place"),
    ("t[0].start <> 0", "blocks are not contiguous from 0"),
    (f"exists(sequence(1, size(t) - 1), i -> t[i].start <> {_ENDS})", "blocks are not contiguous"),
    ("exists(t, x -> x.source IS NOT NULL AND"
     " (x.source < 0 OR x.length = 0 OR x.source + x.length > x.start))",
     "copy reference reaches outside the text before it"),
    ("exists(t, x -> x.source IS NULL AND x.literal IS NULL AND x.code IS NULL)",
     "unknown or empty block"),
)


def _first_problem() -> str:
    # sequence(1, 0) would count down: one tile has no pair to look at
    cases = " ".join(
        f"WHEN {'size(t) > 1 AND ' if 'sequence' in test else ''}{test} THEN '{text}'"
        for test, text in PROBLEMS
    )
    return f"CASE WHEN size(t) = 0 THEN NULL {cases} END"


def checked_tiles(tiles: str, length: str) -> Column:
    """The tiles, or an error where they do not tile ``length`` symbols."""
    # a lambda refers to nothing outside it, so that no Python call can be copied into one
    total = "aggregate(t.tiles, 0L, (n, x) -> n + x.length)"
    problem = _first_problem().replace("t[", "t.tiles[").replace("(t,", "(t.tiles,")
    problem = problem.replace("size(t)", "size(t.tiles)")
    return F.expr(
        f"""transform(array(named_struct('tiles', {tiles}, 'length', {length})), t -> CASE
        WHEN {problem} IS NOT NULL THEN raise_error({problem})
        WHEN {total} <> t.length THEN raise_error('blocks do not add up to the stored length')
        ELSE t.tiles END)[0]"""
    )


def _following(tiles: list[dict], window: int) -> Generator[tuple[Encoded, str], str, str]:
    """The sequence that checked tiles describe; asks for the text of each coded chunk."""
    text = bytearray()
    for tile in tiles:
        if tile["literal"] is not None:
            text += tile["literal"].encode("ascii")
        elif tile["source"] is not None:
            text += text[tile["source"] : tile["source"] + tile["length"]]
        else:
            before = text[-window:].decode("ascii") if tile["context"] and window else ""
            chunk = yield Encoded(tile["code"], tile["bits"], tile["symbols"], bool(tile["context"])), before
            if len(chunk) != tile["length"]:
                raise ValueError(f"residual at {tile['start']} decodes to another length")
            text += chunk.encode("ascii")
    return text.decode("ascii")


def follow_all(cells: list[list[dict] | None], codec: ResidualCodec | None) -> list[str | None]:
    """Sequences of many records: the chunk that each waits for is decoded with the others'."""
    texts: list[str | None] = [None] * len(cells)
    window = codec.context_window if codec else 0
    going = {k: _following(cell, window) for k, cell in enumerate(cells) if cell is not None}
    answers: dict[int, str | None] = dict.fromkeys(going)
    while going:
        asked = {}
        for k, record in list(going.items()):
            try:
                asked[k] = record.send(answers[k])
            except StopIteration as end:
                texts[k] = end.value
                del going[k]
        if asked:
            coded, before = zip(*asked.values(), strict=True)
            answers = dict(zip(asked, codec.decode_batch(coded, before), strict=True))
    return texts


def _follow_column(codec: ResidualCodec | None):
    rows = TOGETHER if codec and codec.in_lanes else 1

    @F.arrow_udf(T.StringType())
    def followed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for group in together(sliced(batches), rows):
            texts = follow_all(sum((cells.to_pylist() for cells in group), []), codec)
            for cells in group:
                yield pa.array(texts[: len(cells)], pa.string())
                del texts[: len(cells)]

    return followed.asNondeterministic()


def restored(rows: DataFrame, codec: ResidualCodec | None = None) -> DataFrame:
    """``(record_id, header, seq)`` from ``(record_id, header, length, sha256, tiles)``."""
    ready = rows.withColumn("tiles", apart(checked_tiles("tiles", "length")))
    texts = ready.withColumn("seq", _follow_column(codec)("tiles"))
    return texts.select(
        "record_id",
        "header",
        F.when(F.sha2("seq", 256) == F.col("sha256"), F.col("seq"))
        .otherwise(F.raise_error(F.lit("restored text does not match its checksum")))
        .alias("seq"),
    )


def tile(**fields: str) -> str:
    """SQL of one tile; fields that are left out are null."""
    cells = (f"'{n}', CAST({fields.get(n, 'NULL')} AS {kind})" for n, kind in TILE.items())
    return f"named_struct({', '.join(cells)})"
