"""Scalar functions as SQL expressions.

Each function is one built-in Spark SQL expression, so Catalyst sees through it and
nothing leaves the JVM. The same text backs two call styles:

* ``expr("gc_fraction", "seq")`` in DataFrame code (arguments are SQL text);
* ``gc_fraction(seq)`` in ``spark.sql`` after :func:`register`.
"""

import string
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScalarFunction:
    params: tuple[tuple[str, str], ...]
    returns: str
    body: str


CATALOG: dict[str, ScalarFunction] = {}


def _define(name: str, params: str, returns: str, body: str) -> None:
    pairs = tuple(tuple(item.split(":")) for item in params.split(","))
    CATALOG[name] = ScalarFunction(pairs, returns, " ".join(body.split("\n")))


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``name`` in ``body``.

    Without it an argument that is itself an expression would be evaluated again for every
    element a higher-order function visits.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def sql(name: str, *args: str) -> str:
    """Inline a catalogue function over SQL argument texts."""
    function = CATALOG[name]
    if len(args) != len(function.params):
        raise TypeError(f"{name} takes {len(function.params)} arguments")
    text = function.body
    for (param, _), arg in zip(function.params, args):
        text = text.replace("{" + param + "}", f"({arg})")
    return f"({text})"


def expr(name: str, *args: str) -> Column:
    return F.expr(sql(name, *args))


def apart(column: Column) -> Column:
    """``column``, in a projection that Spark does not merge with the one that uses it.

    Needed for arguments of Python calls that can raise an error: merged, Spark would leave the
    call unplanned. The condition always holds, and is non-deterministic to Spark.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def register(spark: SparkSession) -> list[str]:
    """Create every catalogue function as a temporary SQL function."""
    for name, function in CATALOG.items():
        params = ", ".join(f"{param} {kind}" for param, kind in function.params)
        body = function.body
        for param, _ in function.params:
            body = body.replace("{" + param + "}", param)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) "
            f"RETURNS {function.returns} RETURN {body}"
        )
    return sorted(CATALOG)


# --- text ------------------------------------------------------------------

_define(
    "file_stem", "path:STRING", "STRING",
    r"regexp_replace(element_at(split({path}, '/'), -1), '[.][^.]*$', '')",
)
_define(
    "normalise_sequence", "body:STRING", "STRING",
    r"upper(regexp_replace({body}, r'^\s+|\s*\R\s*|\s+$', ''))",
)
_define(
    "alphabet_violations", "seq:STRING", "STRING",
    """array_join(array_sort(array_distinct(filter(
       split(translate({seq}, 'ACGTN', ''), ''), c -> c <> ''))), '')""",
)
_define("sequence_checksum", "seq:STRING", "STRING", "sha2({seq}, 256)")
_define(
    "fasta_text", "header:STRING,seq:STRING,width:INT", "STRING",
    r"""CASE WHEN {width} <= 0 THEN raise_error('lines need a width above zero')
    ELSE concat({header}, '\n',
         regexp_replace({seq}, concat('(.{', {width}, '})(?=.)'), '$1\n'), '\n') END""",
)
_define(
    "context_tail", "seq:STRING,start:BIGINT,window:BIGINT", "STRING",
    """substring({seq}, CAST(greatest(0, {start} - {window}) + 1 AS INT),
       CAST(least({window}, {start}) AS INT))""",
)
_define(
    "kmers", "seq:STRING,k:INT", "ARRAY<STRING>",
    let(
        "bases", "CAST({seq} AS BINARY)",
        """CASE WHEN {k} > 0 AND octet_length(bases) >= {k}
        THEN transform(sequence(0, octet_length(bases) - {k}),
             i -> CAST(substring(bases, i + 1, {k}) AS STRING))
        ELSE CAST(array() AS ARRAY<STRING>) END""",
    ),
)
# a pattern costs many times the look at single characters, and few labels need one
_define(
    "mermaid_id", "label:STRING", "STRING",
    f"""concat(CASE WHEN {{label}} = '' OR left({{label}}, 1) BETWEEN '0' AND '9' THEN 'node_' ELSE '' END,
    CASE WHEN translate({{label}}, '{string.ascii_letters}{string.digits}_', '') = '' THEN {{label}}
    ELSE regexp_replace({{label}}, '[^0-9A-Za-z_]', '_') END)""",
)

# --- composition -----------------------------------------------------------

_define(
    "gc_fraction", "seq:STRING", "DOUBLE",
    """CASE WHEN length({seq}) = 0 THEN 0.0D ELSE
    CAST(length({seq}) - length(replace(replace({seq}, 'G', ''), 'C', '')) AS DOUBLE)
    / length({seq}) END""",
)
_define(
    "shannon_bits", "seq:STRING", "DOUBLE",
    let(
        "s", "{seq}",
        # one pass per symbol of the alphabet; only what is left is listed symbol by symbol
        """CASE WHEN length(s) = 0 THEN 0.0D ELSE aggregate(
        filter(transform(concat(array('A', 'C', 'G', 'T', 'N'), filter(array_distinct(
          split(translate(s, 'ACGTN', ''), '')), c -> c <> '')),
          c -> CAST(length(s) - length(replace(s, c, '')) AS DOUBLE) / length(s)), p -> p > 0),
        0.0D, (total, p) -> total - p * log2(p)) END""",
    ),
)

# --- bits ------------------------------------------------------------------
# conv() moves 64 bits at a time between bases 2, 4 and 16.

_define(
    "pack_bases", "seq:STRING", "BINARY",
    let(
        "digits", "CAST(translate({seq}, 'ACGT0123', '0123####') AS BINARY)",
        """CASE WHEN octet_length(digits) = 0 THEN X''
        WHEN NOT CAST(digits AS STRING) RLIKE '^[0-3]*$' THEN raise_error(concat(
             'only A/C/G/T pack into two bits, not ',
             array_join(array_sort(array_distinct(filter(split(
             translate(CAST(digits AS STRING), '0123', ''), ''), c -> c <> ''))), '')))
        ELSE substring(unhex(array_join(transform(
             sequence(0, (octet_length(digits) - 1) DIV 32),
             i -> lpad(conv(rpad(CAST(substring(digits, 32 * i + 1, 32) AS STRING), 32, '0'),
                  4, 16), 16, '0')), '')),
             1, (octet_length(digits) + 3) DIV 4) END""",
    ),
)
_define(
    "unpack_bases", "payload:BINARY,symbols:BIGINT", "STRING",
    let(
        "cell", "named_struct('bytes', {payload}, 'symbols', {symbols})",
        """CASE WHEN cell.symbols < 0
        THEN raise_error('fewer than no packed symbols')
        WHEN octet_length(cell.bytes) <> (cell.symbols + 3) DIV 4
        THEN raise_error('packed symbols and their number do not go together')
        WHEN cell.symbols = 0 THEN ''
        ELSE left(translate(array_join(transform(
             sequence(0, (octet_length(cell.bytes) - 1) DIV 8),
             i -> lpad(conv(rpad(hex(substring(cell.bytes, 8 * i + 1, 8)), 16, '0'), 16, 4),
                  32, '0')), ''), '0123', 'ACGT'), CAST(cell.symbols AS INT)) END""",
    ),
)
_define(
    "pack_bits", "bits:ARRAY<INT>", "BINARY",
    let(
        "b", "{bits}",
        """CASE WHEN exists(b, x -> x IS NULL OR x NOT IN (0, 1))
        THEN raise_error('every bit is 0 or 1')
        WHEN size(b) = 0 THEN X''
        ELSE substring(unhex(array_join(transform(
             sequence(0, (size(b) - 1) DIV 64),
             i -> lpad(conv(rpad(array_join(slice(b, 64 * i + 1, 64), ''), 64, '0'),
                  2, 16), 16, '0')), '')), 1, (size(b) + 7) DIV 8) END""",
    ),
)
_define(
    "unpack_bits", "payload:BINARY,bit_length:BIGINT", "ARRAY<INT>",
    let(
        "cell", "named_struct('bytes', {payload}, 'size', {bit_length})",
        """CASE WHEN cell.size < 0 OR cell.size > 8 * octet_length(cell.bytes)
        THEN raise_error('the payload does not hold that bit length')
        WHEN cell.size = 0 THEN CAST(array() AS ARRAY<INT>)
        ELSE slice(flatten(transform(
             sequence(0, (octet_length(cell.bytes) - 1) DIV 8),
             i -> transform(filter(split(lpad(conv(rpad(hex(substring(
                  cell.bytes, 8 * i + 1, 8)), 16, '0'), 16, 2), 64, '0'), ''), c -> c <> ''),
                  c -> CAST(c AS INT)))), 1, CAST(cell.size AS INT)) END""",
    ),
)

_define(
    "pack_bit_text", "bits:STRING", "BINARY",
    let(
        "b", "CAST({bits} AS BINARY)",
        """CASE WHEN octet_length(b) = 0 THEN X''
        WHEN NOT CAST(b AS STRING) RLIKE '^[01]*$' THEN raise_error('every bit is 0 or 1')
        ELSE substring(unhex(array_join(transform(
             sequence(0, (octet_length(b) - 1) DIV 64),
             i -> lpad(conv(rpad(CAST(substring(b, 64 * i + 1, 64) AS STRING), 64, '0'),
                  2, 16), 16, '0')), '')), 1, (octet_length(b) + 7) DIV 8) END""",
    ),
)

# --- cumulative frequencies ------------------------------------------------

_define(
    "cdf_is_valid", "cdf:ARRAY<BIGINT>", "BOOLEAN",
    let(
        "marks", "{cdf}",
        """size(marks) > 0 AND marks[0] > 0 AND forall(
        sequence(1, greatest(size(marks) - 1, 1)),
        i -> i >= size(marks) OR marks[i] > marks[i - 1])""",
    ),
)
# rint() rounds half to even, which the format needs (round() would not)
_define(
    "integer_cdf", "weights:ARRAY<DOUBLE>,scale:BIGINT", "ARRAY<BIGINT>",
    let(
        "dist",
        """named_struct('weights', {weights}, 'scale', {scale},
        'mass', aggregate({weights}, 0.0D, (t, w) -> t + w))""",
        """CASE WHEN size(dist.weights) <= 0 OR exists(dist.weights, w -> w < 0)
        THEN raise_error('weights are needed, and none may be below zero')
        WHEN dist.mass <= 0
        THEN raise_error('weights add up to nothing')
        WHEN dist.scale <= 0 THEN raise_error('the scale has to be above zero')
        ELSE aggregate(dist.weights,
          named_struct('mass', 0.0D, 'last', 0L, 'cdf', CAST(array() AS ARRAY<BIGINT>)),
          (s, w) -> named_struct(
            'mass', s.mass + w / dist.mass,
            'last', greatest(CAST(rint((s.mass + w / dist.mass) * dist.scale) AS BIGINT),
                             s.last + 1),
            'cdf', concat(s.cdf, array(greatest(
               CAST(rint((s.mass + w / dist.mass) * dist.scale) AS BIGINT), s.last + 1)))),
          s -> s.cdf) END""",
    ),
)
_define(
    "interval_bits", "cdf:ARRAY<BIGINT>,symbol:INT", "DOUBLE",
    """log2(CAST({cdf}[size({cdf}) - 1] AS DOUBLE)
       / ({cdf}[{symbol}] - CASE WHEN {symbol} = 0 THEN 0 ELSE {cdf}[{symbol} - 1] END))""",
)

# --- block-table entries ---------------------------------------------------

_define(
    "u32_hex", "value:BIGINT", "STRING",
    """CASE WHEN {value} < 0 OR {value} > 4294967295
    THEN raise_error('block field does not fit in 32 bits')
    ELSE lpad(hex({value}), 8, '0') END""",
)
_define(
    "copy_entry_hex", "start:BIGINT,source:BIGINT,length:BIGINT", "STRING",
    f"""concat('01', {sql('u32_hex', '{start}')}, {sql('u32_hex', '{source}')},
    {sql('u32_hex', '{length}')})""",
)
_define(
    "residual_entry_hex",
    "use_context:BOOLEAN,start:BIGINT,length:BIGINT,symbol_count:BIGINT,"
    "bit_length:BIGINT,payload_offset:BIGINT,payload_length:BIGINT",
    "STRING",
    "concat('02', CASE WHEN {use_context} THEN '01' ELSE '00' END, "
    + ", ".join(
        sql("u32_hex", "{" + field + "}")
        for field in (
            "start", "length", "symbol_count", "bit_length", "payload_offset", "payload_length",
        )
    )
    + ")",
)
_define(
    "raw_entry_hex", "start:BIGINT,length:BIGINT,payload_offset:BIGINT,payload_length:BIGINT",
    "STRING",
    "concat('03', "
    + ", ".join(
        sql("u32_hex", "{" + field + "}")
        for field in ("start", "length", "payload_offset", "payload_length")
    )
    + ")",
)
