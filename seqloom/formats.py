"""Fixed values of the archive formats, and the schemas shared by the operators."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the published archive formats and reports, or
# archives written elsewhere could not be read (and the other way round).
# ---------------------------------------------------------------------------
V1_MAGIC = "GHDNA_1"
V2_MAGIC = "GHDNA_2"
V2_FILE_MAGIC = b"GHDNA2\x00"
MAX_METADATA_BYTES = 64 * 1024 * 1024
BLOCK_TABLE_FORMAT = "binary_v1"

COPY = "graph_copy"
RAW_V1 = "lm_raw"
RESIDUAL = "llm_residual"
RAW = "raw_residual"

# tag, big-endian layout
COPY_TAG, COPY_LAYOUT = 1, ">BIII"
RESIDUAL_TAG, RESIDUAL_LAYOUT = 2, ">BBIIIIII"
RAW_TAG, RAW_LAYOUT = 3, ">BIIII"
# bytes per block-table entry
ENTRY_BYTES = {COPY: 13, RESIDUAL: 26, RAW: 17}

PLAIN_CODEC = "plain_ascii_v1"
MODEL_CODEC = "dnagpt2_arithmetic_v1"
MODEL_FAMILY = "dnagpt2"

SHORT_RESIDUAL = 64
MAX_RESIDUAL_BLOCKS = 8
MAX_SHORT_FRACTION = 0.2
BITS_PER_TOKEN = 2.0

VARIANTS = (
    "graph_only",
    "dnagpt2_residual_only",
    "graph_plus_dnagpt2",
    "adaptive_dnagpt2_hybrid",
)

ALPHABET = "ACGTN"
PACKED_ALPHABET = "ACGT"
# ---------------------------------------------------------------------------

COPY_ITEM = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("source", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
COPY_LIST = T.ArrayType(COPY_ITEM)

BLOCK_ITEM = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("source", T.LongType()),
        T.StructField("symbol_count", T.LongType()),
        T.StructField("bit_length", T.LongType()),
        T.StructField("payload_offset", T.LongType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("use_context", T.BooleanType()),
    ]
)
BLOCK_LIST = T.ArrayType(BLOCK_ITEM)

ENCODED = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("bit_length", T.LongType()),
        T.StructField("symbol_count", T.LongType()),
        T.StructField("used_context", T.BooleanType()),
    ]
)
