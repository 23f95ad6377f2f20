"""From raw documents to packed sequences, in stages that each write and reread their table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import exact_dedup, language, mixing, ngram_join, packing
from seqloom.session import scratch_folder, ship_package


#: The near-duplicate stage: words a shingle, and the least Jaccard similarity in hundredths.
WORDS, LEAST = 5, 80
#: An executor's heap has grown to its limit by the last stages, so Python stays small beside it:
#: bytes of an Arrow batch, which JVM and worker both hold, and words whose ids a worker remembers.
BATCH_BYTES, REMEMBERED = 2 << 20, 100_000


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(docs)

    return run_stage


def _known_language(docs: DataFrame) -> DataFrame:
    return language.accepted(docs, language.train(docs))


def _copies(docs: DataFrame) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _near_copies(docs: DataFrame) -> DataFrame:
    return ngram_join.one_of_each(docs, words=WORDS, least=LEAST)


def _mixed(docs: DataFrame) -> DataFrame:
    return mixing.mixed_documents(docs)


def _packed(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, remembered=REMEMBERED)


STAGES = [
    ("language ID", _shipped(_known_language)),
    ("exact dedup", _shipped(_copies)),
    ("n-gram Jaccard join", _shipped(_near_copies)),
    ("mixing to target weights", _shipped(_mixed)),
    ("best-fit packing", _shipped(_packed)),
]

#: Language ID and token ids have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(rows.schema).parquet(f"{folder}/{k}")
    return docs
