"""Archive FASTA files as they arrive in a folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.residual import ResidualCodec
from seqloom.plans import archive_v2
from seqloom.session import cut_lineage
from seqloom.sources.fasta import parse_files

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_stream(spark: SparkSession, folder: str, mode: str = "QUARANTINE") -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(folder)
    return parse_files(files, mode)


def archive_stream(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    codec: ResidualCodec | None = None,
    **options,
) -> StreamingQuery:
    """Write each micro-batch to ``<output>/batch=<n>``; a replayed batch replaces itself.

    Files that do not parse go to ``<output>_rejected`` with their error.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch = cut_lineage(batch)  # parsed once for both outputs
        good = batch.where("error IS NULL").drop("error")
        archive_v2.compress(good, codec, **options).write.mode("overwrite").parquet(
            f"{output}/batch={number}"
        )
        batch.where("error IS NOT NULL").select("path", "error").write.mode("overwrite").json(
            f"{output}_rejected/batch={number}"
        )

    return (
        read_stream(spark, folder)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
