"""Session defaults and the few cluster-facing helpers the operators share."""

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a byte of sequence costs far more work than a byte of an ordinary table
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole sequences travel; Spark's limit of bytes per batch protects memory, this keeps the
    # working set of one Python call small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def build_session(master: str | None = None, app: str = "seqloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed wherever the executors do not have it installed; skipped when the driver itself
    runs from an archive that was submitted with the job.
    """
    context = spark.sparkContext
    source = Path(__file__).resolve().parent
    if getattr(context, "_seqloom_shipped", False) or not source.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="seqloom-package-")) / "seqloom_package.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for file in sorted(source.rglob("*.py")):
            target.write(file, file.relative_to(source.parent))
    context.addPyFile(str(archive))
    context._seqloom_shipped = True


def rebalance(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute rows by ``keys`` into partitions of the advisory size, however many."""
    return df.hint("rebalance", *[F.col(key) for key in keys])


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Only where none is configured on a single machine (tests) a local folder is made, once.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[str] = []
#: What the open calls of :func:`settled` have written on their way, by thread.
_steps = threading.local()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write an intermediate table and read it back, between iterations.

    The next step neither repeats the plan so far nor depends on executors that may be lost,
    and it is planned with the table's real size, so Spark broadcasts only what is small.
    :func:`drop_scratch` deletes the tables when no result needs them any more. ``options`` are
    those of Spark's Parquet writer.
    """
    path = f"{scratch_folder(df.sparkSession).rstrip('/')}/seqloom-{uuid.uuid4().hex}"
    _written.append(path)
    for held in getattr(_steps, "open", [])[-1:]:
        held.append(path)
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._seqloom_path = path
    return table


def settled(spark: SparkSession, made: Callable[[], DataFrame]) -> DataFrame:
    """:func:`cut_lineage` of what ``made`` gives; tables and shuffle files of its steps go at once.

    For iterations, whose steps would else stay on disk until the query is over. A table that
    outlives the call is marked by :func:`keep`.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    calls = _steps.open = [*getattr(_steps, "open", []), []]
    try:
        table = keep(cut_lineage(made()))
    finally:
        _steps.open = calls[:-1]
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    for path in calls[-1]:
        _delete(spark, path)
    for held in calls[-2:-1]:
        held.append(table._seqloom_path)
    return table


def keep(table: DataFrame) -> DataFrame:
    """A written table that stays when the steps around it are over."""
    for held in getattr(_steps, "open", []):
        if table._seqloom_path in held:
            held.remove(table._seqloom_path)
    return table


def drop(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        if path := getattr(table, "_seqloom_path", None):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    if path in _written:
        _written.remove(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; call it when its results are out."""
    dropped = 0
    while _written:
        dropped += _delete(spark, _written[-1])
    return dropped


def is_empty(df: DataFrame) -> bool:
    return not df.head(1)
