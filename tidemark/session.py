"""Session factory and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "tidemark", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested with; on a cluster pass your own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset on a local master (tests, a laptop) a
    temporary folder is made and put into the session's settings; executors on other machines could not read it,
    so any other master without the setting is an error.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session's setting while the block runs, and as it was afterwards."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


_COLLECTORS: list[list[str]] = []


@contextmanager
def collecting(paths: list[str]):
    """Paths of the tables that :func:`materialize` writes in the block go to ``paths``, unless it is told another list."""
    _COLLECTORS.append(paths)
    try:
        yield paths
    finally:
        _COLLECTORS.remove(paths)


def materialize(df: DataFrame, label: str, keep: list[str] | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there and a lost executor
    costs nothing that is already written. The shuffle files of the write go when it is done. ``keep``, if given,
    collects the path for :func:`discard`; ``batch_rows`` bounds the rows that go to Python at a time in this write."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with setting(spark, SHUFFLE_CLEANUP_KEY, "true"), setting(spark, BATCH_KEY, str(batch_rows or spark.conf.get(BATCH_KEY))):
        df.write.parquet(path)
    for held in (keep,) if keep is not None else _COLLECTORS[-1:]:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables written by :func:`materialize` that no plan needs any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table this application wrote with :func:`materialize`. Results that still read them must have been
    written elsewhere before."""
    discard(spark, [f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"])
