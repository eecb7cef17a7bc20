"""Intermediate tables and files in the folder that the whole cluster shares."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; removed when the session's JVM ends.

    Where that setting is unset, as in tests, a local folder stands in for a local session; on
    a cluster each executor would write to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="shared-"))
        base = _own_folder[0]
    folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(frame: DataFrame, *partition_by: str) -> DataFrame:
    """The frame as a Parquet table in a new shared folder, read back.

    Cuts the lineage: lost executors cost only the stage that reads the table.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark)
    frame.write.option("compression", "zstd").partitionBy(*partition_by).parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def removed(table: DataFrame) -> None:
    """Take a table that `written` made, and that nothing reads any more, off the disk."""
    context = table.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in here remove their shuffle files when they are done, not whenever the driver
    happens to collect its garbage. The session's own setting is put back."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Where the session leaves it open, batches on their way to Python are bounded as well:
    with Spark's own bound, long texts take hundreds of megabytes of each executor.
    """
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in sorted(os.walk(root)):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    archive.write(path, os.path.join(name, os.path.relpath(path, root)))
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{name}.zip")
    with open(target, "wb") as file:
        file.write(packed.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)
