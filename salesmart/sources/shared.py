"""Folders and files that the whole cluster sees, through Spark's own file systems."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A path for a new folder below ``spark.checkpoint.dir``, removed when the session ends.

    Without that setting only a local session gets one: on a cluster each executor would
    write to its own disk.
    """
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="salesmart-"))
        base = _local[0]
    folder = f"{base.rstrip('/')}/sales-{uuid.uuid4().hex}"
    path, system = _located(spark, folder)
    system.deleteOnExit(path)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _located(spark, path)
    return system.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    """Take a folder that nothing reads any more off the disk."""
    where, system = _located(spark, path)
    system.delete(where, True)


@contextmanager
def settings(spark: SparkSession, chosen: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; what its owner has set is put back."""
    before = {key: spark.conf.get(key, None) for key in chosen}
    try:
        for key, value in chosen.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def input_files(df: DataFrame) -> list[str]:
    """Path, length and time of change of every file a frame reads, in order.

    Taken from the listing that reading made; no job runs. Frames that read anything but
    files raise ``ValueError``: nothing tells when that changes.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found: list[str] = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or not hasattr(leaf.relation(), "location"):
            raise ValueError("only tables in files can be told apart by their files")
        listed = leaf.relation().location().allFiles().mkString("\n")
        found += [";".join(m) for m in re.findall(r"path=(.*?); isDirectory=false; length=(\d+);.*?modification_time=(\d+)", listed)]
    return sorted(found)


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
