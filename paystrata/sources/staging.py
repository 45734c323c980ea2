"""Staged tables: results written once to the shared checkpoint folder.

A staged table cuts the lineage, survives the loss of any executor, and has an
exact size on disk. The last point replaces broadcast hints: the planner
compares the file size with ``spark.sql.autoBroadcastJoinThreshold`` and picks
a broadcast join below it and a sort-merge join (with adaptive skew splitting)
above it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folder: str | None = None
# What was staged, by scope: the last list belongs to the innermost open scope.
_scopes: list[list[str]] = [[]]


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode."""
    global _local_folder
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/") + "/paystrata"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="paystrata-stage-")
    return _local_folder


def staging_path(spark: SparkSession, label: str) -> str:
    """A new place in the staging folder; it goes with the scope it was made in."""
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder in whatever store it lies; false if there was none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _release(spark: SparkSession, paths: list[str]) -> int:
    count = len(paths)
    while paths:
        delete_path(spark, paths.pop())
    return count


def release_staged(spark: SparkSession) -> int:
    """Delete what was staged outside any scope; returns how much there was.

    Call it when the results built on it have been written. Results that are
    still lazy cannot be evaluated afterwards.
    """
    return _release(spark, _scopes[0])


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside the ``with`` block when it ends.

    Build a result and write it inside one block; results of other blocks are
    not touched.
    """
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.pop()
        _release(spark, mine)
