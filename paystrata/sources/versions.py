"""Small versioned records beside the tables: numbered texts that are written once and never changed.

A record is a folder of files named by version. A new version is written aside
and renamed to its number, which fails when that number exists: of two writers
that start from the same version one succeeds, and the other looks again. A
reader sees whole versions only. The store must rename without overwriting, as
HDFS does.

``Published`` keeps which folder holds each year of the payroll records;
``reserve_ids`` hands out ranges of ids.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_DIGITS = 12
# A plain local disk renames a file and its checksum one after the other; threads of one driver wait for both.
_renaming = threading.Lock()


def _hadoop(spark: SparkSession, path: str):
    """(path, its file system) in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file as a whole, unless there is one of that name; whether it was written."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    target, store = _hadoop(spark, path)
    aside, _ = _hadoop(spark, f"{target.getParent().toString()}/.{uuid.uuid4().hex}")
    out = store.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        with _renaming:
            files.rename(store.makeQualified(aside), store.makeQualified(target), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        store.delete(aside, False)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    place, store = _hadoop(spark, path)
    with _renaming:
        file = store.open(place)
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    place, store = _hadoop(spark, folder)
    return [status.getPath().getName() for status in store.listStatus(place)] if store.exists(place) else []


def latest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The newest version of a record and its text; (0, None) if there is none."""
    numbers = [int(name) for name in names(spark, folder) if name.isdigit()]
    if not numbers:
        return 0, None
    return max(numbers), read_text(spark, f"{folder}/{max(numbers):0{_DIGITS}d}")


def put_next(spark: SparkSession, folder: str, version: int, text: str) -> bool:
    """Write the version after ``version``; false if somebody else has."""
    return put_if_absent(spark, f"{folder}/{version + 1:0{_DIGITS}d}", text)


# --- ids -------------------------------------------------------------------

def reserve_ids(spark: SparkSession, folder: str, column: str, count: int, at_least: int = 1) -> int:
    """Reserve ``count`` ids in a row and return the first of them.

    Ranges never overlap, also not between jobs that start from the same state.
    ``at_least`` is the first id that the stored rows leave free; ids of a job
    that fails stay unused.
    """
    place = f"{folder}/_ids/{column}"
    while True:
        version, text = latest(spark, place)
        first = max(at_least, int(text) if text else 1)
        if put_next(spark, place, version, str(first + count)):
            return first


# --- published years -------------------------------------------------------

@dataclass(frozen=True)
class Published:
    """Which folder holds each year, and in which version the year was last replaced."""

    version: int
    years: dict[int, tuple[str, int]]

    def replaced_since(self, years: list[int], version: int) -> bool:
        return any(self.years.get(year, ("", 0))[1] > version for year in years)


def _record(folder: str, table: str) -> str:
    return f"{folder}/_versions/{table}"


def published(spark: SparkSession, folder: str, table: str) -> Published | None:
    """The newest published version of a table; none if it was only saved."""
    version, text = latest(spark, _record(folder, table))
    if text is None:
        return None
    return Published(version, {int(year): (place, at) for year, (place, at) in json.loads(text).items()})


def switch(spark: SparkSession, folder: str, table: str, now: Published, changed: dict[int, str | None]) -> bool:
    """Publish the version after ``now``, with these years in their new folders (none: the year is empty now)."""
    years = dict(now.years)
    for year, place in changed.items():
        years[year] = (place or "", now.version + 1)
    return put_next(spark, _record(folder, table), now.version, json.dumps({str(year): years[year] for year in sorted(years)}))
