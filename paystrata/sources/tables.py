"""Readers of the operational and warehouse tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from paystrata.schema import KEYS, TABLES
from paystrata.sources import versions
from paystrata.sources.staging import delete_path


def load_tables(spark: SparkSession, folder: str,
                names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Scan the model's tables from ``folder/<table>`` with their declared schema.

    Schemas are never inferred, so a scan starts without reading any data file.
    Payroll records are those of the version that is newest now; a scan that has
    been made keeps its version.
    """
    return {name: _scanned(spark, folder, name).select(TABLES[name].names) for name in (names or TABLES)}


def _scanned(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = StructType(list(TABLES[name].fields))
    if name in _DATED:
        schema = schema.add(DATE_COLUMN, DateType())
    now = versions.published(spark, folder, name) if name == "payroll_records" else None
    if now:
        return _published_scan(spark, folder, schema, now)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def load_log(spark: SparkSession, folder: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The audit log; with an inclusive range of days, only the partitions of its months are read."""
    log = _scanned(spark, folder, "activity_logs")
    if date_from:
        log = log.filter(F.col(DATE_COLUMN) >= F.trunc(F.lit(date_from).cast("date"), "month"))
    if date_to:
        log = log.filter(F.col(DATE_COLUMN) <= F.trunc(F.lit(date_to).cast("date"), "month"))
    return log.select(TABLES["activity_logs"].names)


#: Partition column (first day of the month) of tables that are laid out by time; it is not part of the model.
DATE_COLUMN = "log_month"

# How the big tables are laid out. Rows are range-partitioned before they are
# written: few files per year, none of them huge when one year holds a third of
# all rows, and narrow row-group statistics on the second column.
_LAYOUT = {
    "payroll_records": ("payroll_year", "employee_id"),
    "activity_logs": ("created_at", "log_id"),
}
_PARTITIONED_BY = {"payroll_records": "payroll_year", "activity_logs": DATE_COLUMN}
_DATED = {"activity_logs": "created_at"}


def _laid_out(df: DataFrame, name: str) -> DataFrameWriter:
    """A writer of the table in its columns, order and partitions."""
    shaped = df.select([F.col(field.name).cast(field.dataType) for field in TABLES[name]])
    if name in _DATED:
        shaped = shaped.withColumn(DATE_COLUMN, F.trunc(_DATED[name], "month"))
    if name in _LAYOUT:
        shaped = shaped.repartitionByRange(*_LAYOUT[name]).sortWithinPartitions(*_LAYOUT[name])
    by = _PARTITIONED_BY.get(name)
    return shaped.write.partitionBy(by) if by else shaped.write


def content(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, row_count, filled, hash_sum): what each column of a table holds, in one pass.

    ``hash_sum`` adds up the first 32 bits of the MD5 of each value as text, so it
    does not depend on order or layout.
    """
    def hashed(column: str) -> Column:
        text = F.col(column).cast("string")
        return F.coalesce(F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")), F.lit(0))

    sums = df.agg(F.count("*").alias("row_count"), *[F.count(c).alias(f"filled_{c}") for c in df.columns], *[hashed(c).alias(f"hash_{c}") for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"filled_{c}").alias("filled"), F.col(f"hash_{c}").alias("hash_sum"))
                               for c in df.columns]))
    return sums.select(F.lit(name).alias("table_name"), "row_count", rows.alias("c")).select(
        "table_name", "c.column_name", "row_count", "c.filled", "c.hash_sum")


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Initial load of the given tables into ``folder/<table>``."""
    for name, df in tables.items():
        _laid_out(df, name).mode("errorifexists").parquet(f"{folder}/{name}")


def append_table(df: DataFrame, name: str, folder: str) -> None:
    """Add rows to a stored table, laid out like the rows that are there."""
    _laid_out(df, name).mode("append").parquet(f"{folder}/{name}")


# The codes of the merge job for done and for a conflict.
PUBLISHED, REPLACED_SINCE = 0, 2


def records_version(spark: SparkSession, folder: str) -> int:
    """The version of the stored payroll records; 0 until something is published over what was saved."""
    now = versions.published(spark, folder, "payroll_records")
    return now.version if now else 0


def publish_records(state: DataFrame, folder: str, years: list[int], expected: int | None = None) -> int:
    """Replace the given years of the stored payroll records by those of ``state``.

    The rows of these years go to a folder of their own; one small record then
    says which folder holds each year, and writing it switches all years at
    once. A failure before that leaves the table as it was, and readers that
    have begun keep their files, as none is changed or deleted.

    ``expected`` is the version (``records_version``) that ``state`` was read
    from. When one of the years has been replaced since, nothing is published
    and the answer is REPLACED_SINCE; writers of different years do not hinder
    each other. Otherwise PUBLISHED. Without ``expected`` the last one wins.
    """
    spark, table, column = state.sparkSession, "payroll_records", _PARTITIONED_BY["payroll_records"]
    years = sorted({int(y) for y in years})
    place = f"{table}_new/{uuid.uuid4().hex}"
    _laid_out(state.filter(F.col(column).isin(years)), table).parquet(f"{folder}/{place}")
    filled = versions.names(spark, f"{folder}/{place}")
    changed = {year: place if f"{column}={year}" in filled else None for year in years}
    while True:
        now = versions.published(spark, folder, table) or _saved(spark, folder)
        if expected is not None and now.replaced_since(years, expected):
            delete_path(spark, f"{folder}/{place}")
            return REPLACED_SINCE
        if versions.switch(spark, folder, table, now, changed):
            return PUBLISHED


def _saved(spark: SparkSession, folder: str) -> versions.Published:
    """The years of a table as it was saved, before anything was published."""
    column = _PARTITIONED_BY["payroll_records"]
    found = [name.split("=")[1] for name in versions.names(spark, f"{folder}/payroll_records") if name.startswith(f"{column}=")]
    return versions.Published(0, {int(year): ("payroll_records", 0) for year in found if year.isdigit()})


def _published_scan(spark: SparkSession, folder: str, schema: StructType, now: versions.Published) -> DataFrame:
    """A scan of the folders that hold the years; one for each folder, which are at most as many as years."""
    column = _PARTITIONED_BY["payroll_records"]
    places: dict[str, list[int]] = {}
    for year, (place, _) in now.years.items():
        if place:
            places.setdefault(place, []).append(year)
    scans = [spark.read.schema(schema).option("basePath", f"{folder}/{place}").parquet(*[f"{folder}/{place}/{column}={y}" for y in years])
             for place, years in places.items()]
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], schema)


def remove_replaced(spark: SparkSession, folder: str) -> int:
    """Delete published folders that the newest version does not use; returns how many. Readers of older versions lose their files."""
    now = versions.published(spark, folder, "payroll_records")
    used = {place for place, _ in now.years.values()} if now else set()
    old = [f"payroll_records_new/{name}" for name in versions.names(spark, f"{folder}/payroll_records_new")]
    return sum(delete_path(spark, f"{folder}/{place}") for place in old if place not in used)


def load_jdbc(spark: SparkSession, url: str, table: str, key_range: tuple[int, int],
              partitions: int, **options: str) -> DataFrame:
    """Read one table from a relational database in parallel ranges of its key."""
    low, high = key_range
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=KEYS[table],
                 lowerBound=str(low), upperBound=str(high),
                 numPartitions=str(partitions), **options)
        .load()
    )
