"""Distributed ranks against plain windows, with ties, hot groups and NULL groups."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paystrata.operators.ranking import Level, global_row_number, ntile_of, ranked

SCHEMA = "id long, dept string, period int, net decimal(12,2)"


def _rows(seed, n, values, hot):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        dept = "hot" if rng.random() < hot else rng.choice(["a", "b", None, ""])
        net = Decimal(rng.randrange(1, values + 1)) if rng.random() > 0.34 else Decimal(values // 2 + 1)
        out.append((i, dept, rng.randrange(1, 4), net))
    return out


@pytest.mark.parametrize("seed,n,values,hot,slots", [
    (1, 600, 5, 0.4, 8), (2, 600, 400, 0.34, 8), (3, 300, 1, 0.9, 7), (4, 40, 3, 0.2, 16),
    (5, 500, 20, 0.34, None), (6, 1, 3, 0.5, 4),
])
def test_ranked_equals_plain_windows(spark, seed, n, values, hot, slots):
    df = spark.createDataFrame(_rows(seed, n, values, hot), SCHEMA)
    by_net = F.col("net").desc()
    dept, cell = Window.partitionBy("dept"), Window.partitionBy("dept", "period")
    expected = df.select(
        "id",
        F.row_number().over(Window.orderBy(by_net, "id")).alias("all_row"),
        F.rank().over(Window.orderBy(by_net)).alias("all_rank"),
        F.dense_rank().over(Window.orderBy(by_net)).alias("all_dense"),
        F.row_number().over(dept.orderBy(by_net, "id")).alias("dept_row"),
        F.dense_rank().over(dept.orderBy(by_net)).alias("dept_dense"),
        F.count("*").over(dept).alias("dept_count"),
        F.sum("net").over(dept).alias("dept_total"),
        F.ntile(4).over(dept.orderBy(by_net, "id")).alias("quartile"),
        F.rank().over(cell.orderBy(by_net)).alias("cell_rank"),
        F.sum("net").over(cell).alias("cell_total"),
    )
    got = ranked(df, "net", ["id"], [
        Level(row="all_row", rank="all_rank", dense="all_dense"),
        Level(("dept",), row="dept_row", dense="dept_dense", count="dept_count", total="dept_total"),
        Level(("dept", "period"), rank="cell_rank", total="cell_total"),
    ], slots=slots).withColumn("quartile", ntile_of(4, F.col("dept_row"), F.col("dept_count")))
    assert set(got.columns) == {"dept", "period", "net", *expected.columns}
    key = expected.columns
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("slots", [None, 1, 8, 32])
def test_global_row_number(spark, slots):
    df = spark.createDataFrame(_rows(9, 500, 3, 0.5), SCHEMA)
    order = [F.col("net").desc(), F.col("id")]
    got = {r.id: r.n for r in global_row_number(df, order, "n", start=11, slots=slots).collect()}
    want = sorted(df.collect(), key=lambda r: (-r.net, r.id))
    assert got == {r.id: i + 11 for i, r in enumerate(want)}


def test_row_number_of_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert global_row_number(df, [F.col("id")], "n").count() == 0
    assert ranked(df, "net", ["id"], [Level(row="r")]).count() == 0


@pytest.mark.parametrize("slots", [None, 9])
def test_rank_of_the_whole_table_alone(spark, slots):
    df = spark.createDataFrame(_rows(11, 300, 4, 0.5), SCHEMA)
    got = ranked(df, "net", ["id"], [Level(rank="r", dense="d")], slots=slots)
    over = Window.orderBy(F.col("net").desc())
    want = df.withColumn("r", F.rank().over(over)).withColumn("d", F.dense_rank().over(over))
    assert sorted(map(tuple, got.select("id", "r", "d").collect())) == sorted(
        map(tuple, want.select("id", "r", "d").collect()))


def test_levels_must_be_nested(spark):
    df = spark.createDataFrame(_rows(1, 5, 3, 0.5), SCHEMA)
    with pytest.raises(ValueError):
        ranked(df, "net", ["id"], [Level(("dept",), rank="a"), Level(("period",), rank="b")])
