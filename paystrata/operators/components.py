"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paystrata.sources.staging import staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a long, b long).

    The component is its smallest node. Two alternating steps turn the graph
    into stars: each node hands its larger neighbours, then its smaller ones,
    to the smallest node it sees. Links stay linear in number and the rounds
    grow with the logarithm of the longest chain. A round is written to the
    shared folder, so a lost executor never costs more than one round. Minima
    combine before their shuffle and joins are plain equi-joins, which adaptive
    execution splits when one node holds many links.
    """
    edges = staged(_tidy(links.select("a", "b")), "links")
    mark = _mark(edges)
    while True:
        edges = staged(_small_star(_large_star(edges)), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(centres)


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return _tidy(both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _tidy(moved.unionByName(lowest.withColumnRenamed("low", "b")))
