"""Neighbour graphs: the pruning rule, reachability, recall and exact answers of small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paystrata.llm import graph

SCHEMA = "vec_id long, embedding array<float>, label int"
EXTRA = SCHEMA + ", node long, score string, shard int, rank string"


def table(spark, vectors, schema=SCHEMA):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors]
    if schema == EXTRA:
        rows = [(*r, 7, "x", 1, "y") for r in rows]
    return spark.createDataFrame(rows, schema).repartition(3)


def brute(vectors, queries, k=20, kind=np.float32):
    """(query, rank) -> (vec_id, score), by all inner products."""
    good = {i: np.array(v, kind).astype(float) for i, v in vectors if i is not None and v is not None and len(v)
            and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, kind) != 0)}
    found = {}
    for q in queries:
        if q in good:
            near = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            found |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(near[:k])}
    return found


def answers(rows):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for at, (vec_id, score) in want.items():
        assert got[at][0] == vec_id and got[at][1] == pytest.approx(score, rel=1e-12, abs=1e-300), at


def test_small_table_is_answered_whole(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6)) for i in range(60)]
    rows = table(spark, vectors)
    same(answers(graph.nearest(rows, rows.filter("vec_id % 5 = 0"))), brute(vectors, range(0, 60, 5)))


def test_odd_vectors_ties_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    base = [[1.0, 0.0, 0.0]] * 30 + [[0.0, 2.0, 0.0]] * 3
    vectors = [(i, v) for i, v in enumerate(base)] + [(100 + i, rng.normal(size=3)) for i in range(20)]
    vectors += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 0.0]), (204, [float("nan"), 1.0, 0.0]),
                (205, [float("inf"), 0.0, 0.0]), (206, [-0.0, 2.0, 0.0]), (207, [1.0, 1.0]), (208, [2.0, 1.0]), (None, [9.0, 9.0, 9.0])]
    rows = table(spark, vectors, EXTRA)
    want = brute(vectors, [0, 29, 30, 100, 200, 202, 203, 204, 205, 206, 207])
    asked = rows.filter(F.col("vec_id").isin([0, 29, 30, 100, 200, 202, 203, 204, 205, 206, 207]) | F.col("vec_id").isNull())
    same(answers(graph.nearest(rows, asked)), want)
    assert want[0, 1] != want[29, 1] and (207, 1) in want and (207, 2) not in want
    # Repeated rows count once.
    same(answers(graph.nearest(rows.unionByName(rows), asked.unionByName(asked))), want)


def test_doubles_keep_their_precision_and_range(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=4) * 1e200) for i in range(15)] + [(50, [1 + 1e-12, 0, 0, 0]), (51, [1.0, 0, 0, 0]), (52, [1.0, 0, 0, 0])]
    small = vectors[15:]
    rows = table(spark, small, "vec_id long, embedding array<double>, label int")
    same(answers(graph.nearest(rows, rows)), brute(small, [50, 51, 52], kind=float))
    wide = [(i, v / 1e60) for i, v in vectors[:15]]
    rows = table(spark, wide, "vec_id long, embedding array<double>, label int")
    same(answers(graph.nearest(rows, rows)), brute(wide, range(15), kind=float))


def test_empty_tables(spark):
    rows = table(spark, [])
    assert graph.nearest(rows, rows).count() == 0
    some = table(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])
    assert graph.nearest(rows, some).count() == 0 and graph.nearest(some, rows).count() == 0
    assert answers(graph.nearest(some, some)) == {(1, 1): (2, 4.0), (2, 1): (1, 4.0)}


def test_recall_over_several_shards_and_lengths(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    vectors = [(i, (centres[i % 12] + rng.normal(size=32) * 0.7) * rng.uniform(0.5, 2)) for i in range(3000)]
    rows = table(spark, vectors)
    queries = list(range(0, 3000, 20))
    got = answers(graph.nearest(rows, rows.filter("vec_id % 20 = 0"), shard=700))
    want = brute(vectors, queries)
    assert got.keys() == want.keys()
    hits = sum(len({got[q, r][0] for r in range(1, 21)} & {want[q, r][0] for r in range(1, 21)}) for q in queries)
    assert hits >= 0.95 * 20 * len(queries)
    by_id = {i: np.float32(v).astype(float) for i, v in vectors}
    assert all(score == pytest.approx((by_id[q] * by_id[i]).sum(), rel=1e-12) for (q, _), (i, score) in got.items())
    assert all(got[q, r][1] >= got[q, r + 1][1] for q in queries for r in range(1, 20))


def test_pruning_rule_against_a_plain_loop():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(80, 5)).astype(np.float32)
    square = (points * points).sum(axis=1)
    candidates = np.array([rng.permutation(80)[:30] for _ in range(10)])
    candidates[0, 3] = candidates[0, 4]
    candidates[1, 5] = 1
    candidates[2, 6:] = -1
    got = graph.robust_prune(points, square, np.arange(10), candidates, 6, 1.2)
    far = lambda a, b: ((points[a] - points[b]).astype(float) ** 2).sum()
    for centre in range(10):
        left = sorted({int(c) for c in candidates[centre]} - {-1, centre}, key=lambda c: far(centre, c))
        kept = []
        while left and len(kept) < 6:
            kept.append(left[0])
            left = [c for c in left[1:] if 1.44 * far(kept[-1], c) > far(centre, c)]
        assert [c for c in got[centre].tolist() if c >= 0] == kept


def test_everything_can_be_reached_and_edges_are_few():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(200, 4)) + 50 * i for i in range(4)]).astype(np.float32)
    edges, entries = graph.build_graph(points, degree=16, beam=32)
    seen = np.zeros(len(points), bool)
    graph._reached(edges, entries, seen)
    assert seen.all() and edges.shape == (800, 16) and (edges < 800).all()
    assert all(len({*row[row >= 0]}) == (row >= 0).sum() and i not in row for i, row in enumerate(edges))
    square = (points * points).sum(axis=1)
    ids, _ = graph.beam_search(points, square, edges, entries, points, 32)
    assert (ids[:, 0] == np.arange(800)).all()
