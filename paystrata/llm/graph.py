"""Approximate nearest neighbours by largest inner product, on robust-pruned graphs.

Distinct vectors are dealt into shards of bounded size by a hash. A shard's
task builds a directed graph over them: batches of vectors search the graph so
far greedily, and what they meet are the proposed neighbours; of these the
nearest is kept and whatever it is ``alpha`` times nearer to than the vector
itself is struck out, again and again, so that the kept edges are few and point
into different directions. Edges are also put in backwards and full lists are
pruned by the same rule. Vectors that no edge path reaches from the entry are
entries themselves. Queries search every shard with a beam: the unvisited
vectors nearest to the query are opened and their neighbours enter the beam.

Largest inner product is made nearest distance by one more component, which
brings every indexed vector to the length of the longest one. Graphs work in
single precision about the mean; what a beam holds at its end is scored on the original
vectors in double precision.

Equal vectors are one node, with its smallest ids: no more of them can be among
the answers. So a group of copies, however large, is one node of one shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paystrata.sources.staging import staged

SHARD = 4096
#: Edges of a vector, width of the beam, relaxation of the pruning rule.
DEGREE, BEAM, ALPHA = 32, 96, 1.2
#: Queries that a task holds beside a shard, and that are searched at once.
_QUERIES, _AT_ONCE = 8192, 512
_OPENED = 4


def _distances(points: np.ndarray, square: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances less the query's own square, of each query to its row of points."""
    return square[ids] - 2 * np.matmul(points[ids], queries[:, :, None])[:, :, 0]


def beam_search(points: np.ndarray, square: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``beam`` nearest vectors met by each query, nearest first; -1 fills up.

    ``edges`` has one row of neighbours a vector, filled up with -1. The search
    of a query ends when all of its beam has been opened.
    """
    count = len(queries)
    # A last, endless point stands for no vector.
    none = len(points)
    points = np.vstack([points, np.zeros((1, points.shape[1]), points.dtype)])
    square = np.r_[square, np.float32(np.inf)]
    edges = np.vstack([np.where(edges < 0, none, edges), np.full((1, edges.shape[1]), none)])
    met = np.zeros((count, none + 1), bool)
    met[:, none] = True
    ids = np.full((count, beam), none)
    far = np.full((count, beam), np.inf, np.float32)
    opened = np.ones((count, beam), bool)
    new = np.broadcast_to(entries, (count, len(entries)))
    active = np.arange(count)
    while True:
        # Every vector enters a query's beam at most once.
        fresh = ~met[active[:, None], new]
        order = np.argsort(np.where(fresh, new, none), axis=1, kind="stable")
        new = np.take_along_axis(np.where(fresh, new, none), order, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = none
        met[active[:, None], new] = True
        away = _distances(points, square, queries[active], new)
        all_ids = np.concatenate([ids[active], new], axis=1)
        all_far = np.concatenate([far[active], away], axis=1)
        all_opened = np.concatenate([opened[active], new == none], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids[active], far[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_far, best, 1)
        opened[active] = np.take_along_axis(all_opened, best, 1) | (ids[active] == none)
        active = active[~opened[active].all(axis=1)]
        if not len(active):
            break
        # The nearest that have not been opened.
        shut = opened[active]
        take = np.argsort(shut, axis=1, kind="stable")[:, :_OPENED]
        picked = np.where(np.take_along_axis(shut, take, 1), none, np.take_along_axis(ids[active], take, 1))
        opened[active[:, None], take] = True
        new = edges[picked].reshape(len(active), -1)
    return np.where(ids == none, -1, ids), far


def robust_prune(points: np.ndarray, square: np.ndarray, centres: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each centre at most ``degree`` of its candidates (-1: none), nearest first, that are not struck out by nearer ones."""
    none = candidates < 0
    ids = np.where(none, centres[:, None], candidates)
    away = square[ids] + square[centres][:, None] - 2 * np.matmul(points[ids], points[centres][:, :, None])[:, :, 0]
    away = np.where(none | (ids == centres[:, None]), np.inf, np.maximum(away, 0))
    order = np.argsort(away, axis=1, kind="stable")
    ids, away = np.take_along_axis(ids, order, 1), np.take_along_axis(away, order, 1)
    again = np.argsort(ids, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(ids, again, 1)
    repeated = np.zeros(ids.shape, bool)
    np.put_along_axis(repeated, again[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], axis=1)
    away[repeated] = np.inf
    there = points[ids]
    between = square[ids][:, :, None] + square[ids][:, None, :] - 2 * np.matmul(there, there.transpose(0, 2, 1))
    strikes = alpha * alpha * np.maximum(between, 0) <= away[:, None, :]
    open_, kept, held = np.isfinite(away), np.full((len(ids), degree), -1), np.zeros(len(ids), np.int64)
    rows = np.arange(len(ids))
    for _ in range(degree):
        first = open_.argmax(axis=1)
        live = open_[rows, first]
        if not live.any():
            break
        kept[rows[live], held[live]] = ids[rows[live], first[live]]
        held += live
        open_ &= ~(strikes[rows, first] & live[:, None])
        open_[rows, first] = False
    return kept


def _reached(edges: np.ndarray, start: np.ndarray, seen: np.ndarray) -> None:
    """Mark whatever edges lead to from ``start``."""
    seen[start] = True
    while len(start):
        start = np.unique(edges[start])
        start = start[start >= 0]
        start = start[~seen[start]]
        seen[start] = True


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) over single-precision points; the same for the same points in the same order."""
    count = len(points)
    square = (points * points).sum(axis=1)
    centre = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((count, degree), -1)
    order = np.random.default_rng(count).permutation(count)
    order = np.r_[centre, order[order != centre]]
    done, size = 1, 16
    while done < count:
        batch = order[done:done + size]
        found, _ = beam_search(points, square, edges, np.array([centre]), points[batch], beam)
        # Vectors of one batch do not find each other by the graph: the nearest of them are proposed as well.
        near = square[batch] - 2 * points[batch] @ points[batch].T
        near = batch[np.argsort(near, axis=1, kind="stable")[:, :degree // 2 + 1]]
        edges[batch] = robust_prune(points, square, batch, np.concatenate([found, near], axis=1), degree, alpha)
        to, owner = edges[batch].ravel(), np.repeat(batch, degree)
        owner, to = owner[to >= 0], to[to >= 0]
        _link_back(points, square, edges, to, owner, alpha)
        done += len(batch)
        size = min(2 * size, _AT_ONCE, max(16, done))
    seen, entries = np.zeros(count, bool), [centre]
    _reached(edges, np.array([centre]), seen)
    while not seen.all():
        entries.append(int(np.flatnonzero(~seen)[0]))
        _reached(edges, np.array(entries[-1:]), seen)
    return edges, np.array(entries)


def _link_back(points: np.ndarray, square: np.ndarray, edges: np.ndarray, owner: np.ndarray, to: np.ndarray, alpha: float) -> None:
    """Add the edges owner -> to; a list that would be too long is pruned."""
    degree = edges.shape[1]
    order = np.lexsort((to, owner))
    owner, to = owner[order], to[order]
    nodes, starts, counts = np.unique(owner, return_index=True, return_counts=True)
    inside = np.arange(len(to)) - np.repeat(starts, counts)
    for at in range(0, int(counts.max(initial=0)), degree):
        chunk = (inside >= at) & (inside < at + degree)
        mine = nodes[counts > at]
        more = np.full((len(mine), degree), -1)
        more[np.searchsorted(mine, owner[chunk]), inside[chunk] - at] = to[chunk]
        both = np.concatenate([edges[mine], more], axis=1)
        both[:, degree:][(both[:, degree:, None] == both[:, None, :degree]).any(axis=2)] = -1
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        long = (both[:, degree] >= 0) if both.shape[1] > degree else np.zeros(len(mine), bool)
        edges[mine[~long]] = both[~long, :degree]
        if long.any():
            edges[mine[long]] = robust_prune(points, square, mine[long], both[long], degree, alpha)


def _flat(table: pa.Table, width: int, stored: str) -> np.ndarray:
    return table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(stored).reshape(-1, width)


def _lengthened(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, centre): the vectors, scaled by a power of two, with a component that brings all to the longest length, about their mean."""
    small = np.ldexp(vectors, -int(np.frexp(np.abs(vectors).max())[1]))
    squares = (small * small).sum(axis=1)
    whole = np.c_[small, np.sqrt(squares.max() - squares)]
    return (whole - whole.mean(axis=0)).astype(np.float32), whole.mean(axis=0)


def _index(stored: str, degree: int, beam: int, alpha: float):
    """One row for a shard: its nodes, vectors, edges and entries."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        width = table.column("width")[0].as_py()
        vectors = _flat(table, width, stored)
        edges, entries = build_graph(_lengthened(vectors.astype(np.float64))[0], degree, beam, alpha)
        values = {"vectors": vectors, "nodes": table.column("node").to_numpy().astype("<i8"), "edges": edges.astype("<i4"), "entries": entries.astype("<i4")}
        return pa.table({"width": table.column("width").slice(0, 1), "shard": table.column("shard").slice(0, 1),
                         **{name: pa.array([value.tobytes()], pa.binary()) for name, value in values.items()}})
    return run


def _search(stored: str, degree: int, beam: int, k: int):
    """The ``k`` best nodes of a shard for each query of a chunk."""
    def run(key: tuple, shards: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not shards.num_rows or not queries.num_rows:
            return empty
        row, width = shards.to_pylist()[0], key[0].as_py()
        vectors = np.frombuffer(row["vectors"], stored).reshape(-1, width).astype(np.float64)
        nodes, edges = np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["edges"], "<i4").reshape(-1, degree).astype(np.int64)
        entries = np.frombuffer(row["entries"], "<i4").astype(np.int64)
        points, centre = _lengthened(vectors)
        square = (points * points).sum(axis=1)
        asked, ids = _flat(queries, width, stored).astype(np.float64), queries.column("query_id").to_numpy()
        # A query's length does not change the order of its answers.
        unit = np.ldexp(asked, -np.frexp(np.abs(asked).max(axis=1))[1][:, None])
        unit = (np.c_[unit, np.zeros(len(unit))] - centre).astype(np.float32)
        found = [empty]
        for at in range(0, len(ids), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            near, _ = beam_search(points, square, edges, entries, unit[part], beam)
            i, j = np.nonzero(near >= 0)
            met = near[i, j]
            score = np.full(near.shape, -np.inf)
            score[i, j] = (asked[part][i] * vectors[met]).sum(axis=1)
            best = np.lexsort((np.where(near >= 0, nodes[near], np.iinfo(np.int64).max), -score), axis=1)[:, :k]
            near, score = np.take_along_axis(near, best, 1), np.take_along_axis(score, best, 1)
            i, j = np.nonzero(near >= 0)
            found.append(pa.table({"query_id": ids[part][i], "node": nodes[near[i, j]], "score": score[i, j]}))
        return pa.concat_tables(found)
    return run


def _usable() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM,
            alpha: float = ALPHA) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (vec_id, embedding) the ``k`` nearest found of ``rows`` but its own vec_id.

    Nearest is the largest inner product; ties go to the smaller vec_id. A query
    with fewer candidates gets all of them. Vectors that are null, empty, zero
    or hold null or non-finite components take no part, nor do rows without a
    vec_id; vectors of different lengths never meet. A vec_id names one vector,
    so repeated rows count once. Components keep their type if it is float and
    are taken as doubles otherwise. Other columns are not read.
    """
    element = "float" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    stored = "<f4" if element == "float" else "<f8"
    vector = F.transform(F.col("embedding").cast(f"array<{element}>"), lambda x: x + F.lit(0).cast(element)).alias("embedding")
    able = rows.select("vec_id", "embedding").filter(_usable()).select(F.col("vec_id").cast("long"), vector)
    # The smallest ids of equal vectors: with one to spare for the query's own.
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    few = able.dropDuplicates(["vec_id"]).withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1)
    classes = staged(few.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "graph-classes")
    wide = classes.withColumn("width", F.size("embedding"))
    shards = staged(wide.groupBy("width").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "graph-shards")
    # A shard is much work for little data, so its number of tasks is given and not left to sizes.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wide.join(shards, "width").select("width", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), "node", "embedding")
    index = staged(dealt.repartition(tasks, "width", "shard").groupBy("width", "shard").applyInArrow(
        _index(stored, degree, beam, alpha), "width int, shard int, vectors binary, nodes binary, edges binary, entries binary"), "graph-index")

    asked = queries.select("vec_id", "embedding").filter(_usable()).select(F.col("vec_id").cast("long").alias("query_id"), vector)
    asked = staged(asked.dropDuplicates(["query_id"]), "graph-queries").withColumn("width", F.size("embedding"))
    # Queries go to every shard in chunks; a chunk is what a task holds beside the shard.
    chunks = staged(asked.groupBy("width").agg(F.ceil(F.count("*") / _QUERIES).cast("int").alias("chunks")), "graph-chunks")
    spread = asked.join(chunks, "width").join(shards, "width").select(
        "width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), "query_id", "embedding")
    held = index.join(chunks, "width").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    key = ["width", "shard", "chunk"]
    met = staged(held.repartition(tasks, *key).groupBy(*key).cogroup(spread.repartition(tasks, *key).groupBy(*key)).applyInArrow(
        _search(stored, degree, beam, k + 1), "query_id long, node long, score double"), "graph-met")
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))).filter(F.col("nth") <= k + 1)
    answers = best.join(classes.select("node", "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_graph_neighbours(spark, folder: str) -> DataFrame:
    """Contract query: the 20 nearest of every vector whose id is divisible by 20, among all embeddings."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))
