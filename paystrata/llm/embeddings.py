"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors of one label are dealt into tiles of bounded size and every pair of
tiles is one task's group. In a group both tiles are scaled to unit length and
quantised to int8 with one scale per vector. With U = u - ru and V = v - rv
the quantised vectors, |u.v - U.V| <= |U| |rv| + |ru| |v|, and |ru| is
measured per vector in double precision. So one integer matrix product decides
nearly all pairs: those whose product plus bound stays below the threshold
cannot link. Only the rest are recomputed in double precision.

Equal vectors of one label are made one class first. A group reports, for each
vector, how many vectors it links to, and one link to the smallest member it
is connected to in the group: the output is linear in the vectors, however
dense the links are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paystrata.llm.components import block_components
from paystrata.operators.components import connected_components
from paystrata.sources.staging import staged

TILE = 2048
_STRIP = 512


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the norms of the quantised vectors and of the residuals of unit vectors."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    values = np.rint(vectors / scale[:, None]).astype(np.int8)
    back = values * scale[:, None]
    slack = 1e-12  # covers the rounding of these double-precision sums
    return values, scale, np.linalg.norm(back, axis=1) + slack, np.linalg.norm(vectors - back, axis=1) + slack


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring the largest component to 0.5 to 1, so that no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows (i, j) with a[i].b[j] / (|a[i]| |b[j]|) >= threshold, and how many were recomputed."""
    a, b = _scaled(a), _scaled(b)
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    qa, sa, na, ra = quantised(a / norm_a[:, None])
    qb, sb, _, rb = quantised(b / norm_b[:, None])
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay whole numbers
    qa, qb = qa.astype(exact), qb.astype(exact)
    rows, columns, tried = [], [], 0
    for at in range(0, len(a), _STRIP):
        part = slice(at, at + _STRIP)
        product = (qa[part] @ qb.T).astype(np.float64) * sa[part, None] * sb
        bound = na[part, None] * rb + ra[part, None] * (1 + 1e-9) + 1e-9
        i, j = np.nonzero(product + bound >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        tried += len(i)
        for k in range(0, len(i), 1 << 16):
            x, y = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            cosine = (a[x] * b[y]).sum(axis=1) / (norm_a[x] * norm_b[y])
            rows.append(x[cosine >= threshold])
            columns.append(y[cosine >= threshold])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *columns]), tried


def _pack(table: pa.Table) -> pa.Table:
    """One row for a tile: its class numbers, class sizes and vectors, of the element type they have."""
    vectors = table.column("embedding").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return pa.table({
        "label": table.column("label").slice(0, 1), "tile": table.column("tile").slice(0, 1), "tiles": table.column("tiles").slice(0, 1),
        "nodes": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()),
        "sizes": pa.array([table.column("size").to_numpy().tobytes()], pa.binary()),
        "vectors": pa.array([flat.tobytes()], pa.binary()),
    })


def _compare(threshold: float, stored: str):
    def run(table: pa.Table) -> pa.Table:
        tiles = sorted(table.to_pylist(), key=lambda r: r["tile"])
        nodes = [np.frombuffer(r["nodes"], "<i8") for r in tiles]
        sizes = [np.frombuffer(r["sizes"], "<i8") for r in tiles]
        vectors = [np.frombuffer(r["vectors"], stored).astype(np.float64).reshape(len(n), -1) for r, n in zip(tiles, nodes)]
        i, j, _ = tile_links(vectors[0], vectors[-1], threshold, len(tiles) == 1)
        shift = 0 if len(tiles) == 1 else len(nodes[0])
        node, size = np.concatenate(nodes), np.concatenate(sizes)
        j = j + shift
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        order = np.argsort(node)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = order[block_components(len(node), place[i], place[j])[place]]
        met = links > 0
        return pa.table({"node": node[met], "n": links[met], "low": node[root[met]]})
    return run


def linked_embeddings(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine reaches
    the threshold. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without a label, link with nothing. Repeated rows link
    with each other. Vectors of different lengths never link. A vec_id names one
    vector. Components keep their type if it is float and are taken as doubles
    otherwise. Other columns are not read.
    """
    kind = vectors.schema["label"].dataType.simpleString()
    element = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    plain = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    usable = (F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    rows = staged(plain.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    able = rows.filter("usable").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast(element)))
    classes = staged(able.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")), "vector-classes")
    per_label = classes.groupBy("label", F.size("embedding").alias("width")).agg(F.ceil(F.count("*") / tile).alias("tiles"))
    dealt = classes.withColumn("width", F.size("embedding")).join(per_label, ["label", "width"]) \
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))) \
        .withColumn("label", F.struct("label", "width"))
    packed = dealt.select("label", "tile", "tiles", "node", "size", "embedding").groupBy("label", "tile").applyInArrow(
        _pack, f"label struct<label:{kind},width:int>, tile long, tiles long, nodes binary, sizes binary, vectors binary")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = staged(packed, "vector-tiles").withColumn("other", other).withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other"))
    met = staged(pairs.groupBy("label", "x", "y").applyInArrow(_compare(threshold, "<f4" if element == "float" else "<f8"), "node long, n long, low long"), "vector-links")
    counted = met.groupBy("node").agg(F.sum("n").alias("n"))
    components = connected_components(met.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    named = classes.join(counted, "node", "left").join(components, "node", "left").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    found = able.select("vec_id", "label", "embedding").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark, folder: str) -> DataFrame:
    """Contract query: all embeddings, cosine of at least 0.93 within a label."""
    return linked_embeddings(spark.read.parquet(f"{folder}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.low AS component_id, e.vec_id = c.low AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
