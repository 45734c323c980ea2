"""Embedding near-dedup against all pairs in double precision."""

import numpy as np

from paystrata.llm.embeddings import linked_embeddings, quantised, tile_links

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    usable = {}
    for vec_id, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[vec_id] = (label, np.array(v, np.float32).astype(float))
    low = {r[0]: r[0] for r in rows}
    links = {r[0]: set() for r in rows}
    for a, (la, va) in usable.items():
        for b, (lb, vb) in usable.items():
            if a != b and la == lb and len(va) == len(vb) and va @ vb / (np.linalg.norm(va) * np.linalg.norm(vb)) >= threshold:
                links[a].add(b)
    changed = True
    while changed:
        changed = False
        for a in links:
            for b in links[a]:
                if low[b] < low[a]:
                    low[a], changed = low[b], True
    return sorted((i, len(links[i]), low[i], low[i] == i) for i in low)


def corpus(seed, n=300, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=width) * rng.choice([0.02, 0.25, 0.4])
        rows.append((int(i * 5 % 1009), [float(x) for x in np.float32(v * rng.choice([1e-6, 1.0, 1e6]))], [None, 1, 2, 7][rng.integers(4)]))
    rows += [(5000 + i, rows[3][1], rows[3][2]) for i in range(40)]  # copies
    bad = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] * width, [None] + [1.0] * (width - 1), [1.0, 2.0]]
    return rows + [(6000 + i, v, 1) for i, v in enumerate(bad)] + [(6100, [1.0, 2.0], 1), (6101, [-0.0, 1.0], 2), (6102, [0.0, 1.0], 2)]


def test_against_all_pairs(spark):
    rows = corpus(1)
    for tile in (2048, 37):
        got = linked_embeddings(spark.createDataFrame(rows, SCHEMA), tile=tile)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_bounds_hold_and_spare_the_recomputing():
    rng = np.random.default_rng(2)
    for width in (3, 64, 1500):
        a = rng.normal(size=(200, width))
        b = np.r_[rng.normal(size=(150, width)), a[:50] + rng.normal(size=(50, width)) * 0.3]
        ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        qa, sa, na, ra = quantised(ua)
        qb, sb, _, rb = quantised(ub)
        product = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb
        assert (np.abs(ua @ ub.T - product) <= na[:, None] * rb + ra[:, None] * (1 + 1e-9)).all()
        i, j, tried = tile_links(a, b, 0.93, False)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(ua @ ub.T >= 0.93))))
        if width > 3:
            assert tried < 0.05 * 200 * 200


def test_empty_repeated_and_clashing(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [0.6, 0.8], None)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", node int, n_links string")
    assert linked_embeddings(df.filter("vec_id > 9")).collect() == []
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in linked_embeddings(df).collect())
    assert got == [(0, 0, None), (1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_double_components_are_not_rounded(spark):
    # cosine with (1, 0) just below and at 0.6; float32 cannot tell these apart
    below, at = [0.6 - 1e-12, (1 - (0.6 - 1e-12) ** 2) ** 0.5], [0.6 + 1e-12, (1 - (0.6 + 1e-12) ** 2) ** 0.5]
    rows = [(1, [1.0, 0.0], 1), (2, below, 1), (3, [1.0, 0.0], 2), (4, at, 2),
            (5, [1e300, 1e300], 3), (6, [1e-300, 1.1e-300], 3), (7, [1.0, -1.0], 3)]
    got = linked_embeddings(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), threshold=0.6)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [
        (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 0, 7)]
