"""The divergence audit against whole-table arithmetic, and its tree against dense matrices."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paystrata.llm import divergence as audit
from tests.compare import difference, reference

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, ranks=200):
    """All result rows, by Python integers."""
    words = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(
        "[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source, *_ in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in words:
        seen[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {key[0] for key in counts}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        groups = {s: {t: c[t] for t in kept} for (l, s), c in counts.items() if l == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            away = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(away))]
            used = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(used[:ranks])]
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in audit.divergence(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def documents(seed=0, n=400, sources=23, vocabulary=90):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{'abcdefghij'[k % 10] * (1 + k // 10)}" for k in rng.zipf(1.4, 20) % vocabulary]
        lang = ["en", "en", "de", None][rng.integers(4)]
        rows.append((i, " ".join(words), lang, f"s{rng.integers(sources)}"))
    return rows + [
        (None, None, None, None), (None, "", "", "s1"), (1, "Ab-AB é É straße 12 a1b", "en", ""), (1, "Ab-AB é É straße 12 a1b", "en", ""),
        (2, "ab É ß_\x00\x7f日本", "en", None), (3, "einzig", "eo", "a"), (4, None, "eo", "b"), (5, "long word " * 100_000, "en", "s2"),
        (6, "same same same", "io", "x"), (7, "same", "io", "y"), (8, "same", "io", "z")]


@pytest.mark.parametrize("options", [{}, {"side": 8, "leaf": 2}, {"side": 9, "leaf": 1, "k": 3, "least": 1, "ranks": 4}])
def test_against_plain_integers(spark, options):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    own = {k: v for k, v in options.items() if k in ("least", "ranks")}
    assert found(docs, **options) == plain(rows, **own)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = documents(1, 60, 4)
    names = ["term", "n", "docs", "column", "row", "high", "p", "q", "rank", "value", "item", "part", "kept", "slot", "seq"]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    assert found(docs) == plain(rows)


def test_hot_group_and_small_memory(spark, monkeypatch):
    rows = [(i, f"common word {'abc'[i % 3]} only{'xyz'[i % 3]}", "en", "hot" if i % 10 else f"s{'abc'[i % 3]}") for i in range(2000)]
    monkeypatch.setattr(audit, "_VOCABULARY", 2)
    counts = audit._Counts()
    counts.add([("en", "hot")] * 5, [b"A b a", b"a", b"", b"b", b"c a"])
    assert counts.full()
    rows_of = [b.to_pylist() for b in counts.batches()]
    assert sorted((r["term"], r["n"], r["docs"]) for r in rows_of[1]) == [("a", 4, 3), ("b", 2, 2), ("c", 1, 1)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(8)) == plain(rows)


def test_tree_against_dense_matrices():
    rng = np.random.default_rng(2)
    for side, k, leaf, rows_a, rows_b, density in [(16, 2, 2, 16, 5, 0.05), (27, 3, 1, 20, 27, 0.3), (8, 2, 8, 3, 8, 0.5), (16, 4, 4, 7, 9, 0.0)]:
        trees, dense, zeros = [], [], []
        for rows in (rows_a, rows_b):
            zero = rng.integers(1, 1000, rows)
            matrix = np.repeat(zero[:, None], side, axis=1)
            r, c = np.nonzero(rng.random((rows, side)) < density)
            matrix[r, c] = rng.integers(1, 10**9, len(r))
            trees.append(audit.Quadtree(r, c, matrix[r, c], zero, side, k, leaf))
            dense.append(matrix)
            zeros.append(zero)
        f = lambda p, q: (p - q) ** 2 // q
        want = f(dense[0][:, None, :], dense[1][None, :, :]).sum(axis=2) - side * f(zeros[0][:, None], zeros[1][None, :])
        assert (audit.beyond_zero(*trees, rows_a, rows_b) == want).all()
        held = [{(i // leaf, j // leaf) for i, j in zip(*np.nonzero(d != z[:, None]))} for d, z in zip(dense, zeros)]
        met = set(zip(*(x.tolist() for x in audit.joint_blocks(*trees, -(-rows_a // leaf), -(-rows_b // leaf)))))
        assert met >= {(i, j, c) for i in range(-(-rows_a // leaf)) for j in range(-(-rows_b // leaf)) for c in range(side // leaf)
                       if (i, c) in held[0] or (j, c) in held[1]}
        assert density or not met


def test_shares_of_huge_counts_are_exact(spark):
    row = spark.sql("SELECT 700000000000000000L AS n, 1000000000000000000L AS total, 12345L AS kept")
    want = 1 + 10**9 * (7 * 10**17 + 1) // (10**18 + 12345)
    assert row.select(audit.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == want


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(spark, reference(folder), audit.op12_source_divergence, audit.OP12_SQL, folder) is None
