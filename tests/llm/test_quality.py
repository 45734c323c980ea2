"""Quality rules: counts against a plain version, the trees' constraints and held-out accuracy."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from paystrata.llm import quality
from paystrata.llm.quality import MONOTONIC, STATISTICS, counts_of, train

FOLDER = "/root/testdata/sf0.01"


def plain_counts(text):
    text = text or ""
    words = text.split() if text.isascii() and not set(text) & set("\x1c\x1d\x1e\x1f") else [
        w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts(seed=1, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abÉé#$", k=rng.randint(1, 4))) for _ in range(40)]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t\t", "\x0b"]) for _ in range(rng.randint(0, 80))) * rng.choice([1, 1, 1, 2, 3])
            for _ in range(n)] + ["", "\n\n", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a", "a a a a a", "\x1c \x85  "]


def test_counts():
    for text in texts():
        assert counts_of(text.encode())[0] == plain_counts(text), text


def test_base_rules(spark, documents):
    rows = list(enumerate(texts() + [None]))
    trees = train(np.zeros((0, len(STATISTICS))), np.zeros(0), np.zeros(len(STATISTICS)))
    got = quality.quality(documents(rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "kept"), trees).collect()
    for r in got:
        n, _, _, _, repeat = plain = plain_counts(dict(rows)[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == plain
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality(documents([(1, "x")]).filter("doc_id > 9"), trees).collect() == []


def test_trees_are_monotonic_where_asked():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7) ^ (rng.random(3000) < 0.1)).astype(float)
    signs = np.array([-1, 1, 0, 0])
    trees = train(x, y, signs)
    free = train(x, y, np.zeros(4, int))
    grid = np.linspace(0, 1, 60)
    for base in rng.random((60, 4)):
        for f, sign in ((0, -1), (1, 1)):
            rows = np.tile(base, (60, 1))
            rows[:, f] = grid
            assert (sign * np.diff(trees.raw(rows)) >= -1e-9).all()
    assert ((free.probability(x) > 0.5) == y).mean() > 0.85


def test_arrays_score_like_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((500, 3))
    trees = train(x, (x.sum(axis=1) > 1.5).astype(float), np.zeros(3, int), trees=10)

    def walk(row):
        total = trees.bias
        for node in trees.roots.tolist():
            while trees.low[node] != node:
                node = trees.high[node] if row[trees.feature[node]] > trees.cut[node] else trees.low[node]
            total += trees.value[node]
        return total
    assert np.allclose(trees.raw(x[:50]), [walk(r) for r in x[:50]])


def test_one_class_or_no_labels(spark, documents):
    docs = documents([(i, f"some words of text number {i} that is long enough to be judged") for i in range(5)])
    for labels in ([], [(1, 1, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = quality.quality(docs, quality.fit(docs, table)).collect()
        assert len(got) == 5 and len({r["score"] for r in got}) == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.quality(docs, trees).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in rows]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert all(MONOTONIC[name] == -1 for name in ("symbol_share", "dup_line_share", "repeat_share"))
