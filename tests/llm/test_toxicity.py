"""Toxicity: segments against all intervals, held-out accuracy, and what decides a score."""

import os
import random
import zlib
import zlib

import pytest

from paystrata.llm.toxicity import op1_toxicity, ToxicModel, _Scores, fit, maximal_segments, toxic_passages

FOLDER = "/root/testdata/sf0.1"


def plain_segments(values):
    """Maximal scoring segments by definition: the best interval, then the best on either side of it."""
    def inside(a, b):
        best = max(((round(sum(values[i:j]), 9), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return inside(a, i) + [(i, j - 1, best[0])] + inside(j, b)
    return inside(0, len(values))


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    rng = random.Random(seed)
    values = [rng.choice([-0.25, -0.25, -0.25, 0.37, 1.13]) for _ in range(30)]
    marked = [i for i, v in enumerate(values) if v > 0]
    got = maximal_segments(marked, [values[i] for i in marked], -0.25)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(values)]
    assert [round(s, 6) for *_, s in got] == [round(s, 6) for *_, s in plain_segments(values)]


def corpus(spark, documents, n=600):
    rng = random.Random(3)
    plain = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    bad = ["vile", "nasty", "grimword", "grimness", "grimful"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 200))
        toxic = int(rng.random() < 0.2)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [w for _ in range(rng.randint(2, 6)) for w in (rng.choice(bad), rng.choice(plain))]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return documents(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(docs)


def test_held_out_and_passages(spark, documents):
    docs, labels, texts = corpus(spark, documents)
    model = fit(docs, labels)
    assert {"vile", "nasty"} <= model.lexicon.keys() and model.neutral < 0
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxic_passages(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum((r["score"] >= 0.7) == toxic[r["doc_id"]] for r in held) / len(held) > 0.95
    for r in rows:
        assert 0 <= r["score"] <= 1
        for p in r["passages"]:
            assert any(w in texts[r["doc_id"]][p["start"]:p["end"]] for w in ("vile", "nasty", "grim"))
    # Labels of held-out documents decide nothing.
    other = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert fit(docs, other) == model


def test_nulls_empty_long_and_clashing(spark, documents):
    model = ToxicModel({"vile": (9.0, 4.0)}, -0.1, 1.0, 0.01, (-2.0, 1.0, 1.0, 0.1, 0.1))
    docs = documents([(1, None), (2, ""), (3, "1 2 3 ..."), (4, "İ vile " * 3), (None, "vile " * 100_000)])
    rows = {r["doc_id"]: r for r in toxic_passages(docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "kind"), model).collect()}
    assert rows[1]["score"] == rows[2]["score"] == rows[3]["score"] < rows[4]["score"] <= rows[None]["score"]
    assert rows[4]["passages"][0]["start"] == 2 and rows[None]["passages"][0]["end"] == 499_999
    assert toxic_passages(docs.filter("doc_id > 9"), model).collect() == []


def test_without_labels(spark, documents):
    docs = documents([(1, "some text"), (2, None)])
    model = fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model.lexicon == {} and all(r["score"] < 0.7 for r in toxic_passages(docs, model).collect())


def test_scores_are_bounded_in_memory(monkeypatch):
    monkeypatch.setattr("paystrata.llm.toxicity._MEMO", 4)
    scores = _Scores({"bad": (5.0, 2.0), "grim-": (6.0, 3.0)})
    assert [scores[w] for w in ("bad", "good", "grimly", "grim", "x", "y", "bad")] == [2.0, 0.0, 3.0, 0.0, 0.0, 0.0, 2.0]
    assert len(scores) <= 4


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample data")
def test_held_out_accuracy_on_the_sample(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxic_passages(docs, fit(docs, labels)).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 3 = 1").collect()
    found = [r["score"] >= 0.7 for r in rows]
    caught = sum(f for f, r in zip(found, rows) if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(f for f, r in zip(found, rows) if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert caught > 0.8 and wrong < 0.01


def test_rows_without_a_number_and_repeated_rows(spark, documents, tmp_path):
    documents([(1, "vile words"), (1, "vile words"), (None, "no number"), (5, "clean words"), (0, "other words")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = op1_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 1}) == 1
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (0, 1, 5)} | {None: False}
    assert all(r.held_out == out[r.doc_id] for r in rows)
