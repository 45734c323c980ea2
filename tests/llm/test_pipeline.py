"""The pipeline's stages on a small table, and the registered queries against their SQL."""

import os
import random

import pytest

import corpus_pipeline
from paystrata.llm import queries
from tests.compare import difference, reference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tables(spark, documents, folder):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    docs = [(i, prose(rng.randint(12, 300)), rng.choice("ab")) for i in range(60)]
    docs += [(100 + i, docs[i][1], "c") for i in range(5)] + [(200, "too short", "a"), (201, None, None), (202, "", "b"), (203, "again and " * 90, "a")]
    shared = prose(60)
    docs += [(300, prose(30) + "\n" + shared, "a"), (301, prose(40) + "\n" + shared, "b")]
    documents(docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, shared


def test_stages(spark, documents, tmp_path):
    docs, shared = tables(spark, documents, str(tmp_path))
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert [len(corpus_pipeline.STAGES), *(s.columns == seen[0].columns for s in seen[1:5])] == [5, True, True, True, True]
    ids = [{r["doc_id"] for r in s.collect()} for s in seen]
    assert ids[1] == ids[0] - {200, 201, 202, 203}
    assert ids[2] == ids[1] - {100, 101, 102, 103, 104}
    texts = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert ids[3] == ids[2] and shared in texts[300] and shared not in texts[301]
    assert ids[4] <= ids[3] and ids[5] == ids[4]
    pieces = seen[5].collect()
    assert sum(r["doc_tokens"] for r in pieces if r["start"] == 0) == sum(r["length"] for r in pieces)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole.collect()) == key(pieces)


def test_empty_table_and_nulls(spark, documents, tmp_path):
    tables(spark, documents, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    none = docs.filter("doc_id < 0")
    nulls = spark.createDataFrame([(None,) * 5, (1, "ten words are in this text here to be kept", None, None, None)] * 2, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
        assert stage(spark, nulls, str(tmp_path)).collect() is not None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert difference(spark, reference(FOLDER), queries.queries()[name], queries.oracle_sql()[name], FOLDER) is None


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("number", [0, 1, 2, 3])
def test_stages_with_clashing_columns(spark, documents, tmp_path, number):
    tables(spark, documents, str(tmp_path))
    names = ["__key", "group", "component_id", "text_key", "start", "words", "size", "copies", "__nth", "first", "rows", "score"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    more = docs.selectExpr("*", *[f"{i} AS `{n}_`" if n.startswith("__") else f"{i} AS `{n}`" for i, n in enumerate(names)])
    _, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, more, str(tmp_path))
    assert got.columns == more.columns
    plain = lambda rows: sorted((r["doc_id"], r["text"] or "") for r in rows.collect())
    assert plain(got) == plain(stage(spark, docs, str(tmp_path)))


def test_different_texts_of_one_doc_id(spark, documents):
    rng = random.Random(3)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefghi", k=6)) for _ in range(80)) for _ in range(4))
    kept = lambda rows: sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect())
    assert kept([(5, a), (5, b), (3, b)]) == sorted([(5, a), (3, b)])
    assert kept([(5, a), (5, b), (5, b), (7, b)]) == sorted([(5, a), (5, b)])
    one = kept([(5, c), (5, c.upper()), (8, d)])
    assert one[1:] == [(8, d)] and one[0] in [(5, c), (5, c.upper())]
