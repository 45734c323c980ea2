"""Mixing against its SQL, a plain water-filling, and the rows it returns."""

import random
from collections import Counter

import duckdb
import pytest

from paystrata.llm.mixing import OP2_SQL, mix, mixed_copies, op2_mix_sources, range_slots, source_targets


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["b", "B", "é", "zz", None, "hot", "hot", "hot", "tiny"])
        words = 3 if source == "tiny" else int(rng.paretovariate(1.1))
        rows.append((i, rng.choice([None, "", " \t"]) if rng.random() < 0.1 else " ".join(["w"] * words), source))
    return rows + [(1000 + i, "", "wordless") for i in range(3)]


def plain_targets(sizes):
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes))}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        weights = sum(weight[s] for s in sizes if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else rest * weight[s] / weights for s in sizes}
        over = {s for s in sizes if s not in capped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 1000, None: 5, "d": 0}, {"a": 7}, {"a": 0, "b": 0},
    {"a": 10, "b": 10, "c": 10, "d": 10, "e": 900},
])
def test_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_against_sql(spark, documents):
    rows = corpus()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
    want = con.execute(OP2_SQL).fetchall()
    copies = mixed_copies(documents(rows)).collect()
    got = [(r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["copies"], r["copies"] * r["size"]) for r in copies]
    assert sorted(got, key=str) == sorted(want, key=str)
    taken, largest, target = Counter(), Counter(), {}
    for _, source, size, _, goal, n, words in got:
        assert 0 <= n <= 3
        taken[source] += words
        largest[source] = max(largest[source], size)
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 1) for s in target)


def test_rows_of_the_mix(spark, documents):
    rows = corpus(4, 150)
    docs = documents(rows)
    copies = {r["doc_id"]: r["copies"] for r in mixed_copies(docs).collect()}
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    seen = Counter(r["doc_id"] for r in mixed.collect())
    assert seen == Counter({d: n for d, n in copies.items() if n})
    again = Counter(r["doc_id"] for r in mix(docs.repartition(5)).collect())
    assert seen == again


def test_no_python_in_the_plan(spark, tmp_path, documents):
    documents(corpus(2, 50)).write.parquet(str(tmp_path / "documents.parquet"))
    plan = op2_mix_sources(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_empty_repeated_and_clashing(spark, documents):
    docs = documents([(1, "a b c", "x"), (1, "a b c", "x"), (None, "d", None)])
    assert mixed_copies(docs.filter("doc_id > 9")).collect() == []
    assert mix(docs.filter("doc_id > 9")).collect() == []
    named = docs.withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "copies")
    assert sum(r["copies"] for r in mixed_copies(named).collect()) >= 1
    assert mix(named).columns == named.columns


def test_rows_that_share_id_source_and_size(spark, documents):
    rng = random.Random(7)
    rows = [(rng.choice([None, None, 1, 2]), " ".join(rng.choices("abc", k=rng.randint(1, 3))), rng.choice(["x", "y", "z", None])) for _ in range(300)]
    docs = documents(rows + [(i, "w " * 40, "x") for i in range(10, 30)])
    key = lambda r: (r["doc_id"], r["source"], len(r["text"].split()))
    decided = Counter()
    for r in mixed_copies(docs).collect():
        decided[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert Counter(map(key, mix(docs).collect())) == +decided


def test_one_size_without_ids_spreads_over_the_slots(spark, documents):
    rows = [(None, "a b", "hot")] * 1800 + [(i, "w " * (1 + i % 5), "x") for i in range(200)]
    docs = documents(rows)
    copies = mixed_copies(docs)
    got = [(r["doc_id"], r["source"], r["size"], r["copies"]) for r in copies.collect()]
    assert len(got) == 2000
    hot = [n for doc_id, source, _, n in got if source == "hot"]
    goal = next(r["target"] for r in copies.filter("source = 'hot'").select("target").limit(1).collect())
    assert abs(2 * sum(hot) - goal) <= 2 and max(hot) - min(hot) <= 1
    again = [(r["doc_id"], r["source"], r["size"], r["copies"]) for r in mixed_copies(docs.repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    largest = range_slots(docs, slots).groupBy("slot").count().agg({"count": "max"}).first()[0]
    assert largest < 2 * 2000 / slots
