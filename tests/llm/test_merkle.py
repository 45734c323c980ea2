"""The Merkle manifest against a plain tree, for odd shapes, rows and run lengths."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from paystrata.llm import merkle
from paystrata.llm.merkle import FIELDS, OP13_SQL, fold, manifest, op13_merkle_manifest, proof_digest
from tests.compare import difference, reference


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, arity):
    """(root, siblings of each node level by level)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
    proofs = []
    for i in range(len(nodes)):
        proof = ""
        for level in levels[:-1]:
            start = i - i % arity
            proof += "".join(level[start:i] + level[i + 1:start + arity])
            i //= arity
        proofs.append(proof)
    return levels[-1][0], proofs


def plain(rows, arity):
    """Sorted (doc_id, leaf, lang, subroot, root, siblings in a row) of rows (doc_id, text, lang, source, n_chars)."""
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    leaf = lambda r: digest(framed(r[0]) + framed(r[3]) + framed(r[2]) + framed(r[4]) + framed(r[1]))
    found, roots = [], []
    for _, group in groupby(sorted(rows, key=key), key):
        group = sorted(group, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, proofs = tree([leaf(r) for r in group], arity)
        roots.append(root)
        found.append([(r[0], leaf(r), r[2], root, p) for r, p in zip(group, proofs)])
    if not rows:
        return []
    whole, above = tree(roots, arity)
    return sorted(((*r[:4], whole, r[4] + p) for group, p in zip(found, above) for r in group), key=repr)


def built(docs, arity=2, depth=2):
    rows = manifest(docs, FIELDS, "lang", "doc_id", arity=arity, depth=depth).proofs()
    assert rows.filter(fold(F.col("leaf"), F.col("siblings")) != F.col("root")).isEmpty()
    hex_row = F.array_join(F.transform("siblings", lambda s: F.concat(s["left"], s["right"])), "")
    kept = rows.select("doc_id", "leaf", "lang", "subroot", "root", hex_row.alias("proof"), proof_digest(F.col("siblings")).alias("d")).collect()
    assert all(r.d == digest(r.proof) for r in kept)
    return sorted((tuple(r)[:-1] for r in kept), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rows = [(i, f"text {i % 7} é\n", lang, None if i % 5 == 0 else "s", i) for lang, n in
            (("en", 37), ("de", 8), ("fr", 9), ("", 1), (None, 3), ("é", 2)) for i in range(n)]
    rows += [(None, None, "en", None, None), (None, "x", "en", None, None), (3, "text 3 é\n", "en", "s", 3), (4, "other", "en", "s", 4)]
    return rows + [(99, "long " * 200_000, "de", "s", 1_000_000), (-5, "", "de", "", -1)]


@pytest.mark.parametrize("arity, depth", [(2, 2), (3, 1), (5, 2), (2, 10)])
def test_against_a_plain_tree(spark, arity, depth):
    rows = documents()
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(5), arity, depth) == plain(rows, arity)


def test_empty_table_single_row_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert built(empty) == [] and manifest(empty, FIELDS, "lang", "doc_id").root().count() == 0
    one = [(1, "a", None, None, None)]
    assert built(spark.createDataFrame(one, SCHEMA)) == plain(one, 2)
    names = ["group", "place", "n", "digest", "carried", "root", "leaf", "siblings", "slot", "seq", "block", "key", "subroot"]
    docs = spark.createDataFrame(documents(), SCHEMA)
    assert built(docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])) == plain(documents(), 2)


def test_hot_group_over_many_slots(spark):
    rows = [(i, "t", "en" if i % 10 else "de", "s", 1) for i in range(3000)]
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(8), depth=4) == plain(rows, 2)


def test_subroots_and_root(spark):
    rows = documents()
    made = manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, "lang", "doc_id", depth=3)
    want = plain(rows, 2)
    assert {(r.lang, r.subroot) for r in made.subroots().collect()} == {(r[2], r[3]) for r in want}
    assert [r.root for r in made.root().collect()] == [want[0][4]]


def test_changed_rows_are_found(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    counts = {(r[0], framed(r[4])) for r in rows}
    for r in got:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and any(i == r.doc_id and n != "-" for i, n in counts)
        assert r.verified == (r.folded_root == r.root) == (not hit)
    assert len({r.verified for r in got}) == 2


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(spark, reference(folder), op13_merkle_manifest, OP13_SQL, folder) is None


def test_plan_is_native(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    plan = manifest(docs, FIELDS, "lang", "doc_id").proofs()._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert merkle.DEPTH == 10
