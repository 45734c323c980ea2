"""SimHash near-dedup against all pairs, and the covering property of the Golay keys."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paystrata.llm import simhash
from paystrata.llm.components import block_components
from paystrata.llm.simhash import _ENTRY, bucket_keys, bucket_tiles, fingerprint, print_links, segment_keys, simhash_groups
from paystrata.operators.components import connected_components


def plain_fingerprint(text, k=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, most=4):
    low = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= most and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_golay_keys_cover_two_errors():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 400)
    keys = segment_keys(words)
    assert set((keys >= 0).sum(axis=1)) <= {1, 6}
    for bits in range(3):
        other = words.copy()
        for _ in range(bits):
            other ^= 1 << rng.integers(0, 23, len(words))
        shared = [set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, segment_keys(other))]
        assert all(shared)


def test_any_four_differing_bits_share_a_bucket():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    other = prints.copy()
    for i in range(len(other)):
        for bit in rng.choice(64, 4, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    found = [dict() for _ in prints]
    for side in (prints, other):
        owner, key = bucket_keys(side)
        for o, k in zip(owner.tolist(), key.tolist()):
            found[o].setdefault(k, set()).add(id(side))
    assert all(any(len(s) == 2 for s in f.values()) for f in found)


@pytest.mark.parametrize("text", ["", "one", "Two Words", "a b c d", "A\tb\nc\x0bd\x0ce\rf", "é É ß " * 9, "x" * 5000, "nbsp joined words here now"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_a_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(90_000))
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_links_connect_exactly_what_is_near(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for seed in list(prints)[:10]:
        at = seed
        for _ in range(12):  # chains of near fingerprints, and dense clusters
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
            prints.add(at)
    prints = sorted(prints, key=lambda p: p - (p >> 63 << 64))
    signed = [p - (p >> 63 << 64) for p in prints]
    links = print_links(spark.createDataFrame([(p,) for p in signed], "print long"), entries_per_task=500)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = components(prints)
    assert [got.get(p, p) for p in signed] == [signed[i] for i in want]


def test_a_bucket_of_most_fingerprints_is_cut_into_bounded_tasks(spark):
    rng = np.random.default_rng(11)
    hot = np.uint64(0x2A5A5A5A5A5A) | rng.choice(1 << 18, 1800, replace=False).astype(np.uint64) << np.uint64(46)
    prints = np.unique(np.r_[hot, rng.integers(0, 1 << 64, 200, dtype=np.uint64)])
    table = spark.createDataFrame([(p,) for p in prints.view(np.int64).tolist()], "print long")
    sizes = {(r["part"], r["first"], r["second"]): r["n"] for r in bucket_tiles(table, 400).groupBy("part", "first", "second").agg(
        (F.sum(F.length("entries")) / _ENTRY.itemsize).alias("n")).collect()}
    owner, key = bucket_keys(prints)
    assert np.unique(key, return_counts=True)[1].max() >= 1800 and max(sizes.values()) <= 800
    left, right = np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 4)
    want = block_components(len(prints), left, right)
    got = {r["node"]: r["component"] for r in connected_components(print_links(table, entries_per_task=400)).collect()}
    signed = prints.view(np.int64)
    low = np.full(len(prints), np.iinfo(np.int64).max)
    np.minimum.at(low, want, signed)
    assert [got.get(p, p) for p in signed.tolist()] == low[want].tolist()


def test_a_task_reduces_the_links_it_holds(spark, monkeypatch):
    prints = np.array([0, 1, 3, 7, 15, 31, 63, 63 << 40, 63 << 40 | 1], np.uint64)
    entries = np.zeros(len(prints), _ENTRY)
    entries["print"] = prints
    one = np.zeros(1, np.int64)
    table = pa.table({"part": one, "first": one, "second": one, "slice": one, "entries": pa.array([entries.tobytes()], pa.binary())})
    whole = simhash._linked(4)(table)
    monkeypatch.setattr(simhash, "_HELD", 1)
    assert simhash._linked(4)(table).equals(whole)
    assert sorted(whole.column("b").to_pylist()) == [0] * 6 + [63 << 40]


def test_groups(spark, documents):
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(7, base), (3, base.upper().replace("WORD", "Word")), (9, base.replace("word60", "other")), (1, None), (2, ""), (4, " \n"),
            (5, "unrelated words of another text"), (5, "unrelated words of another text"), (None, "without an id")]
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash_groups(documents(rows)).collect())
    assert [g[1] for g in got] == [f"{plain_fingerprint(t):016x}" for _, t in sorted(rows, key=lambda r: r[0] or 0)]
    by_id = {d: c for d, _, c in got}
    near = (plain_fingerprint(base) ^ plain_fingerprint(rows[2][1])).bit_count() <= 4
    assert by_id == {0: None, 1: 1, 2: 1, 4: 1, 3: 3, 7: 3, 9: 3 if near else 9, 5: 5}


def test_empty_table_and_clashing_columns(spark, documents):
    docs = documents([(1, "a b"), (2, "a b")]).withColumnRenamed("source", "component_id").withColumnRenamed("lang", "print")
    assert simhash_groups(docs.filter("doc_id > 9")).collect() == []
    assert {r["component_id"] for r in simhash_groups(docs).collect()} == {1}


def test_block_components_of_a_chain():
    n = 1000
    order = np.random.default_rng(1).permutation(n)
    assert (block_components(n, order[1:], order[:-1]) == 0).all()
    assert (block_components(3, np.zeros(0, int), np.zeros(0, int)) == np.arange(3)).all()


def test_connected_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(500, i) for i in range(501, 560)] + [(-5, 9), (9, 9)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{c: 100 for c in chain}, **{i: 500 for i in range(500, 560)}, -5: -5, 9: -5}
