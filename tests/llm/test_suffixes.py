"""Exact substring dedup against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from paystrata.llm.suffixes import _ENTRY, _send, hot_anchors, repeated_substrings


def brute(docs, least):
    first = {}
    for doc_id, text in sorted(((d, (t or "").encode()) for d, t in docs), key=lambda x: x[0]):
        for i in range(len(text) - least + 1):
            key = text[i:i + least]
            first[key] = min(first.get(key, (doc_id, i)), (doc_id, i))
    rows = []
    for doc_id, text in docs:
        text = (text or "").encode()
        gone = [False] * len(text)
        for i in range(len(text) - least + 1):
            if first[text[i:i + least]] < (doc_id, i):
                gone[i:i + least] = [True] * least
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rows.append((doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows)


def corpus(seed, n, least):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    passages = [prose(rng.randint(least // 8, least)) for _ in range(4)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and docs:
            text = rng.choice(docs)[1]
        elif kind < 0.5 and docs:
            parts = (rng.choice(docs)[1] or "x").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif kind < 0.8:
            text = prose(rng.randint(0, 30)) + rng.choice(passages) + prose(rng.randint(0, 30))
        else:
            text = rng.choice(["", "it " * rng.randint(1, 90), "\0" * rng.randint(1, 250), None, prose(100)])
        docs.append((i * 3 - 20, text))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, crowded, hot", [(1, 1000, 10**6), (2, 2, 10**6), (3, 1, 10**6), (4, 1000, 0), (5, 2, 40)])
def test_against_all_strings(spark, documents, seed, crowded, hot):
    docs = corpus(seed, 80, 100)
    got = repeated_substrings(documents(docs), block_bytes=2000, crowded=crowded, hot=hot)
    rows = sorted(tuple(r)[:5] for r in got.collect())
    assert rows == brute(docs, 100)


def test_short_strings_and_many_blocks(spark, documents):
    docs = corpus(7, 60, 40)
    got = repeated_substrings(documents(docs), least=40, seed=16, block_bytes=500, crowded=3, with_text=True)
    rows = got.collect()
    assert sorted(tuple(r)[:5] for r in rows) == brute(docs, 40)
    texts = {d: (t or "").encode() for d, t in docs}
    for r in rows:
        text = texts[r["doc_id"]]
        kept = bytearray()
        at = 0
        for s in r["spans"]:
            kept += text[at:s["start"]]
            at = s["end"]
        assert bytes(r["kept"]) == bytes(kept + text[at:])


def test_empty_table_nulls_and_repeated_rows(spark, documents):
    assert repeated_substrings(documents([(1, "x")]).filter("doc_id > 5")).collect() == []
    text = "words of a text that is longer than a hundred bytes, so that it could be found again elsewhere in the corpus."
    got = repeated_substrings(documents([(None, text), (4, text), (4, text), (5, None), (6, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (4, len(text)), (4, len(text)), (5, 0), (6, 0)]
    got = repeated_substrings(documents([(4, text), (4, text)])).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_extra_columns_are_not_read(spark, documents):
    docs = documents([(1, "a" * 300, "s", 5, "x")], ", block long, bytes string")
    got = repeated_substrings(docs).collect()
    assert [tuple(r)[:4] for r in got] == [(1, 300, 299, 1)]


def test_one_anchor_in_most_documents(spark, documents):
    """Its entries stay out of the buckets of anchors, and the result is the same."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    common = "a string of more than forty bytes that nearly every document holds, at its own place"
    docs = [(i, " ".join([word() for _ in range(12)] + [common] * (i % 10 > 0) + [word() for _ in range(12)])) for i in range(300)]
    docs += [(1000 + i, docs[i * 7][1][20:]) for i in range(30)]
    size = sum(len(t) for _, t in docs)
    dealt = documents(docs).selectExpr("doc_id as doc", "cast(text as binary) as bytes", f"pmod(xxhash64(doc_id), {size // 600}) as block")
    often = hot_anchors(dealt, 100, 40, 100)
    assert 1 <= len(often) < 10
    left = dealt.groupBy("block").applyInArrow(_send(100, 40, 1, often), "bucket long, block long, data binary").collect()
    anchors = np.concatenate([np.frombuffer(r["data"], _ENTRY)["anchor"] for r in left])
    assert np.unique(anchors, return_counts=True)[1].max() <= 200 and not np.isin(anchors, often).any()
    got = repeated_substrings(documents(docs), block_bytes=600, hot=100)
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute(docs, 100)


def test_text_longer_than_a_block(spark, documents):
    rng = random.Random(12)
    long = "".join(rng.choices("abcd ", k=30_000))
    docs = [(1, long), (2, "x" + long[5000:15_000]), (3, long[::-1]), (4, "")]
    for hot in (10**6, 0):
        got = repeated_substrings(documents(docs), block_bytes=4000, hot=hot)
        assert sorted(tuple(r)[:5] for r in got.collect()) == brute(docs, 100)
