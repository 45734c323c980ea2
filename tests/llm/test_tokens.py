"""Token files: exact round trip and agreement with the library. Packing: every id in one place, little padding."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paystrata.llm import packing, tokens
from paystrata.llm.packing import Plan, combinations_of, cut, nnls, pack, sequences
from paystrata.llm.tokenfile import decode_ranks, encode_ranks, read_token_files, write_token_files
from paystrata.llm.tokens import ChunkEncoder, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", None, "Plain words, and more words.", "it's we'll DON'T 'S x'd", "<|endoftext|> a<|startoftext|>b <|END|>", "tab\tnl\nvt\x0bff\x0ccr\r\x1c\x1d end",
         "nbsp here   wide　", "é e ́ İ ΣΣ σΣ. Σ", "日本語 テキスト 123 ½ ²", "emoji 👩‍👩‍👧 ‍ x", "a" * 3000, "J\u030c H\u0331, T\u0308. W\u030a! Y\u030aA; I\u0307 E\u0301.", "End. END., 'S 'S. X's. don't. 3.5, <|endoftext|>. <|ENDOFTEXT|>, ...a .a. a.b, ²., Ⅳ.", "\0 nul ﻿ bom", "word " * 5000]


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(vocabulary_path())
    return lambda text: found.encode(text or "", add_special_tokens=False).ids + [1]


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé,.", k=rng.randint(1, 9))) for _ in range(300)]
    docs = [(i * 7, " ".join(rng.choices(words, k=int(rng.paretovariate(0.5)) % 4000))) for i in range(n)]
    return docs + [(10_000 + i, t) for i, t in enumerate(TEXTS)]


def test_chunks_encode_as_whole_texts(library):
    encoder = ChunkEncoder(vocabulary_path())
    for text in TEXTS:
        assert np.frombuffer(encoder.encode([(text or "").encode()])[0], "<u4").tolist() == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(tokens.encoder(vocabulary_path()).encode([text.encode()])[0], "<u4").tolist() == library(text)


_PIECES = st.sampled_from(["J", "j", "H", "W", "Y", "T", "I", "\u030c", "\u0331", "\u030a", "\u0307", "\u0301", "a", "Z", "9", "²", "é", "É", ".", ",", "!", "'s", "'T", "<|", "|>",
                           "endoftext", "<|endoftext|>", " ", "\n", "\u00a0", "\x1c", "ß", "Σ", "ǅ", "Ⅳ", "-", ":"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_PIECES, max_size=14).map("".join))
def test_texts_of_awkward_pieces(library, text):
    assert np.frombuffer(tokens.encoder(vocabulary_path()).encode([text.encode()])[0], "<u4").tolist() == library(text)


def test_memo_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 12)
    encoder = ChunkEncoder(vocabulary_path())
    texts = ["one two three", "four five six one", "one two three four five six seven eight"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [library(t) for t in texts]
    assert len(encoder.memo) <= 6 + 8
    encoder.encode([b"nine ten eleven twelve thirteen fourteen"])
    assert len(encoder.memo) <= 12 and b"one" in encoder.memo


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_coding_round_trip(values):
    control, data = encode_ranks(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert decode_ranks(control, data, len(values)).tolist() == values


def test_files_round_trip(spark, documents, tmp_path, library):
    docs = corpus()
    write_token_files(documents(docs).repartition(5), str(tmp_path / "f"), vocabulary_path(), files=3)
    rows = sorted(read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(d for d, _ in docs)
    at = 0
    for r in rows:
        ids = np.array(library(dict(docs)[r["doc_id"]]), "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)


def test_files_of_nothing_and_of_repeated_rows(spark, documents, tmp_path):
    docs = documents([(3, "a b"), (3, "a b"), (None, "c")]).withColumnRenamed("source", "rank").withColumnRenamed("lang", "ids")
    write_token_files(docs, str(tmp_path / "two"), vocabulary_path())
    rows = sorted(read_token_files(spark, str(tmp_path / "two")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 3, 3] and [r["start"] for r in rows] == [0, rows[0]["n_tokens"], rows[0]["n_tokens"] + rows[1]["n_tokens"]]
    write_token_files(docs.filter("doc_id > 9"), str(tmp_path / "none"), vocabulary_path())
    assert read_token_files(spark, str(tmp_path / "none")).collect() == []


def test_null_ids_and_long_texts_spread_over_files(spark, documents, tmp_path, library):
    docs = [(None, f"w{i} x") for i in range(400)] + [(1, "a b"), (2, "long " * 70_000)]
    write_token_files(documents(docs).repartition(4), str(tmp_path / "f"), vocabulary_path(), files=6)
    held = spark.read.parquet(str(tmp_path / "f" / "blocks")).selectExpr("file_no", "size(doc_ids) AS n").groupBy("file_no").sum("n").collect()
    assert max(r[1] for r in held) < 200
    rows = sorted(read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 400 + [1, 2]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist() and rows[-1]["n_tokens"] > 1 << 16
    want = sorted(library(text) for _, text in docs)
    assert sorted(np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in rows) == want


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6) * 5 - 1
        x = nnls(a, b)
        y = np.zeros(9)
        for _ in range(20_000):
            y = np.maximum(0, y - 0.05 * a.T @ (a @ y - b))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-4


def test_combinations():
    found = combinations_of(6, 3, 5)
    assert sorted(found) == [(2, 2, 2), (3, 2, 1), (3, 3), (4, 1, 1), (4, 2), (5, 1)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from([2048, *range(64, 2048, 64), *range(1, 64)]), st.integers(0, 400), max_size=40))
def test_plan_places_every_piece_once(histogram):
    plan = Plan(histogram)
    length = np.repeat(np.array(list(histogram), np.int64), list(histogram.values()))
    number = np.concatenate([np.arange(n) for n in histogram.values()]) if histogram else np.zeros(0, np.int64)
    if not len(length):
        return
    sequence, offset = plan.place(length, number)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    first = np.r_[True, s[1:] != s[:-1]]
    assert (o[first] == 0).all() and (o[~first] == (o + n)[:-1][~first[1:]]).all()
    assert (o + n <= 2048).all() and sorted(set(s.tolist())) == list(range(s[-1] + 1))


def test_even_lengths_leave_little_padding():
    rng = np.random.default_rng(3)
    lengths = [n for t in rng.integers(1, 6000, 4000).tolist() for _, n in cut(t)]
    values, counts = np.unique(lengths, return_counts=True)
    plan = Plan(dict(zip(values.tolist(), counts.tolist())))
    number = np.concatenate([np.arange(c) for c in counts])
    sequence, _ = plan.place(np.repeat(values, counts), number)
    total = np.bincount(sequence, np.repeat(values, counts)).astype(int)
    padded = sum(0 if t & (t - 1) == 0 else 2048 - t for t in total.tolist())
    assert padded < 0.005 * total.sum()


@pytest.mark.parametrize("tokens_", [1, 63, 64, 65, 2047, 2048, 2049, 10_000])
def test_cut(tokens_):
    pieces = cut(tokens_)
    assert [s for s, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist() and sum(n for _, n in pieces) == tokens_
    assert all(0 < n <= 2048 for _, n in pieces)


def test_pack(spark, documents, library):
    docs = corpus(2) + [(5, "repeated row"), (5, "repeated row")]
    pieces = pack(documents(docs).repartition(4), vocabulary_path(), with_ids=True).cache()
    whole = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in sequences(pieces).collect()}
    seen = {}
    for r in pieces.collect():
        ids = whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        seen.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
    texts = dict(docs)
    assert seen.keys() == texts.keys()
    for doc_id, parts in seen.items():
        want = library(texts[doc_id])
        times = sum(d == doc_id for d, _ in docs)
        assert all(n == len(want) for _, _, n in parts)
        assert sorted((s, x) for s, x, _ in parts) == sorted((s, want[s:s + n]) for s, n in cut(len(want)) for _ in range(times))
    assert sum(len(x) for x in whole.values()) == sum(len(library(t)) for _, t in docs)
    assert max(map(len, whole.values())) <= packing.WINDOW
    pieces.unpersist()


def test_pack_of_nothing(spark, documents):
    docs = documents([(1, "x")]).withColumnRenamed("lang", "length").withColumnRenamed("source", "slot")
    assert pack(docs.filter("doc_id > 9"), vocabulary_path()).collect() == []
    assert len(pack(docs, vocabulary_path()).collect()) == 1


def test_pack_without_ids_and_very_long(spark, documents, library):
    docs = [(None, "no id"), (None, "no id"), (None, None), (4, "long " * 70_000)]
    rows = pack(documents(docs), vocabulary_path()).collect()
    assert sorted(r["length"] for r in rows if r["doc_id"] is None) == sorted(len(library(t)) for i, t in docs if i is None)
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == len(library(docs[-1][1])) > 1 << 16
