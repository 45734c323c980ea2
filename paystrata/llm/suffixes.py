"""Exact substring dedup by longest-previous-factor arrays.

A byte goes if a string of ``least`` bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start). In terms of the
longest-previous-factor array, the strings to look at start where LPF reaches
``least``, and LPF follows from suffix order: the longest earlier match of a
suffix is with its previous or next smaller position in that order.

A suffix array over everything cannot be sorted in one place, so suffixes are
cut to ``least`` bytes and split into buckets that hold all equal ones:

1. Every window of ``least`` bytes has one anchor, the least hash of its
   ``seed``-byte strings (leftmost on ties). Equal windows have equal anchors at
   equal places. The windows of one anchor are one segment of text.
2. Blocks of documents send (anchor hash, segment hash, place of the first) of
   their distinct segments to the bucket of the anchor. The bucket tells which
   segments are unique, which occur earlier as a whole, and which share their
   anchor with different text.
3. Only segments of the last kind are sent as text. In a bucket their suffixes
   are put in order, and previous and next smaller positions among those with a
   common prefix of ``least`` bytes mark the windows to remove. Where an anchor
   has very many different segments, each window goes to the bucket of its own
   bytes instead, so that no anchor's text meets in one task.
4. Each block merges its windows into spans and cuts them out.

Whatever a block sends is distinct within the block, so a frequent string
arrives at most once per block. Where that is still too much for one task (a
string in every document), the anchor is hot: its segments are not asked about
in step 2; all its windows go to the buckets of their own bytes, first in parts
by block, and what no part finds earlier goes on to the whole bucket. Which
anchors are hot is estimated from one block in ``SAMPLED``; it changes the way a
window takes, never whether it goes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paystrata.llm.words import by_group, mixed

LEAST, SEED = 100, 40
BLOCK_BYTES = 1 << 20
CROWDED = 1000  # different segments of one anchor from which their windows are spread; a route, with equal results
HOT = 1_000_000  # entries of one anchor that a task takes; from 10 TB on, one for each 10 MB of text
SAMPLED = 16  # one block in so many is counted for that
_PARTS = 1024
_ENTRY = np.dtype([("anchor", "<u8"), ("segment", "<u8"), ("doc", "<i8"), ("start", "<u4")])
_HEAD = np.dtype([("doc", "<i8"), ("start", "<u4"), ("length", "<u4"), ("block", "<i8")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
_BASE = 0x5851F42D4C957F2D
_UNIQUE, _EARLIER, _MIXED, _CROWD, _HOT = range(5)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64, and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return (np.cumprod(np.r_[one, np.full(size, _BASE, np.uint64)]), np.cumprod(np.r_[one, np.full(size, inverse, np.uint64)]))


def _eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    x = text.astype(np.uint64)
    for shift in (1, 2, 4):
        x[:-shift] |= x[shift:] << np.uint64(8 * shift)
    return x


class Segments:
    """The anchors of a block's windows and the segments of text around them.

    ``first`` and ``last`` are the first and last window of a segment,
    ``anchor`` and ``digest`` the hashes of its anchor and of its whole text.
    """

    def __init__(self, text: np.ndarray, lengths: np.ndarray, least: int, seed: int):
        self.text, self.least = text, least
        ends = np.cumsum(lengths)
        n = len(text)
        width = least - seed + 1
        windows = lengths - least + 1
        fits = windows > 0
        self.first = self.last = np.zeros(0, np.int64)
        self.anchor = self.digest = np.zeros(0, np.uint64)
        if not fits.any():
            return
        begins = (ends - lengths)[fits]
        windows = windows[fits]
        at = np.arange(windows.sum()) + np.repeat(begins - np.r_[0, np.cumsum(windows)[:-1]], windows)
        eight = mixed(_eight(text))
        hashes = eight.copy()
        for offset in [*range(8, seed - 8, 8), seed - 8]:
            hashes[:-offset] = hashes[:-offset] * np.uint64(_BASE) + eight[offset:]
        hashes = mixed(hashes)
        # Leftmost least hash of `width` neighbours: minima from both ends of blocks of that width.
        padded = np.full(-(-n // width) * width + width, ~np.uint64(0))
        padded[:n] = hashes & ~np.uint64(127) | (np.arange(n) % width).astype(np.uint64)
        rows = padded.reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        left, right = after[at], before[at + width - 1]
        here = left >> np.uint64(7) <= right >> np.uint64(7)
        place = (np.where(here, left, right) & np.uint64(127)).astype(np.int64)
        anchors = np.where(here, at, at + width - 1) // width * width + place
        starts = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)])
        self.first, self.last = at[starts], at[np.r_[starts[1:], len(at)] - 1]
        where = anchors[starts]
        self.anchor = hashes[where]
        up, down = _powers(1 << int(n).bit_length())
        total = np.r_[np.uint64(0), np.cumsum(eight * up[:n])]
        self.digest = mixed((total[self.last + least - 7] - total[self.first]) * down[self.first]
                            + (self.last - self.first).astype(np.uint64)) ^ mixed((where - self.first).astype(np.uint64))


class Block:
    """Documents of a block in order of doc_id, their segments, and the distinct ones among them."""

    def __init__(self, docs: pa.Table, least: int, seed: int):
        rows = sorted(zip(docs.column("doc").to_pylist(), docs.column("bytes").to_pylist()))
        self.ids = np.array([doc for doc, _ in rows], np.int64)
        texts = [text for _, text in rows]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.least = least
        self.segments = s = Segments(self.text, self.lengths, least, seed)
        self.doc = np.searchsorted(self.begins + self.lengths, s.first, side="right")
        self.start = s.first - self.begins[self.doc] if len(s.first) else s.first
        # Distinct segments: the earliest of each, and for every segment which one that is.
        order = np.lexsort((self.start, self.ids[self.doc], s.digest, s.anchor))
        a, d = s.anchor[order], s.digest[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])][:len(a)]
        self.kinds = order[new]
        self.kind_of = np.empty(len(order), np.int64)
        self.kind_of[order] = np.cumsum(new) - 1

    def entries(self) -> np.ndarray:
        found = np.empty(len(self.kinds), _ENTRY)
        found["anchor"], found["segment"] = self.segments.anchor[self.kinds], self.segments.digest[self.kinds]
        found["doc"], found["start"] = self.ids[self.doc[self.kinds]], self.start[self.kinds]
        return found

    def is_hot(self, hot: np.ndarray) -> np.ndarray:
        """Whether the anchors of the distinct segments are among the hot ones."""
        return np.isin(self.segments.anchor[self.kinds], hot)

    def later(self, items: np.ndarray, firsts: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether items start later than the first of their kind (repeated rows of one doc_id do not)."""
        return (self.ids[doc[items]] != self.ids[doc[firsts]]) | (start[items] != start[firsts])


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(buckets)).astype(np.int64)


def _census(least: int, seed: int):
    def run(docs: pa.Table) -> pa.Table:
        anchors, n = np.unique(Block(docs, least, seed).entries()["anchor"], return_counts=True)
        return pa.table({"anchor": pa.array(anchors.view(np.int64)), "n": pa.array(n.astype(np.int64))})
    return run


def hot_anchors(dealt: DataFrame, least: int, seed: int, limit: int) -> np.ndarray:
    """Anchors with more than about ``limit`` entries, in order.

    ``limit`` grows with the text, so there are at most some 300,000 of them
    (2.4 MB), whatever the corpus.
    """
    counted = dealt.filter(F.col("block") % SAMPLED == 0).groupBy("block").applyInArrow(_census(least, seed), "anchor long, n long")
    found = counted.groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") * SAMPLED > limit)
    return np.array(sorted(r["anchor"] for r in found.select("anchor").collect()), np.int64).view(np.uint64)


def _send(least: int, seed: int, buckets: int, hot: np.ndarray):
    def run(docs: pa.Table) -> pa.Table:
        distinct = Block(docs, least, seed)
        entries = distinct.entries()[~distinct.is_hot(hot)]
        order, starts, groups = by_group(_bucket_of(entries["anchor"], buckets))
        pieces = np.split(entries[order], starts[1:]) if len(starts) else []
        block = docs.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(groups, pa.int64()), "block": pa.array([block] * len(pieces), pa.int64()),
                         "data": pa.array([p.tobytes() for p in pieces], pa.binary())})
    return run


def _answer(crowded: int):
    """For the segments a bucket got from every block: unique, earlier elsewhere, or in mixed company."""
    def run(table: pa.Table) -> pa.Table:
        data = table.column("data").to_pylist()
        entries = np.frombuffer(b"".join(data), _ENTRY)
        order = np.lexsort((entries["start"], entries["doc"], entries["segment"], entries["anchor"]))
        e = entries[order]
        new_anchor = np.r_[True, e["anchor"][1:] != e["anchor"][:-1]]
        new_segment = new_anchor | np.r_[True, e["segment"][1:] != e["segment"][:-1]]
        first = np.flatnonzero(new_segment)[np.cumsum(new_segment) - 1]
        anchor = np.cumsum(new_anchor) - 1
        variety = np.bincount(anchor[new_segment])[anchor]
        state = np.where(variety == 1, _UNIQUE, np.where(variety <= crowded, _MIXED, _CROWD))
        state[(e["doc"] != e["doc"][first]) | (e["start"] != e["start"][first])] = _EARLIER
        back = np.empty(len(e), np.uint8)
        back[order] = state
        cuts = np.cumsum([len(d) // _ENTRY.itemsize for d in data])[:-1]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "data": pa.array([p.tobytes() for p in np.split(back, cuts)], pa.binary())})
    return run


def _sort_out(least: int, seed: int, buckets: int, text_buckets: int, hot: np.ndarray):
    """Spans of what is settled, and the text of what is not, by bucket."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([])
        block = Block(docs, least, seed)
        s = block.segments
        number = docs.column("block")[0].as_py()
        asked = np.flatnonzero(~block.is_hot(hot))
        order, _, _ = by_group(_bucket_of(s.anchor[block.kinds[asked]], buckets))
        parts = [answers.column("data")[i].as_py() for i in np.argsort(answers.column("bucket").to_numpy(), kind="stable").tolist()]
        state = np.full(len(block.kinds), _HOT, np.uint8)
        state[asked[order]] = np.frombuffer(b"".join(parts), np.uint8)
        every = np.arange(len(s.first))
        gone = (state[block.kind_of] == _EARLIER) | block.later(every, block.kinds[block.kind_of], block.doc, block.start)
        mine = block.kinds[state == _MIXED]
        spread = (state == _CROWD) | (state == _HOT)
        crowd = block.kinds[spread]
        first, last, doc = s.first[mine], s.last[mine], block.doc[mine]
        key = s.anchor[mine]
        warm = np.zeros(len(mine), bool)
        spans = [_spans(block.ids[block.doc[gone]], block.start[gone], (block.start + s.last - s.first)[gone], least)]
        if len(crowd):
            size = s.last[crowd] - s.first[crowd] + 1
            at = np.repeat(s.first[crowd] - np.cumsum(size) + size, size) + np.arange(size.sum())
            home = np.repeat(block.doc[crowd], size)
            early = np.lexsort((at - block.begins[home], block.ids[home]))
            at, home, heat = at[early], home[early], np.repeat(state[spread] == _HOT, size)[early]
            inside = at - block.begins[home]
            windows = np.lib.stride_tricks.sliding_window_view(block.text, least)[at]
            value = np.ascontiguousarray(windows).view(f"S{least}").ravel()
            _, one, back = np.unique(value, return_index=True, return_inverse=True)
            again = (block.ids[home] != block.ids[home[one[back]]]) | (inside != inside[one[back]])
            spans.append(_spans(block.ids[home[again]], inside[again], inside[again], least))
            lone = np.sort(one)
            words = mixed(np.ascontiguousarray(windows[lone][:, :least // 8 * 8]).view("<u8"))
            hashes = np.zeros(len(lone), np.uint64)
            for column in words.T:
                hashes = mixed(hashes + column)
            first, last = np.r_[first, at[lone]], np.r_[last, at[lone]]
            doc, key = np.r_[doc, home[lone]], np.r_[key, hashes]
            warm = np.r_[warm, heat[lone]]
        rows = [(number % text_buckets, 0, number, np.concatenate(spans).tobytes(), None, None)]
        raw = block.text.data
        for part, chosen in ((0, np.flatnonzero(~warm)), (1 + number % _PARTS, np.flatnonzero(warm))):
            order, starts, groups = by_group(_bucket_of(key[chosen], text_buckets))
            for group, some in zip(groups.tolist(), np.split(chosen[order], starts[1:]) if len(starts) else []):
                heads = np.empty(len(some), _HEAD)
                heads["doc"], heads["start"] = block.ids[doc[some]], first[some] - block.begins[doc[some]]
                heads["length"], heads["block"] = last[some] - first[some] + least, number
                texts = b"".join(raw[a:b] for a, b in zip(first[some].tolist(), (last[some] + least).tolist()))
                rows.append((group, part, number, None, heads.tobytes(), texts))
        return _rows(rows)
    return run


_PIECES = "bucket long, part long, block long, spans binary, heads binary, texts binary"


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 6
    types = [pa.int64()] * 3 + [pa.binary()] * 3
    names = ["bucket", "part", "block", "spans", "heads", "texts"]
    return pa.table(dict(zip(names, (pa.array(c, t) for c, t in zip(columns, types)))))


def _spans(doc: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """The bytes of the windows first to last."""
    found = np.empty(len(doc), _SPAN)
    found["doc"], found["start"], found["end"] = doc, first, last + least
    return found


def previous_factor_reaches(text: np.ndarray, starts: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """Whether LPF is at least ``least`` at each start, with ``place`` as the order of positions.

    Suffixes are sorted by their first ``least`` bytes. Where neighbours share
    them all, LPF reaches ``least`` at a suffix that has a smaller position
    before or after it in the run, which running minima from both ends tell.
    """
    cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, least)[starts]).view(f"S{least}").ravel()
    order = np.argsort(cut, kind="stable")
    cut = cut[order]
    run = np.cumsum(np.r_[True, cut[1:] != cut[:-1]]) - 1
    _, rank = np.unique(place[order], return_inverse=True)
    rank = rank.astype(np.int64)
    step = len(rank) + 1
    down = rank + (run[-1] - run) * step
    up = (rank + run * step)[::-1]
    top = np.iinfo(np.int64).max
    previous = np.r_[top, np.minimum.accumulate(down)[:-1]] < down
    following = (np.r_[top, np.minimum.accumulate(up)[:-1]] < up)[::-1]
    reaches = np.zeros(len(order), bool)
    reaches[order] = previous | following
    return reaches


def _factor(least: int, buckets: int):
    """Spans of the windows that occur earlier, among the segments of a bucket or of a part of it.

    Of a part, the windows that do not occur earlier there are passed on to the bucket.
    """
    def run(table: pa.Table) -> pa.Table:
        settled = [(r["block"], r["spans"]) for r in table.select(["block", "spans"]).to_pylist() if r["spans"]]
        passed = []
        heads = np.frombuffer(b"".join(x for x in table.column("heads").to_pylist() if x), _HEAD)
        found = []
        if len(heads):
            text = np.frombuffer(b"".join(x for x in table.column("texts").to_pylist() if x), np.uint8)
            lengths = heads["length"].astype(np.int64)
            windows = lengths - least + 1
            owner = np.repeat(np.arange(len(heads)), windows)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = (np.cumsum(lengths) - lengths)[owner] + inside
            doc, at = heads["doc"][owner], heads["start"][owner].astype(np.int64) + inside
            order = np.lexsort((at, doc))
            new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])]
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new)
            reaches = previous_factor_reaches(text, starts, place, least)
            gone = np.flatnonzero(reaches)
            if table.column("part")[0].as_py():  # every piece of a part is one window
                passed = [(table.column("bucket")[0].as_py(), 0, None, None, heads[~reaches].tobytes(),
                           text.reshape(-1, least)[~reaches].tobytes())]
            if len(gone):  # neighbouring windows of one segment make one span
                new = np.r_[True, (owner[gone][1:] != owner[gone][:-1]) | (gone[1:] != gone[:-1] + 1)]
                a = gone[new]
                b = gone[np.r_[np.flatnonzero(new)[1:], len(gone)] - 1]
                spans = _spans(doc[a], at[a], at[b], least)
                order, begins, groups = by_group(heads["block"][owner[a]])
                found = [(g, p.tobytes()) for g, p in zip(groups.tolist(), np.split(spans[order], begins[1:]))]
        return _rows([(b % buckets, 0, b, spans, None, None) for b, spans in settled + found] + passed)
    return run


def _cut(with_text: bool):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        spans = np.frombuffer(b"".join(found.column("spans").to_pylist()), _SPAN)
        spans = spans[np.lexsort((spans["start"], spans["doc"]))]
        bounds = np.searchsorted(spans["doc"], docs.column("doc").to_numpy(), side="left"), \
            np.searchsorted(spans["doc"], docs.column("doc").to_numpy(), side="right")
        rows = []
        for doc_id, text, a, b in zip(docs.column("doc_id").to_pylist(), docs.column("bytes").to_pylist(), *map(np.ndarray.tolist, bounds)):
            merged: list[list[int]] = []
            for start, end in zip(spans["start"][a:b].tolist(), spans["end"][a:b].tolist()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            # A span of another row with this doc_id may reach past the text.
            merged = [[s, min(e, len(text))] for s, e in merged if s < len(text)]
            edges = [0, *(x for span in merged for x in span), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            rows.append((doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                         [{"start": s, "end": e} for s, e in merged], kept if with_text else None))
        columns = list(zip(*rows)) or [()] * 7
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.table(dict(zip(names, (pa.array(c, t) for c, t in zip(columns, types)))))
    return run


def repeated_substrings(docs: DataFrame, least: int = LEAST, seed: int = SEED, block_bytes: int = BLOCK_BYTES,
                        crowded: int = CROWDED, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of every document.

    ``spans`` are the maximal removed runs as byte offsets, ``kept`` the
    remaining bytes (null unless ``with_text``). Null texts are empty. A null
    doc_id comes before all others. Rows that repeat a doc_id are ordered by
    start alone, so equal ones lose nothing to each other. Other columns of
    ``docs`` are not read. ``crowded`` and ``hot`` choose routes, not results.
    """
    if seed < 16 or not 0 <= least - seed < 128:
        raise ValueError("anchors need 16 <= seed <= least < seed + 128")
    spark = docs.sparkSession
    low = -(1 << 63)
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(low)).alias("doc"),
                        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(1, -(-size // (16 * block_bytes)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (32 << 20)))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks))).repartition(parts, "block")
    often = hot_anchors(dealt, least, seed, max(hot, size // 10_000_000))
    sent = dealt.groupBy("block").applyInArrow(_send(least, seed, buckets, often), "bucket long, block long, data binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer(crowded), "block long, bucket long, data binary")
    pieces = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _sort_out(least, seed, buckets, buckets, often), _PIECES)
    if len(often):
        pieces = pieces.groupBy("bucket", "part").applyInArrow(_factor(least, buckets), _PIECES)
    found = pieces.groupBy("bucket").applyInArrow(_factor(least, buckets), _PIECES).select("block", "spans")
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _cut(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                         "spans array<struct<start:long,end:long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query: all documents, strings of 100 bytes."""
    return repeated_substrings(spark.read.parquet(f"{folder}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
