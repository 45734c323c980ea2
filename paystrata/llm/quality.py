"""Quality rules: fixed rules, then gradient-boosted trees over document statistics.

The trees are trained on a bounded sample of labelled documents and flattened
into node arrays, so a batch of documents is scored by a few array lookups per
level. On chosen statistics the score is monotonic: more symbols, repeated
lines or repeated words never make a document look better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paystrata.llm.words import utf8
from paystrata.sources.staging import staged

SAMPLE = 20_000  # labelled rows, the bound of the fit
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
_SPACE, _DIGITS, _UPPER = b" \t\n\x0b\x0c\r", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
              "words_a_line", "upper_share", "digit_share", "mark_share")
#: Direction in which the score may move with a statistic: 1 up, -1 down, 0 either.
MONOTONIC = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}


def repeated_words(words: list[bytes], window: int = 5) -> tuple[int, int]:
    """Words inside ``window``-word windows that occur at least twice, and the number of distinct words.

    Windows are compared through exact ranks of one, two and four words.
    """
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    distinct = len(number)
    if len(words) <= window or distinct == len(words):
        return 0, distinct
    ranks, width = codes, 1
    while width < window:  # windows of `width` words become windows of `wider`, as two that overlap
        wider = min(2 * width, window)
        ahead = ranks[wider - width:]
        pairs = ranks[:len(ahead)] * (int(ranks.max()) + 1) + ahead
        values, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0, distinct
        width = wider
    marks = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(counts[ranks] > 1)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum()), distinct


def counts_of(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The counts of ``COUNTS`` and the values of ``STATISTICS`` for one text."""
    words = text.split()
    n = len(words)
    bare = text.translate(None, _SPACE)
    chars = len(bare.decode("utf-8", "replace"))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    less = lambda drop: len(bare) - len(bare.translate(None, drop))
    size, some, rows = max(chars, 1), max(n, 1), max(len(lines), 1)
    return (n, chars, symbols, dup, repeat), [
        np.log1p(n), chars / some, symbols / size, dup / rows, repeat / some, distinct / some,
        n / rows, less(_UPPER) / size, less(_DIGITS) / size, less(b".,;:!?'\"()-") / size]


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rules: fewer than ten words, or over a fifth of them in repeated windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


@dataclass
class Trees:
    """Flattened trees: node arrays, where a leaf points to itself, and each tree's root."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] > self.cut[node], self.high[node], self.low[node])
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def train(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15,
          bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for the logistic loss, on histograms of quantile bins.

    A split on a monotonic statistic must order its two values accordingly, and
    the middle of the two bounds all values below it on either side.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1) if n else np.zeros((0, width), int)
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots, score = [], np.full(n, bias)

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, floor: float, ceiling: float):
        best = None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(width):
            size = len(edges[f]) + 1
            if size < 2:
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            left = np.clip(-left_g / (left_h + ridge), floor, ceiling)
            right = np.clip(-right_g / (right_h + ridge), floor, ceiling)
            gain = -(left_g * left + (left_h + ridge) * left ** 2 / 2) - (right_g * right + (right_h + ridge) * right ** 2 / 2)
            fine = (left_h >= least) & (right_h >= least) & (signs[f] * (right - left) >= 0)
            gain = np.where(fine, gain, -np.inf)
            at = int(gain.argmax())
            if np.isfinite(gain[at]) and (best is None or gain[at] > best[0]):
                best = (gain[at], f, at, left[at], right[at])
        own = float(np.clip(-total_g / (total_h + ridge), floor, ceiling))
        return own, best if best and best[0] > -(total_g * own + (total_h + ridge) * own ** 2 / 2) + 1e-6 else None

    def grow(rows: np.ndarray, level: int, g, h, floor: float, ceiling: float) -> int:
        own, split = best_split(rows, g, h, floor, ceiling)
        if level == depth or split is None:
            score[rows] += rate * own
            return leaf(rate * own)
        _, f, at, left, right = split
        me = len(nodes)
        nodes.append([f, float(edges[f][at]), 0, 0, 0.0])
        middle = (left + right) / 2
        bounds = {1: ((floor, middle), (middle, ceiling)), -1: ((middle, ceiling), (floor, middle)), 0: ((floor, ceiling),) * 2}[int(signs[f])]
        goes = binned[rows, f] <= at
        nodes[me][2] = grow(rows[goes], level + 1, g, h, *bounds[0])
        nodes[me][3] = grow(rows[~goes], level + 1, g, h, *bounds[1])
        return me

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), 0, p - y, p * (1 - p), -np.inf, np.inf))
    if not nodes:
        roots.append(leaf(0.0))
    feature, cut, low, high, value = map(np.array, zip(*nodes))
    return Trees(feature, cut.astype(float), low, high, value.astype(float), np.array(roots), bias, depth)


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    few = staged(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
                 .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "quality-labels")  # bounded by `sample`
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Train on at most ``sample`` labelled documents, chosen by a hash of doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [counts_of(t)[1] for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = _sampled(docs, labels, sample).select("doc_id", "text", "quality").mapInArrow(
        run, "doc_id long, quality int, x array<double>").orderBy("doc_id", "quality").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(STATISTICS))
    signs = np.array([MONOTONIC.get(name, 0) for name in STATISTICS])
    return train(x, np.array([r["quality"] for r in rows], float), signs)


def judged(texts: list[bytes], trees: Trees, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, whether the fixed rules fail, the trees' score, and whether the document is kept."""
    both = [counts_of(t) for t in texts]
    counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
    score = trees.probability(np.array([s for _, s in both], float).reshape(-1, len(STATISTICS)))
    failed = base_failed(counts)
    return counts, failed, score, ~failed & (score >= threshold)


def quality(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of every document.

    Null and empty texts have no words, fail the fixed rules and are not kept.
    Repeated rows give repeated rows. Other columns of ``docs`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, score, kept = judged(utf8(batch.column(1)), trees, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(score), pa.array(kept)],
                                             ["doc_id", *COUNTS, "base_failed", "score", "kept"])
    fields = ", ".join(f"{name} long" for name in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {fields}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judged(utf8(batch.column(at)), trees, threshold)[3]))
    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query: all documents, trees trained on the labels."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return quality(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
