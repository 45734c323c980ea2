"""Toxic passages by maximum-scoring segment search over token log-odds.

Fitting. From a bounded sample of labelled documents, each word and each word
beginning gets the log-odds of occurring in toxic against clean documents,
with an informative Dirichlet prior: how many of all documents hold it, scaled
to the weight of the toxic sample. Features whose log-odds lie ``min_z`` standard errors above zero
make the lexicon.

Scoring. A word scores the log-odds of its most significant feature; any other
word scores a small negative constant, so that the expected score is negative
on clean text. One linear scan finds all maximal scoring segments of a text
(those whose score no extension and no part exceeds). The greatest segment
score of n clean words has an extreme-value distribution, P(S >= x) about
K n exp(-lambda x); lambda and K come from the clean sample, and turn a segment
score into bits above chance, comparable over text lengths. A document's score
is a logistic function of its best passage, the sum of its significant
passages, and how dense they are.

The model is the lexicon and a few numbers; both are bounded by the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paystrata.sources.staging import staged

SAMPLE_PER_CLASS = 10_000  # labelled rows a class, the bound of the fit
BEGINNINGS = (4, 5, 6)
DENSITY = 0.1  # share of marked words that a toxic passage is assumed to have
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 300_000


def features_of(word: str) -> list[str]:
    """A word, and its beginnings marked by a trailing hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def maximal_segments(positions: list[int], scores: list[float], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score) of word positions.

    ``positions`` are the words with their own score, ascending; every other
    word scores ``neutral`` < 0. A segment is kept on a list with the cumulative
    scores before and after it; a new one joins back to the latest one that
    starts lower, if it also ends higher.
    """
    kept: list[tuple[int, int, float, float]] = []
    total, before = 0.0, -1
    for at, score in zip(positions, scores):
        total += neutral * (at - before - 1)
        before = at
        low, total = total, total + score
        if score <= 0:
            continue
        first, high = at, total
        while kept:
            j = len(kept) - 1
            passed = []
            while j >= 0 and kept[j][2] >= low:
                passed.append(j)
                j -= 1
            if j < 0 or kept[j][3] >= high:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, at, low, high))
    return [(a, b, high - low) for a, b, low, high in kept]


@dataclass
class ToxicModel:
    """Lexicon, neutral score, extreme-value parameters and the logistic weights."""

    lexicon: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature -> (z, log-odds)
    neutral: float = -0.1
    rate: float = 1.0
    constant: float = 0.01
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0, 0.0)

    def word_scores(self) -> "_Scores":
        return _Scores(self.lexicon)

    def bits(self, score: float, n: int) -> float:
        """Bits by which a segment score beats chance in n words."""
        return (self.rate * score - np.log(max(self.constant * n, 1e-9))) / np.log(2)

    def passages(self, words: list[str], scores: "_Scores") -> list[tuple[int, int, float]]:
        values = list(map(scores.__getitem__, words))
        marked = [i for i, v in enumerate(values) if v]
        return maximal_segments(marked, [values[i] for i in marked], self.neutral) if marked else []

    def inputs(self, found: list[tuple[int, int, float]], n: int) -> list[float]:
        """Best bits, sum of the significant passages' bits, passages a hundred words, and passages."""
        bits = [self.bits(s, n) for _, _, s in found]
        good = [b for b in bits if b > 0]
        return [max(bits, default=0.0) / 10, np.log1p(sum(good)), 100 * len(found) / max(n, 20), np.log1p(len(found))]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + rows @ np.array(self.weights[1:]), -35, 35)))


class _Scores(dict):
    """Word scores on demand; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        best = max((self.lexicon[f] for f in features_of(word) if f in self.lexicon), default=(0.0, 0.0))
        if len(self) >= _MEMO:
            self.clear()
        self[word] = best[1]
        return best[1]


def _words(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    text = text or ""
    lowered = text.lower()
    return _WORD.findall(lowered) if len(lowered) == len(text) else [w.lower() for w in _WORD.findall(text)]


def _counted(texts: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(feature, kind, n): documents of a kind that hold a feature; the empty feature counts all documents.

    With ``only``, other features are left out, and a task sends no more rows
    a batch than that set has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            counts: dict[int, Counter] = {}
            for text, kind in zip(batch.column(0), batch.column(1).to_pylist()):
                features = {""}
                for word in set(_words(text.as_py())):
                    mine = known.get(word)
                    if mine is None:
                        if len(known) >= _MEMO:
                            known.clear()
                        mine = known[word] = tuple(f for f in features_of(word) if only is None or f in only)
                    features.update(mine)
                counts.setdefault(kind, Counter()).update(features)
            for kind, found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([kind] * len(found), pa.int32()),
                                                  pa.array(list(found.values()), pa.int64())], ["feature", "kind", "n"])
    counted = texts.select("text", "kind").mapInArrow(run, "feature string, kind int, n long")
    return counted.groupBy("feature", "kind").agg(F.sum("n").alias("n"))


def _remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def in_training(doc_id):
    """Whether labels of the document may be learnt from: crc32 of the doc_id as text, modulo 3, is not 1. Without a doc_id never."""
    return F.coalesce(_remainder(doc_id) != 1, F.lit(False))


def held_out(doc_id):
    """Whether that remainder is 1; without a doc_id there is none."""
    return F.coalesce(_remainder(doc_id) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, text, kind) of at most ``per_class`` labelled documents of each class, chosen by a hash of doc_id."""
    marked = labels.filter(F.col("toxic").isin(0, 1)).filter(in_training(F.col("doc_id"))).select(
        "doc_id", F.col("toxic").cast("int").alias("kind")).distinct()
    chosen = [marked.filter(F.col("kind") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for kind in (0, 1)]
    few = staged(chosen[0].unionByName(chosen[1]), "toxic-labels")  # at most 2 * per_class rows of two numbers
    return staged(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, min_documents: int = 5,
        min_z: float = 3.0, density: float = DENSITY) -> ToxicModel:
    """Fit a model. Labels decide the sample and the classes and nothing else."""
    sample = training_sample(docs, labels, per_class)
    counts = staged(_counted(sample), "toxic-counts")
    totals = {r["kind"]: r["n"] for r in counts.filter("feature = ''").collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    model = ToxicModel()
    if not n0 or not n1:
        return model
    wide = counts.filter("feature <> ''").groupBy("feature").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("y1"),
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("y0"))
    # The sample is bounded, and so is what it can propose.
    proposed = {r["feature"]: (r["y0"], r["y1"]) for r in wide.filter(
        (F.col("y1") >= min_documents) & (F.col("y1") * n0 > 2 * F.col("y0") * n1)).collect()}
    background = {r["feature"]: r["n"] for r in _counted(
        docs.select("text", F.lit(0).cast("int").alias("kind")), frozenset(proposed)).collect()}
    for feature, (y0, y1) in sorted(proposed.items()):
        prior = n1 * background[feature] / background[""]
        odds = np.log((y1 + prior) / (2 * n1 - y1 - prior)) - np.log((y0 + prior) / (n0 + n1 - y0 - prior))
        z = odds / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        if z >= min_z:
            model.lexicon[feature] = (float(z), float(odds))
    _calibrate(model, sample, density)
    return model


def _calibrate(model: ToxicModel, sample: DataFrame, density: float) -> None:
    """Neutral score, extreme-value parameters and logistic weights from the training sample."""
    lexicon = dict(model.lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(lexicon)
        for batch in batches:
            rows = []
            for doc_id, text, kind in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = list(map(scores.__getitem__, _words(text)))
                marked = [i for i, v in enumerate(values) if v]
                rows.append((doc_id, kind, len(values), marked, [values[i] for i in marked]))
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "kind", "n", "marked", "scores"])

    found = sample.select("doc_id", "text", "kind").mapInArrow(
        run, "doc_id long, kind int, n long, marked array<long>, scores array<double>").orderBy("doc_id", "kind").collect()
    clean = [r for r in found if r["kind"] == 0]
    words = max(1, sum(r["n"] for r in clean))
    hits = np.array([s for r in clean for s in r["scores"]] or [1.0])
    share = min((len(hits) if any(r["scores"] for r in clean) else 0.5) / words, density / 2)
    model.neutral = float(np.log((1 - density) / (1 - share)))
    low, high = 1e-3, 50.0  # lambda solves E[exp(lambda s)] = 1 over clean words
    for _ in range(100):
        mid = (low + high) / 2
        mean = (1 - share) * np.exp(mid * model.neutral) + share * np.exp(np.minimum(mid * hits, 500)).mean()
        low, high = (low, mid) if mean > 1 else (mid, high)
    model.rate = low
    segments = [s for r in clean for _, _, s in maximal_segments(r["marked"], r["scores"], model.neutral)]
    floor = float(np.median(list(odds for _, odds in lexicon.values()))) if lexicon else 1.0
    model.constant = float((sum(s >= floor for s in segments) + 0.5) / words * np.exp(model.rate * floor))
    x = np.array([model.inputs(maximal_segments(r["marked"], r["scores"], model.neutral), r["n"]) for r in found])
    model.weights = tuple(_logistic(x, np.array([r["kind"] for r in found], float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score, passages) of every document.

    ``passages`` are the maximal segments that beat chance: start and end as
    character offsets of the text, and bits. Null and empty texts, and texts
    without letters, have none and the lowest score. Repeated rows get the same
    score each, an empty table has no rows. Other columns of ``docs`` are not
    read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.word_scores()
        for batch in batches:
            rows, spans = [], []
            for text in batch.column(1):
                words = _words(text.as_py())
                found = model.passages(words, scores)
                rows.append(model.inputs(found, len(words)))
                good = [(a, b, s) for a, b, s in found if model.bits(s, len(words)) > 0]
                if good:
                    at = [m.span() for m in _WORD.finditer(text.as_py())]
                    spans.append([{"start": at[a][0], "end": at[b][1], "bits": model.bits(s, len(words))} for a, b, s in good])
                else:
                    spans.append([])
            score = model.probability(np.array(rows).reshape(-1, 4))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "passages"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, passages array<struct<start:long,end:long,bits:double>>")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query: all documents; labels only from documents that are not held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxic_passages(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
