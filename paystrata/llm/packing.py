"""Packing documents into sequences by non-negative least squares.

A document's ids are cut into whole windows, then one piece whose length is a
multiple of ``unit``, then a tail shorter than ``unit``. That leaves a constant
number of lengths, whatever the corpus, and only their histogram reaches the
driver. Two levels are planned there, each by the same method: enumerate the
combinations of few lengths that fill a window exactly (tails fill blocks of
``unit``, blocks and pieces fill sequences), solve by non-negative least
squares how often to repeat each so that the histogram is used up, round down
to what is there, and pack the rest greedily, longest first.

Every piece is numbered within its length: inside its input partition while it
is cut, then shifted by what earlier partitions hold. Its number alone tells
its sequence and offset, by a lookup in the plan. So nothing is sorted, no group
meets in one task, and texts are read once and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paystrata.llm.tokens import END_ID, encoder, vocabulary_path
from paystrata.llm.words import utf8
from paystrata.sources.staging import staged

WINDOW, UNIT = 2048, 64


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method.

    Columns enter by the steepest gradient; those that would turn negative
    leave again, until no column outside promises a gain.
    """
    x = np.zeros(a.shape[1])
    used = np.zeros(a.shape[1], bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(gain.argmax())
        if gain[best] <= small:
            break
        used[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            sinking = used & (trial <= 0)
            if not sinking.any():
                break
            step = (x[sinking] / np.maximum(x[sinking] - trial[sinking], 1e-300)).min()
            x = x + step * (trial - x)
            used &= x > 1e-12
            x[~used] = 0
        x = trial
    return x


def combinations_of(total: int, parts: int, largest: int) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``parts`` numbers up to ``largest`` that sum to ``total``."""
    if total == 0:
        return [()]
    if parts == 0:
        return []
    return [(first, *rest) for first in range(min(total, largest), 0, -1) if first * parts >= total
            for rest in combinations_of(total - first, parts - 1, first)]


def _repeat(left: dict[int, int], fills: list[tuple[int, ...]]) -> list[tuple[dict[int, int], int]]:
    """Recipes (length -> pieces) with their repeat counts, by least squares; takes them from ``left``."""
    lengths = sorted(left)
    fills = [f for f in fills if all(left.get(x, 0) for x in f)]
    if not fills:
        return []
    row = {x: i for i, x in enumerate(lengths)}
    a = np.zeros((len(lengths), len(fills)))
    for j, fill in enumerate(fills):
        for x in fill:
            a[row[x], j] += 1
    times = nnls(a, np.array([left[x] for x in lengths], float))
    found = []
    for j in sorted(range(len(fills)), key=lambda j: -times[j]):
        recipe = {x: fills[j].count(x) for x in fills[j]}
        n = min(int(round(times[j])), *(left[x] // m for x, m in recipe.items()))
        if n > 0:
            found.append((recipe, n))
            for x, m in recipe.items():
                left[x] -= n * m
    return found


def _greedy(left: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Recipes for all that is left: longest first, each repeated as often as it can be."""
    found = []
    while any(left.values()):
        recipe, room = {}, window
        for x in sorted((x for x, n in left.items() if n), reverse=True):
            if m := min(left[x], room // x):
                recipe[x], room = m, room - m * x
        n = min(left[x] // m for x, m in recipe.items())
        found.append((recipe, n))
        for x, m in recipe.items():
            left[x] -= n * m
    return found


class Plan:
    """Where the k-th piece of each length goes; its size depends on window and unit alone."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT):
        left = {x: n for x, n in histogram.items() if 0 < x < window and n}
        tails = {x: n for x, n in left.items() if x < unit}
        blocks = _repeat(tails, combinations_of(unit, 3, unit - 1))
        pieces = {x: n for x, n in left.items() if x >= unit}
        self.own_blocks = pieces.get(unit, 0)
        made = sum(n for _, n in blocks)
        if made:
            pieces[unit] = self.own_blocks + made
        units = {x // unit: n for x, n in pieces.items()}
        full = [({x * unit: m for x, m in recipe.items()}, n)
                for recipe, n in _repeat(units, combinations_of(window // unit, 4, window // unit - 1))]
        rest = {x * unit: n for x, n in units.items()} | tails
        whole = [({window: 1}, histogram[window])] if histogram.get(window) else []
        self.unit = unit
        self.sequences = self._allot(whole + full + _greedy(rest, window), {x: 0 for x in tails})
        self.blocks = self._allot(blocks, {})
        used_in_blocks = {x: sum(n * r.get(x, 0) for r, n in blocks) for x in left if x < unit}
        self.in_blocks = used_in_blocks

    @staticmethod
    def _allot(recipes: list[tuple[dict[int, int], int]], start: dict[int, int]) -> dict[int, np.ndarray]:
        """By length, rows (first piece, first window, pieces a window, offset of the first)."""
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken, base = dict(start), 0
        for recipe, n in recipes:
            offset = 0
            for x, m in sorted(recipe.items(), reverse=True):
                rows.setdefault(x, []).append((taken.get(x, 0), base, m, offset))
                taken[x] = taken.get(x, 0) + n * m
                offset += m * x
            base += n
        return {x: np.array(r, np.int64) for x, r in rows.items()}

    @staticmethod
    def _find(rows: np.ndarray, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(rows[:, 0], number, side="right") - 1
        first, base, many, offset = rows[at].T
        return base + (number - first) // many, offset + (number - first) % many * length

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given each one's length and number within its length."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            mine = np.flatnonzero(length == x)
            k = number[mine]
            blocked = k < self.in_blocks.get(x, 0)
            if blocked.any():
                block, inside = self._find(self.blocks[x], x, k[blocked])
                s, o = self._find(self.sequences[self.unit], self.unit, self.own_blocks + block)
                sequence[mine[blocked]], offset[mine[blocked]] = s, o + inside
            if not blocked.all():
                rest = k[~blocked] - self.in_blocks.get(x, 0)
                sequence[mine[~blocked]], offset[mine[~blocked]] = self._find(self.sequences[x], x, rest)
        return sequence, offset


def cut(tokens: int, window: int = WINDOW, unit: int = UNIT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    whole, rest = divmod(tokens, window)
    pieces = [(i * window, window) for i in range(whole)]
    at = whole * window
    for length in (rest // unit * unit, rest % unit):
        if length:
            pieces.append((at, length))
            at += length
    return pieces


def pack(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, end_id: int = END_ID,
         with_ids: bool = False, memo: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    Null and empty texts are the end id alone. Repeated rows are packed as often
    as they occur. Sequences are gapless from 0 and at most ``window`` long;
    ``unit`` must divide ``window``. ``memo`` bounds the chunks a worker remembers
    (its memory against time), if not the usual number. Other columns of ``docs`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(path, end_id, most=memo).encode(utf8(part.column(1)))):
                    total = len(ids) // 4
                    for start, length in cut(total, window, unit):
                        number = seen[length] = seen.get(length, -1) + 1
                        piece = ids[4 * start:4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(piece), total, number, piece if with_ids else None))
                columns = list(zip(*rows)) or [()] * 7
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))],
                    ["slot", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "number", "ids"])

    pieces = staged(docs.select("doc_id", "text").mapInArrow(
        run, "slot long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long, ids binary"), "pieces")
    held = staged(pieces.groupBy("slot", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, window, unit)
    earlier = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("slot", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            sequence, offset = plan.place(columns["length"].to_numpy(), columns.pop("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    numbered = pieces.join(shift, ["slot", "length"]).select(*kept, (F.col("number") + F.col("shift")).alias("number"))
    types = {"ids": "binary"}
    schema = ", ".join(f"{name} {types.get(name, 'long')}" for name in [*kept, "sequence_id", "offset"])
    return numbered.mapInArrow(place, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from ``pack(..., with_ids=True)``."""
    ordered = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.aggregate("parts", F.to_binary(F.lit(""), F.lit("utf-8")), lambda all, p: F.concat(all, p["ids"])).alias("ids"))


def op9_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query: all documents, windows of 2048 ids."""
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary_path())
