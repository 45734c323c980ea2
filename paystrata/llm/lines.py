"""Substring dedup by hashing lines and the sentences in them.

A document is cut into units: a line, cut again after each sentence, so that a
passage inside a longer line is found as well as one that is a line of its own.
A unit's digest covers its words (A-Z in lower case, white space normalised).
Units of fewer than ``min_words`` words would match by chance; such a unit is
digested together with as many units before it as are needed for ``min_words``
words. Equal digests are grouped over all documents; the earliest unit by
(doc_id, offset) stays and the others are repeats. Units whose document has fewer
than ``min_words`` words up to their end, and units without words, always stay.

A sentence or a short line that occurs elsewhere does not make a repeated
passage. Repeats in a row are a run, and a run goes if it has ``min_run`` words;
with 1 every repeated unit goes, down to a line of ``min_words`` words.

The earliest unit of a digest is a minimum, which combines before the shuffle,
so no group of copies meets in one task; the join that names the others is a
plain equi-join that adaptive execution splits when one digest is frequent.

Host text shifts the units at the ends of a passage that lies inside a line. So
runs of words are looked up too, wherever they lie: of ``_window`` runs of
``_gram`` words in a row the one with the least hash is an anchor, so every
passage of PASSAGE words holds an anchor that its own words choose. Anchors that
occur earlier are chained, the ends of a chain are moved outward word by word
along the earliest occurrence, and chains of PASSAGE words or more go. Only
texts at the end of a chain are read for that, a bounded number of words each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paystrata.llm.words import WORD, mixed
from paystrata.sources.staging import staged

MIN_WORDS = 5
#: Words that repeats in a row must have together to go.
MIN_RUN = 20
#: Words of a passage that is found wherever it lies.
PASSAGE = 50
#: Words whose hashes a task remembers, and bytes of the texts that are cut at once.
_MEMO, _AT_ONCE = 200_000, 1 << 20
_PLACE = re.compile(WORD)
#: Up to and with a line end, or the spaces after a sentence end.
UNIT = re.compile(r"(?:[^\n.!?]+|[.!?]+[^ \t\n.!?])*(?:\n|[.!?]+(?:[ \t]+\n?|\n)|[.!?]*\Z)")


def units_of(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digested words) of the units that are judged, in order."""
    places, digested, _ = _cut(text, min_words)
    return [(start, end, words) for start, end, words in zip(places[::4], places[1::4], digested)]


def _cut(text: str, min_words: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Start, end, words before and own words of each unit in a row, what is digested of each, and all words of the text."""
    places, digested, before, all_words = [], [], [], []
    for match in UNIT.finditer(text):
        words = match.group().encode().lower().split()
        if not words:
            continue
        at = len(all_words)
        all_words += words
        if len(words) >= min_words:
            before = [words]
            places += (*match.span(), at, len(words))
            digested.append(b" ".join(words))
            continue
        before.append(words)
        need, parts = min_words, []
        for part in reversed(before):
            parts.append(part)
            need -= len(part)
            if need <= 0:
                break
        before = parts[::-1]
        if need <= 0:
            places += (*match.span(), at, len(words))
            digested.append(b" ".join([w for part in before for w in part]) + b" |%d" % len(words))
    return places, digested, all_words


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): the key tells apart different texts of one doc_id."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


_MARKS = ("doc_id long, text_key long, units array<struct<span:long,place:long,high:long,low:long>>, "
          "anchors array<struct<at:int,high:long,low:long>>")


def text_marks(docs: DataFrame, min_words: int = MIN_WORDS, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, text_key, units, anchors) of every document, with 128-bit digests.

    ``span`` holds a unit's start and length and ``place`` the words before it
    and its own, each pair as the halves of one number.
    """
    gram = _gram(passage)
    weights = mixed(np.arange(1, 2 * gram + 1, dtype=np.uint64)).reshape(2, gram) | np.uint64(1)

    def lists(counts: list[int], **columns: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns.values()], list(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, known = xxhash.xxh3_128_digest, _WordHashes()
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _AT_ONCE, "right")))
                part = batch.slice(at, end - at)
                places, digests, n_units, firsts, sums = [], [], [], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
                for text in part.column(2).to_pylist():
                    mine, digested, words = _cut(text or "", min_words)
                    places += mine
                    digests += map(digest, digested)
                    n_units.append(len(digested))
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    firsts.append(anchors_of(hashes, passage))
                    runs = hashes[firsts[-1][:, None] + np.arange(gram)]
                    # Two sums of all word hashes, each times an odd number of its place.
                    sums.append(np.stack([(runs * w).sum(axis=1) for w in weights], axis=1))
                start, stop, before, words = np.array(places, np.int64).reshape(-1, 4).T
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                anchors = mixed(np.concatenate(sums)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1),
                     lists(n_units, span=start << 32 | stop - start, place=before << 32 | words, high=halves[:, 0], low=halves[:, 1]),
                     lists([len(f) for f in firsts[1:]], at=np.concatenate(firsts).astype(np.int32), high=anchors[:, 0], low=anchors[:, 1])],
                    ["doc_id", "text_key", "units", "anchors"])
                at = end
        pa.default_memory_pool().release_unused()
    return keyed(docs).mapInArrow(run, _MARKS)


def _units(marks: DataFrame) -> DataFrame:
    return marks.select("doc_id", "text_key", F.inline("units"))


def _anchors(marks: DataFrame) -> DataFrame:
    return marks.select("doc_id", "text_key", F.inline("anchors"))


def _halves(pair: str) -> tuple[Column, Column]:
    return F.shiftright(pair, 32).cast("int"), F.col(pair).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _later(rows: DataFrame, at: str, label: str) -> DataFrame:
    """The rows with a doc_id whose digest occurs earlier, with ``first`` (doc_id, text_key, at) and ``copies``."""
    groups = staged(rows.groupBy("high", "low").agg(
        F.min(F.struct("doc_id", "text_key", at)).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), label)
    return rows.join(groups, ["high", "low"]).filter("doc_id is not null").filter(
        ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("text_key") != F.col("first.text_key"))
        | (F.col(at) != F.col(f"first.{at}")))


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = 1) -> DataFrame:
    """(doc_id, start, length, first_doc_id, first_start, copies, text_key) of every repeated unit of a run that goes.

    Offsets count characters of the original text. Null and empty texts have no
    units. Repeated rows of one doc_id and text hold their units at the same
    place, so they lose none to each other and lose the same to earlier
    documents. A document without a doc_id counts as the earliest and loses
    nothing. Other columns of ``docs`` are not read.
    """
    return _repeated_units(staged(text_marks(docs, min_words), "marks"), min_run)


def _repeated_units(marks: DataFrame, min_run: int) -> DataFrame:
    later = _later(_units(marks), "span", "unit-groups")
    if min_run > 1:
        # A run begins where the words before a unit are not those up to the last unit's end. Places, not rows, are
        # compared, so that repeated rows count once.
        before, words = _halves("place")
        text = Window.partitionBy("doc_id", "text_key").orderBy("before")
        later = later.withColumn("before", before).withColumn("end", before + words)
        follows = F.max("end").over(text.rangeBetween(Window.unboundedPreceding, -1)) == F.col("before")
        later = later.withColumn("begin", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("before")))
        later = later.withColumn("run", F.max("begin").over(text.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        held = F.max("end").over(Window.partitionBy("doc_id", "text_key", "run")) - F.col("run")
        later = later.withColumn("held", held).filter(F.col("held") >= min_run)
    start, length = _halves("span")
    return later.select("doc_id", start.alias("start"), length.alias("length"), F.col("first.doc_id").alias("first_doc_id"),
                        F.shiftright("first.span", 32).cast("int").alias("first_start"), "copies", "text_key")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _gram(passage: int) -> int:
    """Words of an anchor: at least as many as there are starts in a window, so that anchors in a row touch."""
    return passage // 2 + 1


def _window(passage: int) -> int:
    return passage - _gram(passage) + 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def anchors_of(hashes: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """First words of the anchors of a text of these word hashes: at least one in every ``passage`` words."""
    gram, window = _gram(passage), _window(passage)
    count = len(hashes) - gram + 1
    if count < window:
        return np.zeros(0, np.int64)
    total, value, width, done, rest = np.zeros(count, np.uint64), hashes, 1, 0, gram
    while rest:  # runs of 1, 2, 4, ... words, put together to ``gram``
        if rest & 1:
            total = mixed(total + value[done:done + count])
            done += width
        rest >>= 1
        if rest:
            value = mixed(mixed(value[:-width]) + value[width:])
            width *= 2
    chosen = np.pad(_least(total, window), window - 1)
    return np.flatnonzero(total == ~_least(~chosen, window))


def surroundings(text: str, spots: list[tuple[int, int]], gram: int, reach: int) -> Iterator[tuple[list[str], list[int]]]:
    """For each (first word of an anchor, side): up to ``reach`` words beside it, outward, and the offsets before, between and after them.

    Side 0 is the left one and offsets are where words begin; on side 1 they are
    where words end, with the blanks that follow on the line.
    """
    spans = [m.span() for m in _PLACE.finditer(text)]

    def after(i: int) -> int:
        gap = text[spans[i][1]:spans[i + 1][0] if i + 1 < len(spans) else len(text)]
        return spans[i][1] + len(gap) - len(gap.lstrip(" \t"))

    for at, side in spots:
        if side:
            near, edge = range(at + gram, min(at + gram + reach, len(spans))), after
            offsets = [after(at + gram - 1)]
        else:
            near, edge = range(at - 1, max(at - reach, 0) - 1, -1), lambda i: spans[i][0]
            offsets = [spans[at][0]]
        yield [text[a:b].encode().lower().decode() for a, b in (spans[i] for i in near)], offsets + [edge(i) for i in near]


def _beside(docs: DataFrame, spots: DataFrame, gram: int, reach: int) -> DataFrame:
    """(doc_id, text_key, at, side, words, offsets) of the distinct spots (doc_id, text_key, at, side)."""
    asked = spots.distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "side")).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for doc_id, key, text, wanted in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    wanted = [(s["at"], s["side"]) for s in wanted]
                    rows += [(doc_id, key, *spot, *found) for spot, found in zip(wanted, surroundings(text, wanted, gram, reach))]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)],
                                                 ["doc_id", "text_key", "at", "side", "words", "offsets"])

    texts = keyed(docs).alias("t").join(asked.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (
        F.col("t.text_key") == F.col("s.text_key"))).select("t.doc_id", "t.text_key", "text", "spots")
    found = texts.mapInArrow(run, "doc_id long, text_key long, at int, side int, words array<string>, offsets array<int>")
    return staged(found, "passage-ends").dropDuplicates(["doc_id", "text_key", "at", "side"])


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, start, length, first_doc_id, first_start, copies, text_key) of every passage to remove.

    A passage is a run of at least ``passage`` words that occur earlier, wherever
    it begins and ends. ``first_doc_id`` and ``first_start`` say where its
    beginning occurs first, ``copies`` how often. Otherwise as ``repeated_units``.
    """
    return _repeated_passages(docs, staged(text_marks(docs, passage=passage), "marks"), passage)


def _repeated_passages(docs: DataFrame, marks: DataFrame, passage: int) -> DataFrame:
    gram, window = _gram(passage), _window(passage)
    later = _later(_anchors(marks), "at", "anchor-groups")
    along = Window.partitionBy("doc_id", "text_key").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(along) > window, F.lit(True)).cast("int")
    chains = staged(
        later.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(along)).groupBy("doc_id", "text_key", "chain").agg(
            F.min(F.struct("at", "first", "copies")).alias("head"), F.max(F.struct("at", "first", "copies")).alias("tail")), "passage-chains")
    ends = chains.select("doc_id", "text_key", "chain", F.posexplode(F.array("head", "tail")).alias("side", "end")).select(
        "doc_id", "text_key", "chain", "side", "end.*")
    beside = _beside(docs, ends.select("doc_id", "text_key", "at", "side").unionByName(ends.select("first.*", "side")), gram, window - 1)
    own, other = beside.alias("own"), beside.alias("other")
    both = ends.alias("e").join(own, ["doc_id", "text_key", "at", "side"]).join(
        other, F.col("e.first.doc_id").eqNullSafe(F.col("other.doc_id")) & (F.col("e.first.text_key") == F.col("other.text_key"))
        & (F.col("e.first.at") == F.col("other.at")) & (F.col("e.side") == F.col("other.side")))
    differs = F.array_position(F.zip_with("own.words", "other.words", lambda x, y: x.eqNullSafe(y)), False)
    moved = both.withColumn("more", F.when(differs == 0, F.size("own.words")).otherwise(differs - 1).cast("int")).select(
        "e.doc_id", "e.text_key", "chain", F.struct(
            F.col("e.side").alias("side"), F.col("e.at").alias("at"), "more", F.get("own.offsets", F.col("more")).alias("offset"),
            F.col("first.doc_id").alias("first_doc_id"), F.get("other.offsets", F.col("more")).alias("first_start"), "copies").alias("end"))
    whole = moved.groupBy("doc_id", "text_key", "chain").agg(F.min("end").alias("left"), F.max("end").alias("right"))
    return whole.filter(F.col("right.at") + gram + F.col("right.more") - F.col("left.at") + F.col("left.more") >= passage).select(
        "doc_id", F.col("left.offset").alias("start"), (F.col("right.offset") - F.col("left.offset")).alias("length"),
        "left.first_doc_id", "left.first_start", "left.copies", "text_key")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, passage: int = PASSAGE, min_run: int = MIN_RUN) -> DataFrame:
    """Every unit and every passage to remove; a passage's row may cover rows of units."""
    marks = staged(text_marks(docs, min_words, passage), "marks")
    return _repeated_units(marks, min_run).unionByName(_repeated_passages(docs, marks, passage))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the (start, length) spans, which are sorted and apart."""
    kept, at = [], 0
    for start, length in spans:
        kept.append(text[at:start])
        at = start + length
    kept.append(text[at:])
    return "".join(kept)


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (start, length) spans with overlapping and touching ones made one."""
    found: list[tuple[int, int]] = []
    for start, length in spans:
        if found and start <= sum(found[-1]):
            found[-1] = (found[-1][0], max(sum(found[-1]), start + length) - found[-1][0])
        else:
            found.append((start, length))
    return found


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, passage: int = PASSAGE, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with repeated units and passages cut out of ``text`` and ``n_chars`` counted anew where both exist.

    Every row stays, with all its columns, even if its text becomes empty.
    """
    spans = repeats(docs, min_words, passage, min_run).select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), F.struct("start", "length").alias("span"))
    cuts = spans.groupBy("__doc", "__key").agg(F.array_sort(F.collect_set("span")).alias("__cuts"))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(names)}
            cut = batch.column(len(names)).to_pylist()
            texts = [t if not c else without(t, joined_spans([(s["start"], s["length"]) for s in c]))
                     for t, c in zip(columns["text"].to_pylist(), cut)]
            columns["text"] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in columns:
                counts = [None if t is None else len(t) for t in texts]
                columns["n_chars"] = pa.array(counts, pa.int64()).cast(batch.schema.field(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)
        pa.default_memory_pool().release_unused()

    joined = docs.join(cuts, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__key")), "left").select(*names, "__cuts")
    return joined.mapInArrow(run, docs.schema)


def op8_substring_dedup(spark, folder: str) -> DataFrame:
    """All documents: one row for each unit or passage that goes, with its original offset and the one that stays."""
    return repeats(spark.read.parquet(f"{folder}/documents.parquet")).drop("text_key")
