"""Divergence audit of the sources of a language by their term counts.

Every group (lang, source) and every language gives each term a smoothed share
in billionths; two groups differ by the sum of the chi-square-like integer
f(p, q) = floor((p - q)^2 / q) over all kept terms of the language. All
arithmetic is exact.

The counts of a language are a matrix of groups by terms, mostly zeros. It is
laid out as a K-squared tree: a square is divided into K by K quadrants, an
all-zero quadrant is a leaf without content, the others are divided again until
they are small dense blocks. A zero cell's share is the same for all terms of a
group, so a pair of all-zero quadrants is worth its width times one number; the
sum over *all* of them is priced at once as V * f(p0, q0), and only where one
of the two quadrants holds something is the pair traversed, down to the blocks,
where the difference to that price is added up. Terms are numbered by falling
document frequency, so that the nonzero blocks lie together.

The top of the tree is a table: one row for each nonzero quadrant of SIDE rows
and columns, which is what a task holds. A pair of group ranges meets once per
column range. Everything beside the traversal is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paystrata.sources.staging import staged

#: Rows and columns of the quadrants that tasks work on, and of the dense blocks at the bottom.
SIDE, LEAF = 1024, 8
SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TERM_RANKS = 200
#: Distinct terms, and (group, term) counts, that a task remembers before it passes them on.
_VOCABULARY, _HELD = 400_000, 2_000_000
#: Bytes of the texts that are counted at once.
_BYTES = 1 << 20

# Letters A-Z in lower case, a-z and all bytes beyond ASCII stay, everything else separates.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Numbers(dict):
    """Numbers for terms, in the order they are met."""

    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self)
        return value


class _Counts:
    """Counts of (group, term) and of the documents that hold the term, by numbers."""

    def __init__(self):
        self.groups, self.terms = _Numbers(), _Numbers()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, groups: list[tuple], texts: list[bytes]) -> None:
        words = [text.translate(_LETTERS).split() for text in texts]
        ids = np.fromiter((i for w in words for i in map(self.terms.__getitem__, w)), np.int64)
        doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
        in_doc, n = np.unique(doc << 32 | ids, return_counts=True)
        group = np.array([self.groups[g] for g in groups], np.int64)
        self._keep(group[in_doc >> 32] << 32 | in_doc & 0xFFFFFFFF, n, np.ones(len(n), np.int64))
        if self.held > _HELD:
            self._merge()

    def _keep(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if len(starts):
            n, docs = np.add.reduceat(n[order], starts), np.add.reduceat(docs[order], starts)
        self.parts.append((key[starts], n, docs))
        self.held += len(starts)

    def _merge(self) -> None:
        parts, self.parts, self.held = self.parts, [], 0
        self._keep(*(np.concatenate(c) for c in zip(*parts)))

    def full(self) -> bool:
        return len(self.terms) > _VOCABULARY or self.held > _HELD // 2 and len(self.parts) == 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs) of what is held, and one row with a null term for each group."""
        if not self.groups:
            return
        self._merge()
        langs, sources = (pa.array(c, pa.string()) for c in zip(*self.groups))
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        (key, n, docs), = self.parts
        zero = np.zeros(len(langs), np.int64)
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(langs), pa.string()), pa.array(zero), pa.array(zero)], _COUNTED)
        for at in range(0, len(key), 1 << 16):
            part = slice(at, at + (1 << 16))
            group = pa.array(key[part] >> 32)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(pa.array(key[part] & 0xFFFFFFFF)),
                                              pa.array(n[part]), pa.array(docs[part])], _COUNTED)


_COUNTED = ["lang", "source", "term", "n", "docs"]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and documents that hold it.

    Null text, lang and source count as ''. A group has one more row, with a
    null term and no counts, so that groups without terms are known too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # Some texts at once, by their bytes; a longer one alone.
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _BYTES, "right")))
                part = batch.slice(at, end - at)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                counts.add(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())), texts)
                at = end
                if counts.full():
                    yield from counts.batches()
                    counts = _Counts()
        yield from counts.batches()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # By language and term: the terms' totals need no further shuffle.
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact for any counts."""
    whole = "decimal(20,0)"
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast(whole)
    bottom = F.greatest((total + kept).cast(whole), F.lit(1).cast(whole))
    return F.call_function("div", top, bottom).cast("long") + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Add the place of each row in its group, from 0, without a task for a whole group."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("seq", F.monotonically_increasing_id())
    placed = staged(ranged.withColumn("slot", F.shiftright("seq", 33)), f"divergence-{name}")
    heads = placed.groupBy("slot", group).agg(F.min("seq").alias("first"), F.count("*").alias("held"))
    earlier = Window.partitionBy(group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per slot
    shifts = staged(heads.select("slot", group, "first", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("shift")), "divergence-slots")
    return placed.join(shifts, ["slot", group]).withColumn(name, F.col("seq") - F.col("first") + F.col("shift")).drop(
        "slot", "seq", "first", "shift")


class Quadtree:
    """A K-squared tree over a square of shares: which quadrants of each level hold something, and dense blocks at the bottom."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shares: np.ndarray, zero: np.ndarray, side: int, k: int, leaf: int):
        self.k = k
        blocks, number = np.unique((rows // leaf) * (side // leaf) + columns // leaf, return_inverse=True)
        at_row, at_column = blocks // (side // leaf), blocks % (side // leaf)
        padded = np.ones(side, np.int64)
        padded[:len(zero)] = zero
        self.zero = padded.reshape(-1, leaf)
        #: The dense blocks, and last of all none: every block without content has this number.
        self.dense = np.repeat(self.zero[at_row][:, :, None], leaf, axis=2)
        self.dense[number, rows % leaf, columns % leaf] = shares
        width = side // leaf
        self.number = np.full((width, width), -1)
        self.number[at_row, at_column] = np.arange(len(blocks))
        level, self.levels = self.number >= 0, []
        while True:
            self.levels.append(level)
            if len(level) == 1:
                break
            level = level.reshape(len(level) // k, k, -1, k).any(axis=(1, 3))
        self.levels.reverse()

    def blocks(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The dense blocks at these places; the zero share of each row where there is none."""
        number = self.number[row, column]
        found = np.repeat(self.zero[row][:, :, None], self.zero.shape[1], axis=2)
        found[number >= 0] = self.dense[number[number >= 0]]
        return found


def joint_blocks(a: Quadtree, b: Quadtree, rows_a: int, rows_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row block of a, row block of b, column block) wherever one of the two holds something, by walking both trees down."""
    k, size = a.k, len(a.levels[-1])
    i = j = c = np.zeros(1, np.int64)
    alive = a.levels[0][0, 0] or b.levels[0][0, 0]
    i, j, c = (x[:int(alive)] for x in (i, j, c))
    steps = np.stack(np.meshgrid(*[np.arange(k)] * 3, indexing="ij")).reshape(3, 1, -1)
    for level_a, level_b in zip(a.levels[1:], b.levels[1:]):
        i, j, c = ((x[:, None] * k + s).ravel() for x, s in zip((i, j, c), steps))
        scale = size // len(level_a)
        inside = (i * scale < rows_a) & (j * scale < rows_b)
        i, j, c = i[inside], j[inside], c[inside]
        held = level_a[i, c] | level_b[j, c]
        i, j, c = i[held], j[held], c[held]
    return i, j, c


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    away = p - q
    return (away * away).astype(np.uint64) // q.astype(np.uint64)


def beyond_zero(a: Quadtree, b: Quadtree, rows_a: int, rows_b: int) -> np.ndarray:
    """For each pair of a row of a and one of b: the sum of f(p, q) - f(p0, q0) over the columns."""
    leaf = a.zero.shape[1]
    blocks_a, blocks_b = -(-rows_a // leaf), -(-rows_b // leaf)
    total = np.zeros((blocks_a, blocks_b, leaf, leaf), np.int64)
    price = _f(a.zero[:blocks_a, None, :, None], b.zero[None, :blocks_b, None, :]).astype(np.int64)
    i, j, c = joint_blocks(a, b, blocks_a, blocks_b)
    step = max(1, (1 << 20) // leaf ** 3)
    for at in range(0, len(i), step):
        x, y, z = i[at:at + step], j[at:at + step], c[at:at + step]
        worth = _f(a.blocks(x, z)[:, :, None, :], b.blocks(y, z)[:, None, :, :]).astype(np.int64).sum(axis=3)
        np.add.at(total, (x, y), worth - leaf * price[x, y])
    return total.transpose(0, 2, 1, 3).reshape(blocks_a * leaf, blocks_b * leaf)[:rows_a, :rows_b]


def _pack(table: pa.Table) -> pa.Table:
    """One row for a quadrant: the places and shares of its cells."""
    cells = [pa.array([table.column(name).to_numpy().astype(kind).tobytes()], pa.binary()) for name, kind in
             (("row", "<i4"), ("column", "<i4"), ("p", "<i8"))]
    keys = [table.column(name).slice(0, 1).combine_chunks() for name in ("lang", "high", "across")]
    return pa.table([*keys, *cells], ["lang", "high", "across", "rows", "columns", "shares"])


def _meet(side: int, k: int, leaf: int):
    """Both directions of a pair of quadrants beside each other, or of a quadrant with itself or with an all-zero one."""
    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        trees, zeros = {}, {first["x"]: first["zero_x"], first["y"]: first["zero_y"]}
        empty = np.zeros(0, np.int64)
        cells = {place: (empty, empty, empty) for place in zeros}
        for row in table.to_pylist():
            cells[row["high"]] = tuple(np.frombuffer(row[name], kind).astype(np.int64) for name, kind in (
                ("rows", "<i4"), ("columns", "<i4"), ("shares", "<i8")))
        for place, zero in zeros.items():
            trees[place] = Quadtree(*cells[place], np.array(zero, np.int64), side, k, leaf)
        a_rows, b_rows, worths = [empty], [empty], [empty]
        for x, y in {(first["x"], first["y"]), (first["y"], first["x"])}:
            worth = beyond_zero(trees[x], trees[y], len(zeros[x]), len(zeros[y]))
            a, b = np.nonzero(worth)
            a_rows.append(a + x * side)
            b_rows.append(b + y * side)
            worths.append(worth[a, b])
        a = np.concatenate(a_rows)
        return pa.table([pa.array([first["lang"]] * len(a), pa.string()), pa.array(a), pa.array(np.concatenate(b_rows)),
                         pa.array(np.concatenate(worths))], ["lang", "a", "b", "worth"])
    return run


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, side: int = SIDE, k: int = 2,
               leaf: int = LEAF) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``docs`` (lang, source, text).

    Part ``pair``: every other source of the language by how far it is away.
    Part ``term``: the terms that the group uses more than its language does, to
    the given rank. A term is a run of letters A-Z (in lower case) and
    characters beyond ASCII; a language keeps those in at least ``least`` of its
    documents. Null text, lang and source count as ''; repeated rows count as
    often as they occur; texts may be empty or of any length; a language without
    kept terms has pairs of value 0 and no terms, an empty table has no rows.
    ``side`` and ``leaf`` must be ``leaf`` times a power of ``k``. Other columns
    are not read.
    """
    counts = staged(term_counts(docs), "term-counts")
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(
        F.col("docs") >= least)
    terms = staged(_numbered(terms, "lang", [F.col("docs").desc(), F.col("term")], "column"), "divergence-terms")
    cells = staged(counts.filter("term is not null").drop("docs").join(terms.select("lang", "term", "all_n", "column"), ["lang", "term"]), "divergence-cells")
    sizes = terms.groupBy("lang").agg(F.sum("all_n").alias("lang_n"), F.count("*").alias("kept"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    named = _numbered(counts.filter("term is null").select("lang", "source"), "lang", [F.col("source")], "row")
    groups = named.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["group_n", "lang_n", "kept"])
    none = F.lit(0).cast("long")
    groups = staged(groups.withColumn("p0", share(none, F.col("group_n"), F.col("kept"))).withColumn("high", F.floor(F.col("row") / side)), "divergence-groups")

    shares = staged(cells.join(groups.select("lang", "source", "row", "high", "group_n", "lang_n", "kept"), ["lang", "source"]).select(
        "lang", "source", "term", "row", "high", "column", share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"),
        share(F.col("all_n"), F.col("lang_n"), F.col("kept")).alias("q")), "divergence-shares")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          distance(F.col("p"), F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= ranks)

    # Ranges of at most ``side`` groups, and which of them meet.
    ranges = groups.groupBy("lang", "high").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(F.struct("row", "source", "p0"))).alias("held"))
    ranges = staged(ranges, "divergence-ranges")
    count = ranges.groupBy("lang").agg(F.count("*").alias("ranges"))
    other = F.explode(F.sequence(F.lit(0), F.col("ranges") - 1))
    inside = shares.select("lang", "high", F.floor(F.col("column") / side).alias("across"), (F.col("row") % side).alias("row"),
                           (F.col("column") % side).alias("column"), "p")
    quadrants = inside.groupBy("lang", "high", "across").applyInArrow(
        _pack, "lang string, high long, across long, rows binary, columns binary, shares binary")
    zero = F.transform("held", lambda g: g["p0"])
    meeting = staged(quadrants, "divergence-quadrants").join(count, "lang").withColumn("other", other).withColumn(
        "x", F.least("high", "other")).withColumn("y", F.greatest("high", "other"))
    for name in ("x", "y"):
        meeting = meeting.join(ranges.select("lang", F.col("high").alias(name), zero.alias(f"zero_{name}")), ["lang", name])
    met = meeting.drop("ranges", "other").groupBy("lang", "x", "y", "across").applyInArrow(
        _meet(side, k, leaf), "lang string, a long, b long, worth long")
    worth = staged(met.groupBy("lang", "a", "b").agg(F.sum("worth").alias("worth")), "divergence-worth")

    left = ranges.join(count, "lang").withColumn("other", other).select("lang", "other", "kept", F.explode("held").alias("g"))
    right = ranges.select("lang", F.col("high").alias("other"), F.col("held").alias("others"))
    pairs = left.join(right, ["lang", "other"]).select("lang", "kept", "g", F.explode("others").alias("o")).filter("g.row <> o.row")
    apart = pairs.select("lang", F.col("g.source").alias("source"), F.col("o.source").alias("item"), F.col("g.row").alias("a"), F.col("o.row").alias("b"),
                         (F.col("kept") * distance(F.col("g.p0"), F.col("o.p0"))).alias("price"))
    valued = apart.join(worth, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.col("price") + F.coalesce("worth", F.lit(0))).alias("value"))
    return valued.withColumn("rank", F.row_number().over(best)).unionByName(above)


def op12_source_divergence(spark, folder: str) -> DataFrame:
    """Contract query: all documents, terms of three documents or more, 200 terms a group."""
    return divergence(spark.read.parquet(f"{folder}/documents.parquet"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc, lang, source, term, count(*) AS n FROM (
    SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents))
  GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, sum(n)::HUGEINT AS all_n FROM words GROUP BY lang, term HAVING count(*) >= 3
), sizes AS (
  SELECT lang, sum(all_n)::HUGEINT AS lang_n, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), named AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), counted AS (
  SELECT w.lang, w.source, w.term, sum(w.n)::HUGEINT AS n FROM words w JOIN kept k USING (lang, term) GROUP BY ALL
), sums AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS group_n FROM named g LEFT JOIN counted c USING (lang, source) GROUP BY ALL
), dense AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.group_n + s.v) AS p,
    1 + 1000000000::HUGEINT * (k.all_n + 1) // (s.lang_n + s.v) AS q
  FROM sums g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((
    SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM named a JOIN named b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 200
"""
