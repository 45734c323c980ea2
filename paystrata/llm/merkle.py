"""Merkle manifest of a data set: a digest per row, a root per group, a root of all.

Rows are put in order inside their group (a range partition, so a hot group is
no hot task) and cut into aligned blocks of ``arity ** depth`` nodes. A block
keeps each level of its part of the tree as one string of hex digests in a row:
a parent is the hash of a fixed-width substring of the level below, and the
siblings of a node are the substrings that flank it in its run. A block yields
one digest, and the blocks of a group are the nodes of the next tier, which is
built the same way until each group is one digest; these subroots, ordered by
group, are the nodes of a last tree. Everything is DataFrame expressions; what
a task holds is one block, and upper tiers are a block size smaller each time.

Proofs go down again: a node's siblings in its block come before those of the
block in the tier above, whose rows are joined by block and not by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paystrata.operators.ranking import global_row_number
from paystrata.sources.staging import staged

_HEX = 64
#: Levels of a tree that one block holds; 1,024 leaves to a block with two to a run.
DEPTH = 10
_POS_BITS = 33  # monotonically_increasing_id keeps the row number in 33 bits


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    """The digest of a row: of its framed values, one after the other."""
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that follows from a leaf and its (left, right) siblings, level by level."""
    return F.aggregate(siblings, leaf, lambda low, s: F.sha2(F.concat(s["left"], low, s["right"]), 256))


def proof_digest(siblings: Column) -> Column:
    """The digest of all siblings in a row."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """The tiers of all groups, and those of the tree over the groups' subroots."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    by: str
    arity: int
    depth: int

    def subroots(self) -> DataFrame:
        """(group, subroot) of every group; a null group is null."""
        return self.tiers[-1].select(_name().alias(self.by), F.col("root").alias("subroot"))

    def root(self) -> DataFrame:
        """(root): one row, or none for an empty table."""
        return self.top[-1].select("root")

    def proofs(self) -> DataFrame:
        """Every row's carried columns, ``leaf``, group, ``subroot``, ``root`` and ``siblings`` (left, right) from leaf to root."""
        above = None
        for tier in reversed(self.top):
            above = staged(_paths(tier, above, self.arity, self.depth), "merkle-paths")
        # One row per group from here on: what lies above its subroot.
        tops = staged(above.join(self.top[-1].select("group", "root"), "group").select(
            F.col("digest").alias("subroot"), "root", "siblings", F.col("carried.group").alias("group")), "merkle-tops")
        above = None
        for tier in reversed(self.tiers[1:]):
            above = staged(_paths(tier, above, self.arity, self.depth), "merkle-paths")
        rows = _paths(self.tiers[0], above, self.arity, self.depth, tops)
        return rows.select("carried.*", F.col("digest").alias("leaf"), _name().alias(self.by), "subroot", "root", "siblings")


def _name() -> Column:
    """The group from its non-null form, which orders null first and then by bytes."""
    return F.when(F.col("group") != "", F.expr("substring(group, 2)"))


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``place`` (from 0 inside the group, in the given order) and ``n`` (rows of the group)."""
    seq = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order).withColumn("seq", seq)
    numbered = staged(ranged.withColumn("slot", F.shiftright("seq", _POS_BITS)), "merkle-leaves")
    heads = staged(numbered.groupBy("slot", "group").agg(F.min("seq").alias("first"), F.count("*").alias("held")), "merkle-slots")
    # One row per slot of a group.
    earlier = Window.partitionBy("group").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = heads.select("slot", "group", "first", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("shift"),
                          F.sum("held").over(Window.partitionBy("group")).alias("n"))
    return numbered.join(staged(shifts, "merkle-shifts"), ["slot", "group"]).select(
        "group", (F.col("seq") - F.col("first") + F.col("shift")).alias("place"), "n", "digest", "carried")


def _tier(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """One row per aligned block of (group, place, n, digest, carried): its members, the strings of its levels, its digest."""
    size = arity ** depth
    blocks = nodes.withColumn("block", F.floor(F.col("place") / size)).groupBy("group", "block").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "digest", "carried"))).alias("members"))
    # As many levels as the whole group needs, at most ``depth``; a group of one node needs none.
    steps = F.size(F.filter(F.array(*[F.lit(arity ** j).cast("long") for j in range(depth)]), lambda power: power < F.col("n")))
    level = F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary")

    def parents(low: Column) -> Column:
        count = F.ceil(F.length(low) / (_HEX * arity)).cast("int")
        run = lambda i: F.substring(low, i * (_HEX * arity) + 1, F.lit(_HEX * arity))
        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.sha2(run(i), 256)), "").cast("binary")

    rounds = F.filter(F.array(*[F.lit(j) for j in range(1, depth + 1)]), lambda j: j <= F.col("steps"))
    built = blocks.withColumn("steps", steps).withColumn("levels", F.aggregate(
        rounds, F.array(level), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1))))))
    return built.withColumn("root", F.element_at("levels", -1).cast("string"))


def _tiers(nodes: DataFrame, arity: int, depth: int) -> list[DataFrame]:
    """Tiers from the given nodes up to one digest a group; their number grows with the logarithm of the largest group."""
    found = []
    while True:
        found.append(staged(_tier(nodes, arity, depth), "merkle-tier"))
        most = found[-1].agg(F.max("n")).first()[0]
        if most is None or most <= arity ** depth:
            return found
        nodes = found[-1].select("group", F.col("block").alias("place"), F.ceil(F.col("n") / arity ** depth).alias("n"),
                                 F.col("root").alias("digest"), F.lit(0).alias("carried"))


def _paths(tier: DataFrame, above: DataFrame | None, arity: int, depth: int, tops: DataFrame | None = None) -> DataFrame:
    """(group, place, digest, carried, siblings[, subroot, root]) of the members of a tier's blocks, from the paths of the tier above."""
    blocks = tier.drop("n", "root")
    rest = F.array().cast("array<struct<left:string,right:string>>")
    if above is not None:
        blocks = blocks.join(above.select("group", F.col("place").alias("block"), F.col("siblings").alias("above")), ["group", "block"])
        rest = F.col("above")
    if tops is not None:
        blocks = blocks.join(tops.select("group", "subroot", "root", F.col("siblings").alias("over")), "group")
        rest = F.concat(rest, F.col("over"))
    powers = F.array(*[F.lit(arity ** j) for j in range(depth)])

    def beside(level: Column, j: Column, i: Column) -> Column:
        at = F.floor(i / F.element_at(powers, j + 1)).cast("int")
        start = at - at % arity
        return F.struct(F.substring(level, start * _HEX + 1, (at - start) * _HEX).cast("string").alias("left"),
                        F.substring(level, (at + 1) * _HEX + 1, (start + arity - at - 1) * _HEX).cast("string").alias("right"))

    below = F.slice("levels", F.lit(1), F.col("steps"))
    rows = F.transform("members", lambda m, i: F.struct(
        m["place"].alias("place"), m["digest"].alias("digest"), m["carried"].alias("carried"),
        F.transform(below, lambda level, j: beside(level, j, i)).alias("own")))
    kept = ["subroot", "root"] if tops is not None else []
    spread = blocks.select("group", rest.alias("rest"), *kept, F.explode(rows).alias("row"))
    return spread.select("group", *kept, "row.place", "row.digest", "row.carried", F.concat("row.own", "rest").alias("siblings"))


def manifest(rows: DataFrame, columns: list[str], by: str, key: str, carry: dict[str, Column] | None = None,
             arity: int = 2, depth: int = DEPTH) -> Manifest:
    """The Merkle tree over ``rows``, digested over ``columns``, in order of ``key`` inside each value of ``by``.

    Nulls are digested as ``-`` and come first in any order. Rows that share a
    key are ordered by their digest, so repeated rows are leaves of their own
    and reruns agree. Any column may be null, a text empty or of any length; an
    empty table has no rows and no root. ``carry`` names further expressions
    that ``proofs`` returns beside each leaf. Other columns are not read, and
    may have any name.
    """
    shown = {key: F.col(key), **(carry or {})}
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    leaves = rows.select(group.alias("group"), F.col(key).alias("key"), row_digest([F.col(c) for c in columns]).alias("digest"),
                         F.struct(*[v.alias(name) for name, v in shown.items()]).alias("carried"))
    tiers = _tiers(_placed(leaves, [F.col("key").asc_nulls_first(), F.col("digest")]).select(
        "group", "place", "n", "digest", "carried"), arity, depth)
    subroots = staged(tiers[-1].select("group", F.col("root").alias("digest")), "merkle-subroots")
    count = subroots.count()
    numbered = global_row_number(subroots, [F.col("group")], "place", start=0)
    top = _tiers(numbered.select(F.lit("").alias("group"), "place", F.lit(count).cast("long").alias("n"), "digest",
                                 F.struct("group").alias("carried")), arity, depth)
    return Manifest(tiers, top, by, arity, depth)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark, folder: str) -> DataFrame:
    """Contract query: a manifest of all documents; every seventh doc_id by crc32 is presented with n_chars one larger."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = row_digest([F.col(c).cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    proofs = manifest(docs, FIELDS, "lang", "doc_id", carry={"presented": F.when(hit, changed)}).proofs()
    folded = fold(F.coalesce("presented", "leaf"), F.col("siblings"))
    return proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("siblings")).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH RECURSIVE framed AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head, n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    -- crc32, bit by bit over the eight bits of each digit
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda i:
      CASE WHEN i % 8 = 0 THEN ord(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT ELSE 0 END)),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)) AS c
  FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || tail) AS changed,
    coalesce(xor(c, 4294967295) % 7 = 0, false) AS hit
  FROM framed
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), low AS MATERIALIZED (
  SELECT lang, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(digest || coalesce(beside, '')), (n + 1) // 2
  FROM (SELECT *, lead(digest) OVER (PARTITION BY lang ORDER BY place) AS beside FROM low WHERE n > 1) WHERE place % 2 = 0
), subroots AS MATERIALIZED (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), high AS MATERIALIZED (
  SELECT 0 AS level, place, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(digest || coalesce(beside, '')), (n + 1) // 2
  FROM (SELECT *, lead(digest) OVER (ORDER BY place) AS beside FROM high WHERE n > 1) WHERE place % 2 = 0
), whole AS (
  SELECT digest AS root, level AS height FROM high WHERE n = 1
), steps AS MATERIALIZED (
  SELECT p.lang, p.place, l.level AS step, l.place AS beside_place, l.digest AS beside
  FROM placed p JOIN low l ON p.lang IS NOT DISTINCT FROM l.lang AND l.place = xor(p.place >> l.level, 1) AND l.n > 1
  UNION ALL
  SELECT p.lang, p.place, s.height + h.level, h.place, h.digest
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN high h ON h.place = xor(s.place >> h.level, 1) AND h.n > 1
), proofs AS (
  SELECT lang, place, string_agg(beside, '' ORDER BY step) AS siblings FROM steps GROUP BY lang, place
), folded AS (
  SELECT p.lang, p.place, p.doc_id, p.leaf, 0 AS step, CASE WHEN hit THEN changed ELSE leaf END AS digest, s.height + w.height AS height,
    s.subroot, w.root, s.height AS low_height, s.place AS high_place
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, whole w
  UNION ALL
  SELECT f.lang, f.place, f.doc_id, f.leaf, f.step + 1, sha256(
      CASE WHEN b.beside IS NULL THEN digest
        WHEN (CASE WHEN f.step < low_height THEN f.place >> f.step ELSE high_place >> (f.step - low_height) END) & 1 = 1 THEN b.beside || digest
        ELSE digest || b.beside END),
    height, subroot, root, low_height, high_place
  FROM folded f LEFT JOIN steps b ON f.lang IS NOT DISTINCT FROM b.lang AND f.place = b.place AND f.step = b.step WHERE f.step < f.height
)
SELECT f.doc_id, f.leaf, f.subroot, f.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = f.root AS verified
FROM folded f LEFT JOIN proofs p ON f.lang IS NOT DISTINCT FROM p.lang AND f.place = p.place WHERE f.step = f.height
"""
