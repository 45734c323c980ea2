"""Mixing sources to target weights by systematic sampling (no Python in the plan).

Each document of a source is expected target / source_size times. Within its
source, documents are put in order of size, the expected copies are summed up
along that order, one offset in [0, 1) is added, and a document is emitted once
for every whole number its stretch of the sum crosses. Because every document
of a source is expected equally often, the prefix sum is ordinal times rate;
the order by size makes the sample a stratified one, so the words taken differ
from the target by little more than one long document. The offset is the one of
``OFFSETS`` random ones that brings the words taken nearest to the target.

A window over a whole source would sort a hot source in one task. Instead the
(source, size, doc_id) rows are range-partitioned and written once; rows are
numbered inside each slot, and each slot is shifted by what earlier slots hold
of the source. Rows that agree in all three (a source may hold many of one size
without a doc_id) are told apart by their place in the input, so they spread over
slots as well; which of them is which makes no difference. Only the sources themselves (one row each, already summed) pass
through one window.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paystrata.llm.words import word_count
from paystrata.sources.staging import staged

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
OFFSETS = 16
_SLOTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources get weights in code point order, null last. The whole size is shared
    by weight; a source stops at ``most`` times its size and the excess goes to
    the others by weight, until none is above. Sources are capped in order of
    size / weight, so the capped ones are a prefix of that order: the longest
    whose last member is below its share of what the earlier ones leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long"))
    need = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ordered = (
        weighted
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left_size", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", most * F.col("source_size") * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
        .withColumn("free_from", F.max(F.when(~F.col("capped"), F.struct("left_weight", "left_size"))).over(everything))
    )
    share = F.col("free_from")["left_size"] * F.col("weight") / F.col("free_from")["left_weight"]
    return ordered.select("source", "source_size", F.when(
        F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def offset_of(source: Column, number: int) -> Column:
    """A random offset of a source: a multiple of 2^-20 in [0, 1), fixed by its name and the number."""
    digest = F.md5(F.concat(F.lit(f"mix:{number}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / (1 << 20)


def _copies(rate: Column, offset: Column, most: int) -> Column:
    """Whole numbers that a document's stretch of the prefix sum crosses."""
    ordinal = F.col("ordinal")
    return F.least(F.floor(ordinal * rate + offset) - F.floor((ordinal - 1) * rate + offset), F.lit(most)).cast("long")


def range_slots(docs: DataFrame, slots: int) -> DataFrame:
    """(doc_id, source, size, tie, slot): the documents in ranges of about equal numbers of rows."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("tie"))
    ranged = sized.repartitionByRange(slots, F.col("source").asc_nulls_last(), "size", F.col("doc_id").asc_nulls_last(), "tie")
    return ranged.withColumn("slot", F.spark_partition_id())


def mixed_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document.

    Null and empty texts have size 0 and, like documents of a source without
    words, take no words; those of a source without words get no copies. Null
    sources form one source. Repeated rows are counted as often as they occur.
    Reruns agree: the order and the offset depend on the rows alone.
    """
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = staged(range_slots(docs, slots), "mix-sizes")
    held = staged(numbered.groupBy("slot", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-slots")
    targets = source_targets(held.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("slot", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    plan = shift.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    inside = Window.partitionBy("slot", "source").orderBy("size", F.col("doc_id").asc_nulls_last(), "tie")
    ranked = numbered.withColumn("place", F.row_number().over(inside))
    placed = ranked.alias("r").join(
        plan.alias("p"), (F.col("r.slot") == F.col("p.slot")) & F.col("r.source").eqNullSafe(F.col("p.source"))).select(
            "doc_id", "r.source", "size", "source_size", "target", (F.col("place") + F.col("shift")).alias("ordinal"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    taken = [F.sum(F.col("size") * _copies(rate, offset_of(F.col("source"), k), most)) for k in range(OFFSETS)]
    away = [F.abs(words - F.first("target")).alias(f"away{k}") for k, words in enumerate(taken)]
    best = placed.groupBy("source").agg(*away).select(F.col("source").alias("name"), F.least(*[
        F.struct(F.col(f"away{k}").alias("away"), F.lit(k).alias("k"), offset_of(F.col("source"), k).alias("offset"))
        for k in range(OFFSETS)])["offset"].alias("offset"))
    return placed.join(best, F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "copies", _copies(rate, F.col("offset"), most)).drop("ordinal", "name", "offset")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mixed corpus: every document as often as the sample takes it, with its columns.

    A document occurs 0 to ``most`` times. Rows that share doc_id, source and
    size share the copies of them all evenly, the rest going to the first rows.
    These are numbered by slots of a salt, as there may be many without a doc_id.
    """
    picked = staged(mixed_copies(docs, weights, most).groupBy("doc_id", "source", "size").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0"), "mix-copies")
    renamed = picked.select(*[F.col(c).alias(f"__{c}") for c in picked.columns])
    sized = docs.withColumn("__words", word_count(F.col("text")))
    mine = (F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source"))
            & (F.col("__words") == F.col("__size")))
    # The copies grow with the documents, so they are never broadcast: each text is shuffled once, at any size.
    salt = (F.pmod(F.xxhash64("text"), F.lit(_SLOTS)) * _SLOTS + F.floor(F.rand(0) * _SLOTS)).cast("int")
    taken = staged(sized.join(renamed.hint("merge"), mine).withColumn("__salt", salt), "mix-taken")
    alone = taken.filter("__rows = 1").withColumn("__times", F.col("__copies"))
    shared = taken.filter("__rows > 1")
    group = ["__doc_id", "__source", "__size"]
    held = shared.groupBy(*group, "__salt").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select(*[F.col(c).alias(f"{c}_of") for c in (*group, "__salt")], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    place = F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(F.xxhash64("text")))
    numbered = shared.withColumn("__place", place).join(shifts, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*group, "__salt")]))
    evenly = F.floor(F.col("__copies") / F.col("__rows")) + F.when(
        F.col("__place") + F.col("__shift") <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    rows = alone.select(*docs.columns, "__times").unionByName(numbered.withColumn("__times", evenly).select(*docs.columns, "__times"))
    times = F.col("__times").cast("int")
    return rows.filter(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op2_mix_sources(spark, folder: str) -> DataFrame:
    """Contract query: all documents, weights 1, 2, 3, at most three copies."""
    copies = mixed_copies(spark.read.parquet(f"{folder}/documents.parquet"))
    return copies.select("doc_id", "source", "size", "source_size", "target", "copies",
                         (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), sums AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(source_size) OVER w, 0) AS size_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, total - 3 * size_before AS left_size, all_weight - weight_before AS left_weight,
    3 * source_size * (all_weight - weight_before) <= (total - 3 * size_before) * weight AS capped FROM sums
), free AS (
  SELECT arg_max(left_size, left_weight) FILTER (NOT capped) AS left_size,
    max(left_weight) FILTER (NOT capped) AS left_weight FROM capped
), targets AS (
  SELECT c.source, c.source_size, CASE WHEN c.capped THEN (3 * c.source_size)::DOUBLE
    ELSE (f.left_size * c.weight)::DOUBLE / f.left_weight::DOUBLE END AS target
  FROM capped c, free f
), placed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) AS ordinal
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), offsets AS (
  SELECT source, k, ('0x' || substr(md5('mix:' || k || ':' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start
  FROM targets, range(16) r(k)
), tried AS (
  SELECT p.*, o.k, least(floor(ordinal::DOUBLE * rate + start) - floor((ordinal - 1)::DOUBLE * rate + start), 3)::BIGINT AS copies
  FROM placed p JOIN offsets o ON p.source IS NOT DISTINCT FROM o.source
), best AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies)::DOUBLE - any_value(target)), k) AS n, k
  FROM tried GROUP BY source, k
)
SELECT t.doc_id, t.source, t.size, t.source_size, t.target, t.copies, t.copies * t.size AS taken
FROM tried t JOIN best b ON b.n = 1 AND b.k = t.k AND b.source IS NOT DISTINCT FROM t.source
"""
