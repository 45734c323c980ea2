"""Ranks over whole tables and over few-valued groups, without a single task.

A plain window over a whole table, or over a department that holds a third of
it, sorts all of those rows in one task. Here the rows are range-partitioned by
(value descending, unique tie-break) instead, so that every *slot* holds a
consecutive run of the final order, however often one value or group repeats.
Ranks are computed inside the slots and then shifted by what the earlier slots
hold. The shifts come from an aggregate with one row per slot and group.

Range boundaries are sampled, so a second evaluation could cut elsewhere; the
slots are therefore written once (see ``sources.staging``) before anything is
derived from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paystrata.schema import MONEY_SUM
from paystrata.sources.staging import staged

_SEQ, _SLOT, _POS = "_seq", "_slot", "_pos"
_POS_BITS = 33  # monotonically_increasing_id keeps the row number in 33 bits


def _ranged(df: DataFrame, order: list[Column], slots: int | None, numbered: bool = True) -> DataFrame:
    """Rows in total order: ``_slot`` ascending, then (if numbered) ``_pos`` from 0 inside it.

    Without an explicit slot count the adaptive planner merges small adjacent
    ranges, which keeps the order.
    """
    spread = df.repartitionByRange(slots, *order) if slots else df.repartitionByRange(*order)
    if not numbered:
        return spread.withColumn(_SLOT, F.spark_partition_id())
    return (
        spread.sortWithinPartitions(*order)
        .withColumn(_SEQ, F.monotonically_increasing_id())
        .withColumn(_SLOT, F.shiftright(_SEQ, _POS_BITS).cast("int"))
        .withColumn(_POS, F.col(_SEQ).bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        .drop(_SEQ)
    )


def _before(amount: str, window) -> Column:
    """Running sum over the earlier rows of the window."""
    return F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def global_row_number(df: DataFrame, order: list[Column], name: str, start: int = 1,
                      slots: int | None = None) -> DataFrame:
    """Number the rows from ``start`` without gaps in the given total order.

    ``order`` must end on a unique key for a repeatable result.
    """
    rows = staged(_ranged(df, order, slots), "row-number")
    # One row per slot: as many as the range partitioning has partitions.
    shifts = (
        rows.groupBy(_SLOT).agg(F.count("*").alias("_n"))
        .select(_SLOT, _before("_n", Window.orderBy(_SLOT)).alias("_shift"))
    )
    return (
        rows.join(F.broadcast(shifts), _SLOT)
        .withColumn(name, (F.col("_shift") + F.col(_POS) + start).cast("long"))
        .drop(_SLOT, _POS, "_shift")
    )


@dataclass(frozen=True)
class Level:
    """One grouping of the ranked rows and the output columns wanted from it."""

    columns: tuple[str, ...] = ()
    row: str | None = None     # ROW_NUMBER, ties by the tie-break
    rank: str | None = None    # RANK, by value alone
    dense: str | None = None   # DENSE_RANK, by value alone
    count: str | None = None   # rows of the group
    total: str | None = None   # sum of the value over the group




def _join_on(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join in which a NULL key matches a NULL key."""
    renamed = right.select([F.col(c).alias(f"_k_{c}") if c in columns else F.col(c)
                            for c in right.columns])
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    return left.join(renamed, condition).drop(*[f"_k_{c}" for c in columns])


def _local_ranks(rows: DataFrame, value: str, tie_break: list[str], levels: list[Level]) -> DataFrame:
    """Ranks inside each slot; one shuffle by slot serves every level."""
    by_value = F.col(value).desc()
    full_order = [by_value, *[F.col(c) for c in tie_break]]
    for i, level in enumerate(levels):
        group = Window.partitionBy(_SLOT, *level.columns)
        if level.row and level.columns:
            rows = rows.withColumn(f"_row{i}", F.row_number().over(group.orderBy(*full_order)))
        if level.dense:
            rows = rows.withColumn(f"_dense{i}", F.dense_rank().over(group.orderBy(by_value)))
        if level.rank:
            rows = rows.withColumn(f"_rank{i}", F.rank().over(group.orderBy(by_value)))
    return rows


def _slot_groups(rows: DataFrame, value: str, levels: list[Level]) -> DataFrame:
    """One row per slot and finest group: counts, edge values, edge tie sizes."""
    aggregates = [F.count("*").alias("n"), F.max(value).alias("top"), F.min(value).alias("bottom"),
                  F.sum(value).cast(MONEY_SUM).alias("total")]
    for i, level in enumerate(levels):
        if level.rank:
            aggregates += [F.count_if(F.col(f"_rank{i}") == 1).alias(f"n_top{i}"),
                           F.max(f"_rank{i}").alias(f"last_rank{i}")]
        if level.dense:
            aggregates.append(F.max(f"_dense{i}").alias(f"n_values{i}"))
    return rows.groupBy(_SLOT, *levels[-1].columns).agg(*aggregates)


def _level_shifts(groups: DataFrame, i: int, level: Level) -> DataFrame:
    """What the earlier slots add to the local ranks of one level.

    Every window below runs over at most one row per slot.
    """
    columns = list(level.columns)
    aggregates = [F.sum("n").alias("n"), F.max("top").alias("top"), F.min("bottom").alias("bottom"),
                  F.sum("total").cast(MONEY_SUM).alias("total")]
    if level.rank:
        aggregates += [F.sum(f"n_top{i}").alias("n_top"), F.max(f"last_rank{i}").alias("last_rank")]
    if level.dense:
        aggregates.append(F.max(f"n_values{i}").alias("n_values"))
    shifts = groups.groupBy(_SLOT, *columns).agg(*aggregates)

    group = Window.partitionBy(*columns)
    in_order = group.orderBy(_SLOT)
    if level.row or level.rank:
        shifts = shifts.withColumn(f"_before{i}", _before("n", in_order))
    if level.dense:
        # A value cut by a slot boundary must count once.
        joined_on = F.when(F.col("top") == F.lag("bottom").over(in_order), 1).otherwise(0)
        shifts = (
            shifts.withColumn("cut", joined_on)
            .withColumn(f"_dense_before{i}", _before("n_values", in_order) - F.sum("cut").over(
                in_order.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("cut")
        )
    if level.count:
        shifts = shifts.withColumn(level.count, F.sum("n").over(group))
    if level.total:
        shifts = shifts.withColumn(level.total, F.sum("total").over(group).cast(MONEY_SUM))
    if level.rank:
        shifts = _join_on(shifts, _carried_ties(shifts, i, columns), [_SLOT, *columns])
        shifts = shifts.withColumnRenamed("top", f"_top{i}")
    produced = [c for c in (level.count, level.total) if c]
    return shifts.select(_SLOT, *columns, *produced,
                         *[c for c in shifts.columns if c.startswith("_") and c != _SLOT])


def _carried_ties(shifts: DataFrame, i: int, columns: list[str]) -> DataFrame:
    """Rows of earlier slots that tie with the first value of this slot.

    A value that spans slots is the last of one and the first of the next, so
    the edges of each slot are enough to count it.
    """
    edge = F.explode(F.when(F.col("top") == F.col("bottom"),
                            F.array(F.struct(F.lit(True).alias("first"), F.col("top").alias("value"),
                                             F.col("n_top").alias("ties"))))
                     .otherwise(F.array(
                         F.struct(F.lit(True).alias("first"), F.col("top").alias("value"),
                                  F.col("n_top").alias("ties")),
                         F.struct(F.lit(False).alias("first"), F.col("bottom").alias("value"),
                                  (F.col("n") - F.col("last_rank") + 1).alias("ties")))))
    edges = shifts.select(_SLOT, *columns, edge.alias("edge")).select(_SLOT, *columns, "edge.*")
    same_value = Window.partitionBy(*columns, "value").orderBy(_SLOT)
    return (
        edges.withColumn(f"_tied{i}", _before("ties", same_value))
        .filter("first").select(_SLOT, *columns, f"_tied{i}")
    )


def ranked(df: DataFrame, value: str, tie_break: list[str], levels: list[Level],
           slots: int | None = None) -> DataFrame:
    """Add ranks by ``value`` descending at several nested grouping levels.

    ``levels`` go from coarse to fine, each level's columns extending the one
    before. ``value`` must not be NULL; ``tie_break`` must be unique.
    """
    for coarse, fine in zip(levels, levels[1:]):
        if fine.columns[:len(coarse.columns)] != coarse.columns:
            raise ValueError("each level must extend the columns of the level before it")
    order = [F.col(value).desc(), *[F.col(c) for c in tie_break]]
    placed = _ranged(df, order, slots, numbered=any(l.row and not l.columns for l in levels))
    if any((l.row and l.columns) or l.rank or l.dense for l in levels):
        placed = placed.repartition(slots, _SLOT) if slots else placed.repartition(_SLOT)
    rows = staged(_local_ranks(placed, value, tie_break, levels), "ranked-rows")

    finest = list(levels[-1].columns)
    groups = _slot_groups(rows, value, levels)
    if not finest:
        # One row per slot: as many as the range partitioning has partitions.
        out = _join_on(rows, F.broadcast(_level_shifts(groups, 0, levels[0])), [_SLOT])
    else:
        # One row per slot and group, which may be many: joined by its written size.
        groups = staged(groups, "slot-groups")
        shifts = groups.select(_SLOT, *finest)
        for i, level in enumerate(levels):
            shifts = _join_on(shifts, _level_shifts(groups, i, level), [_SLOT, *level.columns])
        out = _join_on(rows, staged(shifts, "slot-shifts"), [_SLOT, *finest])

    for i, level in enumerate(levels):
        before = F.col(f"_before{i}") if (level.row or level.rank) else None
        if level.row:
            local = F.col(f"_row{i}") if level.columns else F.col(_POS) + 1
            out = out.withColumn(level.row, (before + local).cast("long"))
        if level.rank:
            tied = F.when(F.col(value) == F.col(f"_top{i}"), F.col(f"_tied{i}")).otherwise(0)
            out = out.withColumn(level.rank, (before - tied + F.col(f"_rank{i}")).cast("long"))
        if level.dense:
            out = out.withColumn(level.dense,
                                 (F.col(f"_dense_before{i}") + F.col(f"_dense{i}")).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns
                      and c not in {n for l in levels for n in (l.row, l.rank, l.dense, l.count, l.total)}])


def ntile_of(buckets: int, row: Column, rows: Column) -> Column:
    """NTILE from a row number and the size of its group."""
    size = F.floor(rows / buckets)
    larger = rows - size * buckets          # the first buckets hold one row more
    in_larger = larger * (size + 1)
    return F.when(row <= in_larger, F.floor((row - 1) / (size + 1)) + 1).otherwise(
        larger + F.floor((row - in_larger - 1) / F.greatest(size, F.lit(1))) + 1).cast("long")
