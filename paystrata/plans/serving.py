"""First come, first served over whole request tables, when every key value may be used once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paystrata.operators.components import connected_components
from paystrata.operators.ranking import global_row_number
from paystrata.sources.staging import staged

ORDER = "request_order"
#: Rounds over all open requests, before what is left is served along its chains.
ROUNDS = 4
#: Requests of one chain that one task serves at a time.
WINDOW = 100_000

_OPEN, _WON = 0, 1


def first_come(requests: DataFrame, keys: list[str], rounds: int = ROUNDS, window: int = WINDOW) -> DataFrame:
    """The requests that take effect when every key value may be used once.

    Requests are served in ``request_order``; one is refused when an accepted
    request before it has the same value in any key. NULL never collides. A
    request refused for one key does not hold its other keys, so the answer of
    a request can hang on a long chain of others. Only requests that share a
    value with another one are looked at further. Each round accepts whatever is
    first of the open ones in all of its keys and refuses what collides with
    that; grouped minima do it, so a value shared by a third of all requests is
    no hot task, and a value takes two rounds however often it is shared. What
    is still open after ``rounds`` hangs on long chains, see ``_along_chains``.

    Returns the accepted ``request_order`` values.
    """
    # A shared value is named by the first request that has it; equality of the
    # keys, under whatever collation, is left to the grouping.
    shared = staged(requests.select(ORDER, *keys), "first-come")
    names = [f"_shared{i}" for i in range(len(keys))]
    for key, name in zip(keys, names):
        first = shared.filter(F.col(key).isNotNull()).groupBy(key).agg(
            F.min(ORDER).cast("long").alias(name), F.count("*").alias("_n")).filter("_n > 1").select(key, name)
        shared = shared.join(first, key, "left")
    leads = _all(F.coalesce(F.col(name) == F.col(ORDER), F.lit(True)) for name in names)
    judged = staged(shared.select(ORDER, *names, F.when(leads, _WON).otherwise(_OPEN).alias("_state")), "first-come-round")
    accepted = [_won(judged)]
    judged = judged.filter(~_all(F.col(name).isNull() for name in names))
    for _ in range(rounds):
        if judged.filter(F.col("_state") == _OPEN).isEmpty():
            return reduce(DataFrame.unionByName, accepted)
        judged = staged(_round(judged, names), "first-come-round")
        accepted.append(_won(judged))
    left = staged(_round(judged, names).drop("_state"), "first-come-open")
    return reduce(DataFrame.unionByName, accepted + _along_chains(left, names, window))


def _all(conditions) -> Column:
    return reduce(Column.__and__, conditions)


def _won(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("_state") == _WON).select(ORDER)


def _round(judged: DataFrame, names: list[str]) -> DataFrame:
    """The open requests that do not collide with those that won the round before, each open or winning now."""
    rows = judged.filter(F.col("_state") == _OPEN)
    for name in names:
        value = judged.filter(F.col(name).isNotNull()).groupBy(name).agg(
            F.min(F.when(F.col("_state") == _OPEN, F.col(ORDER))).alias(f"_first{name}"), F.max("_state").alias(f"_taken{name}"))
        rows = rows.join(value, name, "left")
    free = _all(F.coalesce(F.col(f"_taken{name}") == _OPEN, F.lit(True)) for name in names)
    leads = _all(F.coalesce(F.col(f"_first{name}") == F.col(ORDER), F.lit(True)) for name in names)
    return rows.filter(free).select(ORDER, *names, F.when(leads, _WON).otherwise(_OPEN).alias("_state"))


def _along_chains(rows: DataFrame, names: list[str], window: int) -> list[DataFrame]:
    """Accepted requests of ``rows``, served component by component.

    Components do not affect each other. Their requests are numbered in order
    and served in windows: the next ``window`` requests of every component go to
    tasks, a component's to one, and what collides with their accepted values
    leaves before the next window. So there are as many steps as windows in the
    largest component, however long its chains are.
    """
    # Values are nodes of their own, beside the requests, which have natural numbers.
    links = reduce(DataFrame.unionByName, [
        rows.filter(F.col(name).isNotNull()).select(
            F.col(ORDER).cast("long").alias("a"), (-1 - (F.col(name) * len(names) + i)).alias("b")) for i, name in enumerate(names)])
    linked = rows.join(connected_components(links).withColumnRenamed("node", ORDER), ORDER)
    numbered = staged(global_row_number(linked, [F.col("component"), F.col(ORDER)], "_nth", start=0), "first-come-numbered")
    begins = numbered.groupBy("component").agg(F.min("_nth").alias("_begin"))
    waiting = staged(numbered.join(begins, "component").withColumn("_window", F.floor((F.col("_nth") - F.col("_begin")) / window))
                     .select(ORDER, "component", *names, "_window"), "first-come-waiting")
    last = waiting.agg(F.max("_window")).first()[0]
    accepted: list[DataFrame] = []
    kind = rows.schema[ORDER].dataType.simpleString()
    for step in range(0 if last is None else last + 1):
        mine = waiting.filter(F.col("_window") == step).select("component", ORDER, *names)
        served = staged(mine.repartition("component").sortWithinPartitions("component", ORDER).mapInArrow(
            _served, f"component long, {ORDER} {kind}, " + ", ".join(f"{name} long" for name in names)), "first-come-served")
        accepted.append(served.select(ORDER))
        if step < last:
            waiting = waiting.filter(F.col("_window") > step)
            for name in names:
                waiting = waiting.join(served.filter(F.col(name).isNotNull()).select(name), name, "left_anti")
            waiting = staged(waiting.select(ORDER, "component", *names, "_window"), "first-come-waiting")
    return accepted


def _served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Serve the requests of a task in a row; they are sorted by component and order.

    What is remembered are the values of one component's window.
    """
    component, used = None, []
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        kept = []
        for i, (mine, _, *values) in enumerate(zip(*columns)):
            if mine != component:
                component, used = mine, [set() for _ in values]
            if all(value is None or value not in taken for value, taken in zip(values, used)):
                kept.append(i)
                for value, taken in zip(values, used):
                    taken.add(value)
        yield batch.take(pa.array(kept, pa.int64()))
