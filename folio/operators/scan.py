"""Scans in order that need no task to hold a whole group: slices of a bounded number of rows, then one value for each slice.

The order column is a number that rises by about one a row within a group (an index
or an event id); a slice is ``size`` of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _slice(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size).cast("long")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on &= a[c].eqNullSafe(b[f"{c}_"])
    return on


def sum_before(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int = 1 << 16) -> DataFrame:
    """rows with the sum of value over all rows of the same keys that come before: within a slice by a window, before it by the slices' sums."""
    rows = rows.withColumns({"_slice": _slice(order, size), "_value": value})
    own = W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"{c}_") for c in (*keys, "_slice")], F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    out = rows.join(sums, _same(rows, sums, [*keys, "_slice"])).withColumn(name, F.col("_own") + F.col("_before"))
    return out.drop("_slice", "_value", "_own", "_before", *[f"{c}_" for c in (*keys, "_slice")])


def states_before(rows: DataFrame, keys: list[str], order: str, step: Column, states: int, name: str, start: int = 0, size: int = 1 << 8) -> DataFrame:
    """rows with the state of a small automaton before each of them.

    ``step``: a row's transitions, an array with the next state for each of the ``states``. Transitions compose
    associatively: a slice's rows become one array, the slices of a group give the state at each slice's begin,
    and each slice is gone through again from there. Slices are cut by rank, so however far apart the orders of a
    group's rows are, they hold ``size`` rows each. Orders of a group differ.
    """
    rows = sum_before(rows.withColumn("_step", F.transform(step, lambda s: s.cast("int"))), keys, order, F.lit(1), "_rank")
    rows = rows.withColumn("_slice", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_step").alias("step"))))
    slices = rows.groupBy(*keys, "_slice").agg(steps.alias("steps"))
    none = F.array(*[F.lit(k) for k in range(states)])
    slices = slices.withColumn("whole", F.aggregate("steps", none, lambda a, x: F.transform(a, lambda s: F.get(x["step"], s))))
    groups = slices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slice", "whole"))).alias("all"))  # an array of a few numbers for each slice
    begin = F.aggregate(
        "all", F.struct(F.lit(start).alias("s"), F.array().cast("array<struct<_slice:bigint,begin:int>>").alias("out")),
        lambda a, x: F.struct(F.get(x["whole"], a["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(x["_slice"].alias("_slice"), a["s"].alias("begin")))).alias("out")),
        lambda a: a["out"],
    )
    begins = groups.select(*[F.col(c).alias(f"{c}_") for c in keys], F.explode(begin).alias("b")).select(*[f"{c}_" for c in keys], F.col("b._slice").alias("_slice_"), "b.begin")
    slices = slices.drop("whole").join(begins, _same(slices, begins, [*keys, "_slice"]))
    through = F.aggregate(
        "steps", F.struct(F.col("begin").alias("s"), F.array().cast(f"array<struct<at:{rows.schema[order].dataType.simpleString()},step:array<int>,s:int>>").alias("out")),
        lambda a, x: F.struct(F.get(x["step"], a["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), x["step"].alias("step"), a["s"].alias("s")))).alias("out")),
        lambda a: a["out"],
    )
    found = slices.select(*[F.col(c).alias(f"{c}_") for c in keys], F.explode(through).alias("o")).select(*[f"{c}_" for c in keys], F.col("o.at").alias(f"{order}_"), F.col("o.s").alias(name))
    found = found.groupBy(*[f"{c}_" for c in keys], f"{order}_").agg(F.min(name).alias(name))
    out = rows.join(found, _same(rows, found, [*keys, order]), "left")
    return out.drop("_slice", "_step", f"{order}_", *[f"{c}_" for c in keys])
