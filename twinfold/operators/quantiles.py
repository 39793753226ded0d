"""Exact interpolated quantiles without gathering a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells per doubling of the size of a value.
CELLS = 64


def cell_of(value: Column) -> Column:
    """Number of the range a value lies in; grows with the value, finer near zero than far from it."""
    return F.signum(value) * F.rint(F.log1p(F.abs(value)) / F.log(F.lit(2.0)) * CELLS)


def exact_quantiles(counted: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """One row per group of ``keys`` with a column for every name in ``shares``.

    ``counted`` holds distinct values with their counts. The first pass adds
    the counts up per cell, a table that is short for any number of values,
    and tells which cell holds each wanted rank. The second pass numbers the
    values inside those cells only. Null values and null keys take no part.
    Without keys there is always one row, null if there are no values.
    """
    rows = counted.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_value"), F.col(weight).alias("_weight"),
        cell_of(F.col(value)).alias("_cell"))
    # The constant keeps a window without keys in the same form as one with keys.
    group = [F.lit(0), *keys]
    ahead = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "_cell").agg(F.sum("_weight").alias("_held")).withColumns({
        "_before": F.coalesce(F.sum("_held").over(ahead), F.lit(0)),
        "_last": F.sum("_held").over(Window.partitionBy(*group)) - 1,
    })
    positions = [F.col("_last") * F.lit(float(share)) for share in shares.values()]
    ranks = F.array(*[
        F.struct(F.lit(i).alias("at"), F.lit(upper).alias("upper"), p.alias("position"),
                 (F.ceil(p) if upper else F.floor(p)).alias("rank"))
        for i, p in enumerate(positions) for upper in (False, True)])
    inside = lambda start, held: lambda r: (r["rank"] >= F.col(start)) & (r["rank"] < F.col(start) + F.col(held))
    wanted = cells.withColumn("_ranks", F.filter(ranks, inside("_before", "_held"))).where(F.size("_ranks") > 0)

    earlier = Window.partitionBy(*group, "_cell").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.join(wanted.select(*keys, "_cell", "_before", "_ranks"), [*keys, "_cell"]).withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_weight").over(earlier), F.lit(0)))
    hits = near.select(*keys, "_value", F.explode(F.filter("_ranks", inside("_start", "_weight"))).alias("_r"))

    ends = {}
    for i in range(len(shares)):
        own = F.col("_r.at") == i
        ends[i] = (F.max(F.when(own & ~F.col("_r.upper"), F.col("_value"))),
                   F.max(F.when(own & F.col("_r.upper"), F.col("_value"))), F.max(F.when(own, F.col("_r.position"))))
    found = hits.groupBy(*keys).agg(*[
        F.struct(low.alias("low"), high.alias("high"), p.alias("p")).alias(f"_q{i}") for i, (low, high, p) in ends.items()])
    return found.select(*keys, *[_between(F.col(f"_q{i}")).alias(name) for i, name in enumerate(shares)])


def _between(q: Column) -> Column:
    low, high, p = q["low"], q["high"], q["p"]
    return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)


def quantile_struct(counted: DataFrame, value: str, weight: str, shares: dict[str, float]) -> Column:
    """The quantiles of a whole table as one struct, for a single-row aggregate beside it."""
    return exact_quantiles(counted, [], value, weight, shares).select(F.struct(*shares)).scalar()
