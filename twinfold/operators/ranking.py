"""First rows per group without gathering whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(df: DataFrame, keys: list[str], order: list[Column] | list[str], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    The rank filter sits directly on the window, so Spark cuts every map
    output to ``n`` rows per group before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def examples(df: DataFrame, keys: list[str], value: str, order: str, n: int, name: str = "examples") -> DataFrame:
    """Per group, the ``value`` of its first ``n`` rows as an ordered array."""
    few = df.select(*keys, F.col(order).alias("_order"), F.col(value).alias("_value"))
    few = first_n(few, keys, ["_order"], n)
    gathered = F.sort_array(F.collect_list(F.struct("_order", "_value")))
    return few.groupBy(*keys).agg(gathered["_value"].alias(name))
