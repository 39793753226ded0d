"""Joining rows with figures of their own keys when a few keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds so many rows, and at least this share of all: at most 1 / HEAVY_SHARE keys are.
HEAVY_ROWS, HEAVY_SHARE = 100_000, 0.001


def join_figures(rows: DataFrame, figures: DataFrame, keys: list[str], n: str, heavy_rows: int = HEAVY_ROWS, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``figures``, which has one row per key, and in ``n`` how many of the rows hold it.

    ``figures`` tells which keys are heavy. Their rows never move: the at most 1,000 heavy keys are broadcast, and all
    other keys are joined by a shuffle: their number has no bound, and files of them are small for what they hold in
    memory, so no size of theirs makes them fit for a broadcast. ``how`` is inner, or left_semi to keep the rows of those keys only.
    """
    total = figures.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
    is_heavy = F.col(n) >= F.greatest(F.lit(heavy_rows), total * F.lit(HEAVY_SHARE))
    heavy, light = figures.where(is_heavy), figures.where(~is_heavy)
    by_map = rows.join(F.broadcast(heavy), keys, how)
    by_shuffle = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge"), keys, how)
    return by_map.unionByName(by_shuffle)
