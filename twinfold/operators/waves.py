"""Hire dates shared by an unusual share of the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import text

MIN_RATE = 0.01


def wave_dates(pairs: DataFrame, min_rate: float = MIN_RATE, min_count: int = 1) -> DataFrame:
    """(new_hire_date, wave_count, total_pairs): dates held by at least ``min_rate`` of all pairs."""
    counts = pairs.groupBy(text("new_hire_date").alias("new_hire_date")).agg(
        F.count(F.lit(1)).alias("wave_count")
    )
    total = pairs.agg(F.count(F.lit(1))).scalar()
    share = F.col("wave_count") / F.col("total_pairs")
    return counts.withColumn("total_pairs", total).where(
        (F.col("new_hire_date") != "") & (share >= min_rate) & (F.col("wave_count") >= min_count)
    )


def flag_waves(pairs: DataFrame, waves: DataFrame | None, min_rate: float = MIN_RATE) -> DataFrame:
    """Add the boolean ``in_wave``.

    Broadcast is safe: at most 1 / min_rate dates can each hold that share.
    """
    if waves is None:
        return pairs.withColumn("in_wave", F.lit(False))
    if min_rate < 0.0001:
        hint = lambda df: df
    else:
        hint = F.broadcast
    dates = waves.select(F.col("new_hire_date").alias("_wave"))
    joined = pairs.join(hint(dates), text("new_hire_date") == F.col("_wave"), "left")
    return joined.withColumn("in_wave", F.col("_wave").isNotNull()).drop("_wave")
