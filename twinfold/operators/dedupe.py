"""Keep the best row per identifier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import blank_strict, folded
from ..functions.dates import iso_date
from ..functions.numbers import number
from ..sources.snapshots import ROW, ensure_columns
from ..sources.staging import materialize
from .heavy import join_figures


def row_rank(row: str = ROW) -> Column:
    """Greatest wins: active, latest hire, highest salary, pay present, first in file."""
    salary = number("salary")
    return F.struct(
        (folded("worker_status") == "active").cast("int").alias("active"),
        iso_date("hire_date").alias("hired"),
        salary.alias("salary"),
        salary.isNotNull().cast("int").alias("has_salary"),
        number("payrate").isNotNull().cast("int").alias("has_rate"),
        (-F.col(row)).alias("order"),
    )


def losing_rows(df: DataFrame, column: str, row: str = ROW) -> DataFrame:
    """Row numbers that give way to a better row with the same non-blank id."""
    df = ensure_columns(df, ["worker_status", "hire_date", "salary", "payrate", column])
    keyed = df.where(~blank_strict(column)).select(row, folded(column).alias("_key"), row_rank(row).alias("_rank"))
    best = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("_rank").alias("_best"))
    winners = best.where("_n > 1").select("_key", "_n", (-F.col("_best.order")).alias("_winner"))
    return join_figures(keyed.select(row, "_key"), winners, ["_key"], "_n").where(F.col(row) != F.col("_winner")).select(row)


def dedupe_best(
    df: DataFrame, ids: tuple[str, ...] = ("worker_id", "recon_id"), row: str = ROW,
    stage: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """One row per non-blank id, for each id column in turn; blank ids never collapse.

    Only ids and ranks are shuffled, combined on the map side. The wide rows
    meet nothing but an anti join with the few losing row numbers, which needs
    no shuffle of theirs while that list is small enough to broadcast.
    """
    gone = None
    for column in ids:
        rest = df if gone is None else df.join(gone, row, "left_anti")
        losers = stage(losing_rows(rest, column, row), f"losers-{column}")
        gone = losers if gone is None else gone.unionByName(losers)
    return df if gone is None else df.join(gone, row, "left_anti")
