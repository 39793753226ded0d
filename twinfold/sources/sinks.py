"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import formula_safe, slug


def formula_safe_table(df: DataFrame) -> DataFrame:
    """Every text column with formula starts defused."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({n: formula_safe(F.col(f"`{n}`")) for n in names})


# Quotes inside a value are doubled, and spaces stay.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table; an empty CSV still gets its header."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        formula_safe_table(df).write.mode(mode).options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(fmt).save(path)


def department_slugs(queue: DataFrame, column: str = "department") -> DataFrame:
    """(department, dept_slug): one file-safe name per department, collisions numbered.

    The window runs over the distinct departments that share a slug, not over rows.
    """
    names = queue.select(F.col(column).alias("department")).distinct().withColumn("base", slug("department"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("department"))
    return names.withColumn("n", n).select(
        "department",
        F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("dept_slug"))


def with_department(queue: DataFrame) -> DataFrame:
    pick = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("old_district", "new_district") if c in queue.columns]
    return queue.withColumn("department", F.coalesce(*pick, F.lit("unknown")))


def write_partitioned_queue(queue: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per department of the review queue."""
    rows = with_department(queue)
    named = rows.join(department_slugs(rows), "department")
    options = CSV_OPTIONS if fmt == "csv" else {}
    named.write.mode("overwrite").partitionBy("dept_slug").options(**options).format(fmt).save(path)


def _write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write the rows of one run in place of any that it wrote before; other runs are not touched.

    Spark replaces the partitions that the rows have, and the folder of a run
    appears as a whole when the job commits.
    """
    writer = df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def append_run_history(spark: SparkSession, row: dict, path: str) -> None:
    """Add one row of run figures; with a ``run_id``, a run that is written again leaves one row."""
    figures = {k: v for k, v in row.items() if k != "run_id"}
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in figures.items()])
    if "run_id" in row:
        _write_run(one, path, str(row["run_id"]))
    else:
        one.write.mode("append").parquet(path)


def append_audit_trail(trail: DataFrame, path: str, run_id: str) -> None:
    """Add the decisions of a run; earlier runs are never rewritten, and a run that is repeated replaces its own."""
    _write_run(trail, path, run_id)
