"""Long field-by-field differences and the patterns that repeat in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import SPACE_CLASS, folded, strip, text
from ..functions.numbers import number, parse_money_loose
from ..sources.snapshots import ROW, ensure_columns
from .ranking import examples

# Field groups of the severity rule.
MONEY_FIELDS = ("salary", "annual_salary", "base_salary", "payrate", "hourly_rate", "rate")
HIGH_RISK_FIELDS = (
    "worker_status", "employment_status", "status", "worker_type", "employee_type",
    "location_state", "state", "hire_date", "rehire_date", "termination_date", "last4_ssn",
    "ssn_last4", "ssn4", "dob", "date_of_birth",
)
CENT, DOLLAR = 0.01, 1.00
DELTA_FIELDS = ("salary", "payrate")


def field_severity(field: str, old: Column, new: Column) -> Column:
    """green, yellow or red for one field of a pair."""
    o, n = text(old), text(new)
    plain = lambda c: strip(F.regexp_replace(F.lower(c), SPACE_CLASS + "+", " "))
    equal = plain(o) == plain(n)
    name = field.strip().lower()
    if name in MONEY_FIELDS:
        gap = F.abs(parse_money_loose(o) - parse_money_loose(n))
        one_blank = (o == "") != (n == "")
        verdict = (
            F.when(gap <= CENT, "green").when(gap <= DOLLAR, "yellow").when(gap.isNotNull(), "red")
            .when(one_blank, "red").otherwise("yellow")
        )
    else:
        verdict = F.lit("red" if name in HIGH_RISK_FIELDS else "yellow")
    return F.when(equal, "green").otherwise(verdict)


def diff_pairs(old: DataFrame, new: DataFrame, matches: DataFrame, fields: list[str], row: str = ROW) -> DataFrame:
    """(old_row_id, new_row_id, field, old_value, new_value, severity) for fields that differ."""
    sides = []
    for prefix, side in (("old", old), ("new", new)):
        side = ensure_columns(side, fields)
        values = [F.col(f).cast("string").alias(f"{prefix}_{f}") for f in fields]
        sides.append(side.select(F.col(row).alias(f"{prefix}_row_id"), *values))
    wide = matches.select("old_row_id", "new_row_id").join(sides[0], "old_row_id").join(sides[1], "new_row_id")
    entries = F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"), F.col(f"new_{f}").alias("new_value"),
            field_severity(f, F.col(f"old_{f}"), F.col(f"new_{f}")).alias("severity"),
        )
        for f in fields
    ])
    found = F.filter(entries, lambda e: e["severity"] != "green")
    return wide.select("old_row_id", "new_row_id", F.explode(found).alias("d")).select(
        "old_row_id", "new_row_id", "d.*"
    )


def _percent_text(count: Column, total: Column) -> Column:
    share = F.bround(F.try_divide(count, total) * 100, 1)
    return F.coalesce(F.concat(share.cast("string"), F.lit("%")), F.lit("0%"))


def trends(diff: DataFrame, key: str = "record_key", total: Column | None = None) -> DataFrame:
    """Numeric deltas and value changes that repeat, with counts and three sample keys."""
    if total is None:
        total = diff.select(F.count_distinct(key).alias("n")).scalar()
    values = diff.select("field", key, text("old_value").alias("old_value"), text("new_value").alias("new_value"))
    deltas = values.where(F.col("field").isin(*DELTA_FIELDS)).withColumn(
        "delta", number("new_value") - number("old_value")
    ).where("delta is not null")

    kinds = []
    for name, rows, keys in (
        ("repeated_numeric_difference", deltas, ["field", "delta"]),
        ("repeated_value_change", values, ["field", "old_value", "new_value"]),
    ):
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where("count >= 2")
        samples = examples(rows, keys, key, key, 3, "sample_record_keys")
        joined = counts.join(samples, keys).withColumns({
            "pattern_type": F.lit(name),
            "sample_record_keys": F.array_join("sample_record_keys", ", "),
        })
        kinds.append(joined)
    numeric, changes = kinds
    numeric = numeric.withColumns({
        "old_value": F.lit(""), "new_value": F.lit(""),
        "possible_reason": F.lit(
            "Repeated pay delta detected. Common causes: COL overwrite, rounding, "
            "missed effective-dated change, mapping rule."
        ),
    })
    gone = (F.col("old_value") != "") & (F.col("new_value") == "")
    came = (F.col("old_value") == "") & (F.col("new_value") != "")
    changes = changes.withColumns({
        "delta": F.lit(None).cast("double"),
        "possible_reason": F.when(
            gone, "Value present in OLD but missing in NEW. Possible mapping loss, export gap, "
                  "or field not populated in new system.",
        ).when(
            came, "Value missing in OLD but present in NEW. Possible enrichment in new system "
                  "or old export missing column.",
        ).otherwise(F.concat(
            F.lit("Repeated change from '"), F.col("old_value"), F.lit("' to '"), F.col("new_value"), F.lit("'."))),
    })
    return numeric.unionByName(changes).withColumn(
        "percent_of_matched", _percent_text(F.col("count"), total)
    )


def key_overlap(old: DataFrame, new: DataFrame, keys: dict[str, tuple[str, ...]], min_length: int = 1) -> DataFrame:
    """Per key: distinct values on each side, how many are shared, and blank rows.

    Every key of both sides goes through one aggregate, so repeated values are
    combined before they are moved.
    """
    needed = sorted({c for parts in keys.values() for c in parts})
    sides = []
    for flag, side in ((1, old), (0, new)):
        side = ensure_columns(side, needed)
        entries = F.array(*[
            F.struct(
                F.lit(name).alias("key_name"),
                F.when(
                    reduce(lambda a, b: a | b, [text(p) != "" for p in parts]),
                    F.concat_ws("|", *[text(p) for p in parts]),
                ).otherwise("").alias("value"),
            )
            for name, parts in keys.items()
        ])
        sides.append(side.select(F.explode(entries).alias("e"), F.lit(flag).alias("is_old")).select("e.*", "is_old"))
    rows = sides[0].unionByName(sides[1]).groupBy("key_name", "value").agg(
        F.sum("is_old").alias("in_old"), (F.count(F.lit(1)) - F.sum("is_old")).alias("in_new")
    )
    usable = F.length("value") >= min_length
    o, n = F.col("in_old") > 0, F.col("in_new") > 0
    blank = F.col("value") == ""
    return rows.groupBy("key_name").agg(
        F.count_if(usable & o).alias("unique_old"), F.count_if(usable & n).alias("unique_new"),
        F.count_if(usable & o & n).alias("overlap"),
        F.coalesce(F.sum(F.when(blank, F.col("in_old"))), F.lit(0)).alias("blank_old"),
        F.coalesce(F.sum(F.when(blank, F.col("in_new"))), F.lit(0)).alias("blank_new"),
        F.coalesce(
            F.bround(100 * F.sum(F.when(blank, F.col("in_old"))) / F.sum("in_old"), 2), F.lit(0.0)
        ).alias("blank_old_pct"),
        F.coalesce(
            F.bround(100 * F.sum(F.when(blank, F.col("in_new"))) / F.sum("in_new"), 2), F.lit(0.0)
        ).alias("blank_new_pct"),
    )


def shared_values(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values present on both sides."""
    side = lambda df: df.select(text(column).alias(column)).where(F.col(column) != "")
    return side(old).intersect(side(new))


def only_in(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-blank key values of ``left`` that ``right`` does not have."""
    key = lambda df: df.select(*[folded(c).alias(c) for c in columns]).distinct()
    return key(left).join(key(right), columns, "left_anti")
