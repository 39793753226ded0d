"""Money parsing, deltas, ratios and labelled bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import as_col, text

# Band tables. A bound of None is open.
SALARY_BUCKETS = (
    ("0-100", 0, 100), ("100-1,000", 100, 1000), ("1,000-5,000", 1000, 5000),
    ("5,000-20,000", 5000, 20000), ("20,000+", 20000, None),
)
DAY_BUCKETS = (
    ("1-7", 1, 7), ("8-30", 8, 30), ("31-180", 31, 180), ("181-365", 181, 365),
    ("366-1095 (1-3yr)", 366, 1095), ("1096+ (3yr+)", 1096, None),
)
SALARY_RANGES = (
    ("Under $30k", 0, 30000), ("$30k-$60k", 30000, 60000), ("$60k-$100k", 60000, 100000),
    ("$100k-$150k", 100000, 150000), ("$150k-$200k", 150000, 200000), ("$200k+", 200000, None),
)
HOURS_PER_YEAR, PAY_PERIODS, CONVERSION_TOLERANCE = 2080, 26, 0.02

def number(c: Column | str) -> Column:
    """Plain numeric text to double, else NULL.

    The cast alone would also take NaN, 1d and 0x1p3: a number ends in a digit
    or a dot and has no x. That is cheaper to see than a pattern.
    """
    value = text(c)
    last = F.right(value, F.lit(1))
    plain = (last.between("0", "9") | (last == ".")) & ~value.contains("x") & ~value.contains("X")
    return F.when(plain, value.try_cast("double"))


def parse_money(c: Column | str) -> Column:
    value = as_col(c).cast("string")
    for symbol in ("$", ","):
        value = F.replace(value, F.lit(symbol), F.lit(""))
    return number(value)


def parse_money_loose(c: Column | str) -> Column:
    """Keep digits, dots and minus signs, then parse."""
    return number(F.regexp_replace(as_col(c).cast("string"), r"[^0-9.\-]", ""))


def parse_confidence(c: Column | str) -> Column:
    value = parse_money(c)
    return F.when(value.between(0.0, 1.0), value)


def money_delta(old: Column | str, new: Column | str) -> Column:
    return parse_money(new) - parse_money(old)


def money_ratio(old: Column | str, new: Column | str) -> Column:
    return F.try_divide(parse_money(new), parse_money(old))


def _near(ratio: Column, target: int) -> Column:
    return F.abs(ratio - target) / target <= CONVERSION_TOLERANCE


def conversion_of(old_salary: Column, new_salary: Column, old_rate: Column, new_rate: Column) -> Column:
    """Name of the unit conversion that explains a pay rate change, else NULL."""
    over_new = F.try_divide(old_salary, F.when(new_rate > 0, new_rate))
    over_old = F.try_divide(new_salary, F.when(old_rate > 0, old_rate))
    return (
        F.when(_near(over_new, HOURS_PER_YEAR), "annual_to_hourly")
        .when(_near(over_old, HOURS_PER_YEAR), "hourly_to_annual")
        .when(_near(over_old, PAY_PERIODS), "biweekly_to_annual")
        .when(_near(over_new, PAY_PERIODS), "annual_to_biweekly")
    )


def payrate_conversion(
    old_salary: Column | str, new_salary: Column | str,
    old_payrate: Column | str, new_payrate: Column | str,
) -> Column:
    return conversion_of(*[parse_money(c) for c in (old_salary, new_salary, old_payrate, new_payrate)])


def _bands(value: Column, table, closed: bool) -> Column:
    chain = None
    for label, low, high in table:
        test = value >= low
        if high is not None:
            test = test & ((value <= high) if closed else (value < high))
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def bucket_salary_delta(abs_delta: Column) -> Column:
    return _bands(abs_delta, SALARY_BUCKETS, closed=False)


def bucket_day_gap(abs_days: Column) -> Column:
    return _bands(abs_days, DAY_BUCKETS, closed=True)


def salary_range(value: Column) -> Column:
    return _bands(value, SALARY_RANGES, closed=False)


def _steps(value: Column, steps, default: str) -> Column:
    """First label whose floor the value reaches."""
    chain = None
    for floor, label in steps:
        chain = F.when(value >= floor, label) if chain is None else chain.when(value >= floor, label)
    return chain.otherwise(default)


def severity_band(old: Column, new: Column) -> Column:
    """Band of the relative change of two money texts."""
    o, n = parse_money(old), parse_money(new)
    share = F.abs(F.try_divide(n - o, o))
    return (
        F.when((text(old) == "") | (text(new) == ""), "missing")
        .when(share > 0.10, "high").when(share > 0.03, "medium").otherwise("low")
    )


def delta_band(old: Column, new: Column) -> Column:
    o, n = parse_money(old), parse_money(new)
    share = F.abs(F.try_divide(n - o, o))
    return _steps(share, ((0.50, ">=50%"), (0.25, "25-49%"), (0.10, "10-24%"), (0.03, "3-9%")), "<3%")


def anomaly_band(share: Column) -> Column:
    """Band of a signed relative change."""
    steps = (
        (1.0, "over_100_percent"), (0.50, "over_50_percent"),
        (0.25, "over_25_percent"), (0.15, "over_15_percent"),
    )
    return (
        F.when(share.isNull(), "invalid").when(share < 0, "negative")
        .when(share == 0, "no_change").otherwise(_steps(share, steps, "normal"))
    )


def rate_band(rate: Column) -> Column:
    return _steps(rate, ((0.40, "critical"), (0.25, "high"), (0.10, "medium")), "low")


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence.isNull(), "missing").when(confidence == 1.0, "exact")
        .when((confidence >= 0.97) & (confidence < 1.0), "high")
        .when((confidence >= 0.80) & (confidence < 0.97), "medium")
        .when(confidence < 0.80, "low")
    )


def review_severity(score: Column) -> Column:
    return _steps(score, ((90, "Critical"), (60, "High"), (30, "Medium")), "Low")


def report_severity(score: Column) -> Column:
    return _steps(score, ((70, "CRITICAL"), (40, "HIGH"), (20, "MEDIUM")), "LOW")


def readiness_score(safe_pct: Column, n_active_zero: Column, n_rejected: Column) -> Column:
    """Safe percentage less capped deductions, 0 to 100."""
    deductions = F.least(
        n_rejected * 10.0
        + F.least(n_active_zero * 0.1, F.lit(15.0))
        + F.when(safe_pct < 80.0, 2.0).otherwise(0.0),
        F.lit(45.0),
    )
    score = F.bround(safe_pct - deductions, 0).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def completeness_status(filled_pct: Column) -> Column:
    return _steps(
        filled_pct, ((99, "Complete"), (95, "Acceptable"), (80, "Needs Attention")), "Critical Gap"
    )


def plain_text(c: Column) -> Column:
    """A double as text: its shortest digits without an exponent, at least one decimal."""
    given = c.cast("double").cast("string")
    sign = F.when(given.startswith("-"), "-").otherwise("")
    mantissa = F.ltrim(F.substring_index(given, "E", 1), F.lit("-"))
    power = F.substring_index(given, "E", -1).try_cast("int")
    decimals = F.substring_index(mantissa, ".", -1)
    decimals = F.when(decimals == "0", "").otherwise(decimals)
    digits = F.concat(F.substring_index(mantissa, ".", 1), decimals)
    whole = F.length(decimals) <= power
    moved = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(whole, F.concat(digits, F.repeat(F.lit("0"), power - F.length(decimals)), F.lit(".0")))
        .otherwise(F.concat(F.left(digits, power + 1), F.lit("."), digits.substr(power + 2, F.length(digits))))
    )
    return F.when(given.contains("E"), F.concat(sign, moved)).otherwise(given)
