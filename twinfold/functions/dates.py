"""Date parsing and day-gap rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import NULL_WORDS, folded, strip, text

# Formats tried in this order; the first that parses wins.
LENIENT_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d-MMM-yyyy", "MMM d yyyy", "MMMM d, yyyy",
)
BIRTH_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy",
    "yyyyMMdd", "d-MMM-yyyy", "MMM d yyyy", "MMMM d, yyyy",
)
# The range in which a bare number is read as a spreadsheet day serial.
SERIAL_MIN, SERIAL_MAX, SERIAL_ORIGIN = 20000, 60000, "1899-12-30"
# Day gaps that are a known one or two year shift.
YEAR_SHIFT_DAYS = (365, 366, 730, 731)

_CLOCK = r"[\sT]+\d{1,2}:\d{2}(:\d{2})?.*$"
_CLOCK_SECONDS = r"\s+\d{1,2}:\d{2}:\d{2}.*$"
_CLOCK_AMPM = r"(?i)\s+\d{1,2}:\d{2}\s*(AM|PM)$"


def _could_be(value: Column, fmt: str) -> Column:
    """A cheap look at the shape, because a failed parse is expensive."""
    if fmt == "yyyyMMdd":
        return F.length(value) == 8
    separator = "-" if "-" in fmt else "/" if "/" in fmt else " "
    at = F.instr(value, separator)
    return at == 5 if fmt.startswith("yyyy") else at > 1 if separator == " " else at.between(2, 3)


def _iso_shaped(value: Column) -> Column:
    return (F.length(value) == 10) & (F.substring(value, 5, 1) == "-") & (F.substring(value, 8, 1) == "-")


def _first_format(value: Column, formats: tuple[str, ...]) -> Column:
    tried = [F.when(_could_be(value, f), F.try_to_date(value, f)) for f in formats]
    return (
        F.when(value == "", F.lit(None).cast("date")).when(_iso_shaped(value), value.try_cast("date"))
        .otherwise(F.coalesce(*tried))
    )


def iso_date(c: Column | str) -> Column:
    """Date from exactly yyyy-MM-dd text, else NULL."""
    value = strip(c)
    return F.when(_iso_shaped(value), value.try_cast("date"))


def parse_date(c: Column | str, formats: tuple[str, ...] = LENIENT_FORMATS) -> Column:
    """Date or NULL; a time of day after the date is ignored."""
    value = text(c)
    day = F.when(value.contains(":"), F.regexp_replace(value, _CLOCK, "")).otherwise(value)
    return _first_format(day, formats)


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def parse_date_flexible(c: Column | str) -> Column:
    """ISO text from yyyyMMdd, a spreadsheet serial or a known format; '' when none fits."""
    value = text(c)
    serial = value.try_cast("int")
    parsed = (
        F.when(value.rlike(r"^\d{8}$"), F.try_to_date(value, "yyyyMMdd"))
        .when(
            value.rlike(r"^\d{4,6}$") & serial.between(SERIAL_MIN, SERIAL_MAX),
            F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), serial),
        )
        .otherwise(parse_date(value))
    )
    return F.coalesce(date_text(parsed), F.lit(""))


def clean_dob(c: Column | str) -> Column:
    """ISO text of a birth date tried against explicit formats; '' when none fits."""
    value = F.regexp_replace(text(c), _CLOCK_SECONDS, "")
    value = strip(F.regexp_replace(value, _CLOCK_AMPM, ""))
    parsed = F.when(~F.lower(value).isin(*NULL_WORDS), _first_format(value, BIRTH_FORMATS))
    return F.coalesce(date_text(parsed), F.lit(""))


def day_gap(old: Column | str, new: Column | str) -> Column:
    """Absolute days between two ISO texts; NULL unless both parse."""
    return F.abs(F.datediff(iso_date(new), iso_date(old)))


def pattern_of(days: Column, source: Column, has_other_fix: Column) -> Column:
    """Struct (action, reason) when the gap in days is a known systematic shift, else NULL."""
    applies = source.isin("worker_id", "pk")
    year = days.isin(*YEAR_SHIFT_DAYS)
    result = lambda action, reason: F.struct(
        F.lit(action).alias("action"), F.lit("hire_date:" + reason).alias("reason")
    )
    return (
        F.when(applies & (days == 1), result("APPROVE", "off_by_one_day_pattern"))
        .when(applies & year & ~has_other_fix, result("APPROVE", "systematic_year_shift_pattern"))
        .when(applies & year, result("REVIEW", "year_shift_with_other_mismatches"))
    )


def hire_date_pattern(
    old: Column | str, new: Column | str, source: Column | str, has_other_fix: Column
) -> Column:
    return pattern_of(day_gap(old, new), folded(source), has_other_fix)
