"""Blank tests and trimming.

Three blank rules live side by side because the three parts of the system
disagree on which words count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() and the regex class \s treat as whitespace.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = "[" + SPACE_CHARS + "]"

NULL_WORDS = ("", "nan", "none", "null")
AUDIT_NULL_WORDS = ("", "nan", "none", "null", "n/a", "na")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace, not only the space character."""
    return F.btrim(as_col(c).cast("string"), F.lit(SPACE_CHARS))


def text(c: Column | str) -> Column:
    """Trimmed text, NULL as the empty string."""
    return F.coalesce(strip(c), F.lit(""))


def folded(c: Column | str) -> Column:
    """Trimmed lower-case text, NULL as the empty string."""
    return F.lower(text(c))


def null_if_blank(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def blank_strict(c: Column | str) -> Column:
    return text(c) == ""


def blank_null_words(c: Column | str) -> Column:
    return folded(c).isin(*NULL_WORDS)


def blank_audit(c: Column | str) -> Column:
    return folded(c).isin(*AUDIT_NULL_WORDS)


def changed(old: Column | str, new: Column | str) -> Column:
    """Trimmed, case-blind inequality in which NULL and blank are the same."""
    return folded(old) != folded(new)


def changed_both_present(old: Column | str, new: Column | str) -> Column:
    """Text inequality that needs a value on both sides; never NULL."""
    o, n = as_col(old).cast("string"), as_col(new).cast("string")
    return F.coalesce((o != "") & (n != "") & (o != n), F.lit(False))


def changed_trimmed(old: Column | str, new: Column | str) -> Column:
    """Trimmed inequality in which a value against a blank counts as changed."""
    return text(old) != text(new)
