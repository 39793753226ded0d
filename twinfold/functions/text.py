"""String, identifier and name expressions, all evaluated inside the JVM."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import SPACE_CLASS, as_col, folded, strip, text

# Name suffixes and the form they are shown in.
SUFFIX_DISPLAY = {
    "jr": "Jr.", "sr": "Sr.",
    "ii": "II", "iii": "III", "iv": "IV", "v": "V",
    "esq": "Esq.", "phd": "PhD", "md": "MD",
}
# Nicknames replaced in the first token of a name.
NICKNAMES = {
    "jon": "john", "johnny": "john", "mike": "michael", "rob": "robert",
    "bob": "robert", "bill": "william", "liz": "elizabeth",
    "beth": "elizabeth", "kate": "katherine",
}
# Worker type synonyms.
WORKER_TYPES = {
    "full time": "regular", "full-time": "regular",
    "part time": "regular", "part-time": "regular",
    "temp": "contingent", "temporary": "contingent",
    "contractor": "contingent", "contract": "contingent",
}
# State names that have an abbreviation.
STATE_NAMES = {"texas": "tx", "florida": "fl", "california": "ca", "new york": "ny"}
# Street words and their short forms, applied in this order.
STREET_WORDS = (
    ("street", "st"), ("avenue", "ave"), ("road", "rd"), ("boulevard", "blvd"),
    ("drive", "dr"), ("lane", "ln"), ("suite", "ste"), ("apartment", "apt"),
)
# Words that stand for "no plan" in a benefit plan list.
EMPTY_PLAN_WORDS = (
    "", "none", "no plan", "not enrolled", "waived", "waive", "declined", "decline",
)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a small fixed map, NULL when the key is not in it."""
    return F.element_at(literal_map(values), key)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_CLASS + "+", " ")


def norm_str(c: Column | str) -> Column:
    return squeeze(text(c))


def norm_id(c: Column | str) -> Column:
    return folded(c)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, str]:
    """Compatibility folds generated from the Unicode database.

    Characters that fold to one ASCII character go into one ``translate``;
    those that fold to several are looked up in a map, which is given as JSON.
    """
    source, target, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(ch)
            target.append(plain)
        elif len(plain) > 1:
            several[ch] = plain
    return "".join(source), "".join(target), json.dumps(several)


def ascii_fold(c: Column | str) -> Column:
    """Accents off, everything outside ASCII dropped."""
    source, target, several = _fold_table()
    value = as_col(c)
    folded_value = F.translate(value, source, target)
    # One constant map; only characters still outside ASCII are looked up.
    table = F.from_json(F.lit(several), "map<string,string>")
    characters = F.regexp_extract_all(folded_value, F.lit(r"([\s\S])"), F.lit(1))
    spelled = F.array_join(F.transform(
        characters, lambda ch: F.when(ch.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_element_at(table, ch), F.lit(""))).otherwise(ch)), "")
    folded_value = F.when(folded_value.rlike(r"[^\x00-\x7F]"), spelled).otherwise(folded_value)
    return F.when(value.rlike(r"[^\x00-\x7F]"), folded_value).otherwise(value)


def norm_name(c: Column | str, strip_accents: bool = False) -> Column:
    value = norm_str(c)
    if strip_accents:
        value = ascii_fold(value)
    value = F.regexp_replace(F.lower(value), "[^a-z\\-'" + SPACE_CLASS[1:], "")
    return strip(squeeze(value))


def full_name_norm(first: Column | str, last: Column | str) -> Column:
    joined = F.concat(norm_name(first), F.lit(" "), norm_name(last))
    return F.nullif(strip(joined), F.lit(""))


def split_first_middle(c: Column | str) -> Column:
    """Struct (first, middle) from a given-name field."""
    name = norm_name(c, strip_accents=True)
    parts = F.split(name, " ")
    second = F.get(parts, 1)
    one_given_name = (F.size(parts) == 2) & (F.length(second) == 2)
    whole = (F.size(parts) == 1) | one_given_name
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " ")
    return F.struct(
        F.when(whole, name).otherwise(F.get(parts, 0)).alias("first"),
        F.when(whole, F.lit(None).cast("string")).otherwise(rest).alias("middle"),
    )


def strip_suffix(c: Column | str) -> Column:
    """Struct (last, suffix): a trailing suffix word moves to its display form."""
    name = norm_name(c, strip_accents=True)
    parts = F.split(name, " ")
    shown = lookup(SUFFIX_DISPLAY, F.get(parts, F.size(parts) - 1))
    found = (F.size(parts) >= 2) & shown.isNotNull()
    body = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " ")
    return F.struct(
        F.when(found, body).otherwise(name).alias("last"),
        F.when(found, shown).alias("suffix"),
    )


def name_components(
    first: Column | str, last: Column | str, middle: Column | str
) -> dict[str, Column]:
    """first_name_norm, last_name_norm, middle_name (explicit wins) and suffix."""
    given, family = split_first_middle(first), strip_suffix(last)
    blank_to_null = lambda x: F.nullif(x, F.lit(""))
    return {
        "first_name_norm": blank_to_null(given["first"]),
        "last_name_norm": blank_to_null(family["last"]),
        "middle_name": F.coalesce(blank_to_null(norm_str(middle)), blank_to_null(given["middle"])),
        "suffix": family["suffix"],
    }


def norm_basic(c: Column | str) -> Column:
    """Lower case, punctuation and hyphens to single spaces."""
    value = F.regexp_replace(folded(c), r"[^\p{L}\p{N}_]+", " ")
    return strip(value)


def nickname_name(c: Column | str) -> Column:
    name = norm_basic(c)
    parts = F.split(name, " ")
    first = F.get(parts, 0)
    formal = F.coalesce(lookup(NICKNAMES, first), first)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.array_join(F.concat(F.array(formal), rest), " ")


def last_token(c: Column | str) -> Column:
    parts = F.split(strip(squeeze(text(c))), " ")
    return F.get(parts, F.size(parts) - 1)


def name_prefix(c: Column | str, n: int = 3) -> Column:
    return F.substring(norm_basic(c), 1, n)


def extract_last4(c: Column | str) -> Column:
    """Last four digits; fewer when the text holds fewer."""
    digits = F.regexp_replace(text(c), "[^0-9]", "")
    return F.right(digits, F.lit(4))


def extract_last4_strict(c: Column | str) -> Column:
    digits = F.regexp_replace(text(c), "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise("")


def extract_state(c: Column | str) -> Column:
    # First stand-alone pair of letters of the upper-cased text.
    return F.regexp_extract(F.upper(norm_str(c)), r"(?<![\p{L}\p{N}_])([A-Z]{2})(?![\p{L}\p{N}_])", 1)


def norm_state(c: Column | str) -> Column:
    value = norm_basic(c)
    return F.coalesce(lookup(STATE_NAMES, value), value)


def split_location(c: Column | str) -> Column:
    """Struct (city, state): the last token is the state when there are two or more."""
    spaced = strip(squeeze(F.replace(text(c), F.lit(","), F.lit(" "))))
    parts = F.split(spaced, " ")
    several = F.size(parts) >= 2
    body = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " ")
    return F.struct(
        F.when(several, norm_basic(body)).otherwise(norm_basic(spaced)).alias("city"),
        F.when(several, norm_state(F.get(parts, F.size(parts) - 1))).otherwise("").alias("state"),
    )


def norm_address(c: Column | str) -> Column:
    value = F.concat(F.lit(" "), norm_basic(c), F.lit(" "))
    for word, short in STREET_WORDS:
        value = F.replace(value, F.lit(f" {word} "), F.lit(f" {short} "))
    return strip(squeeze(value))


def norm_worker_type(c: Column | str) -> Column:
    value = norm_basic(c)
    return F.coalesce(lookup(WORKER_TYPES, value), value)


def recon_hash(name: Column | str, dob: Column | str, last4: Column | str) -> Column:
    joined = F.concat(as_col(name), F.lit("|"), as_col(dob), F.lit("|"), as_col(last4))
    return F.substring(F.sha1(joined), 1, 12)


def pair_id(old_key: Column | str, new_key: Column | str) -> Column:
    joined = F.concat(as_col(old_key), F.lit("|"), as_col(new_key))
    return F.substring(F.sha2(joined, 256), 1, 12)


def id_prefix(c: Column | str, n: int = 5) -> Column:
    return F.substring(folded(c), 1, n)


def slug(c: Column | str, limit: int = 40) -> Column:
    value = F.regexp_replace(folded(c), "[^a-z0-9]+", "_")
    value = F.substring(F.btrim(value, F.lit("_")), 1, limit)
    return F.when(value == "", F.lit("unknown")).otherwise(value)


def plan_tokens(c: Column | str) -> Column:
    """Distinct lower-case plan names in a list split on ; , or |."""
    parts = F.transform(F.split(text(c), r"[;,|]"), folded)
    return F.array_distinct(F.filter(parts, lambda x: ~x.isin(*EMPTY_PLAN_WORDS)))


def formula_safe(c: Column | str) -> Column:
    value = as_col(c)
    return F.when(value.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), value)).otherwise(value)
