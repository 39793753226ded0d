"""Linking two snapshots in ordered key tiers under a one-to-one rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as tx
from ..functions.blanks import folded, text
from ..functions.numbers import plain_text
from ..functions.similarity import indel_ratio
from ..sources.snapshots import ROW, ensure_columns
from ..sources.staging import materialize

# The tiers, their key columns and their order.
TIERS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("worker_id", ("worker_id",)),
    ("recon_id", ("recon_id",)),
    ("pk", ("full_name_norm", "dob", "last4_ssn")),
    ("last4_dob", ("last4_ssn", "dob")),
    ("dob_name", ("dob", "full_name_norm")),
    ("name_hire_date", ("last_name_norm", "hire_date")),
)
ID_TIERS = ("worker_id", "recon_id")

# Fields carried as old_/new_ columns of a pair.
PAIR_FIELDS = (
    "worker_id", "recon_id", "full_name_norm", "first_name_norm", "last_name_norm", "middle_name",
    "suffix", "dob", "hire_date", "last4_ssn", "salary", "payrate", "position", "district",
    "location_state", "worker_status", "worker_type",
)


def match_key(columns: tuple[str, ...], ids: tuple[str, ...] = ID_TIERS, require_all_parts: bool = False) -> Column:
    """Joined key text; NULL when a single key is empty.

    A composite of blanks is a legal key that matches when it is unique on both
    sides; ``require_all_parts`` turns that off.
    """
    parts = [folded(c) if c in ids else text(c) for c in columns]
    joined = F.concat_ws("|", *parts) if len(parts) > 1 else F.nullif(parts[0], F.lit(""))
    if require_all_parts:
        complete = reduce(lambda a, b: a & b, [p != "" for p in parts])
        joined = F.when(complete, joined)
    return joined


def _unique_keys(side: DataFrame, key: str, row: str) -> DataFrame:
    # count and min combine on the map side, so an ambiguous key of any size stays small.
    counted = side.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(row).alias(row)
    )
    return counted.where("_n = 1").drop("_n")


def link_unique_keys(old: DataFrame, new: DataFrame, key: str, source: str, row: str = ROW) -> DataFrame:
    """(old_row, new_row, match_source) for every key that occurs once on each side."""
    o = _unique_keys(old, key, row).withColumnRenamed(row, "old_row")
    n = _unique_keys(new, key, row).withColumnRenamed(row, "new_row")
    return o.join(n, key).select("old_row", "new_row", F.lit(source).alias("match_source"))


def without_rows(side: DataFrame, links: DataFrame, link_column: str, row: str = ROW) -> DataFrame:
    used = links.select(F.col(link_column).alias(row))
    return side.join(used, row, "left_anti")


def unique_key_join(
    old: DataFrame, new: DataFrame, columns: tuple[str, ...], source: str,
    row: str = ROW, require_all_parts: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One tier: the links and what remains of both sides."""
    key = match_key(columns, require_all_parts=require_all_parts).alias("_k")
    links = link_unique_keys(old.select(row, key), new.select(row, key), "_k", source, row)
    return links, without_rows(old, links, "old_row", row), without_rows(new, links, "new_row", row)


@dataclass
class MatchResult:
    links: DataFrame
    unmatched_old: DataFrame
    unmatched_new: DataFrame


def _tier_keys(side: DataFrame, tiers, row: str, require_all_parts: bool) -> DataFrame:
    keys = [
        match_key(columns, require_all_parts=require_all_parts).alias(f"_k{i}")
        for i, (_, columns) in enumerate(tiers)
    ]
    return side.select(row, *keys)


def tiered_match(
    old: DataFrame, new: DataFrame, tiers=TIERS, row: str = ROW, allow_blank_id: bool = False,
    require_all_parts: bool = False, stage: Callable[[DataFrame, str], DataFrame] = materialize,
) -> MatchResult:
    """Link rows tier by tier; a linked row leaves the pools of all later tiers.

    Only row numbers and keys move through the tiers. The links of each tier
    are staged, so the plan of tier n reads n small tables instead of
    containing n nested joins.
    """
    needed = sorted({c for _, columns in tiers for c in columns})
    old, new = ensure_columns(old, needed), ensure_columns(new, needed)
    tiers = tuple(t for t in tiers if all(c in old.columns and c in new.columns for c in t[1]))
    has_id = F.lit(True) if allow_blank_id else folded("worker_id") != ""

    pools = [_tier_keys(side.where(has_id), tiers, row, require_all_parts) for side in (old, new)]
    found: list[DataFrame] = []
    for i, (source, _) in enumerate(tiers):
        left, right = (p.select(row, f"_k{i}") for p in pools)
        if found[1:]:
            done = reduce(DataFrame.unionByName, found[1:])
            left = without_rows(left, done, "old_row", row)
            right = without_rows(right, done, "new_row", row)
        tier = link_unique_keys(left, right, f"_k{i}", source, row)
        found.append(stage(tier.withColumn("tier", F.lit(i)), f"links-{source}"))
        if i == 0:
            # The first tier links most rows; the later ones read only what it left.
            pools = [
                stage(without_rows(pool, found[0], f"{name}_row", row), f"{name}-keys")
                for name, pool in zip(("old", "new"), pools)
            ]
    links = reduce(DataFrame.unionByName, found)

    reason = F.when(has_id, "no_match_found").otherwise("no_id").alias("unmatched_reason")
    return MatchResult(
        links,
        without_rows(old, links, "old_row", row).select("*", reason),
        without_rows(new, links, "new_row", row).select("*", reason),
    )


def _ratio(a: str | None, b: str | None) -> float | None:
    from difflib import SequenceMatcher

    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def name_similarity(old: Column, new: Column, method: str = "sequence", skip: Column | None = None) -> Column:
    """Similarity of two names, 0 to 1; equal and blank names are decided without Python.

    ``sequence`` is the longest-matching-blocks ratio. Rows that need no ratio go
    to Python as NULL, and so cost no more than the transfer of a NULL.
    ``edit`` is one minus the Levenshtein distance over the longer length.
    """
    o, n = text(old), text(new)
    if method == "edit":
        close = 1 - F.levenshtein(o, n) / F.greatest(F.length(o), F.length(n))
    else:
        needed = (o != n) & (o != "") & (n != "")
        if skip is not None:
            needed = needed & ~skip
        close = sequence_ratio(F.when(needed, o), F.when(needed, n))
    return F.when((o == "") | (n == ""), 0.0).when(o == n, 1.0).otherwise(close)


def token_sort(c: Column | str) -> Column:
    tokens = F.filter(F.split(tx.squeeze(folded(c)), " "), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def token_sort_similarity(old: Column, new: Column, method: str = "sequence") -> Column:
    return name_similarity(token_sort(old), token_sort(new), method)


def title_similarity(a: Column, b: Column) -> Column:
    """Share of common words of two normalised titles."""
    ta, tb = (F.filter(F.split(c, " "), lambda t: t != "") for c in (a, b))
    either = F.size(F.array_union(ta, tb))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(ta, tb)) / either)


def title_ratio(a: Column, b: Column) -> Column:
    """Likeness of two titles whatever the order of their words: insertions and deletions between the sorted words."""
    return indel_ratio(token_sort(a), token_sort(b))


def confidence(method: str = "sequence") -> Column:
    """Weighted evidence of a pair; the two id tiers score 1."""
    same = lambda f, fold: (
        (fold(f"old_{f}") != "") & (fold(f"old_{f}") == fold(f"new_{f}"))
    ).cast("double")
    by_id = folded("match_source").isin(*ID_TIERS)
    name = name_similarity(F.col("old_full_name_norm"), F.col("new_full_name_norm"), method, skip=by_id)
    score = (
        name * 0.5 + same("dob", text) * 0.2 + same("last4_ssn", text) * 0.2
        + same("location_state", folded) * 0.1
    )
    return F.when(by_id, 1.0).otherwise(F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4))


def name_change_detected(old: str = "old_last_name_norm", new: str = "new_last_name_norm") -> Column:
    """Last names differ beyond accents and case."""
    o, n = (folded(tx.ascii_fold(text(c))) for c in (old, new))
    return (o != "") & (n != "") & (o != n)


def candidate_order(first: Column, second: Column) -> Column:
    """One number that orders by ``first``, then by ``second``; unique if the two are, for all non-negative longs."""
    return first.cast("decimal(38,0)") * F.lit(Decimal(10) ** 19).cast("decimal(38,0)") + second


def pair_rows(
    result: MatchResult, old: DataFrame, new: DataFrame, extras: list[str] | tuple[str, ...] = (),
    row: str = ROW, method: str = "sequence",
) -> DataFrame:
    """Wide pair rows: both records side by side with source, confidence and name flag."""
    fields = list(PAIR_FIELDS) + [e for e in extras if e not in PAIR_FIELDS]
    sides = []
    for prefix, side in (("old", old), ("new", new)):
        side = ensure_columns(side, fields)
        kinds = dict(side.dtypes)
        renamed = [
            (plain_text(F.col(f)) if kinds[f] in ("double", "float") else F.col(f).cast("string")).alias(f"{prefix}_{f}") for f in fields
        ]
        sides.append(side.select(F.col(row).alias(f"{prefix}_row"), *renamed))
    wide = result.links.join(sides[0], "old_row").join(sides[1], "new_row")
    # Order of the candidates: tier first, then position in the old snapshot.
    order = candidate_order(F.col("tier"), F.col("old_row")).cast("decimal(38,0)").alias("cand_ord")
    paired = [f"{p}_{f}" for f in fields for p in ("old", "new")]
    wide = wide.select(order, *paired, name_change_detected().alias("name_change_detected"), "match_source")
    return wide.withColumn("confidence", confidence(method))


def match_report(result: MatchResult, tiers=TIERS) -> DataFrame:
    """One row: matches per tier, total, and what stayed unmatched on each side."""
    per_tier = [
        F.count_if(F.col("match_source") == name).alias(f"matched_by_{name}") for name, _ in tiers
    ]
    links = result.links.agg(F.count(F.lit(1)).alias("matched_total"), *per_tier)
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return links.select(
        "*", count(result.unmatched_old).alias("unmatched_old"),
        count(result.unmatched_new).alias("unmatched_new"),
    )
