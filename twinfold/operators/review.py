"""Candidate pairs for human review, and what happens to the reviewers' decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import blank_null_words, folded, text
from ..functions.numbers import number
from ..sources.snapshots import ROW, ensure_columns, require_columns
from ..sources.staging import materialize
from . import partners
from .heavy import join_figures
from .match import name_similarity, token_sort_similarity
from .partners import FIELDS
from .ranking import first_n

REVIEW_FIELDS = (
    "recon_id", "worker_id", "full_name_norm", "last_name", "dob", "birth_year",
    "last_name_prefix3", "location_state",
)
NAME_CLOSE = 0.90

# Reviewer words that approve a pair.
MATCH_WORDS = ("match", "matched", "yes", "y", "true", "1", "approve", "approved")
APPLY_WORDS = ("match", "yes", "true", "1")
CONFIDENCE_WORDS = {"med": "medium"}


def cleaned(c: str) -> Column:
    """Trimmed text; null words count as blank."""
    return F.when(blank_null_words(c), "").otherwise(text(c))


def review_side(side: DataFrame, row: str = ROW) -> DataFrame:
    """The fields reviewers see, with birth year and name prefix filled in when missing."""
    side = ensure_columns(side, ["last4_ssn", "last_name_norm", *REVIEW_FIELDS])
    dob, prefix = cleaned("dob"), F.lower(cleaned("last_name_prefix3"))
    year = F.when(cleaned("birth_year") != "", cleaned("birth_year")).otherwise(F.substring(dob, 1, 4))
    own_prefix = F.substring(F.lower(cleaned("last_name_norm")), 1, 3)
    return side.select(
        F.col(row).alias("row"), cleaned("last4_ssn").alias("last4_ssn"),
        cleaned("recon_id").alias("recon_id"), cleaned("worker_id").alias("worker_id"),
        F.lower(cleaned("full_name_norm")).alias("full_name_norm"),
        cleaned("last_name").alias("last_name"), dob.alias("dob"), year.alias("birth_year"),
        F.when(prefix != "", prefix).otherwise(own_prefix).alias("last_name_prefix3"),
        F.lower(cleaned("location_state")).alias("location_state"),
    )


def _as_side(side: DataFrame, prefix: str, key: str) -> DataFrame:
    return side.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in side.columns if c != key])


def _agree(field: str) -> Column:
    return (F.col(f"old_{field}") != "") & (F.col(f"old_{field}") == F.col(f"new_{field}"))


def _signal_score(pairs: DataFrame, method: str) -> DataFrame:
    """Five yes/no signals, one point each."""
    pairs = pairs.withColumns({
        "dob_match": _agree("dob"), "birth_year_match": _agree("birth_year"),
        "lname3_match": _agree("last_name_prefix3"), "state_match": _agree("location_state"),
        "_similar": name_similarity(F.col("old_full_name_norm"), F.col("new_full_name_norm"), method),
    })
    signals = [F.col(f"{s}_match") for s in ("dob", "birth_year", "lname3", "state")]
    score = reduce(lambda a, b: a + b, [s.cast("int") for s in signals + [F.col("_similar") >= NAME_CLOSE]])
    pairs = pairs.withColumns({"score": score, "name_similarity": F.bround("_similar", 3)}).drop("_similar")
    level = F.when(F.col("score") >= 4, "HIGH").when(F.col("score") == 3, "MEDIUM").otherwise("LOW")
    return pairs.withColumn("confidence", level)


def _weighted_score(pairs: DataFrame, method: str) -> DataFrame:
    """Birth date 3 (else year 2), name prefix 2, state 1, close name 2."""
    similar = token_sort_similarity(F.col("old_full_name_norm"), F.col("new_full_name_norm"), method)
    pairs = pairs.withColumn("_similar", similar)
    score = (
        F.when(_agree("dob"), 3).when(_agree("birth_year"), 2).otherwise(0)
        + F.when(_agree("last_name_prefix3"), 2).otherwise(0)
        + F.when(_agree("location_state"), 1).otherwise(0)
        + F.when(F.col("_similar") >= NAME_CLOSE, 2).otherwise(0)
    )
    pairs = pairs.withColumns({"score": score, "name_similarity": F.bround("_similar", 3)}).drop("_similar")
    level = F.when(F.col("score") >= 7, "HIGH").when(F.col("score") >= 4, "MEDIUM").otherwise("LOW")
    return pairs.withColumn("confidence", level)


SCORES = {"signals": _signal_score, "weighted": _weighted_score}

# Fields that agree beside the last four digits. Every pair that reaches MEDIUM
# agrees on at least one of these sets.
EVIDENCE = {
    "signals": (
        ("dob",), ("birth_year", "last_name_prefix3"), ("birth_year", "location_state"),
        ("last_name_prefix3", "location_state"),
    ),
    "weighted": (("dob",), ("birth_year",), ("last_name_prefix3",)),
}


def group_sizes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key on each side, for the keys both sides have."""
    sides = [
        side.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        for name, side in (("old", left), ("new", right))
    ]
    return sides[0].join(sides[1].hint("merge"), keys)


# A key is listed as pairs if it is unique on a side, which is linear in rows,
# and by its members if it repeats on both, whatever its size.
_PAIRED, _LISTED = "n_old = 1 or n_new = 1", "n_old > 1 and n_new > 1"


def group_members(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of keys that repeat on both sides, once each instead of as pairs.

    Every old row of a key goes with every new row of it, so the two member
    lists say the same as the pairs and grow with the rows, not their product.
    """
    repeated = group_sizes(left, right, keys).where(_LISTED)
    parts = [
        join_figures(side.select(*keys, "row"), repeated, keys, n).select(F.lit(name).alias("side"), *keys, "row", "n_old", "n_new")
        for name, n, side in (("old", "n_old", left), ("new", "n_new", right))
    ]
    return parts[0].unionByName(parts[1])


def review_pairs_last4(
    old: DataFrame, new: DataFrame, score: str = "signals", per_side: int | None = None,
    method: str = "sequence", row: str = ROW,
) -> DataFrame:
    """Scored pairs of unmatched rows that share the last four digits.

    Every MEDIUM or HIGH pair is reached by an equi-join on the digits and an
    evidence set, without pairing whole groups; evidence keys that repeat on
    both sides come whole from ``grouped_evidence`` instead. ``per_side`` is a
    feature for a short list: it pairs the first rows per digits and side, LOW
    pairs included.
    """
    left, right = review_side(old, row), review_side(new, row)
    left, right = (s.where("last4_ssn <> ''") for s in (left, right))
    if per_side is not None:
        left, right = (first_n(s, ["last4_ssn"], ["row"], per_side) for s in (left, right))
        pairs = _as_side(left, "old", "last4_ssn").join(_as_side(right, "new", "last4_ssn"), "last4_ssn")
        return SCORES[score](pairs, method)
    return _pairs_by_evidence(left, right, score, method)


def _evidence_sides(left: DataFrame, right: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[str]]:
    present = reduce(lambda a, b: a & b, [F.col(f) != "" for f in fields])
    return left.where(present), right.where(present), ["last4_ssn", *fields]


def grouped_evidence(old: DataFrame, new: DataFrame, score: str = "signals", row: str = ROW, method: str = "sequence") -> DataFrame:
    """Members of the evidence keys that the list of pairs leaves out, each with its best partner.

    ``partner_row`` is the row of the other side with the highest score, of equal ones the first; ``score``,
    ``confidence`` and ``name_similarity`` are those of the pair.
    """
    # Each side is read a few times for every evidence set; stored, its columns are computed once.
    sides = [
        materialize(review_side(s, row).where("last4_ssn <> ''").select("row", "last4_ssn", "full_name_norm", *FIELDS), f"evidence-{name}")
        for name, s in (("old", old), ("new", new))]
    parts = []
    for fields in EVIDENCE[score]:
        left, right, keys = _evidence_sides(*sides, fields)
        both = left.withColumn("side", F.lit("old")).unionByName(right.withColumn("side", F.lit("new"))).withColumn("group", F.concat_ws("\x1f", *keys))
        sizes = both.groupBy("group").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("old", "new")])
        crowded = materialize(sizes.where(F.col("n_old") + F.col("n_new") > partners.GROUP_ROWS).where(_LISTED), "crowded-groups")
        pairs = []
        if crowded.isEmpty():
            light = both
        else:
            # A crowded group has more than GROUP_ROWS rows, so there are few.
            light = both.join(F.broadcast(crowded.select("group")), "group", "left_anti")
            pairs.append(_crowded_evidence(both.join(F.broadcast(crowded), "group"), fields, score, method))
        pairs.append(partners.partners_in_groups(light, fields, score, method))
        scored = SCORES[score](reduce(DataFrame.unionByName, pairs), method)
        parts.append(scored.select(
            "side", F.lit("+".join(keys)).alias("evidence"), F.translate("group", "\x1f", "|").alias("key"), "row", "n_old", "n_new",
            F.col("partner").alias("partner_row"), "score", "confidence", "name_similarity"))
    return reduce(DataFrame.unionByName, parts)


def _crowded_evidence(members: DataFrame, fields: tuple[str, ...], score: str, method: str) -> DataFrame:
    """The members of groups of any size with the best partner of each, as ``partners_in_groups``, by joins."""
    members = materialize(members, "crowded-members")
    by_side = [members.where(F.col("side") == s) for s in ("old", "new")]
    best = materialize(partners.best_partners(*by_side, fields, score, method), "best-partners")
    listed = members.join(best.hint("merge"), ["side", "group", "row"])
    # The partner's fields, for the score of the pair as it is shown.
    shown = [*FIELDS, "full_name_norm"]
    other = members.select(
        F.when(F.col("side") == "old", "new").otherwise("old").alias("side"), F.col("row").alias("partner"), "group", *[F.col(c).alias(f"p_{c}") for c in shown])
    asked = best.groupBy("side", "group", "partner").agg(F.count("*").alias("askers"))
    pairs = join_figures(listed, other.join(asked.hint("merge"), ["side", "group", "partner"]), ["side", "group", "partner"], "askers")
    first = F.col("side") == "old"
    return pairs.select(
        "side", "group", "row", "partner", "n_old", "n_new",
        *[F.when(first, F.col(c)).otherwise(F.col(f"p_{c}")).alias(f"old_{c}") for c in shown],
        *[F.when(first, F.col(f"p_{c}")).otherwise(F.col(c)).alias(f"new_{c}") for c in shown])


def _pairs_by_evidence(left: DataFrame, right: DataFrame, score: str, method: str) -> DataFrame:
    parts, earlier = [], []
    for fields in EVIDENCE[score]:
        kept_left, kept_right, keys = _evidence_sides(left, right, fields)
        allowed = group_sizes(kept_left, kept_right, keys).where(_PAIRED).select(*keys)
        o = kept_left.join(allowed, keys).select(*keys, *[F.col(c).alias(f"old_{c}") for c in left.columns if c != "last4_ssn"])
        n = kept_right.select(*keys, *[F.col(c).alias(f"new_{c}") for c in right.columns if c != "last4_ssn"])
        pairs = o.join(n, keys).drop(*fields)
        if earlier:
            # A pair is reported under the first evidence set it agrees on.
            pairs = pairs.where(~reduce(lambda a, b: a | b, earlier))
        earlier.append(reduce(lambda a, b: a & b, [_agree(f) for f in fields]))
        parts.append(pairs)
    scored = SCORES[score](reduce(DataFrame.unionByName, parts), method)
    return scored.where("confidence <> 'LOW'")


def _keyed(side: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(p) != "" for p in parts])
    return side.where(present).withColumn("key", F.concat_ws("|", *parts))


def _tier_pairs(
    left: DataFrame, right: DataFrame, parts: tuple[str, ...], level: str, score: int
) -> DataFrame:
    """Pairs with equal keys that are unique on a side, with a note where one repeats on the other."""
    left, right = _keyed(left, parts), _keyed(right, parts)
    shared = group_sizes(left, right, ["key"]).where(_PAIRED)
    note = lambda side: F.when(
        F.col(f"n_{side}") > 1,
        F.concat(F.lit(f"dup_in_{side}("), F.col(f"n_{side}").cast("string"), F.lit(")")),
    )
    shared = shared.select("key", F.concat_ws("|", note("old"), note("new")).alias("notes"))
    # The sizes are joined first, so a key of members is gone before any pairing.
    pairs = _as_side(left, "old", "key").join(shared, "key").join(_as_side(right, "new", "key"), "key")
    return pairs.select(
        F.lit(level).alias("confidence"), F.lit(score).alias("score"),
        F.lit("1.0" if level == "HIGH" else "").alias("name_similarity"),
        F.when(F.col("old_last4_ssn") != "", F.col("old_last4_ssn")).otherwise(F.col("new_last4_ssn")).alias("last4_ssn"),
        *[f"{p}_{f}" for p in ("old", "new") for f in ("row", *REVIEW_FIELDS) if f != "last_name"],
        "notes",
    )


def _owner(recon: str, worker: str) -> Column:
    """Whom candidates belong to: the reconciliation id, else the worker id. NULL without either: such a row has no others."""
    return F.coalesce(F.nullif(F.col(recon), F.lit("")), F.concat(F.lit("w:"), F.nullif(F.col(worker), F.lit(""))))


def _preference(n: Column, hits: Column) -> Column:
    """The note on several candidates of one owner."""
    return F.when((n > 1) & (hits == 1), "auto_preferred_wdX_id").when((n > 1) & (hits > 1), "multiple_wdX_candidates")


def _owner_sizes(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(owner, rows, n, hits): an owner's rows here, and its candidates and preferred ones among pairs and groups."""
    mine = pairs.select("owner", F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("n"), F.col("preferred").cast("long").alias("hits"))
    mine = mine if groups is None else mine.unionByName(groups.select("owner", F.lit(1).cast("long").alias("rows"), "n", "hits"))
    return mine.where("owner is not null").groupBy("owner").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "hits")])


def prefer_id_pattern(pairs: DataFrame, pattern: str = r"^wdX\d+$", groups: DataFrame | None = None) -> DataFrame:
    """Among the candidates of one old record keep the single preferred id.

    Several preferred ids are all kept and annotated. Owners are counted by an
    aggregate and joined back; no group is gathered, and rows without an owner
    stay as they are. ``groups`` (owner, n, hits) adds candidates that are
    listed by their members.
    """
    pairs = pairs.withColumns({"owner": _owner("old_recon_id", "old_worker_id"), "preferred": F.col("new_worker_id").rlike(pattern)})
    sizes = _owner_sizes(pairs, groups)
    owned = join_figures(pairs.where("owner is not null"), sizes, ["owner"], "rows")
    none = {c: F.lit(None).cast("long") for c in ("rows", "n", "hits")}
    joined = owned.unionByName(pairs.where("owner is null").withColumns(none))
    notes = F.concat_ws("|", F.nullif(F.col("notes"), F.lit("")), _preference(F.col("n"), F.col("hits")))
    kept = F.coalesce((F.col("n") <= 1) | (F.col("hits") != 1), F.lit(True)) | F.col("preferred")
    return joined.where(kept).withColumn("notes", notes).drop("owner", "preferred", "rows", "n", "hits")


KEY_A, KEY_B = ("full_name_norm", "dob"), ("full_name_norm", "birth_year", "last_name_prefix3")


def _tier_b_sides(left: DataFrame, right: DataFrame) -> list[DataFrame]:
    """What is left for tier B: rows whose tier A key is not unique on both sides."""
    unique = [
        _keyed(s, KEY_A).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias(f"{p}_row"))
        .where("n = 1").drop("n") for p, s in (("old", left), ("new", right))
    ]
    used = unique[0].join(unique[1], "key")
    return [
        s.join(used.select(F.col(f"{p}_row").alias("row")), "row", "left_anti")
        for p, s in (("old", left), ("new", right))
    ]


def review_candidates_tiered(
    old: DataFrame, new: DataFrame, pattern: str = r"^wdX\d+$", row: str = ROW
) -> DataFrame:
    """Tier A by name and birth date, tier B by name, birth year and name prefix.

    Keys that repeat on both sides come whole from ``grouped_candidates``; their
    members count among the candidates of an owner.
    """
    left, right = review_side(old, row), review_side(new, row)
    groups = _group_owners(*[_keyed(s, KEY_A) for s in (left, right)], pattern)
    tier_a = prefer_id_pattern(_tier_pairs(left, right, KEY_A, "HIGH", 2), pattern, groups)
    return tier_a.unionByName(_tier_pairs(*_tier_b_sides(left, right), KEY_B, "MED", 1))


def _group_owners(left: DataFrame, right: DataFrame, pattern: str) -> DataFrame:
    """(key, row, owner, n, hits) of the old rows of keys that repeat on both sides: their candidates and the preferred ones."""
    shared = group_sizes(left, right, ["key"]).where(_LISTED)
    hits = right.groupBy("key").agg(F.count_if(F.col("worker_id").rlike(pattern)).cast("long").alias("hits"))
    figures = shared.join(hits, "key").select("key", F.col("n_new").alias("n"), "hits", F.col("n_old").alias("rows"))
    mine = left.select("key", "row", _owner("recon_id", "worker_id").alias("owner"))
    return join_figures(mine, figures, ["key"], "rows").drop("rows")


def grouped_candidates(old: DataFrame, new: DataFrame, row: str = ROW, pattern: str = r"^wdX\d+$") -> DataFrame:
    """Members of the keys that ``review_candidates_tiered`` leaves out as pairs, each with its first partner.

    All pairs of a key have the same score. Where an owner has several candidates in tier A and one preferred id among
    them, only that one stays its partner: its old rows in other keys get none, and a new member whose old rows all
    prefer another gets none. ``notes`` say so, or that there are several preferred ids.
    """
    # Each side is read a dozen times; stored, its columns are computed once.
    left, right = (materialize(review_side(side, row), f"review-{name}") for name, side in (("old", old), ("new", new)))
    rest = [materialize(side, f"rest-{name}") for name, side in zip(("old", "new"), _tier_b_sides(left, right))]
    preferred = F.col("worker_id").rlike(pattern)
    parts = []
    for level, score, sides, key in (("HIGH", 2, [left, right], KEY_A), ("MED", 1, rest, KEY_B)):
        mine, other = (_keyed(s, key) for s in sides)
        sizes = group_sizes(mine, other, ["key"]).where(_LISTED)
        olds = _group_owners(mine, other, pattern)
        if level == "HIGH":
            pairs = _tier_pairs(left, right, KEY_A, "HIGH", 2)
            pairs = pairs.withColumns({"owner": _owner("old_recon_id", "old_worker_id"), "preferred": F.col("new_worker_id").rlike(pattern)})
            totals = _owner_sizes(pairs, olds.select("owner", "n", "hits")).withColumnsRenamed({"n": "all_n", "hits": "all_hits"})
            owned = join_figures(olds.where("owner is not null"), totals, ["owner"], "rows").drop("rows")
            none = {c: F.lit(None).cast("long") for c in ("all_n", "all_hits")}
            olds = owned.unionByName(olds.where("owner is null").withColumns(none))
            notes = _preference(F.col("all_n"), F.col("all_hits"))
            single = F.coalesce((F.col("all_n") > 1) & (F.col("all_hits") == 1), F.lit(False))
        else:
            notes, single = F.lit(None).cast("string"), F.lit(False)
        olds = materialize(olds.select("key", "row", single.alias("single"), notes.alias("notes")), "group-owners")
        # Per key: the first rows of each side, all of them and those that a preference leaves.
        firsts = sizes.join(olds.groupBy("key").agg(F.min("row").alias("old_any"), F.min(F.when(~F.col("single"), F.col("row"))).alias("old_free")), "key")
        firsts = firsts.join(other.groupBy("key").agg(F.min("row").alias("new_any"), F.min(F.when(preferred, F.col("row"))).alias("new_preferred")), "key")
        firsts = materialize(firsts, "group-firsts")
        old_rows = join_figures(olds, firsts, ["key"], "n_old").withColumn(
            "partner_row", F.when(F.col("single"), F.col("new_preferred")).otherwise(F.col("new_any")))
        new_rows = join_figures(other.select("key", "row", preferred.alias("preferred")), firsts, ["key"], "n_new").withColumns({
            "partner_row": F.when(F.col("preferred"), F.col("old_any")).otherwise(F.col("old_free")), "notes": F.lit(None).cast("string")})
        for side, rows in (("old", old_rows), ("new", new_rows)):
            parts.append(rows.select(
                F.lit(side).alias("side"), "key", "row", "n_old", "n_new", F.lit(level).alias("confidence"), F.lit(score).alias("score"),
                F.lit("1.0" if level == "HIGH" else "").alias("name_similarity"), "partner_row", "notes"))
    return reduce(DataFrame.unionByName, parts)


def approved(decision: str = "decision", words: tuple[str, ...] = MATCH_WORDS) -> Column:
    return F.lower(cleaned(decision)).isin(*words)


def apply_decisions(
    matched: DataFrame, review: DataFrame,
    pair_key: tuple[str, str] = ("recon_id_old", "recon_id_new"),
    unique_ids: tuple[str, ...] = ("old_worker_id", "new_worker_id"), check: bool = True,
) -> DataFrame:
    """Matched rows plus the approved review rows that are not there yet."""
    require_columns(review, ["decision"], "review table")
    fresh = review.where(approved(words=APPLY_WORDS))
    if all(k in matched.columns for k in pair_key):
        fresh = ensure_columns(fresh, list(pair_key))
        known = matched.select(*[cleaned(k).alias(k) for k in pair_key]).distinct()
        fresh = fresh.withColumns({k: cleaned(k) for k in pair_key}).join(known, list(pair_key), "left_anti")
    fresh = ensure_columns(fresh, matched.columns)
    row = lambda df: df.select(*[cleaned(c).alias(c) for c in matched.columns])
    combined = row(matched).unionByName(row(fresh))
    if check:
        for column in unique_ids:
            if column in combined.columns and not repeated_ids(combined, column).isEmpty():
                raise ValueError(f"duplicate {column!r} values after appending approved rows")
    return combined


def repeated_ids(df: DataFrame, column: str) -> DataFrame:
    """Non-blank values that occur more than once, with their counts."""
    return (
        df.where(text(column) != "").groupBy(text(column).alias(column))
        .agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    )


def candidate_id(df: DataFrame) -> Column:
    """Stable id of a candidate from the best identity columns the table has."""
    has = lambda *cols: all(c in df.columns for c in cols)
    if has("old_recon_id", "new_recon_id"):
        parts = ["old_recon_id", "new_recon_id"]
    elif has("old_worker_id", "new_worker_id"):
        parts = ["old_worker_id", "new_worker_id"]
    elif has("old_full_name_norm", "old_dob", "new_full_name_norm", "new_dob"):
        parts = ["old_full_name_norm", "old_dob", "new_full_name_norm", "new_dob"]
    else:
        raise ValueError("the review table has none of the identity column pairs")
    return F.substring(F.sha2(F.concat_ws("|", *[folded(p) for p in parts]), 256), 1, 12)


def finalize(
    review: DataFrame, levels: tuple[str, ...] = ("high", "medium"), min_similarity: float = NAME_CLOSE
) -> tuple[DataFrame, DataFrame]:
    """(finalised, ambiguous): approved candidates with evidence, split by repeated ids."""
    require_columns(review, ["decision"], "review table")
    level = F.lower(cleaned("confidence")) if "confidence" in review.columns else F.lit(levels[0])
    for short, full in CONFIDENCE_WORDS.items():
        level = F.when(level == short, full).otherwise(level)
    value = lambda c: (
        F.coalesce(number(c), F.lit(0.0)) if c in review.columns else F.lit(0.0)
    )
    evidence = (F.floor(value("score")) >= 1) | (value("name_similarity") >= min_similarity)
    if "old_dob" in review.columns and "new_dob" in review.columns:
        evidence = evidence | ((cleaned("old_dob") != "") & (cleaned("old_dob") == cleaned("new_dob")))
    if "candidate_id" not in review.columns:
        review = review.withColumn("candidate_id", candidate_id(review))
    matches = review.where(approved() & level.isin(*levels) & evidence)

    flags = []
    for column in ("old_worker_id", "new_worker_id"):
        if column in matches.columns:
            # Only ids that repeat are joined back. A missing id equals no other.
            counts = matches.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
            counts = counts.where("_n > 1").select(column, F.lit(True).alias(f"_dup_{column}"))
            matches = matches.join(counts, column, "left").withColumn(f"_dup_{column}", F.coalesce(f"_dup_{column}", F.lit(False)))
            flags.append(f"_dup_{column}")
    repeated = reduce(lambda a, b: a | b, [F.col(f) for f in flags]) if flags else F.lit(False)
    return matches.where(~repeated).drop(*flags), matches.where(repeated).drop(*flags)


def merge_decisions(existing: DataFrame, fresh: DataFrame, key: str = "old_recon_id") -> DataFrame:
    """Reviewer values stay; blanks and new columns are filled from the fresh table."""
    others = [c for c in fresh.columns if c != key]
    renamed = fresh.select(key, *[F.col(c).alias(f"_{c}") for c in others])
    merged = existing.join(renamed, key, "left")
    columns = [
        F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in others else F.col(c) for c in existing.columns
    ]
    added = [F.col(f"_{c}").alias(c) for c in others if c not in existing.columns]
    return merged.select(*columns, *added)


def confirmed_matches(old: DataFrame, new: DataFrame, decisions: DataFrame, row: str = ROW) -> DataFrame:
    """Match rows for the row pairs a reviewer confirmed."""
    score = number("confidence") if "confidence" in decisions.columns else F.lit(0.0)
    wanted = decisions.where(folded("decision") == "confirm").select(
        number("old_row_id").cast("bigint").alias("old_row_id"),
        number("confirmed_new_row_id").cast("bigint").alias("new_row_id"),
        F.coalesce(score, F.lit(0.0)).alias("confidence"),
    )
    o = old.select(F.col(row).alias("old_row_id"), F.col("recon_id").alias("old_recon_id"),
                   F.col("full_name_norm").alias("old_full_name"))
    n = new.select(F.col(row).alias("new_row_id"), "worker_id", F.col("recon_id").alias("new_recon_id"),
                   F.col("full_name_norm").alias("new_full_name"))
    return wanted.join(o, "old_row_id").join(n, "new_row_id").select(
        F.lit("confirmed").alias("match_type"), "confidence", "worker_id", "old_row_id", "new_row_id",
        "old_recon_id", "new_recon_id", "old_full_name", "new_full_name",
        F.lit("User confirmed match").alias("reason"),
    )


def suspicious_matches(pairs: DataFrame, limit: float = 0.60, method: str = "sequence") -> DataFrame:
    """Pairs with equal digits and birth date whose names hardly agree."""
    same = (text("old_last4_ssn") != "") & (text("old_last4_ssn") == text("new_last4_ssn")) & (
        text("old_dob") != "") & (text("old_dob") == text("new_dob"))
    scored = pairs.where(same).withColumn(
        "name_similarity",
        name_similarity(folded("old_full_name_norm"), folded("new_full_name_norm"), method),
    )
    return scored.where(F.col("name_similarity") < limit)


