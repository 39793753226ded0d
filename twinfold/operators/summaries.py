"""Report aggregates over pairs and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import blank_strict, changed_both_present, changed_trimmed, folded, text
from ..functions.numbers import (
    confidence_band, number, parse_confidence, parse_money, readiness_score,
)
from .gate import FIX_TYPES, differs, has_fix, priority_score
from .outputs import active_zero, both
from .pair_audits import extreme_shift
from .quantiles import quantile_struct
from .ranking import first_n

ACTIONS = ("APPROVE", "REVIEW", "REJECT_MATCH")


def _count(test: Column | None = None) -> Column:
    return F.count(F.lit(1)) if test is None else F.count_if(test)


def unpivoted(row: DataFrame, entries: list[tuple[dict, Column]]) -> DataFrame:
    """One-row aggregate to a long table: (constant columns, value column) per entry."""
    structs = [
        F.struct(*[F.lit(v).alias(k) for k, v in const.items()], value.cast("bigint").alias("count"))
        for const, value in entries
    ]
    return row.select(F.explode(F.array(*structs)).alias("e")).select("e.*")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(F.bround(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def source_shares(pairs: DataFrame) -> DataFrame:
    source = F.coalesce(F.nullif(F.col("match_source"), F.lit("")), F.lit("unknown")).alias("match_source")
    counts = pairs.groupBy(source).agg(_count().alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("pct", percent(F.col("count"), total))


def salary_change_stats(pairs: DataFrame) -> DataFrame:
    """One row: parseable pairs, mismatches, direction and spread of the changes.

    Equal deltas are counted first; the quantiles rank only the values near the wanted places.
    """
    delta = parse_money("new_salary") - parse_money("old_salary")
    counted = pairs.select(delta.alias("d")).where("d is not null").groupBy("d").agg(_count().alias("n"))
    moved = F.when(F.col("d") != 0, F.col("d"))
    weight = F.col("n")
    total = lambda test: F.coalesce(F.sum(F.when(test, weight)), F.lit(0))
    stats = counted.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("both_valid"), total(F.col("d") != 0).alias("mismatches"),
        total(F.col("d") > 0).alias("increases"), total(F.col("d") < 0).alias("decreases"),
        F.min(moved).alias("min_delta"),
        F.bround(F.sum(moved * weight) / F.sum(F.when(F.col("d") != 0, weight)), 2).alias("avg_delta"),
        F.max(moved).alias("max_delta"),
    )
    shares = {"p10_delta": 0.1, "median_delta": 0.5, "p90_delta": 0.9}
    found = quantile_struct(counted.where("d <> 0"), "d", "n", shares)
    return stats.withColumns({name: F.bround(found[name], 2) for name in shares})


def gate_by_fix_type(gated: DataFrame) -> DataFrame:
    """Per field: verdicts on that field and the approved share."""
    fields = gated.select(F.explode("per_fix").alias("fix_type", "v"))
    counts = fields.groupBy("fix_type").agg(
        _count().alias("total"), _count(F.col("v.action") == "APPROVE").alias("approve"),
        _count(F.col("v.action") == "REVIEW").alias("review"))
    return counts.withColumn("approve_pct", percent(F.col("approve"), F.col("total")))


def gate_by_source(gated: DataFrame) -> DataFrame:
    """Per match source: decisions on pairs with a change, all three kept apart."""
    source = F.coalesce(F.nullif(text("match_source"), F.lit("")), F.lit("unknown")).alias("match_source")
    counts = gated.where(F.size("fix_types") > 0).groupBy(source).agg(
        _count().alias("total"), *[_count(F.col("action") == a).alias(a.lower()) for a in ACTIONS])
    return counts.withColumn("approve_pct", percent(F.col("approve"), F.col("total")))


def confidence_bands(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(confidence_band(parse_confidence("confidence")).alias("band")).agg(
        _count().alias("pairs"))


def salary_report(gated: DataFrame) -> DataFrame:
    """One row of salary change figures without active records that have no pay."""
    zero = active_zero(("active",))
    rows = gated.where(has_fix("salary"))
    delta = F.when(~zero & (F.col("salary_delta") != 0), F.col("salary_delta"))
    counted = rows.select(delta.alias("d")).groupBy("d").agg(_count().alias("n"))
    median = quantile_struct(counted, "d", "n", {"median": 0.5})["median"]
    return rows.agg(
        _count().alias("total"), _count(zero).alias("n_excluded_active_zero"), _count(~zero).alias("n_included"),
        _count(delta > 0).alias("n_increase"), _count(delta < 0).alias("n_decrease"),
        F.coalesce(F.bround(F.avg(delta), 2), F.lit(0.0)).alias("mean_delta"),
        F.coalesce(F.max(delta), F.lit(0.0)).alias("max_increase"),
        F.coalesce(F.min(delta), F.lit(0.0)).alias("max_decrease"),
    ).withColumn("median_delta", F.coalesce(F.bround(median, 2), F.lit(0.0)))


def _top(counts: DataFrame, name: str, n: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), name).limit(n)


def status_transitions(gated: DataFrame, n: int = 10) -> DataFrame:
    side = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("blank"))))
    change = F.concat(side("old_worker_status"), F.lit(" → "), side("new_worker_status"))
    counts = gated.where(has_fix("status")).groupBy(change.alias("transition")).agg(_count().alias("count"))
    return _top(counts, "transition", n)


def hire_date_patterns(gated: DataFrame, n: int = 8) -> DataFrame:
    reason = F.coalesce(F.nullif(F.col("per_fix")["hire_date"]["reason"], F.lit("")), F.lit("none"))
    counts = gated.where(has_fix("hire_date")).groupBy(reason.alias("pattern")).agg(_count().alias("count"))
    return _top(counts, "pattern", n)


def top_wave_dates(gated: DataFrame, n: int = 10) -> DataFrame:
    waved = gated.where(F.col("reason").contains("hire_date_wave"))
    return _top(waved.groupBy("new_hire_date").agg(_count().alias("count")), "new_hire_date", n)


def reject_reasons(gated: DataFrame, n: int = 5) -> DataFrame:
    rejected = gated.where("action = 'REJECT_MATCH'")
    return _top(rejected.groupBy("reason").agg(_count().alias("count")), "reason", n)


def top_review_items(gated: DataFrame, n: int = 20, policy: dict | None = None) -> DataFrame:
    rows = gated.where("action = 'REVIEW'").select(
        "pair_id", "old_full_name_norm", "reason", F.array_join("fix_types", "|").alias("fix_types"),
        priority_score(policy).alias("priority_score"))
    return rows.orderBy(F.desc("priority_score"), "pair_id").limit(n)


def review_by_fix_type(gated: DataFrame) -> DataFrame:
    fixes = gated.where("action = 'REVIEW'").select(F.explode("fix_types").alias("fix_type"))
    return fixes.groupBy("fix_type").agg(_count().alias("count"))


def run_overview(gated: DataFrame, policy: dict | None = None) -> DataFrame:
    """One row for the cover page: decisions, fields, priorities, readiness."""
    rows = gated.withColumn("_score", F.when(F.col("action") == "REVIEW", priority_score(policy)))
    score = F.col("_score")
    base = rows.agg(
        _count().alias("total_matched"),
        *[_count(F.col("action") == a).alias(n) for a, n in zip(ACTIONS, ("n_safe", "n_review", "n_wrong"))],
        *[_count(has_fix(f)).alias(f"n_{f}") for f in ("salary", "status", "hire_date", "job_org")],
        _count(parse_confidence("confidence") < 1.0).alias("n_fuzzy"),
        _count(active_zero(("active",))).alias("n_active_zero"),
        _count(score >= 70).alias("prio_critical"), _count((score >= 40) & (score < 70)).alias("prio_high"),
        _count((score >= 20) & (score < 40)).alias("prio_medium"), _count(score < 20).alias("prio_low"),
    )
    base = base.withColumn("safe_pct", percent(F.col("n_safe"), F.col("total_matched")))
    ready = readiness_score(F.col("safe_pct"), F.col("n_active_zero"), F.col("n_wrong"))
    status = F.when((F.col("n_active_zero") > 0) | (F.col("n_wrong") > 0), "BLOCKED").when(
        F.col("safe_pct") >= 80.0, "PASS").otherwise("WARNING")
    return base.withColumns({"readiness_score": ready, "gate_status": status})


def conversion_counts(gated: DataFrame) -> DataFrame:
    found = gated.where(text("conversion_type") != "")
    return found.groupBy("conversion_type").agg(_count().alias("count"))


def risk_rows(gated: DataFrame) -> DataFrame:
    """Risks that occur, with the step each one asks for."""
    row = gated.agg(
        _count(active_zero()).alias("zero"), _count(F.col("action") == "REVIEW").alias("review"),
        _count(F.col("action") == "REJECT_MATCH").alias("reject"),
        _count(F.col("reason").contains("hire_date_wave")).alias("wave"),
        _count(F.col("reason").contains("salary_ratio_extreme")).alias("variance"))
    entries = [
        ("Active employees with $0 salary", "zero", "Investigate before load"),
        ("Records requiring human review", "review", "Complete review queue first"),
        ("Possible wrong-person matches", "reject", "Manual investigation required"),
        ("Hire date wave detected", "wave", "Verify bulk import date is correct"),
        ("Salary changes > 15% variance", "variance", "Spot check recommended"),
    ]
    rows = unpivoted(row, [({"risk": r, "next_step": s}, F.col(c)) for r, c, s in entries])
    return rows.where("count > 0")


def correction_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("correction_type").agg(_count().alias("count"))


def salary_quality(pairs: DataFrame) -> DataFrame:
    """Per side: salaries with stray characters and blank ones."""
    columns = []
    for side in ("old", "new"):
        value = text(f"{side}_salary")
        bad = (value != "") & (value.contains("$") | value.contains(",") | number(value).isNull())
        columns += [_count(bad).alias(f"{side}_bad"), _count(value == "").alias(f"{side}_blank")]
    row = pairs.agg(_count().alias("rows"), *columns)
    sides = F.array(*[
        F.struct(F.lit(s).alias("field_side"), F.col(f"{s}_bad").alias("bad_char_count"),
                 F.col(f"{s}_blank").alias("blank_count"), F.col("rows").alias("total_rows_checked"))
        for s in ("old", "new")
    ])
    return row.select(F.explode(sides).alias("s")).select("s.*")


def run_summary(pairs: DataFrame) -> DataFrame:
    """One row of mismatch totals for the run record."""
    test = lambda f: changed_both_present(f"old_{f}", f"new_{f}")
    return pairs.agg(
        _count().alias("total_matched"), _count(test("salary")).alias("salary_mismatch"),
        _count(extreme_shift()).alias("extreme_salary"), _count(test("hire_date")).alias("hire_date_mismatch"),
        _count(test("worker_status")).alias("status_mismatch"))


def finalized_score(finalized: DataFrame) -> DataFrame:
    """How many candidates were finalised and their mean score."""
    return finalized.agg(
        _count().alias("finalized_count"), F.bround(F.avg(number("score")), 4).alias("identity_confidence_score"))


def department_summary(queue: DataFrame) -> DataFrame:
    """Review rows and highest priority per department."""
    department = F.coalesce(
        F.nullif(text("old_district"), F.lit("")), F.nullif(text("new_district"), F.lit("")), F.lit("unknown"))
    return queue.groupBy(department.alias("department")).agg(
        _count().alias("count"), F.max("priority_score").alias("max_priority"))


def _histogram(values: DataFrame, low: Column, high: Column, bins: int) -> DataFrame:
    """Equal-width bins over a value column; the top edge belongs to the last bin."""
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1))
    placed = values.withColumns({"low": low, "high": high}).withColumn(
        "bin", F.when(F.col("high") > F.col("low"), at).otherwise(0).cast("int"))
    return placed.groupBy("bin").agg(_count().alias("count"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))


def salary_delta_histogram(pairs: DataFrame, bins: int = 50) -> DataFrame:
    values = pairs.select((parse_money("new_salary") - parse_money("old_salary")).alias("v")).where("v <> 0")
    return _histogram(values, values.agg(F.min("v")).scalar(), values.agg(F.max("v")).scalar(), bins)


def salary_ratio_histogram(pairs: DataFrame, bins: int = 50) -> DataFrame:
    old, new = parse_money("old_salary"), parse_money("new_salary")
    values = pairs.where(old != new).select(F.try_divide(new, old).alias("v")).where("v > 0 and v < 5")
    return _histogram(values, values.agg(F.min("v")).scalar(), values.agg(F.max("v")).scalar(), bins)


_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def run_findings(gated: DataFrame, parse_failures: dict[str, int] | None = None) -> DataFrame:
    """Findings of the run that occur, most severe first."""
    failures = parse_failures or {}
    row = gated.agg(
        _count(active_zero(("active",))).alias("zero"), _count(F.col("action") == "REJECT_MATCH").alias("reject"),
        _count(F.col("action") == "REVIEW").alias("review"),
        _count(parse_confidence("confidence") < 0.70).alias("low"))
    entries = [
        ("CRITICAL", "Active Employees with $0 Salary", F.col("zero"),
         "Salary corrections blocked; source data correction required"),
        ("MEDIUM", "Old-System Salary Parse Failures", F.lit(failures.get("old", 0)),
         "Some old-system salary values were treated as missing during normalization"),
        ("MEDIUM", "New-System Salary Parse Failures", F.lit(failures.get("new", 0)),
         "Some new-system salary values were treated as missing during normalization"),
        ("HIGH", "Wrong-Person Pairings (REJECT_MATCH)", F.col("reject"),
         "Excluded from all corrections; require manual investigation"),
        ("HIGH", "Pairs Requiring Human Review", F.col("review"), "Corrections held until reviewer approves"),
        ("HIGH", "Low-Confidence Fuzzy Matches (< 0.70)", F.col("low"),
         "High risk of wrong-person corrections; verify before applying"),
    ]
    rows = unpivoted(row, [
        ({"rank": _ORDER[s], "at": i, "severity": s, "title": t, "impact": m}, c)
        for i, (s, t, c, m) in enumerate(entries)
    ])
    return rows.where("count > 0").orderBy("rank", "at").drop("rank", "at")


FIELD_LABELS = {"salary": "Salary", "payrate": "Payrate", "status": "Worker Status",
                "hire_date": "Hire Date", "job_org": "Job / Organization"}


def change_summary(gated: DataFrame) -> DataFrame:
    """Changed pairs per field and their share of all pairs."""
    row = gated.agg(_count().alias("total"), *[_count(has_fix(f)).alias(f) for f in FIX_TYPES])
    entries = F.array(*[
        F.struct(F.lit(FIELD_LABELS[f]).alias("field"), F.col(f).alias("count"),
                 percent(F.col(f), F.col("total")).alias("pct"))
        for f in FIX_TYPES
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def recommendations(gated: DataFrame) -> DataFrame:
    """Advice that applies, in order, with the count behind it."""
    row = gated.agg(
        _count().alias("total"), _count(active_zero(("active",))).alias("zero"),
        _count(F.col("action") == "REJECT_MATCH").alias("reject"), _count(F.col("action") == "REVIEW").alias("review"))
    safe = F.try_divide(F.col("total") - F.col("reject") - F.col("review"), F.col("total"))
    low = F.coalesce(safe < 0.80, F.lit(True))
    none = (F.col("zero") == 0) & (F.col("reject") == 0) & (F.col("review") == 0) & ~low
    entries = [
        (F.col("zero"), "Fix the active employees who show no salary in the new system before loading salaries."),
        (F.col("reject"), "Investigate the blocked records; they look like wrong-person matches."),
        (F.col("review"), "Work through the review queue before running corrections."),
        (low.cast("int"), "The auto-approval rate is below the recommended 80% target; check the source extract."),
        (none.cast("int"), "All data quality checks passed. The correction files are ready to load."),
    ]
    rows = unpivoted(row, [({"position": i + 1, "advice": t}, c) for i, (c, t) in enumerate(entries)])
    return rows.where("count > 0")


# Field groups of the pair completeness table.
PAIR_GROUPS = {
    "Critical Fields": ("old_worker_id", "new_worker_id", "old_first_name_norm", "old_last_name_norm",
                        "new_worker_status", "old_salary", "new_salary"),
    "Standard Fields": ("old_hire_date", "new_hire_date", "old_worker_type", "new_worker_type",
                        "match_source", "confidence"),
    "Optional Fields": ("old_manager_id", "old_department_id", "old_job_code", "old_location_id"),
}


def pair_completeness(pairs: DataFrame) -> DataFrame:
    """Blank count and status per field group of the pair table; one aggregate."""
    listed = [(g, f) for g, fields in PAIR_GROUPS.items() for f in fields if f in pairs.columns]
    row = pairs.agg(_count().alias("n_total"), *[_count(blank_strict(f)).alias(f) for _, f in listed])
    entries = F.array(*[
        F.struct(F.lit(g).alias("group"), F.lit(f).alias("field"), F.col("n_total"), F.col(f).alias("n_blank"))
        for g, f in listed
    ])
    rows = row.select(F.explode(entries).alias("e")).select("e.*")
    share = F.try_divide(F.col("n_blank"), F.col("n_total")) * 100
    return rows.withColumns({
        "n_complete": F.col("n_total") - F.col("n_blank"),
        "status": F.when(F.coalesce(share, F.lit(0.0)) == 0, "Complete").when(share <= 5.0, "Acceptable")
        .otherwise("Critical Gap"),
    })


def topic_samples(gated: DataFrame, n: int = 8) -> DataFrame:
    """The first rows per topic of the printed report: largest salary changes, then by pair."""
    topics = F.array_compact(F.array(
        F.when(has_fix("salary"), "salary"), F.when(has_fix("status"), "status"),
        F.when(F.col("action") == "REJECT_MATCH", "wrong_match"), F.when(active_zero(("active",)), "active_zero")))
    rows = gated.select(
        F.explode(topics).alias("topic"), "pair_id", "old_worker_id", "old_full_name_norm", "old_salary",
        "new_salary", "old_worker_status", "new_worker_status", "reason", "salary_delta")
    size = F.when(F.col("topic") == "salary", F.abs("salary_delta"))
    return first_n(rows, ["topic"], [F.desc_nulls_last(size), F.col("pair_id")], n)


def report_priority(pairs: DataFrame) -> DataFrame:
    """The older review score with its reasons; salary steps exclude each other."""
    delta = parse_money("new_salary") - parse_money("old_salary")
    size = F.abs(delta)
    moved = lambda f: changed_trimmed(f"old_{f}", f"new_{f}")
    parts = [
        (text("match_source") != "worker_id", 50, "non_worker_id_match"),
        (moved("worker_status"), 40, "status_mismatch"), (size >= 5000, 30, "salary_delta_ge5000"),
        ((size >= 1000) & (size < 5000), 20, "salary_delta_1000_4999"),
        (moved("hire_date"), 15, "hire_date_mismatch"), (moved("position"), 10, "position_mismatch"),
        (moved("district"), 10, "district_mismatch"), (moved("location_state"), 10, "location_state_mismatch"),
    ]
    score = reduce(lambda a, b: a + b, [F.when(t, p).otherwise(0) for t, p, _ in parts])
    reasons = F.concat_ws("|", *[F.when(t, r) for t, _, r in parts])
    return pairs.select(
        "pair_id", "match_source", "old_worker_id", "new_worker_id", *both(["full_name_norm", "salary"]),
        F.when(delta != 0, delta).alias("salary_delta"),
        *both(["worker_status", "hire_date", "position", "district", "location_state"]),
        F.when(reasons == "", "none").otherwise(reasons).alias("priority_reason"), score.alias("priority_score"))


def side_profile(side: DataFrame) -> DataFrame:
    """One row of preflight figures of a snapshot: blanks, repeated ids and name keys.

    Repeats are rows minus distinct values, counted from two aggregates by key.
    """
    missing = lambda c: (
        _count(blank_strict(c)) if c in side.columns else F.lit(0).cast("bigint"))
    base = side.agg(
        _count().alias("rows"), missing("dob").alias("missing_dob"), missing("worker_id").alias("missing_worker_id"),
        missing("location_city").alias("missing_city"), missing("location_state").alias("missing_state"))
    repeats = lambda df: df.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
    ids = side.where(text("worker_id") != "").groupBy(text("worker_id")).agg(_count().alias("n"))
    names = side.groupBy(F.concat(text("full_name_norm"), F.lit("|"), text("dob"))).agg(_count().alias("n"))
    return base.withColumns({"duplicate_worker_ids": repeats(ids), "duplicate_name_dob": repeats(names)})


def preflight_warnings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(side, warning, count, pct) for everything that weakens the match."""
    parts = []
    for name, side in (("old", old), ("new", new)):
        row = side_profile(side)
        checks = {"missing_dob": "missing_dob", "duplicate_name_dob": "duplicate_name_dob",
                  "missing_location_state": "missing_state"}
        if "location_city" in side.columns:
            checks["missing_location_city"] = "missing_city"
        if name == "new":
            checks |= {"missing_worker_id": "missing_worker_id", "duplicate_worker_id": "duplicate_worker_ids"}
        entries = F.array(*[
            F.struct(F.lit(name).alias("side"), F.lit(w).alias("warning"), F.col(c).alias("count"),
                     percent(F.col(c), F.col("rows")).alias("pct"))
            for w, c in checks.items()
        ])
        parts.append(row.select(F.explode(entries).alias("e")).select("e.*").where("count > 0"))
    return parts[0].unionByName(parts[1])


def upload_check(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Missing required columns, column count and row count of an input."""
    missing = [c for c in required if c not in df.columns]
    return df.agg(_count().alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        F.lit(not missing).alias("valid"))


def mismatch_totals(pairs: DataFrame) -> DataFrame:
    """Trimmed mismatch totals of status, job and hire date."""
    job = reduce(lambda a, b: a | b, [differs(f) for f in ("position", "district", "location_state")])
    return pairs.agg(
        _count(changed_trimmed("old_worker_status", "new_worker_status")).alias("status"),
        _count(job).alias("job_org"), _count(changed_trimmed("old_hire_date", "new_hire_date")).alias("hire_date"),
        _count(folded("match_source") == "worker_id").alias("by_worker_id"))


def wave_table(gated: DataFrame, n: int = 6) -> DataFrame:
    """The most shared hire dates: at least 1% of the pairs and at least two."""
    counts = gated.where(F.col("new_hire_date").isNotNull()).groupBy("new_hire_date").agg(_count().alias("count"))
    total = gated.agg(_count()).scalar()
    least = F.greatest(F.lit(2), F.floor(total * 0.01))
    return _top(counts.withColumn("least", least).where("count >= least").drop("least"), "new_hire_date", n)


def run_stats(
    gated: DataFrame, review: DataFrame, identity: DataFrame, unmatched_old: DataFrame, unmatched_new: DataFrame,
    verdict: dict, run_id: str = "",
) -> DataFrame:
    """One row for the run record; ``review`` and ``identity`` are the friendly tables."""
    rows = lambda df: df.agg(_count()).scalar()
    fixes = F.split("fix_types", r"\|")
    topic = lambda *names: F.arrays_overlap(fixes, F.array(*[F.lit(n) for n in names]))
    base = review.agg(
        _count().alias("review_required_pairs"), _count(topic("salary", "payrate")).alias("salary_issues"),
        _count(topic("status")).alias("employee_status_issues"), _count(topic("hire_date")).alias("hire_date_issues"),
        _count(topic("job_org")).alias("job_and_organization_issues"))
    return base.select(
        F.lit(run_id).alias("run_id"), rows(gated).alias("total_matched_pairs"),
        rows(gated.where("action = 'APPROVE'")).alias("auto_approved_pairs"), "review_required_pairs",
        rows(unmatched_old).alias("unmatched_from_old_system"), rows(unmatched_new).alias("unmatched_from_new_system"),
        "salary_issues", "employee_status_issues", "hire_date_issues", "job_and_organization_issues",
        rows(identity).alias("identity_conflicts"), F.lit("Yes" if verdict["passed"] else "No").alias("gate_passed"),
        F.lit(" | ".join(verdict["reasons"])).alias("gate_reason"),
    ).withColumn("total_unmatched", F.col("unmatched_from_old_system") + F.col("unmatched_from_new_system"))
