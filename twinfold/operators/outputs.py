"""Tables made from gated pairs: comparisons, queues, corrections, holds and trails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import blank_strict, changed, folded, text
from ..functions.labels import friendly_issue_types, lookup
from ..functions.numbers import parse_confidence, parse_money, review_severity
from ..policy import extra_fields, load_policy
from ..sources.snapshots import ensure_columns
from .gate import (
    as_text, classify_field, differs, explanation_text, fix_tests, fix_text, has_fix,
    priority_labels, priority_score, summary_text,
)

SIDE_BY_SIDE = (
    "full_name_norm", "first_name_norm", "last_name_norm", "middle_name", "suffix", "worker_status",
    "worker_type", "hire_date", "position", "district", "location_state", "location", "salary", "payrate",
)
CHANGE_FIELDS = (
    "salary", "payrate", "worker_status", "hire_date", "position", "district", "location_state",
)


def both(fields: tuple[str, ...] | list[str]) -> list[str]:
    return [f"{side}_{f}" for f in fields for side in ("old", "new")]


def _paired(df: DataFrame, fields) -> DataFrame:
    return ensure_columns(df, both(fields))


def _extras(df: DataFrame, policy: dict, taken) -> list[str]:
    return [
        f for f in extra_fields(policy)
        if f not in taken and (f"old_{f}" in df.columns or f"new_{f}" in df.columns)
    ]


def _extra_columns(fields: list[str], policy: dict) -> list[Column]:
    """old_/new_/mm_ triplets and one flag per configured group."""
    columns = []
    for f in fields:
        columns += [
            F.coalesce(F.col(f"{s}_{f}").cast("string"), F.lit("")).alias(f"{s}_{f}") for s in ("old", "new")
        ] + [changed(f"old_{f}", f"new_{f}").alias(f"mm_{f}")]
    for group, members in policy["extra_fields"].get("groups", {}).items():
        tests = [changed(f"old_{m}", f"new_{m}") for m in members if m in fields]
        flag = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        columns.append(flag.alias(f"mismatch_group_{group}"))
    return columns


BAND_COLUMNS = tuple(f"comp_band_{c}" for c in ("status", "min", "mid", "max", "match"))


def wide_compare(gated: DataFrame, policy: dict | None = None) -> DataFrame:
    """One row per pair: keys, decision, both records, deltas and change flags."""
    policy = load_policy(policy)
    df = _paired(gated, SIDE_BY_SIDE)
    extras = _extras(df, policy, SIDE_BY_SIDE)
    if extras:
        df = _paired(df, extras)
    pattern = F.when(has_fix("hire_date"), F.col("per_fix")["hire_date"]["reason"]).otherwise("")
    return df.select(
        "pair_id", "match_source", "confidence", "action", "reason", fix_text().alias("fix_types"),
        summary_text().alias("summary"), explanation_text(policy).alias("match_explanation"),
        priority_score(policy, exempt_auto=False).alias("priority_score"),
        "old_worker_id", "new_worker_id", *both(SIDE_BY_SIDE), "name_change_detected", "salary_delta",
        F.when(F.col("salary_delta").isNotNull(), F.bround("salary_ratio", 6)).alias("salary_ratio"),
        "payrate_delta", F.coalesce("conversion_type", F.lit("")).alias("conversion_type"),
        differs("worker_status").alias("status_changed"), differs("hire_date").alias("hire_date_changed"),
        has_fix("job_org").alias("job_org_changed"), pattern.alias("hire_date_pattern"),
        (F.col("action") == "REVIEW").alias("needs_review"), F.col("action").alias("suggested_action"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in BAND_COLUMNS],
        *_extra_columns(extras, policy),
    )


def lookup_keys(pairs: DataFrame) -> DataFrame:
    """Slim key table; the match key is the old id of id-matched pairs."""
    df = _paired(pairs, ["recon_id"])
    by_id = folded("match_source") == "worker_id"
    return df.select(
        "pair_id", "match_source", "confidence",
        F.when(by_id, F.coalesce("old_worker_id", F.lit(""))).otherwise("").alias("match_key"),
        *both(["worker_id"]),
        *[F.coalesce(c, F.lit("")).alias(c) for c in both(["recon_id"])],
        *both(["full_name_norm"]),
    )


def ui_pairs(gated: DataFrame, policy: dict | None = None) -> DataFrame:
    """Stable table for a front end; extra field triplets follow the fixed columns."""
    policy = load_policy(policy)
    df = _paired(gated, CHANGE_FIELDS + ("location", "worker_type"))
    extras = _extras(df, policy, CHANGE_FIELDS)
    if extras:
        df = _paired(df, extras)
    lowest = F.array_min(F.transform(F.map_values("per_fix"), lambda v: v["min_confidence"]))
    flags = {"salary": "salary", "payrate": "payrate", "status": "status", "hire_date": "hire_date", "job_org": "job_org"}
    return df.select(
        F.lit(policy["ui_contract"]["version"]).alias("ui_contract_version"),
        "pair_id", "match_source", "old_worker_id", "new_worker_id", fix_text().alias("fix_types"),
        "action", "reason", as_text(parse_confidence("confidence"), 4).alias("confidence"),
        as_text(lowest, 4).alias("min_confidence"), priority_score(policy).alias("priority_score"),
        summary_text().alias("summary"),
        *[has_fix(f).alias(f"has_{n}_mismatch") for n, f in flags.items()],
        as_text("salary_delta", 2).alias("salary_delta"), as_text("payrate_delta", 4).alias("payrate_delta"),
        *both(CHANGE_FIELDS),
        *[F.coalesce(c, F.lit("")).alias(c) for c in both(["location", "worker_type"])],
        *_extra_columns(extras, policy),
    )


def review_queue(gated: DataFrame, policy: dict | None = None, ordered: bool = True) -> DataFrame:
    """Pairs to review, most urgent first."""
    queue = gated.where("action = 'REVIEW'").withColumn("_size", F.abs("salary_delta"))
    queue = queue.select(
        "pair_id", "match_source", "old_worker_id", "new_worker_id", "old_full_name_norm",
        fix_text().alias("fix_types"), as_text(parse_confidence("confidence"), 4).alias("confidence"),
        "action", "reason", priority_score(policy).alias("priority_score"),
        priority_labels(policy).alias("priority_labels"), summary_text().alias("summary"),
        explanation_text(policy).alias("match_explanation"), as_text("salary_delta", 2).alias("salary_delta"),
        *both(CHANGE_FIELDS), "_size",
    )
    if ordered:
        queue = queue.orderBy(
            F.desc("priority_score"), F.desc_nulls_last("_size"), "pair_id")
    return queue.drop("_size")


# Reason code, output name, and the columns of each correction table.
CORRECTIONS = {
    "salary": ("RECON_SALARY_CORRECTION", {"compensation_amount": "new_salary"}, True),
    "status": ("RECON_STATUS_CORRECTION", {"worker_status": "new_worker_status"}, True),
    "hire_date": ("RECON_HIRE_DATE_CORRECTION", {"hire_date": "new_hire_date"}, False),
    "job_org": (
        "RECON_JOB_ORG_CORRECTION",
        {"position": "new_position", "district": "new_district",
         "location_state": "new_location_state", "location": "new_location"}, True,
    ),
}


def active_zero(statuses: tuple[str, ...] = ("active", "")) -> Column:
    """Active in the new system with no salary or a salary of zero."""
    salary = parse_money("new_salary")
    return folded("new_worker_status").isin(*statuses) & F.coalesce(salary == 0.0, F.lit(True))


def _confidence_text() -> Column:
    return as_text(parse_confidence("confidence"), 4)


def correctable(gated: DataFrame, kind: str, only_approved: bool = True) -> DataFrame:
    """Approved pairs whose field of this kind may be loaded."""
    rows = gated.where((F.col("action") == "APPROVE") & has_fix(kind))
    if only_approved:
        rows = rows.where(F.col("per_fix")[kind]["action"] == "APPROVE")
    return rows.where(~active_zero()) if kind == "salary" else rows


def corrections(gated: DataFrame, kind: str, as_of: str, only_approved: bool = True) -> DataFrame:
    """Load table of one correction type."""
    code, values, dated = CORRECTIONS[kind]
    rows = ensure_columns(correctable(gated, kind, only_approved), list(values.values()))
    return rows.select(
        F.coalesce("new_worker_id", F.lit("")).alias("worker_id"),
        *([F.lit(as_of).alias("effective_date")] if dated else []),
        *[F.coalesce(source, F.lit("")).alias(name) for name, source in values.items()],
        *([F.lit("USD").alias("currency")] if kind == "salary" else []),
        F.lit(code).alias("reason"), "pair_id", "match_source", _confidence_text().alias("confidence"),
        summary_text().alias("summary"),
    )


def review_needed(gated: DataFrame) -> DataFrame:
    """One row per pair under review, with the field reasons and the highest threshold."""
    held = F.filter("fix_types", lambda f: F.col("per_fix")[f]["action"] == "REVIEW")
    reasons = F.transform(held, lambda f: F.concat(f, F.lit(":"), F.col("per_fix")[f]["reason"]))
    highest = F.array_max(F.transform(held, lambda f: F.col("per_fix")[f]["min_confidence"]))
    return gated.where("action = 'REVIEW'").select(
        F.coalesce("new_worker_id", F.lit("")).alias("worker_id"), "pair_id", "match_source",
        fix_text().alias("fix_types"), F.lit("REVIEW").alias("action"),
        F.array_join(reasons, "|").alias("reason"), _confidence_text().alias("confidence"),
        as_text(highest, 4).alias("min_confidence"), summary_text().alias("summary"),
    )


def held_corrections(gated: DataFrame) -> DataFrame:
    """Pairs kept out of the corrections, and why; one pass over the pairs."""
    blocked = (
        (F.col("action") == "APPROVE") & has_fix("salary")
        & (F.col("per_fix")["salary"]["action"] == "APPROVE") & active_zero()
    )
    reason = F.when(
        F.col("action").isin("REVIEW", "REJECT_MATCH"), F.concat(F.lit("overall_"), F.col("action"))
    ).when(blocked, "active_zero_salary_blocked")
    return gated.withColumn("hold_reason", reason).where("hold_reason is not null").select(
        F.coalesce("new_worker_id", F.lit("")).alias("worker_id"), "pair_id", "match_source",
        fix_text().alias("fix_types"), F.col("action").alias("overall_action"), "hold_reason",
        _confidence_text().alias("confidence"), summary_text().alias("summary"),
    )


def corrections_manifest(gated: DataFrame) -> DataFrame:
    """One row per correction; the kinds are exploded from one pass over the pairs."""
    allowed = F.filter(
        F.array(*[F.lit(k) for k in CORRECTIONS]),
        lambda k: F.array_contains("fix_types", k) & (F.col("per_fix")[k]["action"] == "APPROVE")
        & ~((k == "salary") & active_zero()),
    )
    rows = gated.where("action = 'APPROVE'").withColumn("correction_type", F.explode(allowed))
    return rows.select(
        "correction_type", F.coalesce("new_worker_id", F.lit("")).alias("worker_id"), "pair_id",
        "match_source", fix_text().alias("fix_types"),
        F.col("per_fix")[F.col("correction_type")]["action"].alias("action"),
        _confidence_text().alias("confidence"), summary_text().alias("summary"),
        F.concat(F.lit("corrections_"), F.col("correction_type"), F.lit(".csv")).alias("output_file"),
    )


# Display words of actions, fix types, correction types and columns.
ACTION_LABELS = {"APPROVE": "Safe", "REVIEW": "Needs Review", "REJECT_MATCH": "Wrong Match"}
SHEET_FIX_LABELS = {"salary": "Salary", "status": "Status", "hire_date": "Hire Date", "job_org": "Job / Org"}
CORRECTION_LABELS = {
    "salary": "Update salary", "status": "Change status", "hire_date": "Update hire date",
    "job_org": "Update position / org",
}


def action_label(c: Column | str) -> Column:
    value = F.upper(text(c))
    return F.coalesce(lookup(ACTION_LABELS, value), text(c))


def fix_types_label(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(text(c), r"\|"), text), lambda p: p != "")
    shown = F.transform(parts, lambda p: F.coalesce(
        lookup(SHEET_FIX_LABELS, p), F.initcap(F.replace(p, F.lit("_"), F.lit(" ")))))
    return F.when(F.size(parts) == 0, "No Changes").otherwise(F.array_join(shown, ", "))


def enhance_manifest(manifest: DataFrame) -> DataFrame:
    """Display words and a description per correction."""
    kind = folded("correction_type")
    return manifest.withColumns({
        "action": action_label("action"), "fix_types": fix_types_label(F.col("fix_types")),
        "fix_description": F.coalesce(lookup(CORRECTION_LABELS, kind), F.lit("Update field")),
    })


def audit_trail(gated: DataFrame, recorded_at: str) -> DataFrame:
    """One append-only decision row per pair."""
    optional = lambda c: (
        F.nullif(F.col(c).cast("string"), F.lit("")) if c in gated.columns else F.lit(None).cast("string"))
    return gated.select(
        "pair_id", F.upper(text("action")).alias("action"), "reason", fix_text().alias("fix_types"),
        "match_source", F.coalesce(F.col("confidence").cast("string"), F.lit("")).alias("confidence"),
        optional("conversion_type").alias("conversion_type"),
        optional("comp_band_status").alias("comp_band_status"),
        optional("name_change_detected").alias("name_change_detected"),
        F.lit(recorded_at).alias("recorded_at"),
    )


def action_counts(gated: DataFrame) -> DataFrame:
    names = {"approve": "APPROVE", "review": "REVIEW", "reject_match": "REJECT_MATCH"}
    return gated.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("action") == a).alias(n) for n, a in names.items()],
    )


def friendly_review(gated: DataFrame, policy: dict | None = None) -> DataFrame:
    """The review queue in plain words."""
    first = lambda *cols: F.coalesce(
        *[F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in cols])
    df = ensure_columns(gated, both(["district", "department", "full_name_norm"]))
    base = friendly_issue_types(F.col("fix_types"))
    issue = F.when(base == "", "Review Required").otherwise(base)
    other = folded("match_source") != "worker_id"
    issue = F.when(
        other & ~issue.contains("Identity"), F.concat(issue, F.lit(", Identity"))
    ).when(other, "Identity").otherwise(issue)
    return df.where("action = 'REVIEW'").withColumn("priority_score", priority_score(policy)).select(
        F.coalesce(first("old_full_name_norm", "new_full_name_norm"), F.lit("")).alias("employee_name"),
        issue.alias("issue_type"), review_severity(F.col("priority_score")).alias("severity"),
        F.coalesce(first("old_district", "new_district", "old_department", "new_department"),
                   F.lit("Unassigned")).alias("department"),
        summary_text().alias("what_changed"), explanation_text(policy).alias("recommended_action"),
        "pair_id", "match_source", "old_worker_id", "new_worker_id", fix_text().alias("fix_types"),
        "reason", "priority_score", "name_change_detected",
    )


def fix_type_slice(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one fix type from an array column; salary takes pay rates along."""
    wanted = ("salary", "payrate") if kind == "salary" else (kind,)
    return rows.where(reduce(lambda a, b: a | b, [F.array_contains("fix_types", w) for w in wanted]))


def text_slice(rows: DataFrame, kind: str) -> DataFrame:
    """The same for a pipe-joined text column."""
    return fix_type_slice(rows.withColumn("fix_types", F.split("fix_types", r"\|")), kind).withColumn(
        "fix_types", F.array_join("fix_types", "|"))


def identity_conflicts(review: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Review rows that raise an identity question plus blocked candidates, once per person.

    ``review`` is the friendly review table. The first row per old id, new id
    and name wins: review rows before conflicts, then the smallest pair id.
    """
    doubtful = (folded("match_source") != "worker_id") | F.col("name_change_detected")
    columns = ["employee_name", "issue_type", "severity", "department", "what_changed",
               "recommended_action", "pair_id", "match_source", "old_worker_id", "new_worker_id"]
    asked = review.where(doubtful).withColumns({"issue_type": F.lit("Identity"), "_from": F.lit(0)})
    df = ensure_columns(conflicts, both(["district", "full_name_norm"]))
    pick = lambda f, other: F.coalesce(
        F.nullif(text(f"old_{f}"), F.lit("")), F.nullif(text(f"new_{f}"), F.lit("")), F.lit(other))
    blocked = df.withColumns({
        "employee_name": pick("full_name_norm", ""), "issue_type": F.lit("Identity"),
        "severity": F.lit("High"), "department": pick("district", "Unassigned"),
        "what_changed": F.lit("Worker ID conflict requires identity review."),
        "recommended_action": F.lit("Confirm the correct employee identity before loading corrections."),
        "_from": F.lit(1),
    })
    every = asked.select(*columns, "_from").unionByName(blocked.select(*columns, "_from"))
    keys = ["old_worker_id", "new_worker_id", "employee_name"]
    best = F.min_by(F.struct(*columns), F.struct("_from", "pair_id"))
    return every.groupBy(*keys).agg(best.alias("_best")).select("_best.*")


SHEETS = {
    "salary": ("old_worker_status", "new_worker_status", "old_salary", "new_salary", "salary_delta",
               "old_payrate", "new_payrate", "payrate_delta"),
    "status": ("old_worker_status", "new_worker_status", "old_worker_type", "new_worker_type"),
    "hire_date": ("old_worker_status", "new_worker_status", "old_hire_date", "new_hire_date", "hire_date_pattern"),
    "job_org": ("old_worker_status", "new_worker_status", "old_position", "new_position",
                "old_district", "new_district", "old_location_state", "new_location_state"),
}


def slim(wide: DataFrame, kind: str, labels: bool = False) -> DataFrame:
    """The columns of one topic sheet, of the rows with that fix type."""
    lead = ("pair_id", "match_source", "confidence", "action", "priority_score", "old_worker_id",
            "old_first_name_norm", "old_last_name_norm")
    columns = [c for c in lead + SHEETS[kind] + ("fix_types", "reason", "summary") if c in wide.columns]
    rows = wide.where(F.contains(F.col("fix_types"), F.lit(kind))).select(*columns)
    if not labels:
        return rows
    rows = rows.withColumns({"action": action_label("action"), "fix_types": fix_types_label(F.col("fix_types"))})
    return rows.withColumnsRenamed({c: c.replace("_", " ").title() for c in columns})


def extra_field_mismatch(wide: DataFrame) -> DataFrame:
    flags = [F.col(c) for c in wide.columns if c.startswith("mm_")]
    return wide.where(reduce(lambda a, b: a | b, flags) if flags else F.lit(False))


def held_with_names(held: DataFrame, wide: DataFrame) -> DataFrame:
    """Held rows with the names found under the same id; blocked and rejected rows only."""
    names = wide.groupBy(F.col("old_worker_id").alias("worker_id")).agg(
        F.min_by(
            F.struct(F.coalesce("old_first_name_norm", F.lit("")).alias("first_name"),
                     F.coalesce("old_last_name_norm", F.lit("")).alias("last_name")), "pair_id",
        ).alias("n"))
    kept = held.where(F.col("hold_reason").rlike("BLOCKED|REJECT_MATCH|active_zero_salary_blocked"))
    return kept.join(names, "worker_id", "left").select(
        "worker_id", F.coalesce("n.first_name", F.lit("")).alias("first_name"),
        F.coalesce("n.last_name", F.lit("")).alias("last_name"),
        *[c for c in held.columns if c != "worker_id"],
    )


def recommended_step(action: Column, fixes: Column) -> Column:
    """What the reviewer should do, from the action and the pipe-joined fix types."""
    parts = F.split(F.lower(fixes), r"\|")
    steps = F.concat_ws(
        ", ",
        F.when(F.array_contains(parts, "salary"), "review salary change"),
        F.when(F.array_contains(parts, "status"), "confirm status"),
        F.when(F.array_contains(parts, "hire_date"), "verify hire date"),
        F.when(F.array_contains(parts, "job_org"), "check position / org"),
    )
    return (
        F.when(action == "REJECT_MATCH", "Verify worker identity - match may be wrong")
        .when(action == "APPROVE", "No action needed - auto-approved")
        .when(steps != "", F.concat(F.lit("Manually review: "), steps)).otherwise("Manually review")
    )


def review_slim(queue: DataFrame, wide: DataFrame) -> DataFrame:
    """Eight-column review sheet; names come from the wide table by pair."""
    names = wide.select("pair_id", "old_first_name_norm", "old_last_name_norm")
    return queue.join(names, "pair_id", "left").select(
        "old_worker_id", "old_first_name_norm", "old_last_name_norm", action_label("action").alias("action"),
        fix_types_label(F.col("fix_types")).alias("fix_types"), "summary",
        recommended_step(F.upper(text("action")), F.col("fix_types")).alias("recommended_action"),
        "priority_score",
    )


def single_type_rows(gated: DataFrame, kind: str) -> DataFrame:
    """Pairs with a mismatch of one type, and the plain per-field verdict on it."""
    return gated.where(fix_tests()[kind])


def single_type_audit(gated: DataFrame, kind: str, policy: dict | None = None) -> dict[str, DataFrame]:
    """ui, corrections, review and manifest tables of one correction type.

    The corrections are gated by the field verdict alone, without the pair-level
    overrides; ``gated`` must come from ``gate`` without wave dates.
    """
    policy = load_policy(policy)
    rows = single_type_rows(gated, kind).withColumn("_gate", classify_field(kind, policy))
    worker = F.coalesce(
        F.nullif(text("new_worker_id"), F.lit("")), F.nullif(text("old_worker_id"), F.lit("")), F.lit(""))
    one = rows.withColumn("fix_types", F.array(F.lit(kind)))
    summary = one.withColumn("summary", summary_text())
    values = ensure_columns(summary, ["new_location"])
    fields = [F.coalesce(F.trim(F.col(s)), F.lit("")).alias(n) for n, s in CORRECTIONS[kind][1].items()]
    shown = values.select(
        worker.alias("worker_id"), *fields, F.col("_gate.reason").alias("reason"), "pair_id", "match_source",
        F.coalesce(F.col("confidence").cast("string"), F.lit("")).alias("confidence"), "summary",
        F.col("_gate.action").alias("action"),
    )
    return {
        "ui": ui_pairs(rows.drop("_gate"), policy).withColumn("audit_type", F.lit(kind)),
        "corrections": shown.where("action = 'APPROVE'").drop("action"),
        "review": shown.where("action = 'REVIEW'"),
        "manifest": shown.select(
            F.lit(kind).alias("correction_type"), "worker_id", "pair_id", "match_source", "action",
            "confidence", "summary"),
    }


def strip_pii(df: DataFrame, policy: dict | None = None, target: str = "exports") -> DataFrame:
    """Drop the last four digits, and birth dates unless the policy lets them out."""
    gone = both(["last4_ssn"]) + ["last4_ssn"]
    if not load_policy(policy)["pii"][f"include_dob_in_{target}"]:
        gone += both(["dob"]) + ["dob"]
    return df.drop(*gone)


def non_blank_columns(df: DataFrame, context: list[str]) -> list[str]:
    """The context columns that hold a value in some row; one aggregate row reaches the driver."""
    present = [c for c in context if c in df.columns]
    if not present:
        return []
    found = df.agg(*[F.bool_or(~blank_strict(c)).alias(c) for c in present]).first()
    return [c for c in present if found[c]]


def trim_empty_columns(df: DataFrame, context: list[str]) -> DataFrame:
    """Drop the context columns that are blank in every row."""
    keep = set(non_blank_columns(df, context))
    return df.select(*[c for c in df.columns if c not in context or c in keep])
