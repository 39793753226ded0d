"""The section, the first records and the first groups of every finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import blank_audit, folded
from ..policy import load_policy
from ..sources.snapshots import ROW
from .audit_facts import roles_of, row_number_text, shown, with_facts
from .checks import (
    CATALOG, SAMPLES, all_findings, canonical_conflicts, duplicate_rows, flagged_rows, manager_loops, multiple_plan_rows, pay_equity_groups,
    round_salaries, row_cases, salary_outliers, same_name_other_id,
)
from .ranking import first_n

# The section of a check; some checks are in the first section whenever, others only where a finding is critical.
SECTIONS = {
    "CRITICAL_CHECKS": ("duplicate_worker_id", "active_zero_salary", "benefits_after_termination", "invalid_date_logic", "active_with_termination_date",
                        "missing_required_identity", "ghost_employee_indicator"),
    "PAYROLL_CHECKS": ("pay_type_missing_or_invalid", "compensation_type_mismatch", "comp_dual_value_conflict", "missing_standard_hours_hourly",
                       "hourly_implausible_payrate", "salaried_implausible_salary", "annualized_comp_mismatch", "pay_context_sanity_check"),
    "BENEFITS_CHECKS": ("benefits_enrolled_not_eligible", "benefits_eligible_not_enrolled", "invalid_coverage_level", "dependents_without_coverage",
                        "benefits_start_before_hire", "benefits_after_termination_window", "benefits_waiting_period_violation",
                        "employment_type_eligibility_conflict", "multiple_active_benefit_plans", "coverage_vs_dependent_sanity"),
    "DATE_CHECKS": ("impossible_dates",),
    "STATUS_CHECKS": ("status_hire_date_mismatch", "status_no_terminated", "status_high_pending"),
    "ORG_CHECKS": ("missing_manager", "manager_loop"),
    "SALARY_CHECKS": ("salary_outlier", "suspicious_round_salary"),
    "PAY_EQUITY": ("pay_equity_flag",),
    "IDENTITY_CHECKS": ("duplicate_name_different_id",),
    "SUSPICIOUS": ("salary_suspicious_default", "hire_date_suspicious_default", "status_suspicious_value"),
    "CONTACT_CHECKS": ("phone_invalid",),
    "DATA_QUALITY": ("age_uniformity", "combined_field"),
    "COMPLETENESS": ("high_blank_rate",),
}
CRITICAL_IF = ("pay_type_missing_or_invalid", "compensation_type_mismatch", "hourly_implausible_payrate", "salaried_implausible_salary",
               "benefits_enrolled_not_eligible")
#: Groups that a finding shows at most.
GROUPS = 20
_KEY = ["check_key", "field", "severity", "value"]


def section_of(check: str = "check_key", severity: str = "severity") -> Column:
    """The section of a finding; repeated values of a field have one of their own."""
    known = F.create_map(*[F.lit(x) for s, keys in SECTIONS.items() for k in keys for x in (k, s)])
    critical = F.col(check).isin(*CRITICAL_IF) & (F.col(severity) == "CRITICAL")
    return F.when(critical, "CRITICAL_CHECKS").otherwise(F.coalesce(F.try_element_at(known, F.col(check)), F.lit("DUPLICATES")))


def _marked(rows: DataFrame, key: str, field: str, severity: str, current: Column) -> DataFrame:
    return rows.select(
        ROW, F.lit(key).alias("check_key"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit("").alias("value"),
        current.cast("string").alias("current_value"), F.lit("").alias("reason"))


def flagged_records(df: DataFrame, as_of: str, config: dict, raw: DataFrame | None) -> DataFrame:
    """One row per record and finding that it belongs to, whichever kind of check made the finding."""
    roles = roles_of(df)
    has = lambda *names: set(names) <= set(roles)
    facts = with_facts(df)
    own = flagged_rows(facts, row_cases(facts, config, as_of))
    parts = [own.select(ROW, "check_key", "field", "severity", F.col("setting").alias("value"), "current_value", "reason")]
    for field in config["duplicate_check_fields"]:
        if field in df.columns:
            severity = {"email": "MEDIUM", "worker_id": "CRITICAL", "last4_ssn": "CRITICAL"}.get(field, "LOW")
            parts.append(_marked(duplicate_rows(df, field), f"duplicate_{field}", field, severity, shown(field)))

    def add(rows: DataFrame, key: str, field: str, current: Column) -> None:
        parts.append(_marked(rows, key, field, CATALOG[key][1], current))

    if has("worker_id") and (has("first_name", "last_name") or has("full_name")):
        add(same_name_other_id(df), "duplicate_name_different_id", roles["worker_id"], F.col("worker_id"))
    if has("worker_id", "plan"):
        add(multiple_plan_rows(df), "multiple_active_benefit_plans", roles["plan"], shown(roles["plan"]))
    if has("salary", "department"):
        add(salary_outliers(df, config), "salary_outlier", roles["department"], F.col("salary"))
    if has("salary", "status"):
        add(round_salaries(df), "suspicious_round_salary", "salary", F.col("salary"))
    if "status" in roles:
        add(df.where(folded(roles["status"]) == "pending"), "status_high_pending", roles["status"], shown(roles["status"]))
    if raw is not None:
        on_id = F.col("duplicate_canonical_field") == "worker_id"
        parts.append(canonical_conflicts(raw).where("duplicate_classification = 'duplicate_conflicting_values'").select(
            ROW, F.when(on_id, "duplicate_canonical_worker_id_conflict").otherwise("duplicate_canonical_conflict").alias("check_key"),
            F.col("duplicate_canonical_field").alias("field"), F.when(on_id, "CRITICAL").otherwise("HIGH").alias("severity"), F.lit("").alias("value"),
            F.col("duplicate_values").alias("current_value"), F.lit("").alias("reason")))
    columns = [c for c in df.columns if c != ROW and not c.startswith("f_")]
    blanks = F.array_compact(F.array(*[F.when(blank_audit(F.col(f"`{c}`")), F.lit(c)) for c in columns]))
    blank = df.select(ROW, F.explode(blanks).alias("field"))
    # The severity of a blank field depends on its rate, which the finding has.
    parts.append(blank.select(
        ROW, F.lit("high_blank_rate").alias("check_key"), "field", F.lit("").alias("severity"), F.lit("").alias("value"), F.lit("").alias("current_value"),
        F.lit("").alias("reason")))
    return reduce(DataFrame.unionByName, parts)


def first_records(flagged: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first records of every finding as an array of small JSON maps; each map output is cut to ``n`` rows a finding before the shuffle."""
    few = first_n(flagged, _KEY, [ROW, "reason"], n)
    item = F.to_json(F.create_map(
        F.lit("row_number"), row_number_text().cast("string"), F.lit("value"), F.coalesce("current_value", F.lit("")), F.lit("why_flagged"), F.col("reason")))
    ordered = F.sort_array(F.collect_list(F.struct(ROW, F.col("reason").alias("r"), item.alias("item"))))
    return few.groupBy(*_KEY).agg(ordered.alias("s")).select(*_KEY, F.transform("s", lambda x: x["item"]).alias("sample_rows"))


def _group_lists(df: DataFrame, config: dict) -> DataFrame | None:
    """(check_key, group_sample, group_rows): the first groups of the checks whose findings are groups."""
    roles = roles_of(df)
    parts = []

    def listed(rows: DataFrame, key: str, order: list[str]) -> None:
        few = rows.withColumn("check_key", F.lit(key))
        few = first_n(few, ["check_key"], order, GROUPS, rank="at")
        item = F.to_json(F.struct(*[c for c in rows.columns]))
        parts.append(few.select("check_key", "at", item.alias("item")))

    if {"salary", "department", "title"} <= set(roles):
        listed(pay_equity_groups(df, config), "pay_equity_flag", ["title", "department"])
    if {"worker_id", "manager"} <= set(roles) and config.get("manager_loop_check"):
        loops = manager_loops(df)
        listed(loops, "manager_loop", loops.columns)
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts).groupBy("check_key").agg(F.sort_array(F.collect_list(F.struct("at", "item"))).alias("g"))
    items = F.transform("g", lambda x: x["item"])
    return rows.select("check_key", F.slice(items, 1, SAMPLES).alias("group_sample"), items.alias("group_rows"))


def detailed_findings(df: DataFrame, as_of: str, policy: dict | None = None, raw: DataFrame | None = None) -> DataFrame:
    """``all_findings`` with ``section``, ``sample_rows`` (8 at most) and ``group_rows`` (20 at most), arrays of JSON texts."""
    config = load_policy(policy)["internal_audit"]
    findings = all_findings(df, as_of, policy, raw).withColumn("section", section_of())
    # Blank fields have their samples whatever the severity of the finding is.
    key = F.when(F.col("check_key") == "high_blank_rate", "").otherwise(F.col("severity"))
    samples = first_records(flagged_records(df, as_of, config, raw)).withColumnRenamed("severity", "_severity")
    found = findings.withColumn("_severity", key).join(samples, ["check_key", "field", "_severity", "value"], "left").drop("_severity")
    none = F.array().cast("array<string>")
    grouped = _group_lists(df, config)
    if grouped is None:
        return found.withColumns({"sample_rows": F.coalesce("sample_rows", none), "group_rows": none})
    found = found.join(grouped, "check_key", "left")
    return found.withColumns({"sample_rows": F.coalesce("sample_rows", "group_sample", none), "group_rows": F.coalesce("group_rows", none)}).drop("group_sample")
