"""Data-quality checks of one table.

Checks that look at one row are boolean columns. All of them are counted in a
single aggregate, and the same columns give the row-level issues. Checks over
groups use an aggregate per group and a join back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import blank_audit, folded, strip, text
from ..functions.numbers import SALARY_RANGES, completeness_status, number, salary_range
from ..functions.text import plan_tokens
from ..policy import load_policy
from ..sources.snapshots import ROW, audit_sources
from .advice import DEFAULT_ACTION, advice
from .audit_facts import roles_of, row_number_text, shown, with_facts
from .heavy import join_figures
from .quantiles import exact_quantiles, quantile_struct
from .ranking import first_n

# Every check with its display name and headline severity.
CATALOG = {
    "duplicate_worker_id": ("Duplicate worker_id", "CRITICAL"),
    "invalid_date_logic": ("Invalid date logic", "CRITICAL"),
    "active_with_termination_date": ("Active employees with termination date", "CRITICAL"),
    "missing_required_identity": ("Missing required identity fields", "CRITICAL"),
    "duplicate_canonical_worker_id_conflict": ("Duplicate canonical worker_id with conflicting values", "CRITICAL"),
    "duplicate_email": ("Duplicate email", "MEDIUM"),
    "duplicate_last4_ssn": ("Duplicate last4_ssn", "CRITICAL"),
    "active_zero_salary": ("Active employees with <= $0 or missing salary/payrate", "CRITICAL"),
    "pay_type_missing_or_invalid": ("Missing or Invalid Pay Type", "CRITICAL"),
    "compensation_type_mismatch": ("Compensation Type Mismatch", "CRITICAL"),
    "hourly_implausible_payrate": ("Implausible Hourly Pay Rate", "CRITICAL"),
    "salaried_implausible_salary": ("Implausible Annual Salary", "CRITICAL"),
    "annualized_comp_mismatch": ("Annualized Compensation Mismatch", "HIGH"),
    "pay_context_sanity_check": ("Payroll Context Mismatch", "HIGH"),
    "benefits_enrolled_not_eligible": ("Enrolled in Benefits but Not Eligible", "CRITICAL"),
    "benefits_eligible_not_enrolled": ("Eligible for Benefits but Not Enrolled", "HIGH"),
    "invalid_coverage_level": ("Invalid Coverage Level", "HIGH"),
    "dependents_without_coverage": ("Dependents Without Proper Coverage", "HIGH"),
    "benefits_after_termination": ("Benefits Active After Termination", "CRITICAL"),
    "benefits_start_before_hire": ("Benefits Start Date Before Hire Date", "HIGH"),
    "benefits_after_termination_window": ("Benefits Active Too Long After Termination", "HIGH"),
    "benefits_waiting_period_violation": ("Benefits Waiting Period Violation", "HIGH"),
    "employment_type_eligibility_conflict": ("Employment Type Benefits Eligibility Conflict", "HIGH"),
    "multiple_active_benefit_plans": ("Multiple Active Benefit Plans", "HIGH"),
    "coverage_vs_dependent_sanity": ("Coverage Level vs Dependent Count Mismatch", "HIGH"),
    "comp_dual_value_conflict": ("Salary and Pay Rate Conflict", "HIGH"),
    "missing_standard_hours_hourly": ("Missing Standard Hours for Hourly Worker", "HIGH"),
    "salary_suspicious_default": ("Suspicious salary default values", "HIGH"),
    "hire_date_suspicious_default": ("Suspicious hire date defaults", "HIGH"),
    "status_suspicious_value": ("Suspicious status placeholders", "HIGH"),
    "impossible_dates": ("Impossible dates", "HIGH"),
    "status_hire_date_mismatch": ("Status and termination-date mismatches", "HIGH"),
    "missing_manager": ("Active employees with no manager", "MEDIUM"),
    "manager_loop": ("Manager reporting loops", "HIGH"),
    "salary_outlier": ("Salary outliers by department", "MEDIUM"),
    "pay_equity_flag": ("Pay equity variance flags", "HIGH"),
    "ghost_employee_indicator": ("Ghost employee indicators", "CRITICAL"),
    "duplicate_name_different_id": ("Duplicate names with different IDs", "MEDIUM"),
    "suspicious_round_salary": ("Suspicious round number salaries", "LOW"),
    "phone_invalid": ("Invalid phone numbers", "HIGH"),
    "status_no_terminated": ("No terminated employees found", "MEDIUM"),
    "status_high_pending": ("Unusually high Pending status rate", "MEDIUM"),
    "age_uniformity": ("Age uniformity - possible placeholder data", "MEDIUM"),
    "combined_field": ("Combined field detected", "LOW"),
    "duplicate_canonical_conflict": ("Duplicate canonical field with conflicting values", "HIGH"),
    "high_blank_rate": ("High blank rate", "MEDIUM"),
}
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
# Words of the status and leave checks.
LEAVE_ACTIVE = ("active", "open", "working")
LEAVE_INACTIVE = ("terminated", "inactive", "leave", "leave_of_absence", "loa", "suspended")
LEFT_WORDS = ("terminated", "term", "separated", "resigned", "dismissed")
ROUND_VALUES = (1, 10, 100, 1000, 10000, 12345, 99999, 999999)
SAMPLES = 8


@dataclass(frozen=True)
class Case:
    """One way a row fails a check. ``issue`` names it in the row-level tables."""

    key: str
    severity: str
    mask: Column
    field: str
    reason: str
    value: Column
    action: str = DEFAULT_ACTION
    issue: str | None = None
    category: str = ""
    counted: bool = True
    setting: str = ""


def labelled(**parts: Column) -> Column:
    pieces = [F.concat(F.lit(name.replace("_", " ").title() + ": "), value) for name, value in parts.items()]
    return F.concat_ws(" | ", *pieces)


def row_cases(df: DataFrame, config: dict, as_of: str, values: bool = True) -> list[Case]:
    """All row checks whose columns the table has; ``df`` must carry the facts.

    ``values=False`` leaves out the texts that show the offending values, which
    a count does not need.
    """
    roles = roles_of(df)
    blank = F.lit("")
    _labelled = labelled if values else (lambda **parts: blank)
    has = lambda *names: all(n in roles for n in names)
    f = lambda name: F.col(f"f_{name}")
    val = lambda role, other="": (
        F.coalesce(F.nullif(shown(roles[role]), F.lit("")), F.lit(other)) if values and role in roles else F.lit(other))
    col = lambda role: roles.get(role, "")
    active, today = f("status") == "active", F.lit(as_of).cast("date")
    pay_known = f("pay").isin("hourly", "salaried")
    some_pay = ~f("salary_blank") | ~f("payrate_blank")
    either = has("status") and ("salary" in roles or "payrate" in roles)
    pay_value = _labelled(pay_type=val("pay_type"), salary=val("salary"), pay_rate=val("payrate"))
    cases: list[Case] = []

    def add(key, mask, field, reason, value, action, issue=None, category="", severity=None, setting=""):
        issue = CATALOG[key][0] if issue is True else issue
        severity = severity or CATALOG[key][1]
        cases.append(Case(key, severity, mask, field, reason, value, action, issue, category, True, setting))

    def by_status(key, high, low, mask, *rest):
        add(key, mask & active, *rest, severity=high)
        add(key, mask & ~active, *rest, severity=low)

    if either:
        effective = F.when(~f("salary_blank"), f("salary")).otherwise(f("payrate"))
        given = F.concat_ws(
            " | ", F.when(val("salary") != "", F.concat(F.lit("Salary: "), val("salary"))),
            F.when(val("payrate") != "", F.concat(F.lit("Pay Rate: "), val("payrate"))))
        add("active_zero_salary", active & (~some_pay | (effective <= 0)), col("salary") or col("payrate"),
            "Active employee has a missing, zero, or invalid salary or pay rate.",
            F.when(given == "", "Missing compensation value").otherwise(given),
            "Enter a valid positive salary or pay rate before payroll processing.",
            "Missing or Invalid Salary", "salary")
    if either and has("pay_type"):
        by_status("pay_type_missing_or_invalid", "CRITICAL", "HIGH",
                  some_pay & ((f("pay") == "invalid") | f("pay_type_blank")), col("pay_type"),
                  "Compensation is present but pay type is blank or invalid.", val("pay_type", "Missing pay type"),
                  "Populate a valid pay type from the controlled allowed list before payroll or migration.", True, "salary")
        no_rate = (f("pay") == "hourly") & ~(~f("payrate_blank") & F.coalesce(f("payrate") > 0, F.lit(False)))
        no_salary = (f("pay") == "salaried") & ~(~f("salary_blank") & F.coalesce(f("salary") > 0, F.lit(False)))
        by_status("compensation_type_mismatch", "CRITICAL", "HIGH", some_pay & no_rate, col("pay_type"),
                  "Hourly worker is missing a valid pay rate for the stated pay type.", pay_value,
                  "Populate a valid pay rate that matches the worker pay type before payroll.", True, "salary")
        by_status("compensation_type_mismatch", "CRITICAL", "HIGH", some_pay & no_salary, col("pay_type"),
                  "Salaried worker is missing a valid salary for the stated pay type.", pay_value,
                  "Populate a valid salary that matches the worker pay type before payroll.", True, "salary")
    if has("status", "pay_type", "salary", "payrate"):
        by_status("comp_dual_value_conflict", "HIGH", "MEDIUM",
                  ~f("salary_blank") & ~f("payrate_blank") & pay_known, col("pay_type"),
                  "Both salary and pay rate are populated for this worker and conflict with the stated pay type.", pay_value,
                  "Review the worker record and keep only the compensation field that matches the intended pay type.", True, "salary")
    if has("status", "pay_type", "hours", "payrate"):
        by_status("missing_standard_hours_hourly", "HIGH", "MEDIUM",
                  (f("pay") == "hourly") & ~f("payrate_blank") & f("hours_blank"), col("hours"),
                  "Hourly worker has a pay rate present but standard hours are missing.",
                  _labelled(pay_rate=val("payrate"), standard_hours=val("hours", "Missing")),
                  "Populate standard hours for each hourly worker before migration.", True, "salary")
    for key, role, kind, low, high, word in (
        ("hourly_implausible_payrate", "payrate", "hourly", config["hourly_payrate_min"], config["hourly_payrate_max"], "pay rate"),
        ("salaried_implausible_salary", "salary", "salaried", config["salaried_salary_min"], config["salaried_salary_max"], "salary"),
    ):
        if has("status", "pay_type", role):
            paid = (f("pay") == kind) & ~f(f"{role}_blank")
            value = _labelled(**{word.replace(" ", "_"): val(role)})
            add(key, paid & (f(role) <= 0), col(role), f"{kind.title()} worker has a zero or negative {word}.", value,
                f"Enter a valid positive {word} before payroll.", True, "salary", "CRITICAL")
            add(key, paid & (f(role) > 0) & ((f(role) < low) | (f(role) > high)), col(role),
                f"{kind.title()} worker {word} is outside the configured review range of {low:g} to {high:g}.", value,
                f"Review the {word} and confirm it belongs within the configured range of {low:g} to {high:g}.",
                True, "salary", "HIGH")
    if has("status", "pay_type", "hours", "salary", "payrate"):
        yearly = f("payrate") * f("hours") * 52
        gap = F.abs(yearly - f("salary")) / F.greatest(F.abs(f("salary")), F.lit(1.0))
        usable = pay_known & ~f("salary_blank") & ~f("payrate_blank") & ~f("hours_blank")
        limit = config["annualized_comp_mismatch_pct"]
        add("annualized_comp_mismatch",
            usable & (f("salary") > 0) & (f("payrate") > 0) & (f("hours") > 0) & (gap >= limit), col("pay_type"),
            f"Salary and annualized pay rate differ by at least {limit:.0%}.",
            _labelled(salary=val("salary"), pay_rate=val("payrate"), standard_hours=val("hours")),
            "Review salary, pay rate, and standard hours together before payroll or migration.", True, "salary")
    if either and has("pay_type", "leave"):
        clash = (active & f("leave").isin(*LEAVE_INACTIVE)) | (
            f("status").isin("terminated", "inactive") & f("leave").isin(*LEAVE_ACTIVE))
        add("pay_context_sanity_check", some_pay & pay_known & clash, col("pay_type"),
            "Worker status, leave status, and compensation context disagree in a way that should be reviewed.",
            _labelled(status=val("status"), leave_status=val("leave"), pay_type=val("pay_type"),
                      salary=val("salary"), pay_rate=val("payrate")),
            "Review worker status, leave status, and compensation together before payroll or migration.", True, "salary")
    if has("status", "eligible", "plan"):
        by_status("benefits_enrolled_not_eligible", "CRITICAL", "HIGH", (f("eligible") == "not_eligible") & f("plan"),
                  col("plan"), "Worker is enrolled in benefits but marked as not eligible.",
                  _labelled(benefits_eligible=val("eligible"), benefit_plan=val("plan")),
                  "Remove benefit enrollment or correct eligibility status.", True, "data_quality")
        by_status("benefits_eligible_not_enrolled", "HIGH", "MEDIUM", (f("eligible") == "eligible") & ~f("plan"),
                  col("plan"), "Worker is eligible for benefits but has no enrollment.",
                  _labelled(benefits_eligible=val("eligible"), benefit_plan=F.lit("Missing")),
                  "Confirm if employee should be enrolled or update eligibility.", True, "data_quality")
    if has("status", "plan", "coverage"):
        by_status("invalid_coverage_level", "HIGH", "MEDIUM", f("plan") & f("coverage").isin("", "invalid"),
                  col("coverage"), "Coverage level is missing or not recognized.",
                  _labelled(benefit_plan=val("plan"), coverage_level=val("coverage", "Missing")),
                  "Assign a valid coverage level for the selected plan.", True, "data_quality")
    if has("plan", "coverage", "dependents"):
        if has("status"):
            add("dependents_without_coverage", f("plan") & (f("dependents") > 0) & (f("coverage") == "employee_only"),
                col("coverage"), "Dependents are present but coverage does not include them.",
                _labelled(benefit_plan=val("plan"), coverage_level=val("coverage"), dependent_count=val("dependents")),
                "Update coverage level to include dependents if applicable.", True, "data_quality")
    if has("plan", "term"):
        add("benefits_after_termination", f("plan") & ~f("term_blank"), col("plan"),
            "Benefits appear active after employee termination.",
            _labelled(benefit_plan=val("plan"), termination_date=val("term")),
            "End benefits coverage as of termination date.", True, "data_quality")
        days = int(config["benefits_termination_grace_days"])
        late = f("benefits_end_date").isNull() | (f("benefits_end_date") > F.date_add(f("term_date"), days))
        add("benefits_after_termination_window", f("plan") & f("term_date").isNotNull() & late,
            col("benefits_end") or col("plan"),
            f"Benefits appear to remain active beyond the allowed post-termination window of {days} days, "
            "or no benefits end date is present.",
            _labelled(termination_date=val("term"), benefits_end_date=val("benefits_end", "Missing")),
            "Review benefits end timing and close coverage within the allowed post-termination window when appropriate.",
            True, "data_quality")
    if has("status", "hire", "benefits_start"):
        value = _labelled(hire_date=val("hire"), benefits_start_date=val("benefits_start"))
        by_status("benefits_start_before_hire", "HIGH", "MEDIUM", f("benefits_start_date") < f("hire_date"),
                  col("benefits_start"), "Benefits start date is earlier than the hire date.", value,
                  "Correct the benefits start date so it does not begin before the hire date.", True, "data_quality")
        days = int(config["benefits_waiting_period_days"])
        early = (f("benefits_start_date") >= f("hire_date")) & (
            f("benefits_start_date") < F.date_add(f("hire_date"), days))
        by_status("benefits_waiting_period_violation", "HIGH", "MEDIUM", early, col("benefits_start"),
                  f"Benefits start date begins earlier than the configured waiting period of {days} days.", value,
                  f"Review the hire date and benefits start date and confirm the waiting period should be at least {days} days.",
                  True, "data_quality")
    if has("status", "pay_type", "eligible"):
        conflict = ((f("employment") == "part_time") & (f("eligible") == "eligible")) | (
            f("employment").isin("contractor", "temporary") & ((f("eligible") == "eligible") | f("plan")))
        add("employment_type_eligibility_conflict", conflict, col("pay_type"),
            "Worker type and benefits eligibility context disagree in a way that should be reviewed.",
            _labelled(worker_type=val("pay_type"), benefits_eligible=val("eligible"), benefit_plan=val("plan")),
            "Review worker type, eligibility status, and benefit enrollment together before migration.", True, "data_quality")
    if has("coverage", "dependents"):
        odd = ((f("coverage") == "includes_dependents") & (f("dependents") <= 0)) | (
            (f("coverage") == "employee_only") & (f("dependents") > 0))
        add("coverage_vs_dependent_sanity", odd, col("coverage"),
            "Coverage level and dependent count do not align in a way that suggests the benefit setup should be reviewed.",
            _labelled(coverage_level=val("coverage"), dependent_count=val("dependents")),
            "Review dependent count and coverage level together and confirm the selected coverage tier is correct.",
            True, "data_quality")
    if has("hire"):
        add("invalid_date_logic", f("hire_date") > today, col("hire"), "Hire date is set in the future.", val("hire"),
            "Correct the hire date to today or earlier.", "Invalid Dates", "dates")
        if has("term"):
            add("invalid_date_logic", f("term_date") < f("hire_date"), col("hire"),
                "Termination date is earlier than hire date.",
                _labelled(hire_date=val("hire"), termination_date=val("term")),
                "Update the dates so the termination date is on or after the hire date.", "Invalid Dates", "dates")
    field = col("hire") or col("dob") or col("term")
    if has("hire"):
        add("impossible_dates", f("hire_date") < F.lit("1950-01-01").cast("date"), field,
            "Hire date is before 1950-01-01", val("hire"), DEFAULT_ACTION)
    if has("dob"):
        add("impossible_dates", f("dob_date") <= F.date_sub(today, 365 * 100), field, "DOB implies age over 100",
            val("dob"), DEFAULT_ACTION)
        add("impossible_dates", f("dob_date") >= F.date_sub(today, 365 * 16), field, "DOB implies age under 16",
            val("dob"), DEFAULT_ACTION)
        if has("hire"):
            add("impossible_dates", f("dob_date") > f("hire_date"), field, "DOB is after hire date", val("dob"), DEFAULT_ACTION)
    if has("term", "status"):
        add("impossible_dates", (f("term_date") > today) & (f("status") == "terminated"), field,
            "Termination date is in the future while status is Terminated", val("term"), DEFAULT_ACTION)
        add("status_hire_date_mismatch", (f("status") == "terminated") & f("term_blank"), col("status"),
            "Employee is marked Terminated but has no termination date", val("status"), DEFAULT_ACTION)
        add("active_with_termination_date", active & ~f("term_blank"), col("term"),
            "Employee is marked Active but also has a termination date.",
            F.concat(F.lit("Status: Active | Termination Date: "), val("term")),
            "Remove the termination date or change the worker status to Terminated.",
            "Active Employee with Termination Date", "status")
    names = [r for r in ("worker_id", "first_name", "last_name") if r in roles]
    if names:
        gone = [F.when(blank_audit(roles[r]), r.replace("_", " ").title().replace("Id", "ID")) for r in names]
        missing = F.concat_ws(", ", *gone)
        add("missing_required_identity", missing != "", ",".join(roles[r] for r in names),
            "Required identity fields are missing.", F.concat(F.lit("Missing: "), missing),
            "Populate Worker ID, First Name, and Last Name for this employee.",
            "Missing Required Identity Fields", "identity")
    if has("status", "manager"):
        add("missing_manager", active & f("manager_blank"), col("manager"), "Active employee has no manager assigned",
            F.lit(""), DEFAULT_ACTION)
    if config.get("ghost_employee_check") and has("status", "salary", "department", "manager", "hire"):
        unpaid = f("salary_blank") | F.coalesce(f("salary") == 0, F.lit(False))
        add("ghost_employee_indicator",
            active & unpaid & f("department_blank") & f("manager_blank") & ~f("hire_blank"), col("status"),
            "Possible ghost employee - active status with no salary, no department, and no manager",
            val("worker_id"), DEFAULT_ACTION)
    if has("phone"):
        raw, digits = text(roles["phone"]), F.regexp_replace(text(roles["phone"]), "[^0-9]", "")
        size = F.length(digits)
        same = (digits != "") & (F.replace(digits, F.left(digits, F.lit(1)), F.lit("")) == "")
        wrong = (number(raw) < 0) | (number(raw) == 0) | (size < 7) | (size > 15) | same
        add("phone_invalid", ~blank_audit(roles["phone"]) & number(raw).isNotNull() & wrong, col("phone"),
            "Phone number cannot be a real one.", raw, DEFAULT_ACTION)
        cases.append(Case(
            "phone_invalid", "HIGH", (shown(roles["phone"]) != "") & ((size < 7) | (size > 15)), col("phone"),
            "Phone number has an implausible digit count (expected 7-15 digits).", raw,
            "Correct the phone number from the source record or a verified employee record.",
            "Invalid Phone Number", "identity", counted=False))
    if has("status"):
        cases.append(Case(
            "status_high_pending", "HIGH", f("status") == "pending", col("status"),
            "Worker status is Pending and needs a final employment status.", val("status"),
            "Update to the correct final status (Active, Inactive, or Terminated).",
            "Pending Status", "status", counted=False))
    if has("salary"):
        for value in config["suspicious_salary_values"]:
            add("salary_suspicious_default", f("salary") == float(value), col("salary"),
                "Salary matches a common placeholder default value.", val("salary"),
                "Verify the correct salary from HR records before migrating.", "Suspicious Salary Default", "salary",
                setting=str(value))
    for name in ("hire_date", "start_date", "date_hired"):
        if name in df.columns:
            for prefix in config["suspicious_hire_date_prefixes"]:
                add("hire_date_suspicious_default", F.col(name).startswith(prefix), name,
                    f"{name} starting with {prefix} - possible system default", F.col(name), DEFAULT_ACTION, setting=prefix)
    if has("status"):
        for value in config["suspicious_status_values"]:
            add("status_suspicious_value", f("status") == value, col("status"),
                f"{col('status')} value '{value}' appears to be a placeholder or test value", val("status"),
                DEFAULT_ACTION, setting=value)
    return cases


FINDING_COLUMNS = ("check_key", "check_name", "field", "severity", "value", "count", "pct", "description")


def _finding(key: str, field, severity, count: Column, total: Column, description, value="") -> list[Column]:
    as_text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.lit(key).alias("check_key"), F.lit(CATALOG.get(key, (key,))[0]).alias("check_name"),
        as_text(field).alias("field"), as_text(severity).alias("severity"), as_text(value).alias("value"),
        count.cast("bigint").alias("count"),
        F.coalesce(F.bround(F.try_divide(count, total) * 100, 2), F.lit(0.0)).alias("pct"),
        as_text(description).alias("description"),
    ]


def row_findings(df: DataFrame, cases: list[Case]) -> DataFrame:
    """Counts of all row checks from one pass; the one-row result is turned into findings."""
    counted = [c for c in cases if c.counted]
    row = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(c.mask, F.lit(False))).alias(f"n{i}") for i, c in enumerate(counted)],
    )
    entries = F.array(*[
        F.struct(F.lit(c.key).alias("check_key"), F.lit(c.field).alias("field"), F.lit(c.severity).alias("severity"),
                 F.lit(c.setting).alias("value"), F.lit(i).alias("at"), F.lit(c.reason).alias("description"),
                 F.col(f"n{i}").alias("count"))
        for i, c in enumerate(counted)
    ])
    flat = row.select("total", F.explode(entries).alias("e")).select("total", "e.*").where("count > 0")
    merged = flat.groupBy("check_key", "field", "severity", "value", "total").agg(
        F.sum("count").alias("count"), F.min_by("description", "at").alias("description"))
    names = F.create_map(*[F.lit(x) for k, v in CATALOG.items() for x in (k, v[0])])
    return merged.select(
        "check_key", F.element_at(names, F.col("check_key")).alias("check_name"), "field", "severity", "value",
        "count", F.bround(F.col("count") / F.col("total") * 100, 2).alias("pct"), "description")


def repeated_values(df: DataFrame, column: str, fold: bool = False) -> DataFrame:
    """(value, n) of the non-blank values that occur more than once."""
    value = folded(column) if fold else text(column)
    counts = df.where((value != "") & (F.lower(value) != "nan")).groupBy(value.alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1")


def duplicate_rows(df: DataFrame, column: str, fold: bool = False) -> DataFrame:
    """Every row whose value occurs more than once, found by joining the repeated values."""
    value = folded(column) if fold else text(column)
    repeated = repeated_values(df, column, fold).select(F.col("value").alias("_v"), F.col("n").alias("_n"))
    return join_figures(df.withColumn("_v", value), repeated, ["_v"], "_n", how="left_semi").drop("_v")


def duplicate_findings(df: DataFrame, fields: list[str]) -> DataFrame:
    """One finding per field that has repeated values; all fields go through one aggregate."""
    present = [f for f in fields if f in df.columns]
    entries = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in present])
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.select(F.explode(entries).alias("e")).select("e.*").where(
        (F.col("value") != "") & (F.lower("value") != "nan")).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where("n > 1").groupBy("field").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    severity = F.when(F.col("field") == "email", "MEDIUM").when(
        F.col("field").isin("worker_id", "last4_ssn"), "CRITICAL").otherwise("LOW")
    text_of = F.concat(
        F.col("n").cast("string"), F.lit(" records share duplicate "), F.col("field"),
        F.lit(" values across "), F.col("k").cast("string"), F.lit(" repeated values."))
    return found.withColumn("total", total).select(
        F.concat(F.lit("duplicate_"), F.col("field")).alias("check_key"),
        F.concat(F.lit("Duplicate "), F.col("field")).alias("check_name"), "field", severity.alias("severity"),
        F.lit("").alias("value"), F.col("n").alias("count"),
        F.bround(F.col("n") / F.col("total") * 100, 2).alias("pct"), text_of.alias("description"))


def duplicates_table(df: DataFrame, fields: list[str]) -> DataFrame:
    """All duplicate rows with the field they repeat in; worker ids have their own check."""
    parts = [
        duplicate_rows(df, f).withColumn("_dup_field", F.lit(f)) for f in fields if f in df.columns and f != "worker_id"
    ]
    return reduce(DataFrame.unionByName, parts)


def same_name_other_id(df: DataFrame, per_name: int | None = None) -> DataFrame:
    """Rows whose name occurs with more than one id: all, or the first ``per_name`` of each name.

    The least and greatest id of a name differ exactly when it has several ids,
    so the aggregate keeps two values per name however common the name is.
    """
    roles = roles_of(df)
    if "full_name" in roles:
        key, name = folded(roles["full_name"]), text(roles["full_name"])
    else:
        key = F.concat(folded(roles["first_name"]), F.lit("|"), folded(roles["last_name"]))
        name = strip(F.concat(text(roles["first_name"]), F.lit(" "), text(roles["last_name"])))
    rows = df.select(
        ROW, key.alias("name_key"), text(roles["worker_id"]).alias("worker_id"), name.alias("name")
    ).where("name_key <> '' and worker_id <> ''")
    several = rows.groupBy("name_key").agg(F.min("worker_id").alias("a"), F.max("worker_id").alias("b"), F.count("*").alias("_n"))
    rows = join_figures(rows, several.where("a <> b").select("name_key", "_n"), ["name_key"], "_n", how="left_semi")
    if per_name is not None:
        rows = first_n(rows, ["name_key"], [ROW], per_name)
    return rows.select(ROW, "worker_id", "name")


def multiple_plan_rows(df: DataFrame) -> DataFrame:
    """Rows of workers with more than one distinct plan, on one record or across records."""
    roles = roles_of(df)
    worker = text(roles["worker_id"])
    tokens = df.select(worker.alias("_w"), F.explode(plan_tokens(roles["plan"])).alias("plan")).where("_w <> ''")
    # A worker's tokens are at least as many as its rows with a plan.
    flagged = tokens.groupBy("_w").agg(F.min("plan").alias("a"), F.max("plan").alias("b"), F.count("*").alias("_n")).where("a <> b")
    return join_figures(df.withColumn("_w", worker), flagged.select("_w", "_n"), ["_w"], "_n", how="left_semi").drop("_w")


def median_by(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, least, greatest and median per group, from counts per distinct value."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    spread = counted.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    return spread.join(exact_quantiles(counted, keys, value, "_c", {"median": 0.5}), keys)


def salary_outliers(df: DataFrame, config: dict) -> DataFrame:
    """Rows far from the median salary of their department."""
    roles = roles_of(df)
    rows = df.select(
        ROW, *([text(roles["worker_id"]).alias("worker_id")] if "worker_id" in roles else []),
        text(roles["department"]).alias("department"), number(roles["salary"]).alias("salary"))
    enough = df.agg(F.count(F.lit(1))).scalar()
    usable = rows.where("department <> '' and lower(department) <> 'nan'")
    groups = median_by(usable, ["department"], "salary").where(
        (F.col("n") >= config["salary_outlier_min_dept_size"]) & (F.col("median") > 0))
    joined = usable.join(groups.select("department", "median"), "department").withColumn("total", enough)
    far = (F.col("salary") > F.col("median") * config["salary_outlier_threshold"]) | (
        F.col("salary") < F.col("median") * 0.3)
    return joined.where(far & (F.col("total") >= 10)).withColumn(
        "ratio", F.bround(F.col("salary") / F.col("median"), 2)).drop("total")


def pay_equity_groups(df: DataFrame, config: dict) -> DataFrame:
    """Title and department groups whose salary spread is wide against their median."""
    roles = roles_of(df)
    rows = df.select(
        text(roles["title"]).alias("title"), text(roles["department"]).alias("department"),
        number(roles["salary"]).alias("salary")).where("salary is not null and title <> '' and department <> ''")
    groups = median_by(rows, ["title", "department"], "salary")
    spread = (F.col("most") - F.col("least")) / F.col("median")
    return groups.where(
        (F.col("n") >= config["pay_equity_min_group_size"]) & (F.col("median") > 0)
    ).withColumn("variance", spread).where(F.col("variance") > config["pay_equity_variance_threshold"]).select(
        "title", "department", F.col("n").alias("employees"), F.col("least").alias("min_salary"),
        F.col("most").alias("max_salary"), F.col("median").alias("median_salary"),
        F.bround(F.col("variance") * 100, 1).alias("variance_pct"))


def round_salaries(df: DataFrame) -> DataFrame:
    """Active rows with a repeated placeholder salary that is off its department's median."""
    roles = roles_of(df)
    department = text(roles["department"]) if "department" in roles else F.lit("")
    rows = df.select(
        ROW, (text(roles["worker_id"]) if "worker_id" in roles else F.lit("")).alias("worker_id"),
        folded(roles["status"]).alias("status"), department.alias("department"), number(roles["salary"]).alias("salary"))
    active = rows.where("status = 'active' and salary is not null")
    repeated = active.groupBy("salary").agg(F.count(F.lit(1)).alias("repeated_count")).where("repeated_count > 3")
    whole = F.col("salary").cast("bigint")
    odd = whole.isin(*ROUND_VALUES) | whole.cast("string").endswith("00000")
    medians = median_by(rows.where("department <> '' and lower(department) <> 'nan'"), ["department"], "salary")
    found = join_figures(active.where(odd), repeated.where(odd), ["salary"], "repeated_count").join(
        medians.select("department", "median"), "department", "left")
    off = F.abs(F.col("salary") - F.col("median")) / F.col("median") > 0.2
    return found.where((F.coalesce(F.col("median"), F.lit(0.0)) <= 0) | off).select(
        ROW, "worker_id", "salary", "repeated_count")


def manager_loops(df: DataFrame, row: str = ROW) -> DataFrame:
    """Reporting cycles of one, two or three people; the last row of a worker counts.

    A member of a cycle is somebody's manager, so workers nobody reports to are
    dropped first. That removes the crowd below a popular manager before any
    join on the manager.
    """
    roles = roles_of(df)
    rows = df.select(text(roles["worker_id"]).alias("w"), text(roles["manager"]).alias("m"), F.col(row).alias("r"))
    rows = rows.where("w <> '' and m <> '' and lower(w) <> 'nan' and lower(m) <> 'nan'")
    links = rows.groupBy("w").agg(F.max_by("m", "r").alias("m"), F.min("r").alias("r"))
    links = links.join(links.select(F.col("m").alias("w")).distinct(), "w", "left_semi")
    named = lambda i: links.select(*[F.col(c).alias(f"{c}{i}") for c in ("w", "m", "r")])
    a, b, c = named(1), named(2), named(3)
    step = a.where("w1 <> m1").join(b, F.col("m1") == F.col("w2")).where("r1 < r2")
    pairs = step.where("m2 = w1")
    triples = step.where("m2 <> w1 and m2 <> w2").join(c, F.col("m2") == F.col("w3")).where("m3 = w1 and r1 < r3")
    cycle = lambda rows, ids: rows.select(
        F.lit(len(ids)).alias("cycle_length"),
        F.concat_ws(" -> ", *ids, *([ids[0]] if len(ids) > 1 else [])).alias("employee_ids"))
    return cycle(a.where("w1 = m1"), ["w1"]).unionByName(cycle(pairs, ["w1", "w2"])).unionByName(
        cycle(triples, ["w1", "w2", "w3"]))


def canonical_conflicts(raw: DataFrame, row: str = ROW) -> DataFrame:
    """Per row and canonical name with several source columns: how their values agree.

    ``raw`` still has the source columns; call this before they are collapsed.
    """
    groups = {n: cs for n, cs in audit_sources([c for c in raw.columns if c != row]).items() if len(cs) > 1}
    if not groups:
        return raw.select(row).limit(0).selectExpr(
            row, "'' as duplicate_canonical_field", "'' as duplicate_classification",
            "'' as duplicate_source_columns", "'' as duplicate_values", "'' as retained_value_reason")
    entries = []
    for name, columns in groups.items():
        values = F.array(*[text(F.col(f"`{c}`")) for c in columns])
        filled = F.filter(values, lambda v: v != "")
        distinct = F.size(F.array_distinct(F.transform(filled, F.lower)))
        led = F.get(values, 0) != ""
        same = (F.size(filled) == 0) | ((F.size(filled) == len(columns)) & (distinct == 1))
        partial = (F.size(filled) < len(columns)) & (distinct <= 1)
        entries.append(F.struct(
            F.lit(name).alias("duplicate_canonical_field"),
            F.when(same, "duplicate_same_value").when(partial, "duplicate_blank_vs_value")
            .otherwise("duplicate_conflicting_values").alias("duplicate_classification"),
            F.lit("|".join(columns)).alias("duplicate_source_columns"),
            F.array_join(values, "|").alias("duplicate_values"),
            F.when(same, "identical_values").when(partial & led, "identical_values")
            .when(partial, "first_non_blank").when(led, "conflict_primary_wins")
            .otherwise("first_non_blank").alias("retained_value_reason")))
    return raw.select(row, F.explode(F.array(*entries)).alias("e")).select(row, "e.*")


def conflict_findings(conflicts: DataFrame, total: Column) -> DataFrame:
    counts = conflicts.where("duplicate_classification = 'duplicate_conflicting_values'").groupBy(
        "duplicate_canonical_field").agg(F.count(F.lit(1)).alias("count")).withColumn("total", total)
    on_id = F.col("duplicate_canonical_field") == "worker_id"
    key = F.when(on_id, "duplicate_canonical_worker_id_conflict").otherwise("duplicate_canonical_conflict")
    name = F.when(on_id, CATALOG["duplicate_canonical_worker_id_conflict"][0]).otherwise(
        CATALOG["duplicate_canonical_conflict"][0])
    return counts.select(
        key.alias("check_key"), name.alias("check_name"), F.col("duplicate_canonical_field").alias("field"),
        F.when(on_id, "CRITICAL").otherwise("HIGH").alias("severity"), F.lit("").alias("value"), "count",
        F.bround(F.col("count") / F.col("total") * 100, 1).alias("pct"),
        F.concat(F.col("count").cast("string"), F.lit(" row(s) have conflicting values for '"),
                 F.col("duplicate_canonical_field"), F.lit("'.")).alias("description"))


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    kinds = {"same_value": "duplicate_same_value", "blank_vs_value": "duplicate_blank_vs_value",
             "conflicting_values": "duplicate_conflicting_values"}
    return conflicts.groupBy("duplicate_canonical_field").agg(*[
        F.count_if(F.col("duplicate_classification") == v).alias(k) for k, v in kinds.items()])


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW and not c.startswith("f_")]


def completeness(df: DataFrame, threshold: float) -> DataFrame:
    """Blank figures per column from one aggregate."""
    columns = _data_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(blank_audit(F.col(f"`{c}`"))).alias(f"b{i}") for i, c in enumerate(columns)])
    entries = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"b{i}").alias("blank_count")) for i, c in enumerate(columns)])
    rows = row.select("total", F.explode(entries).alias("e")).select("e.field", "total", "e.blank_count")
    share = lambda n: F.coalesce(F.bround(F.try_divide(n, F.col("total")) * 100, 2), F.lit(0.0))
    rows = rows.withColumns({
        "blank_pct": share(F.col("blank_count")), "filled_pct": share(F.col("total") - F.col("blank_count"))})
    high = F.col("blank_pct") > threshold * 100
    severity = F.when(high & (F.col("field") == "worker_id"), "CRITICAL").when(
        high & (F.col("field") == "full_name"), "HIGH").when(high, "MEDIUM").otherwise("LOW")
    return rows.withColumn("severity", severity)


def blank_findings(table: DataFrame, threshold: float) -> DataFrame:
    return table.where(F.col("blank_pct") > threshold * 100).select(
        F.lit("high_blank_rate").alias("check_key"),
        F.concat(F.lit("High blank rate - "), F.col("field")).alias("check_name"), "field", "severity",
        F.lit("").alias("value"), F.col("blank_count").alias("count"), F.col("blank_pct").alias("pct"),
        F.concat(F.col("field"), F.lit(" is blank on "), F.col("blank_count").cast("string"), F.lit(" rows.")).alias("description"))


def overall_completeness(table: DataFrame) -> DataFrame:
    cells = F.sum("total")
    return table.agg(F.coalesce(
        F.bround(F.try_divide(cells - F.sum("blank_count"), cells) * 100, 1), F.lit(0.0)).alias("overall_completeness"))


# Field groups of the completeness page.
FIELD_GROUPS = {
    "critical": ("worker_id", "first_name", "last_name", "salary", "worker_status", "hire_date", "email"),
    "standard": ("department", "location", "manager_id", "phone", "cost_center", "position"),
    "optional": ("middle_name", "age", "date_of_birth", "performance_score", "remote_work", "suffix", "notes"),
}


def completeness_groups(table: DataFrame) -> DataFrame:
    """The completeness rows of the grouped fields with a status word."""
    group = None
    for name, fields in FIELD_GROUPS.items():
        test = F.lower("field").isin(*fields)
        group = F.when(test, name) if group is None else group.when(test, name)
    return table.withColumn("field_group", group).where("field_group is not null").select(
        "field_group", "field", (F.col("total") - F.col("blank_count")).alias("records_complete"), "total",
        "blank_count", completeness_status(100 - F.col("blank_pct")).alias("status"))


def table_findings(df: DataFrame) -> DataFrame:
    """Findings about the table as a whole: statuses and ages; one aggregate."""
    roles = roles_of(df)
    status = folded(roles["status"]) if "status" in roles else F.lit(None).cast("string")
    age = F.when(~blank_audit(roles["age"]), text(roles["age"])) if "age" in roles else F.lit(None).cast("string")
    row = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status.isin(*LEFT_WORDS)).alias("left"),
        F.count_if(status == "pending").alias("pending"), F.count(age).alias("ages"),
        F.count_distinct(age).alias("distinct_ages"))
    field = lambda r: roles.get(r, "")
    pending_pct = F.bround(F.try_divide(F.col("pending"), F.col("total")) * 100, 1)
    finding = lambda key, role, test, count, pct, words: F.when(test, F.struct(
        F.lit(key).alias("check_key"), F.lit(CATALOG[key][0]).alias("check_name"), F.lit(field(role)).alias("field"),
        F.lit("MEDIUM").alias("severity"), F.lit("").alias("value"), count.cast("bigint").alias("count"),
        pct.alias("pct"), F.lit(words).alias("description")))
    found = F.array_compact(F.array(
        finding("status_no_terminated", "status",
                F.lit("status" in roles) & (F.col("total") > 100) & (F.col("left") == 0), F.lit(1), F.lit(0.0),
                "No terminated employees found. File may be incomplete or limited to active/pending only."),
        finding("status_high_pending", "status", F.lit("status" in roles) & (pending_pct > 25), F.col("pending"),
                pending_pct, "Unusually many employees have Pending status. Indicates incomplete data entry."),
        finding("age_uniformity", "age",
                (F.col("ages") >= 50) & (F.col("distinct_ages") / F.col("ages") < 0.05), F.col("ages"),
                F.bround(F.col("ages") / F.col("total") * 100, 2),
                "Few distinct age values across all employees. Likely placeholder data.")))
    return row.select(F.explode(found).alias("e")).select("e.*")


#: A half of a combined field has fewer different values than this.
MOST_HALVES = 20


def combined_fields(df: DataFrame) -> DataFrame:
    """Columns that join two categories with a hyphen, from one pass over all columns.

    Cells are counted per column, half and value; combined on the map side, a
    column of categories is a few rows. The different halves are then counted
    per column, up to the number that rules a column out.
    """
    columns = _data_columns(df)
    filled = [F.when(~blank_audit(F.col(f"`{c}`")), text(F.col(f"`{c}`"))) for c in columns]
    sides = lambda v: [strip(F.substring_index(v, "-", 1)), strip(F.regexp_replace(v, "^[^-]*-", ""))]
    cells = F.array(*[F.struct(F.lit(i).alias("at"), v.alias("v")) for i, v in enumerate(filled)])
    rows = df.select(F.explode(cells).alias("c")).select("c.*").where("v is not null")
    entries = rows.select("at", F.when(F.col("v").contains("-"), F.array(*[F.struct(F.lit(k).alias("half"), h.alias("value")) for k, h in enumerate(sides(F.col("v")))]))
                          .otherwise(F.array(F.struct(F.lit(-1).alias("half"), F.lit("").alias("value")))).alias("e"))
    counted = entries.select("at", F.explode("e").alias("e")).groupBy("at", "e.half", "e.value").agg(F.count(F.lit(1)).alias("n"))
    halves = counted.groupBy("at", "half").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))
    of = lambda k, c: F.coalesce(F.max(F.when(F.col("half") == k, F.col(c))), F.lit(0))
    figures = halves.groupBy("at").agg(of(-1, "n").alias("plain"), of(0, "n").alias("h"), of(0, "different").alias("d0"), of(1, "different").alias("d1"))
    figures = figures.withColumn("n", F.col("plain") + F.col("h"))
    likely = figures.where((F.col("n") >= 20) & (F.col("h") / F.col("n") >= 0.80) & (F.col("d0") < MOST_HALVES) & (F.col("d1") < MOST_HALVES))
    field = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at") + 1)
    described = F.concat(F.lit("Column '"), field, F.lit("' appears to combine two fields using a hyphen separator. Must be split before system load."))
    found = likely.select(*_finding("combined_field", field, "LOW", F.col("h"), F.col("n"), described))
    return found.withColumns({"check_name": F.concat(F.lit("Combined field detected - "), F.col("field")), "pct": F.bround("pct", 1)})


def salary_distribution(df: DataFrame) -> DataFrame:
    """Rows per fixed salary range and their share of all rows; empty ranges appear."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.select(salary_range(number("salary")).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("count"))
    ranges = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(r[0]).alias("bucket")) for i, r in enumerate(SALARY_RANGES)])
    known = df.sparkSession.range(1).select(F.explode(ranges).alias("r")).select("r.*")
    rows = known.join(counts, "bucket", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return rows.withColumn("total", total).select(
        "bucket", "count", F.bround(F.col("count") / F.col("total") * 100, 2).alias("pct"), "at").orderBy("at").drop("at")


def status_distribution(df: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(folded(roles_of(df)["status"]).alias("status_value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.bround(F.col("count") / total * 100, 2))


def salary_statistics(df: DataFrame) -> DataFrame:
    s = F.col("s")
    rows = df.select(number("salary").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    stats = rows.agg(
        n(s.isNotNull()).alias("count"), n(s.isNull()).alias("missing"), F.min("s").alias("min"), F.max("s").alias("max"),
        F.bround(F.sum(s * F.col("n")) / n(s.isNotNull()), 2).alias("mean"),
        n(s < 50000).alias("under_50k"), n(s > 150000).alias("over_150k"))
    stats = stats.withColumn("median", quantile_struct(rows, "s", "n", {"median": 0.5})["median"])
    share = lambda a, b: F.coalesce(F.bround(F.try_divide(a, b) * 100, 1), F.lit(0.0))
    return stats.withColumns({
        "missing_pct": share(F.col("missing"), F.col("missing") + F.col("count")),
        "under_50k_pct": share(F.col("under_50k"), F.col("count")), "over_150k_pct": share(F.col("over_150k"), F.col("count"))})


def _counted_finding(rows: DataFrame, key: str, field: str, total: Column, description: str) -> DataFrame:
    counts = rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0").withColumn("total", total)
    return counts.select(*_finding(key, field, CATALOG[key][1], F.col("n"), F.col("total"), description))


def group_findings(df: DataFrame, config: dict) -> DataFrame | None:
    """Findings of the checks that compare rows with other rows."""
    roles = roles_of(df)
    has = lambda *names: all(n in roles for n in names)
    total = df.agg(F.count(F.lit(1))).scalar()
    parts = []
    if has("worker_id") and (has("first_name", "last_name") or has("full_name")):
        parts.append(_counted_finding(same_name_other_id(df), "duplicate_name_different_id", roles["worker_id"], total,
                                      "Employees share the same name with different IDs - verify these are different people"))
    if has("worker_id", "plan"):
        parts.append(_counted_finding(multiple_plan_rows(df), "multiple_active_benefit_plans", roles["plan"], total,
                                      "Worker appears to have multiple active benefit plan values that should be reviewed before migration."))
    if has("worker_id", "manager") and config.get("manager_loop_check"):
        parts.append(_counted_finding(manager_loops(df), "manager_loop", roles["manager"], total,
                                      "Manager reporting loop detected - these employees report to each other"))
    if has("salary", "department"):
        parts.append(_counted_finding(salary_outliers(df, config), "salary_outlier", roles["department"], total,
                                      "Salary outliers were detected relative to department medians."))
    if has("salary", "status"):
        parts.append(_counted_finding(round_salaries(df), "suspicious_round_salary", "salary", total,
                                      "Salary appears to be a placeholder value - verify this is correct"))
    if has("salary", "department", "title"):
        grouped = df.agg(F.count_if(
            number(roles["salary"]).isNotNull() & (text(roles["title"]) != "") & (text(roles["department"]) != ""))).scalar()
        parts.append(_counted_finding(
            pay_equity_groups(df, config), "pay_equity_flag", roles["title"], F.greatest(grouped, F.lit(1)),
            "Salary variance of more than 30% within the same title and department - review for pay equity compliance"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def all_findings(df: DataFrame, as_of: str, policy: dict | None = None, raw: DataFrame | None = None) -> DataFrame:
    """Findings of every check the table has the columns for."""
    config = load_policy(policy)["internal_audit"]
    facts = with_facts(df)
    threshold = config["high_blank_rate_threshold"]
    parts = [
        row_findings(facts, row_cases(facts, config, as_of, values=False)),
        duplicate_findings(df, config["duplicate_check_fields"]),
        table_findings(df), combined_fields(df), blank_findings(completeness(df, threshold), threshold),
    ]
    grouped = group_findings(df, config)
    if grouped is not None:
        parts.append(grouped)
    if raw is not None:
        total = df.agg(F.count(F.lit(1))).scalar()
        parts.append(conflict_findings(canonical_conflicts(raw), total))
    found = reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])
    return found.withColumns(advice(config))


def flagged_rows(facts: DataFrame, cases: list[Case]) -> DataFrame:
    """One row per record and failed row check."""
    entries = F.array_compact(F.array(*[
        F.when(c.mask, F.struct(F.lit(c.key).alias("check_key"), F.lit(c.severity).alias("severity"),
                                F.lit(c.field).alias("field"), F.lit(c.setting).alias("setting"), c.value.alias("current_value"),
                                F.lit(c.reason).alias("reason")))
        for c in cases if c.counted
    ]))
    return facts.select(ROW, F.explode(entries).alias("e")).select(ROW, "e.*")


def sample_rows(facts: DataFrame, cases: list[Case], n: int = SAMPLES) -> DataFrame:
    """The first records per check and severity as an array of small maps."""
    few = first_n(flagged_rows(facts, cases), ["check_key", "severity"], [ROW, "reason"], n)
    item = F.create_map(
        F.lit("row_number"), row_number_text().cast("string"), F.lit("value"), F.col("current_value"),
        F.lit("why_flagged"), F.col("reason"))
    ordered = F.sort_array(F.collect_list(F.struct(ROW, F.col("reason").alias("r"), F.to_json(item).alias("item"))))
    return few.groupBy("check_key", "severity").agg(ordered.alias("s")).select(
        "check_key", "severity", F.transform("s", lambda x: x["item"]).alias("sample_rows"))


def check_counts(findings: DataFrame) -> DataFrame:
    """The whole catalog with the records found per check, zeros included."""
    rows = F.array(*[
        F.struct(F.lit(k).alias("check_key"), F.lit(n).alias("check_name"), F.lit(s).alias("severity"))
        for k, (n, s) in CATALOG.items()])
    known = findings.sparkSession.range(1).select(F.explode(rows).alias("c")).select("c.*")
    counts = findings.groupBy("check_key").agg(F.sum("count").alias("count"))
    return known.join(counts, "check_key", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def grouped_findings(findings: DataFrame) -> DataFrame:
    """Findings merged per check, name and severity."""
    first = lambda c: F.min_by(c, F.struct("field", "value")).alias(c)
    return findings.groupBy("check_key", "check_name", "severity").agg(
        F.sum("count").alias("count"), first("pct"), F.min("field").alias("field"), first("description"))


def issue_strings(findings: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("["), F.col("severity"), F.lit("] "), F.col("check_name"), F.lit(": "), F.col("count").cast("string"),
        F.lit(" ("), F.col("pct").cast("string"), F.lit("%) - "), F.col("description"))
    return findings.select(line.alias("issue"))


GATE_MESSAGES = {
    "BLOCKED": "CRITICAL issues detected. Dataset is NOT safe for payroll or production use.",
    "OVERRIDDEN": "WARNING: Gate overridden. CRITICAL issues still exist.",
}


def evaluate_gate(findings: DataFrame, override: bool = False) -> DataFrame:
    """One row: the gate status and what it allows."""
    row = findings.agg(F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("critical"))
    status = F.when(~F.col("critical"), "PASSED").otherwise("OVERRIDDEN" if override else "BLOCKED")
    blocked = F.col("gate_status") == "BLOCKED"
    message = F.when(F.col("critical"), GATE_MESSAGES["OVERRIDDEN" if override else "BLOCKED"]).otherwise("")
    return row.withColumn("gate_status", status).select(
        "gate_status", message.alias("gate_message"), F.lit(override).alias("override_gate"),
        F.col("critical").alias("critical_findings_present"), blocked.alias("corrections_generation_skipped"),
        (~blocked).alias("approved_status_allowed"))
