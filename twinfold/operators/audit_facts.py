"""Typed facts of an audit table, computed once and shared by all checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.blanks import blank_audit, folded, strip
from ..functions.dates import parse_date
from ..functions.numbers import number
from ..sources.snapshots import ROW

# For each role the column names tried, first present wins.
ROLES = {
    "worker_id": ("worker_id", "employee_id"),
    "first_name": ("first_name",), "last_name": ("last_name",), "full_name": ("full_name",),
    "email": ("email",), "last4_ssn": ("last4_ssn",),
    "status": ("worker_status", "status", "employment_status"),
    "pay_type": ("pay_type", "worker_type", "employment_type", "compensation_type"),
    "salary": ("salary",), "payrate": ("payrate",),
    "hours": ("standard_hours", "scheduled_hours", "standard_weekly_hours", "weekly_standard_hours"),
    "hire": ("hire_date", "start_date", "date_hired"),
    "term": ("termination_date", "term_date", "end_date"),
    "dob": ("date_of_birth", "dob", "birth_date"),
    "department": ("department", "business_unit", "dept", "district", "department_name"),
    "title": ("job_title", "position", "position_title", "title"),
    "manager": ("manager_id", "manager", "supervisor_id", "manageremployeeid", "manager_worker_id"),
    "leave": ("leave_status", "absence_status", "loa_status"),
    "eligible": ("benefits_eligible", "benefit_eligible", "benefits_eligibility", "benefit_eligibility"),
    "plan": ("benefit_plan", "benefits_plan", "benefit_plan_name", "plan_name"),
    "coverage": ("coverage_level", "benefit_coverage_level", "coverage_tier"),
    "dependents": ("dependent_count", "dependents", "covered_dependents"),
    "benefits_start": ("benefits_start_date", "benefit_start_date", "coverage_start_date"),
    "benefits_end": ("benefits_end_date", "benefit_end_date", "coverage_end_date"),
    "phone": ("phone", "phone_number", "mobile", "cell"), "age": ("age",),
}


def roles_of(df: DataFrame) -> dict[str, str]:
    """Role -> the column that plays it, for the roles the table has."""
    by_lower = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {r: next((by_lower[n] for n in names if n in by_lower), None) for r, names in ROLES.items()}
    return {r: c for r, c in found.items() if c}


def shown(c: str) -> Column:
    """Trimmed value, '' for null words."""
    value = strip(c)
    return F.when(F.lower(value).isin("nan", "nat", "none", "<na>") | value.isNull(), "").otherwise(value)


def with_facts(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Add ``f_*`` columns; a fact of an absent role is blank, NULL or False."""
    roles = roles_of(df) if roles is None else roles
    of = lambda role, make, absent: make(roles[role]) if role in roles else absent
    nothing, yes, no = F.lit(None), F.lit(True), F.lit(False)
    facts = {
        "f_status": of("status", folded, F.lit("")), "f_pay": of("pay_type", labels.classify_pay_type, F.lit("")),
        "f_employment": of("pay_type", labels.classify_employment_type, F.lit("")),
        "f_eligible": of("eligible", labels.classify_benefits_eligible, F.lit("")),
        "f_plan": of("plan", labels.benefit_plan_present, no),
        "f_coverage": of("coverage", labels.classify_coverage_level, F.lit("")),
        "f_leave": of("leave", folded, F.lit("")),
        "f_dependents": F.coalesce(of("dependents", number, nothing.cast("double")), F.lit(0.0)),
    }
    for role in ("salary", "payrate", "hours"):
        facts[f"f_{role}"] = of(role, number, nothing.cast("double"))
    for role in ("salary", "payrate", "hours", "pay_type", "term", "manager", "department", "hire"):
        facts[f"f_{role}_blank"] = of(role, blank_audit, yes)
    for role in ("hire", "term", "dob", "benefits_start", "benefits_end"):
        facts[f"f_{role}_date"] = of(role, parse_date, nothing.cast("date"))
    return df.withColumns(facts)


def row_number_text(row: str = ROW) -> Column:
    """Line of the record in its file: the header is line 1."""
    return F.col(row) + 2
