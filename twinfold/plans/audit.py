"""Audit of one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, finding_samples, issues
from ..operators.audit_facts import roles_of
from ..policy import load_policy
from ..sources.snapshots import ROW, audit_aliases, require_columns, resolve_aliases
from ..sources.staging import materialize


@dataclass
class AuditResult:
    table: DataFrame
    findings: DataFrame
    issues: DataFrame
    completeness: DataFrame
    gate: DataFrame
    conflicts: DataFrame
    config: dict

    def outputs(self) -> dict[str, DataFrame]:
        """Lazy result tables over the stored table, findings and issues."""
        metadata = issues.review_metadata(self.issues)
        clean = issues.clean_data(self.table, metadata)
        result = {
            "findings": self.findings, "completeness": self.completeness, "gate": self.gate,
            "check_counts": checks.check_counts(self.findings),
            "severity_counts": checks.severity_counts(self.findings),
            "executive_summary": issues.executive_summary(self.findings),
            "fix_list": issues.fix_list(self.findings),
            "findings_index": issues.findings_index(self.findings, self.issues),
            "issue_detail": issues.issue_detail(self.issues),
            "clean_data": clean, "review_required": issues.review_required(clean),
        }
        result |= {f"issues_{c}": issues.category_frame(self.issues, c) for c in issues.CATEGORIES}
        result |= {
            "grouped_findings": checks.grouped_findings(self.findings),
            "issue_strings": checks.issue_strings(self.findings),
            "completeness_groups": checks.completeness_groups(self.completeness),
            "overall_completeness": checks.overall_completeness(self.completeness),
            "quality_score": issues.quality_score(
                self.findings, checks.overall_completeness(self.completeness), self.gate,
                self.table.agg(F.count(F.lit(1))).scalar()),
            "canonical_conflicts": self.conflicts, "conflict_summary": checks.conflict_summary(self.conflicts),
        }
        result |= self._check_rows()
        result |= {f"correction_{k}": issues.correction_template(self.issues, k) for k in issues.TEMPLATES}
        return result


    def _check_rows(self) -> dict[str, DataFrame]:
        """Rows and figures behind the checks whose columns the table has."""
        table, roles = self.table, roles_of(self.table)
        has = lambda *names: all(n in roles for n in names)
        result = {}
        repeated = [f for f in self.config["duplicate_check_fields"] if f in table.columns and f != "worker_id"]
        if repeated:
            result["duplicate_rows"] = checks.duplicates_table(table, repeated)
        if has("worker_id"):
            result["duplicate_worker_rows"] = checks.duplicate_rows(table, roles["worker_id"])
        if has("worker_id") and (has("first_name", "last_name") or has("full_name")):
            result["same_name_other_id"] = checks.same_name_other_id(table)
        if has("worker_id", "plan"):
            result["multiple_plan_rows"] = checks.multiple_plan_rows(table)
        if has("worker_id", "manager"):
            result["manager_loops"] = checks.manager_loops(table)
        if has("salary", "department"):
            result["salary_outliers"] = checks.salary_outliers(table, self.config)
        if has("salary", "department", "title"):
            result["pay_equity_groups"] = checks.pay_equity_groups(table, self.config)
        if has("status"):
            result["status_distribution"] = checks.status_distribution(table)
        if "salary" in table.columns:
            result["salary_distribution"] = checks.salary_distribution(table)
            result["salary_statistics"] = checks.salary_statistics(table)
        return result


def audit(raw: DataFrame, as_of: str, policy: dict | None = None, override_gate: bool = False) -> AuditResult:
    """All checks of a table that carries ``src_ord``; blank text counts as missing."""
    require_columns(raw, [ROW], "table")
    config = load_policy(policy)["internal_audit"]
    named = resolve_aliases(raw)
    table = materialize(audit_aliases(named), "audit-table")
    blanks = checks.completeness(table, config["high_blank_rate_threshold"])
    high = checks.blank_findings(blanks, config["high_blank_rate_threshold"]).select("field")
    # One name per column of the table: a list as short as the header.
    fields = [r["field"] for r in high.toLocalIterator()]
    findings = materialize(finding_samples.detailed_findings(table, as_of, policy, raw=named), "findings")
    frame = materialize(issues.issue_frame(table, as_of, policy, raw=named, blank_fields=sorted(fields)), "issues")
    gate = checks.evaluate_gate(findings, override_gate)
    conflicts = checks.canonical_conflicts(named)
    return AuditResult(table, findings, frame, blanks, gate, conflicts, config)


def gate_passed(result: AuditResult) -> bool:
    return result.gate.where(F.col("gate_status") != "BLOCKED").count() == 1
