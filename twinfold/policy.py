"""Thresholds and value lists, merged deeply over defaults on the driver."""

from __future__ import annotations

import copy
import json
from pathlib import Path

# Default policy.
DEFAULTS: dict = {
    "confidence_policy": {
        "low_confidence_floor": 0.80,
        "match_source": {
            "worker_id": {"auto_approve": True},
            "recon_id": {"min_confidence": 0.95},
            "pk": {"min_confidence": 0.95},
            "last4_dob": {"min_confidence": 0.97},
            "dob_name": {"min_confidence": 0.97},
            "name_hire_date": {"min_confidence": 0.97},
            "_default": {"min_confidence": 0.95},
        },
        "fix_type": {
            "salary": {"min_confidence": 0.97},
            "payrate": {"min_confidence": 0.97},
            "status": {"min_confidence": 0.98},
            "hire_date": {"min_confidence": 0.95},
            "job_org": {"min_confidence": 0.95},
            "_default": {"min_confidence": 0.95},
        },
    },
    "sanity_gate": {
        "enabled": True,
        "block_if_rate_greater_than": {
            "hire_date_default_2026_02": 0.02,
            "salary_suspicious_default": 0.02,
        },
        "block_if_count_greater_than": {
            "hire_date_default_2026_02": 500,
            "salary_suspicious_default": 500,
        },
        "block_corrections": True,
        "block_workbook": False,
        "block_exports": False,
        "health_thresholds": {
            "min_det_rate": 0.95,
            "min_approve_rate": 0.75,
            "max_active_zero_salary": 0,
        },
        "patterns": {
            "hire_date_default_months": ["2026-02", "2026-03"],
            "salary_suspicious_values": [40000, 40003, 40013, 40073],
        },
    },
    "pii": {"include_dob_in_ui": False, "include_dob_in_exports": False},
    "ui_contract": {"version": "v1"},
    "extra_fields": {
        "enabled": True,
        "fields": ["cost_center", "company", "department", "business_unit"],
        "groups": {"org": ["cost_center", "company", "department"]},
        "gate": {"enabled": False, "min_confidence": 0.95},
    },
    "internal_audit": {
        "high_blank_rate_threshold": 0.20,
        "suspicious_salary_values": [40000, 40003, 40013, 40073, 50000, 60000, 99999, 100000],
        "suspicious_hire_date_prefixes": ["2026-02", "2026-03", "1900-", "1970-01-01", "2000-01-01"],
        "suspicious_status_values": ["unknown", "n/a", "na", "null", "none", "test"],
        "duplicate_check_fields": ["worker_id", "email", "last4_ssn"],
        "hourly_payrate_min": 7.25,
        "hourly_payrate_max": 250.0,
        "salaried_salary_min": 10000.0,
        "salaried_salary_max": 1000000.0,
        "annualized_comp_mismatch_pct": 0.10,
        "benefits_termination_grace_days": 30,
        "benefits_waiting_period_days": 30,
        "salary_outlier_threshold": 2.5,
        "salary_outlier_min_dept_size": 5,
        "pay_equity_variance_threshold": 0.30,
        "pay_equity_min_group_size": 3,
        "ghost_employee_check": True,
        "manager_loop_check": True,
    },
}


def merge(base: dict, override: dict | None) -> dict:
    """Deep merge: nested dicts combine, everything else is replaced."""
    result = copy.deepcopy(base)
    for key, value in (override or {}).items():
        if isinstance(value, dict) and isinstance(result.get(key), dict):
            result[key] = merge(result[key], value)
        else:
            result[key] = copy.deepcopy(value)
    return result


def load_policy(source: str | Path | dict | None = None) -> dict:
    """Policy from a dict, a JSON file or (with PyYAML present) a YAML file."""
    if source is None or isinstance(source, dict):
        return merge(DEFAULTS, source)
    content = Path(source).read_text(encoding="utf-8")
    if str(source).endswith(".json"):
        return merge(DEFAULTS, json.loads(content))
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading a YAML policy needs PyYAML; pass a dict or JSON") from error
    return merge(DEFAULTS, yaml.safe_load(content))


def auto_approve_sources(policy: dict) -> list[str]:
    sources = policy["confidence_policy"]["match_source"]
    return [name for name, rule in sources.items() if rule.get("auto_approve")]


def extra_fields(policy: dict) -> list[str]:
    config = policy["extra_fields"]
    return list(config["fields"]) if config.get("enabled") else []
