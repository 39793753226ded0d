import pytest

from twinfold.operators import outputs
from twinfold.operators.gate import explanation_text, gate, summary_text
from twinfold.operators.sanity import evaluate_sanity_gate
from twinfold.operators.waves import wave_dates
from twinfold.sources.staging import materialize

FIELDS = ("salary", "payrate", "worker_status", "hire_date", "position", "district", "location_state", "last_name_norm",
          "worker_id", "full_name_norm")
SAME = dict(salary="50000", payrate="", worker_status="active", hire_date="2020-01-01", position="P", district="D",
            location_state="TX", last_name_norm="smith", worker_id="w", full_name_norm="a smith")


def frame(spark, cases):
    rows = []
    for i, c in enumerate(cases):
        old = {**SAME, **c.get("old", {})}
        new = {**old, **c.get("new", {})}
        rows.append((f"p{i}", c.get("source", "worker_id"), c.get("confidence", 1.0), c.get("renamed", False),
                     *[old[f] for f in FIELDS], *[new[f] for f in FIELDS]))
    schema = "pair_id string, match_source string, confidence double, name_change_detected boolean, " + ", ".join(
        f"{s}_{f} string" for s in ("old", "new") for f in FIELDS)
    return spark.createDataFrame(rows, schema)


def decided(pairs, **options):
    """The stored decisions, which is what reports read."""
    return materialize(gate(pairs, **options), "decided")


CASES = [
    (dict(), "APPROVE", "no_changes_detected"),
    (dict(renamed=True, new=dict(last_name_norm="jones")), "APPROVE", "no_changes_detected"),
    (dict(new=dict(salary="51000")), "APPROVE", "all_fix_types_approved"),
    (dict(new=dict(salary="100000")), "REVIEW", "salary:salary_ratio_extreme (2.0000 outside [0.85, 1.15])"),
    (dict(new=dict(worker_status="Terminated")), "REVIEW", "status:active_to_terminated (active->terminated)"),
    (dict(old=dict(worker_status="leave"), new=dict(worker_status="terminated")), "APPROVE", "all_fix_types_approved"),
    (dict(source="pk", confidence=0.9, new=dict(hire_date="2020-01-02")), "APPROVE", "all_fix_types_approved"),
    (dict(source="pk", confidence=0.9, new=dict(hire_date="2020-12-31")), "APPROVE", "all_fix_types_approved"),
    (dict(new=dict(hire_date="2020-12-31", position="Q")), "REVIEW", "hire_date:hire_date:year_shift_with_other_mismatches"),
    (dict(source="last4_dob", confidence=0.9, new=dict(hire_date="2020-01-02")), "REVIEW",
     "hire_date:below_threshold (0.900<0.970)"),
    (dict(source="pk", confidence=0.9, new=dict(salary="51000")), "REVIEW", "salary:below_threshold (0.900<0.970)"),
    (dict(source="pk", confidence=0.5, new=dict(position="Q")), "REVIEW", "job_org:low_confidence (0.500<0.80)"),
    (dict(source="pk", confidence=None, new=dict(position="Q")), "REVIEW", "job_org:missing_confidence"),
    (dict(source="dob_name", confidence=0.7, new=dict(position="Q")), "REJECT_MATCH", "reject_match:dob_name_low_confidence (0.700<0.75)"),
    (dict(source="dob_name", confidence=None, new=dict(position="Q")), "REJECT_MATCH", "reject_match:dob_name_low_confidence (0.000<0.75)"),
    (dict(source="last4_dob", confidence=0.99, new=dict(salary="150000")), "REJECT_MATCH",
     "reject_match:fuzzy_extreme_salary_ratio (3.0000>2.5)"),
    (dict(source="recon_id", confidence=1.0, new=dict(salary="150000")), "REVIEW",
     "salary:salary_ratio_extreme (3.0000 outside [0.85, 1.15])"),
    (dict(old=dict(payrate="20"), new=dict(payrate="24")), "APPROVE", "all_fix_types_approved"),
    (dict(renamed=True, new=dict(last_name_norm="jones", position="Q")), "REVIEW", "name_change_detected (smith -> jones)"),
    (dict(source="last4_dob", confidence=0.9, old=dict(salary="25", payrate="25"), new=dict(salary="52000", payrate="26")),
     "REVIEW", "salary:salary_ratio_extreme (2080.0000 outside [0.85, 1.15])"),
]


def test_decisions(spark):
    got = {r["pair_id"]: (r["action"], r["reason"]) for r in gate(frame(spark, [c for c, _, _ in CASES])).collect()}
    wrong = {i: (got[f"p{i}"], (a, r)) for i, (_, a, r) in enumerate(CASES) if got[f"p{i}"] != (a, r)}
    assert wrong == {}


def test_wave_dates_force_review_even_without_changes(spark):
    pairs = frame(spark, [dict(old=dict(hire_date="2026-02-01"))] * 3 + [dict(old=dict(hire_date=f"2020-01-{i:02d}")) for i in range(1, 28)])
    waves = wave_dates(pairs, min_rate=0.05)
    assert [(r["new_hire_date"], r["wave_count"]) for r in waves.collect()] == [("2026-02-01", 3)]
    rows = decided(pairs, waves=waves, min_rate=0.05).where("action = 'REVIEW'").collect()
    assert {r["reason"] for r in rows} == {"hire_date_wave"} and len(rows) == 3
    assert wave_dates(pairs, min_rate=0.05, min_count=4).count() == 0


def test_texts(spark):
    row = decided(frame(spark, [dict(new=dict(salary="48500.4", worker_status="", position="Lead"))])).select(
        summary_text().alias("s"), explanation_text().alias("e")).first()
    assert row["s"] == "salary:-1,500 | status:active->blank | job_org(position)"
    assert row["e"] == ("Matched on Worker ID. Salary decreased $1,500, Status changed active to unknown, "
                        "Job title changed from P to Lead. Approved automatically.")


def test_corrections_hold_back_active_zero_pay(spark):
    cases = [dict(source="recon_id", new=dict(salary="51000")), dict(new=dict(salary="51000", worker_status="leave")),
             dict(new=dict(salary="100000"))]
    g = decided(frame(spark, cases))
    manifest = outputs.corrections_manifest(g)
    kinds = [outputs.corrections(g, k, "2026-01-01").count() for k in outputs.CORRECTIONS]
    assert manifest.count() == sum(kinds) == 3
    assert outputs.review_needed(g).count() == 1
    assert [r["hold_reason"] for r in outputs.held_corrections(g).collect()] == ["overall_REVIEW"]


def test_review_queue_order_and_labels(spark):
    g = decided(frame(spark, [dict(new=dict(salary="60000")), dict(new=dict(salary="100000")), dict(new=dict(worker_status="terminated"))]))
    rows = outputs.review_queue(g).collect()
    assert [r["pair_id"] for r in rows] == ["p2", "p1", "p0"]
    assert rows[1]["priority_labels"] == "sal>=5k+30|sal>=1k+15"


@pytest.mark.parametrize("health, suspicious, passed", [
    (dict(det_rate=0.99, approve_rate=0.9, active_zero_approved=0), {}, True),
    (dict(det_rate=0.90, approve_rate=0.9, active_zero_approved=0), {}, False),
    (dict(det_rate=0.99, approve_rate=0.5, active_zero_approved=0), {}, False),
    (dict(det_rate=0.99, active_zero_salary=3), {}, False),
    (dict(det_rate=0.99, approve_rate=0.9, active_zero_approved=0), {"salary_suspicious_default": dict(count=600, rate=0.01)}, False),
])
def test_sanity_gate(health, suspicious, passed):
    verdict = evaluate_sanity_gate({"health_metrics": health, "suspicious": suspicious})
    assert verdict["passed"] is passed
    assert verdict["blocked_outputs"]["corrections"] is (not passed)
    off = evaluate_sanity_gate({}, {"sanity_gate": {"enabled": False}})
    assert off["passed"] and off["reasons"] == ["sanity_gate_disabled"]


def test_single_type_audit_uses_the_field_verdict_alone(spark):
    g = decided(frame(spark, [dict(new=dict(salary="150000")), dict(source="pk", confidence=0.9, new=dict(salary="51000"))]))
    tables = outputs.single_type_audit(g, "salary")
    assert [r["pair_id"] for r in tables["corrections"].collect()] == ["p0"]
    assert [r["pair_id"] for r in tables["review"].collect()] == ["p1"]
    assert tables["manifest"].count() == tables["ui"].count() == 2
