import pytest
from pyspark.sql import functions as F

from twinfold.operators import checks, issues
from twinfold.operators.advice import ADVICE, DEFAULT_ACTION, DEFAULT_IMPACT, advice
from twinfold.operators.audit_facts import with_facts
from twinfold.plans.audit import audit
from twinfold.policy import load_policy

AS_OF = "2026-01-15"
CONFIG = load_policy()["internal_audit"]
BASE = dict(worker_id="", first_name="A", last_name="B", worker_status="active", pay_type="salaried", salary="61000", payrate="",
            standard_hours="", hire_date="2020-01-01", termination_date="", department="D", leave_status="", benefits_eligible="",
            benefit_plan="", coverage_level="", dependent_count="", benefits_start_date="", benefits_end_date="", manager_id="M",
            date_of_birth="1980-01-01", phone="5551234567")
CASES = [
    (dict(), set()),
    (dict(salary="0"), {"active_zero_salary", "compensation_type_mismatch", "salaried_implausible_salary"}),
    (dict(salary="", department="", manager_id=""), {"active_zero_salary", "ghost_employee_indicator", "missing_manager"}),
    (dict(worker_status="leave", salary=""), set()),
    (dict(pay_type="weekly"), {"pay_type_missing_or_invalid"}),
    (dict(pay_type="hourly"), {"compensation_type_mismatch"}),
    (dict(pay_type="hourly", salary="", payrate="20"), {"missing_standard_hours_hourly"}),
    (dict(pay_type="hourly", salary="", payrate="300", standard_hours="40"), {"hourly_implausible_payrate"}),
    (dict(payrate="20", standard_hours="40"), {"comp_dual_value_conflict", "annualized_comp_mismatch"}),
    (dict(salary="41600", payrate="20", standard_hours="40"), {"comp_dual_value_conflict"}),
    (dict(salary="5000"), {"salaried_implausible_salary"}),
    (dict(salary="40003"), {"salary_suspicious_default"}),
    (dict(leave_status="LOA"), {"pay_context_sanity_check"}),
    (dict(benefits_eligible="no", benefit_plan="Gold", coverage_level="family", dependent_count="1"), {"benefits_enrolled_not_eligible"}),
    (dict(benefits_eligible="yes"), {"benefits_eligible_not_enrolled"}),
    (dict(benefits_eligible="yes", benefit_plan="Gold"), {"invalid_coverage_level"}),
    (dict(benefits_eligible="yes", benefit_plan="Gold", coverage_level="self", dependent_count="2"),
     {"dependents_without_coverage", "coverage_vs_dependent_sanity"}),
    (dict(coverage_level="family", dependent_count="0"), {"coverage_vs_dependent_sanity"}),
    (dict(benefits_start_date="2019-12-01"), {"benefits_start_before_hire"}),
    (dict(benefits_start_date="2020-01-15"), {"benefits_waiting_period_violation"}),
    (dict(benefits_start_date="2020-01-31"), set()),
    (dict(worker_status="terminated", termination_date="2024-01-01", benefit_plan="Gold", coverage_level="self",
          benefits_end_date="2024-01-31"), {"benefits_after_termination"}),
    (dict(worker_status="terminated", termination_date="2024-01-01", benefit_plan="Gold", coverage_level="self",
          benefits_end_date="2024-02-01"), {"benefits_after_termination", "benefits_after_termination_window"}),
    (dict(pay_type="contractor", benefits_eligible="yes"),
     {"pay_type_missing_or_invalid", "employment_type_eligibility_conflict", "benefits_eligible_not_enrolled"}),
    (dict(hire_date="2030-01-01"), {"invalid_date_logic"}),
    (dict(worker_status="terminated", termination_date="2019-01-01"), {"invalid_date_logic"}),
    (dict(termination_date="2024-01-01"), {"active_with_termination_date"}),
    (dict(worker_status="terminated"), {"status_hire_date_mismatch"}),
    (dict(hire_date="1940-01-01", date_of_birth="1920-01-01"), {"impossible_dates"}),
    (dict(date_of_birth="2021-01-01"), {"impossible_dates"}),
    (dict(first_name="N/A"), {"missing_required_identity"}),
    (dict(phone="123"), {"phone_invalid"}), (dict(phone="1111111"), {"phone_invalid"}), (dict(phone="555-1234"), set()),
    (dict(worker_status="test"), {"status_suspicious_value"}),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, *[{**BASE, "worker_id": f"w{i}", "last_name": f"B{i}", **c}[k] for k in BASE]) for i, (c, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "src_ord bigint, " + ", ".join(f"{k} string" for k in BASE))


def test_row_checks(table):
    facts = with_facts(table)
    found = {}
    for r in checks.flagged_rows(facts, checks.row_cases(facts, CONFIG, AS_OF)).collect():
        found.setdefault(r["src_ord"], set()).add(r["check_key"])
    wrong = {i: (found.get(i, set()), want) for i, (_, want) in enumerate(CASES) if found.get(i, set()) != want}
    assert wrong == {}


def test_counts_equal_the_flagged_rows(table):
    facts = with_facts(table)
    cases = checks.row_cases(facts, CONFIG, AS_OF)
    counted = {}
    for r in checks.row_findings(facts, cases).collect():
        counted[r["check_key"]] = counted.get(r["check_key"], 0) + r["count"]
    listed = {r["check_key"]: r["count"] for r in checks.flagged_rows(facts, cases).groupBy("check_key").count().collect()}
    assert counted == listed


def test_audit_end_to_end(table):
    result = audit(table, AS_OF)
    gate = result.gate.first()
    assert gate["gate_status"] == "BLOCKED" and gate["corrections_generation_skipped"]
    assert checks.evaluate_gate(result.findings, override=True).first()["gate_status"] == "OVERRIDDEN"
    tables = result.outputs()
    assert tables["clean_data"].count() == len(CASES)
    counts = {r["check_key"]: r["count"] for r in tables["check_counts"].collect()}
    assert set(counts) == set(checks.CATALOG) and counts["active_zero_salary"] == 2
    needed = {r["row_number"] for r in tables["review_required"].collect()}
    assert 3 in needed
    rest = {name: tables[name].collect() for name in (
        "grouped_findings", "issue_strings", "completeness_groups", "overall_completeness", "quality_score", "canonical_conflicts",
        "conflict_summary", "duplicate_worker_rows", "same_name_other_id", "multiple_plan_rows", "manager_loops", "salary_outliers",
        "status_distribution", "salary_statistics")}
    assert len(rest["issue_strings"]) == result.findings.count() and len(rest["salary_statistics"]) == 1
    assert rest["duplicate_worker_rows"] == [] and sum(r["count"] for r in rest["status_distribution"]) == len(CASES)
    assert {r["metric"] for r in rest["quality_score"]} >= {"Total Records", "Completeness %", "Gate Status"}


def test_zero_pay_replaces_what_it_causes(table):
    frame = issues.issue_frame(table, AS_OF)
    row = issues.review_metadata(frame).where("row_number = 3").first()
    assert row["issue_names"] == "Invalid Annual Salary" and row["issue_count"] == 1 and row["review_status"] == "Fix Now"
    fix = issues.correction_template(frame, "salary").where("row_number = 3").first()
    assert (fix["issue_name"], fix["related_issues"]) == ("Invalid Annual Salary", "")


def test_gate_passes_without_critical_findings(spark):
    empty = spark.createDataFrame([("a", "HIGH")], "check_key string, severity string")
    assert checks.evaluate_gate(empty).first()["gate_status"] == "PASSED"


def test_manager_loops_with_a_popular_manager(spark):
    rows = [(i, f"w{i}", "boss") for i in range(500)]
    rows += [(1000, "boss", "ceo"), (1001, "ceo", "ceo"), (1002, "a", "b"), (1003, "b", "a"), (1004, "c", "d"), (1005, "d", "e"),
             (1006, "e", "c"), (1007, "f", "x"), (1008, "f", "f2"), (1009, "f2", "f")]
    df = spark.createDataFrame(rows, "src_ord bigint, worker_id string, manager_id string")
    got = {r["employee_ids"] for r in checks.manager_loops(df).collect()}
    assert got == {"ceo", "a -> b -> a", "c -> d -> e -> c", "f -> f2 -> f"}


def test_canonical_conflicts(spark):
    df = spark.createDataFrame(
        [(0, "a", "A"), (1, "a", ""), (2, "", "b"), (3, "a", "b"), (4, "", "")], "src_ord bigint, worker_id string, emp_id string")
    got = {r["src_ord"]: (r["duplicate_classification"], r["retained_value_reason"]) for r in checks.canonical_conflicts(df).collect()}
    assert got == {
        0: ("duplicate_same_value", "identical_values"), 1: ("duplicate_blank_vs_value", "identical_values"),
        2: ("duplicate_blank_vs_value", "first_non_blank"), 3: ("duplicate_conflicting_values", "conflict_primary_wins"),
        4: ("duplicate_same_value", "identical_values")}


def test_findings_carry_their_own_advice(spark):
    rows = [("salaried_implausible_salary", "HIGH", "salary"), ("benefits_waiting_period_violation", "MEDIUM", "start"),
            ("duplicate_canonical_conflict", "HIGH", "email"), ("phone_invalid", "HIGH", "phone"), (None, None, None)]
    df = spark.createDataFrame(rows, "check_key string, severity string, field string").withColumns(advice(CONFIG))
    got = [(r["impact"], r["recommended_action"]) for r in df.collect()]
    assert got[0][1].endswith(f"{CONFIG['salaried_salary_min']:g} to {CONFIG['salaried_salary_max']:g}.")
    assert got[1][1].endswith("at least 30 days.") and "'email'" in got[2][1]
    assert got[3] == got[4] == (DEFAULT_IMPACT, DEFAULT_ACTION)
    assert {k for k, _ in ADVICE} <= set(checks.CATALOG)
    assert not any("{" in text for pair in got for text in pair)


def test_findings_carry_section_samples_and_groups(spark):
    import json

    from twinfold.operators.finding_samples import detailed_findings

    rows = [(i, f"w{i % 30}", f"f{i}", f"l{i}", "active", "Ops", "Clerk", str(0 if i < 12 else 40_000 + 1000 * (i % 40))) for i in range(60)]
    table = spark.createDataFrame(rows, "src_ord bigint, worker_id string, first_name string, last_name string, worker_status string, department string, job_title string, salary string")
    found = {(r["check_key"], r["severity"]): r for r in detailed_findings(table, "2026-01-01").collect()}
    zero = found["active_zero_salary", "CRITICAL"]
    numbers = [json.loads(s)["row_number"] for s in zero["sample_rows"]]
    assert zero["section"] == "CRITICAL_CHECKS" and zero["count"] == 12 and numbers == [str(k) for k in range(2, 10)] and zero["group_rows"] == []
    twice = found["duplicate_worker_id", "CRITICAL"]
    assert twice["section"] == "CRITICAL_CHECKS" and len(twice["sample_rows"]) == 8 and json.loads(twice["sample_rows"][0])["value"] == "w0"
    equity = found["pay_equity_flag", "HIGH"]
    assert equity["section"] == "PAY_EQUITY" and json.loads(equity["group_rows"][0])["department"] == "Ops" and equity["sample_rows"] == equity["group_rows"]
    assert all(r["section"] and len(r["sample_rows"]) <= 8 for r in found.values())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_light_keys_are_joined_by_a_shuffle(spark):
    from twinfold.operators.heavy import join_figures

    rows = spark.createDataFrame([(i % 3, i) for i in range(9)], "k long, v long")
    joined = join_figures(rows, spark.createDataFrame([(0, 3), (1, 3)], "k long, n long"), ["k"], "n")
    assert "SortMergeJoin [k" in _plan(joined)
    assert sorted(r["v"] for r in joined.collect()) == [0, 1, 3, 4, 6, 7]


def test_people_of_one_file_are_dealt_by_their_key(spark, tmp_path):
    from twinfold.catalog.quality import people

    spark.createDataFrame([(i, f"c{i}", 0, 1.0, "M") for i in range(5)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    rows = people(spark, str(tmp_path))
    assert "hashpartitioning(c_custkey" in _plan(rows) and rows.count() == 5


def test_dealt_people_are_not_merged_into_a_task_again(spark, tmp_path):
    from twinfold.catalog.quality import people
    from twinfold.catalog.samples import TASK_ROWS

    n = 2 * TASK_ROWS + 1
    rows = spark.range(n, numPartitions=1).selectExpr("id as c_custkey", "concat('c', id) as c_name", "0 as c_nationkey", "1.0 as c_acctbal", "'M' as c_mktsegment")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    tasks = people(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 3 and sum(r["count"] for r in tasks) == n
