from twinfold.plans.reconcile import reconcile

COLUMNS = ("worker_id", "first_name", "last_name", "dob", "hire_date", "location", "salary", "position", "worker_status", "ssn")


def rows(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "src_ord bigint, " + ", ".join(f"{c} string" for c in COLUMNS))


def test_reconcile_end_to_end(spark, tmp_path):
    old = [(f"W{i}", f"First{chr(97 + i)}", f"Last{chr(97 + i)}", "1980-01-01", f"2010-01-{1 + i:02d}", "Austin TX", "50000", "Clerk",
            "Active", f"{1000 + i}") for i in range(20)]
    new = [list(r) for r in old]
    new[1][6] = "$51,000"            # approved salary change
    new[2][6] = "100000"             # too large: review
    new[3][8] = "Terminated"         # review
    new[4][0] = "X4"                 # matched by name, birth date and digits
    new[5][0] = ""                   # no id
    new.append(list(new[6]))         # a repeated id keeps its best row
    policy = {"sanity_gate": {"health_thresholds": {"min_det_rate": 0.5, "min_approve_rate": 0.5}}}
    result = reconcile(rows(spark, old), rows(spark, [tuple(r) for r in new]), "2026-01-01", policy)
    sources = {r["match_source"]: r["pair_count"] for r in result.outputs()["match_source_summary"].collect()}
    assert sources == {"worker_id": 18, "pk": 1}
    assert [r["unmatched_reason"] for r in result.match.unmatched_new.collect()] == ["no_id"]
    # Few pairs: every hire date is shared by at least one percent of them, so all go to review.
    assert {r["action"] for r in result.gated.collect()} == {"REVIEW"}
    assert not result.sanity["passed"] and "corrections_salary" not in result.outputs()
    result.write(str(tmp_path / "run"), "r1")
    assert spark.read.parquet(str(tmp_path / "run" / "audit_trail")).count() == 19
    assert "old_last4_ssn" not in spark.read.parquet(str(tmp_path / "run" / "wide_compare")).columns


def test_reports_and_candidates_of_a_run(spark):
    old = [(f"W{i}", f"First{chr(97 + i)}", f"Last{chr(97 + i)}", "1980-01-01", f"2010-01-{1 + i:02d}", "Austin TX", "50000", "Clerk",
            "Active", f"{1000 + i}") for i in range(20)]
    new = [list(r) for r in old]
    new[2][6] = "15,000,000"
    new[3][0] = ""                                  # no id: stays unmatched on the new side
    old[4] = (*old[4][:6], "about 5", *old[4][7:])  # a pay that does not parse
    result = reconcile(rows(spark, old), rows(spark, [tuple(r) for r in new]), "2026-01-01")
    tables = result.outputs()
    got = {name: [r.asDict() for r in tables[name].collect()] for name in (
        "mapping_report_old", "mismatch_pack_salary_extreme", "preflight_warnings", "ui_pairs", "run_stats", "sanity_gate",
        "review_candidates", "review_candidate_groups", "unmatched_old", "unmatched_new")}
    assert got["mapping_report_old"][0]["salary_parse_failures"] == 1
    assert got["mapping_report_old"][0]["salary_parse_failure_samples"] == ["about 5"]
    assert [r["new_value"] for r in got["mismatch_pack_salary_extreme"]] == ["15000000.0"]
    assert {r["side"] for r in got["preflight_warnings"]} >= {"new"}
    assert len(got["ui_pairs"]) == 19 and got["run_stats"][0]["total_matched_pairs"] == 19
    assert got["sanity_gate"][0]["passed"] is False
    # The row without an id and its old partner are offered for review.
    assert got["review_candidates"] or got["review_candidate_groups"]
    assert len(got["unmatched_old"]) == len(got["unmatched_new"]) == 1
