"""Registered queries of the single-table audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, finding_samples, issues
from ..operators.audit_facts import with_facts
from ..policy import load_policy
from . import samples
from .samples import spread_in_tasks, table

QUERIES, SQL = {}, {}
AS_OF = "2026-01-15"
CONFIG = load_policy()["internal_audit"]

# Column -> (Spark expression, DuckDB expression or None when the same) over customer, k = c_custkey.
_B = {
    "worker_id": ("case when k % 101 = 0 then '' when k % 97 = 0 then 'W1' else concat('W', k) end", None),
    "first_name": ("if(k % 103 = 0, 'n/a', concat('Fn', k % 90))", "if(k % 103 = 0, 'n/a', concat('Fn', k % 90))"),
    "last_name": ("concat('Ln', k % 70)", None),
    "email": ("case when k % 89 = 0 then 'Dup@x.org' when k % 4 = 0 then '' else concat('u', k, '@x.org') end", None),
    "last4_ssn": ("lpad(k * 7919 % 1400, 4, '0')", "lpad((k * 7919 % 1400)::varchar, 4, '0')"),
    "worker_status": ("case when k % 211 = 0 then 'test' when k % 10 < 5 then 'Active' when k % 10 = 5 then 'terminated' "
                      "when k % 10 < 9 then 'pending' else 'inactive' end", None),
    "pay_type": ("case when k % 53 = 0 then '' when k % 59 = 0 then 'weekly' when k % 73 = 0 then 'contractor' "
                 "when k % 4 < 2 then 'Hourly' when k % 4 = 2 then 'salaried' else 'annual' end", None),
    "salary": ("case when k % 31 = 0 then '0' when k % 149 = 0 then '2000000' when k % 43 = 0 then '100000' "
               "when k % 41 = 0 then '' when k % 4 >= 2 or k % 37 = 0 then string(40000 + k * 977 % 90000) else '' end",
               "case when k % 31 = 0 then '0' when k % 149 = 0 then '2000000' when k % 43 = 0 then '100000' "
               "when k % 41 = 0 then '' when k % 4 >= 2 or k % 37 = 0 then (40000 + k * 977 % 90000)::varchar else '' end"),
    "payrate": ("case when k % 47 = 0 then '-1' when k % 151 = 0 then '900' when k % 4 < 2 or k % 37 = 0 "
                "then string(15 + k % 40) else '' end",
                "case when k % 47 = 0 then '-1' when k % 151 = 0 then '900' when k % 4 < 2 or k % 37 = 0 "
                "then (15 + k % 40)::varchar else '' end"),
    "standard_hours": ("case when k % 23 = 0 then '' when k % 4 < 2 or k % 37 = 0 then '40' else '' end", None),
    "hire_date": ("case when k % 173 = 0 then '2031-01-01' when k % 179 = 0 then '1940-05-05' when k % 181 = 0 then "
                  "'1900-01-01' when k % 67 = 0 then '2026-02-01' else string(date_add(date'2005-01-01', int(k * 13 % 6000))) end",
                  "case when k % 173 = 0 then '2031-01-01' when k % 179 = 0 then '1940-05-05' when k % 181 = 0 then "
                  "'1900-01-01' when k % 67 = 0 then '2026-02-01' else (date '2005-01-01' + (k * 13 % 6000)::integer)::varchar end"),
    "termination_date": ("case when k % 19 = 0 then '' when k % 191 = 0 then '2001-01-01' when k % 10 = 5 then '2024-06-30' "
                         "when k % 83 = 0 then '2030-01-01' else '' end", None),
    "date_of_birth": ("case when k % 193 = 0 then '1890-01-01' when k % 197 = 0 then '2020-01-01' "
                      "else string(date_add(date'1950-01-01', int(k * 37 % 14000))) end",
                      "case when k % 193 = 0 then '1890-01-01' when k % 197 = 0 then '2020-01-01' "
                      "else (date '1950-01-01' + (k * 37 % 14000)::integer)::varchar end"),
    "department": ("if(k % 61 = 0, '', c_mktsegment)", None),
    "job_title": ("concat('T', k % 12)", None),
    "manager_id": ("case when k % 29 = 0 then '' when k % 50 < 2 then concat('W', if(k % 2 = 0, k + 1, k - 1)) "
                   "when k % 50 = 7 then concat('W', k) when k % 50 between 10 and 12 then "
                   "concat('W', if(k % 50 = 12, k - 2, k + 1)) else 'W3' end", None),
    "leave_status": ("case when k % 13 = 0 then 'LOA' when k % 11 = 0 then 'working' else '' end", None),
    "benefits_eligible": ("case when k % 3 = 0 then 'Yes' when k % 3 = 1 then 'no' else '' end", None),
    "benefit_plan": ("case k % 5 when 0 then 'Gold' when 1 then 'waived' when 2 then 'Gold; Silver' when 3 then '' else 'Silver' end", None),
    "coverage_level": ("case k % 7 when 0 then 'Employee Only' when 1 then 'family' when 2 then 'weird' when 3 then '' else 'employee/spouse' end", None),
    "dependent_count": ("string(k % 4)", "(k % 4)::varchar"),
    "benefits_start_date": ("string(date_add(date'2005-01-01', int(k * 13 % 6000 + k % 80 - 10)))",
                            "(date '2005-01-01' + (k * 13 % 6000 + k % 80 - 10)::integer)::varchar"),
    "benefits_end_date": ("case when k % 2 = 0 then '' else string(date_add(date'2024-06-30', int(k % 60))) end",
                          "case when k % 2 = 0 then '' else (date '2024-06-30' + (k % 60)::integer)::varchar end"),
    "phone": ("case when k % 107 = 0 then '123' when k % 109 = 0 then '-5551234' when k % 113 = 0 then '1111111' "
              "when k % 17 = 0 then '555-1234' when k % 19 = 0 then '' else string(5550000 + k) end",
              "case when k % 107 = 0 then '123' when k % 109 = 0 then '-5551234' when k % 113 = 0 then '1111111' "
              "when k % 17 = 0 then '555-1234' when k % 19 = 0 then '' else (5550000 + k)::varchar end"),
    "age": ("string(30 + k % 3)", "(30 + k % 3)::varchar"),
    "code": ("concat('A', k % 3, '-B', k % 4)", None),
}


def people(spark, sf_dir):
    rows = spread_in_tasks(table(spark, sf_dir, "customer"), "c_custkey").withColumn("k", F.col("c_custkey"))
    return rows.select(F.col("k").alias("src_ord"), *[F.expr(e).alias(c) for c, (e, _) in _B.items()])


def _people_sql():
    columns = ", ".join(f"{d or e} as {c}" for c, (e, d) in _B.items())
    return f"select k, {columns} from (select c_custkey as k, * from customer)"


_n = lambda c: f"try_cast(nullif(trim({c}), '') as double)"
_bl = lambda c: f"(lower(trim({c})) in ('', 'nan', 'none', 'null', 'n/a', 'na'))"
_d = lambda c: f"try_cast(nullif(trim({c}), '') as date)"
_FACTS = (
    "select *, lower(trim(worker_status)) as st, lower(trim(worker_status)) = 'active' as act, "
    "case when lower(trim(pay_type)) = '' then '' when lower(trim(pay_type)) = 'hourly' then 'hourly' "
    "when lower(trim(pay_type)) in ('salaried', 'annual') then 'salaried' else 'invalid' end as pay, "
    "case when lower(trim(pay_type)) = 'contractor' then 'contractor' else '' end as emp, "
    f"{_n('salary')} as sal, {_n('payrate')} as rate, {_n('standard_hours')} as hrs, {_bl('salary')} as sb, {_bl('payrate')} as rb, "
    f"{_bl('standard_hours')} as hb, {_bl('pay_type')} as pb, {_bl('termination_date')} as tb, "
    f"{_d('hire_date')} as hd, {_d('termination_date')} as td, {_d('date_of_birth')} as bd, "
    f"{_d('benefits_start_date')} as bs, {_d('benefits_end_date')} as be, "
    "lower(trim(benefit_plan)) not in ('', 'none', 'no plan', 'not enrolled', 'waived', 'waive', 'declined', 'decline') as plan, "
    "case lower(trim(benefits_eligible)) when 'yes' then 'eligible' when 'no' then 'not_eligible' else '' end as el, "
    "case lower(trim(coverage_level)) when '' then '' when 'employee only' then 'employee_only' when 'family' then 'deps' "
    "when 'employee/spouse' then 'deps' else 'invalid' end as cov, "
    f"coalesce({_n('dependent_count')}, 0) as dep, regexp_replace(phone, '[^0-9]', '', 'g') as dg from people"
)
_somepay = "(not sb or not rb)"
_norate = "(pay = 'hourly' and not (not rb and coalesce(rate > 0, false)))"
_nosal = "(pay = 'salaried' and not (not sb and coalesce(sal > 0, false)))"
_known = "pay in ('hourly', 'salaried')"
# (check, field, severity, value, condition), the twin of the row checks.
MASKS = [
    ("active_zero_salary", "salary", "CRITICAL", "", f"act and ((sb and rb) or (case when not sb then sal else rate end) <= 0)"),
]


def _split(key, field, high, low, cond):
    MASKS.extend([(key, field, high, "", f"({cond}) and act"), (key, field, low, "", f"({cond}) and not act")])


_split("pay_type_missing_or_invalid", "pay_type", "CRITICAL", "HIGH", f"{_somepay} and (pay = 'invalid' or pb)")
_split("compensation_type_mismatch", "pay_type", "CRITICAL", "HIGH", f"{_somepay} and ({_norate} or {_nosal})")
_split("comp_dual_value_conflict", "pay_type", "HIGH", "MEDIUM", f"not sb and not rb and {_known}")
_split("missing_standard_hours_hourly", "standard_hours", "HIGH", "MEDIUM", "pay = 'hourly' and not rb and hb")
MASKS += [
    ("hourly_implausible_payrate", "payrate", "CRITICAL", "", "pay = 'hourly' and not rb and rate <= 0"),
    ("hourly_implausible_payrate", "payrate", "HIGH", "", "pay = 'hourly' and not rb and rate > 0 and (rate < 7.25 or rate > 250)"),
    ("salaried_implausible_salary", "salary", "CRITICAL", "", "pay = 'salaried' and not sb and sal <= 0"),
    ("salaried_implausible_salary", "salary", "HIGH", "", "pay = 'salaried' and not sb and sal > 0 and (sal < 10000 or sal > 1000000)"),
    ("annualized_comp_mismatch", "pay_type", "HIGH", "",
     f"{_known} and not sb and not rb and not hb and sal > 0 and rate > 0 and hrs > 0 and abs(rate * hrs * 52 - sal) / greatest(abs(sal), 1) >= 0.1"),
    ("pay_context_sanity_check", "pay_type", "HIGH", "",
     f"{_somepay} and {_known} and ((act and lower(leave_status) = 'loa') or (st in ('terminated', 'inactive') and lower(leave_status) = 'working'))"),
]
_split("benefits_enrolled_not_eligible", "benefit_plan", "CRITICAL", "HIGH", "el = 'not_eligible' and plan")
_split("benefits_eligible_not_enrolled", "benefit_plan", "HIGH", "MEDIUM", "el = 'eligible' and not plan")
_split("invalid_coverage_level", "coverage_level", "HIGH", "MEDIUM", "plan and cov in ('', 'invalid')")
MASKS += [
    ("dependents_without_coverage", "coverage_level", "HIGH", "", "plan and dep > 0 and cov = 'employee_only'"),
    ("benefits_after_termination", "benefit_plan", "CRITICAL", "", "plan and not tb"),
    ("benefits_after_termination_window", "benefits_end_date", "HIGH", "", "plan and td is not null and (be is null or be > td + 30)"),
]
_split("benefits_start_before_hire", "benefits_start_date", "HIGH", "MEDIUM", "coalesce(bs < hd, false)")
_split("benefits_waiting_period_violation", "benefits_start_date", "HIGH", "MEDIUM", "coalesce(bs >= hd and bs < hd + 30, false)")
MASKS += [
    ("employment_type_eligibility_conflict", "pay_type", "HIGH", "", "emp = 'contractor' and (el = 'eligible' or plan)"),
    ("coverage_vs_dependent_sanity", "coverage_level", "HIGH", "", "(cov = 'deps' and dep <= 0) or (cov = 'employee_only' and dep > 0)"),
    ("invalid_date_logic", "hire_date", "CRITICAL", "", f"hd > date '{AS_OF}'"),
    ("invalid_date_logic", "hire_date", "CRITICAL", "", "td < hd"),
    ("impossible_dates", "hire_date", "HIGH", "", "hd < date '1950-01-01'"),
    ("impossible_dates", "hire_date", "HIGH", "", f"bd <= date '{AS_OF}' - 36500"),
    ("impossible_dates", "hire_date", "HIGH", "", f"bd >= date '{AS_OF}' - 5840"),
    ("impossible_dates", "hire_date", "HIGH", "", "bd > hd"),
    ("impossible_dates", "hire_date", "HIGH", "", f"td > date '{AS_OF}' and st = 'terminated'"),
    ("status_hire_date_mismatch", "worker_status", "HIGH", "", "st = 'terminated' and tb"),
    ("active_with_termination_date", "termination_date", "CRITICAL", "", "act and not tb"),
    ("missing_required_identity", "worker_id,first_name,last_name", "CRITICAL", "",
     f"{_bl('worker_id')} or {_bl('first_name')} or {_bl('last_name')}"),
    ("missing_manager", "manager_id", "MEDIUM", "", f"act and {_bl('manager_id')}"),
    ("ghost_employee_indicator", "worker_status", "CRITICAL", "",
     f"act and (sb or sal = 0) and {_bl('department')} and {_bl('manager_id')} and not {_bl('hire_date')}"),
    ("phone_invalid", "phone", "HIGH", "",
     f"not {_bl('phone')} and {_n('phone')} is not null and ({_n('phone')} <= 0 or length(dg) < 7 or length(dg) > 15 "
     "or length(replace(dg, substr(dg, 1, 1), '')) = 0)"),
]
MASKS += [("salary_suspicious_default", "salary", "HIGH", str(v), f"sal = {v}") for v in CONFIG["suspicious_salary_values"]]
MASKS += [("hire_date_suspicious_default", "hire_date", "HIGH", p, f"starts_with(hire_date, '{p}')") for p in CONFIG["suspicious_hire_date_prefixes"]]
MASKS += [("status_suspicious_value", "worker_status", "HIGH", v, f"st = '{v}'") for v in CONFIG["suspicious_status_values"]]

STEPS = [("people", _people_sql()), ("facts", _FACTS)]
_ROWCOUNT = "(select count(*) from people)"
_reason_sql = " union all ".join(
    f"select k, '{k}' as check_key, '{s}' as severity, {i} as reason from facts where {c}"
    for i, (k, f, s, v, c) in enumerate(MASKS))
_flag_sql = " union all ".join(
    f"select k, '{k}' as check_key, '{f}' as field, '{s}' as severity, '{v}' as value, {i} as at from facts where {c}"
    for i, (k, f, s, v, c) in enumerate(MASKS))


def people_sql(body, more=()):
    return samples.with_sql(STEPS + list(more), body)


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _cases(facts, values=True):
    return checks.row_cases(facts, CONFIG, AS_OF, values)


def _row_findings(spark, sf_dir):
    facts = with_facts(people(spark, sf_dir))
    return checks.row_findings(facts, _cases(facts, False)).select("check_key", "field", "severity", "value", "count", "pct")


_add("audit_row_checks", _row_findings, people_sql(
    f"select check_key, field, severity, value, count(*) as count, round(count(*) / {_ROWCOUNT} * 100, 2) as pct "
    f"from ({_flag_sql}) group by 1, 2, 3, 4"))


def _flags(spark, sf_dir):
    facts = with_facts(people(spark, sf_dir))
    return checks.flagged_rows(facts, _cases(facts)).select("src_ord", "check_key", "severity", "field")


_add("audit_flagged_rows", _flags, people_sql(f"select k as src_ord, check_key, severity, field from ({_flag_sql})"))


def _samples(spark, sf_dir):
    facts = with_facts(people(spark, sf_dir))
    found = checks.sample_rows(facts, _cases(facts))
    numbers = F.transform("sample_rows", lambda x: F.get_json_object(x, "$.row_number"))
    return found.select("check_key", "severity", F.array_join(numbers, ",").alias("rows"))


_add("audit_sample_rows", _samples, people_sql(
    "select check_key, severity, string_agg(k + 2, ',' order by k, reason) as rows from (select *, row_number() over (partition by check_key, severity "
    f"order by k, reason) as rn from ({_reason_sql})) where rn <= 8 group by 1, 2"))


def _dups(spark, sf_dir):
    return checks.duplicate_findings(people(spark, sf_dir), CONFIG["duplicate_check_fields"]).select(
        "check_key", "field", "severity", "count", "pct", "description")


_add("audit_duplicates", _dups, people_sql(
    "select 'duplicate_' || field as check_key, field, case when field = 'email' then 'MEDIUM' else 'CRITICAL' end as severity, "
    f"sum(n)::bigint as count, round(sum(n) / {_ROWCOUNT} * 100, 2) as pct, sum(n)::bigint || ' records share duplicate ' || field || "
    "' values across ' || count(*) || ' repeated values.' as description from ("
    + " union all ".join(f"select '{f}' as field, trim({f}) as v, count(*) as n from people where trim({f}) <> '' group by 2 having count(*) > 1"
                         for f in ("worker_id", "email", "last4_ssn")) + ") group by field"))
_add("audit_duplicate_rows",
     lambda s, d: checks.duplicates_table(people(s, d), CONFIG["duplicate_check_fields"]).select("src_ord", "_dup_field"),
     people_sql(" union all ".join(
         f"select k as src_ord, '{f}' as _dup_field from people where trim({f}) in "
         f"(select trim({f}) from people where trim({f}) <> '' group by 1 having count(*) > 1)" for f in ("email", "last4_ssn"))))
_name = "lower(trim(first_name)) || '|' || lower(trim(last_name))"
_add("audit_same_name_other_id",
     lambda s, d: checks.same_name_other_id(people(s, d)).select("src_ord", "worker_id", "name"),
     people_sql(f"select k as src_ord, worker_id, name from (select k, trim(worker_id) as worker_id, first_name || ' ' || last_name as name, "
                f"row_number() over (partition by {_name} order by k) as rn, min(trim(worker_id)) over (partition by {_name}) as a, "
                f"max(trim(worker_id)) over (partition by {_name}) as b from people where trim(worker_id) <> '') where a <> b"))
_plan_sql = ("select trim(worker_id) as w, unnest(list_filter(list_transform(string_split_regex(benefit_plan, '[;,|]'), lambda x: lower(trim(x))), "
             "lambda x: x not in ('', 'none', 'no plan', 'not enrolled', 'waived', 'waive', 'declined', 'decline'))) as p from people where trim(worker_id) <> ''")
_add("audit_multiple_plans", lambda s, d: checks.multiple_plan_rows(people(s, d)).select("src_ord", "benefit_plan"),
     people_sql(f"select k as src_ord, benefit_plan from people where trim(worker_id) in (select w from ({_plan_sql}) group by 1 "
                "having count(distinct p) > 1)"))
_edges = ("select w, arg_max(m, k) as m, min(k) as r from (select trim(worker_id) as w, trim(manager_id) as m, k from people) "
          "where w <> '' and m <> '' group by 1")
_add("audit_manager_loops", lambda s, d: checks.manager_loops(people(s, d)),
     people_sql("select 1 as cycle_length, w as employee_ids from e where w = m union all "
                "select 2, a.w || ' -> ' || b.w || ' -> ' || a.w from e a join e b on a.m = b.w where b.m = a.w and a.r < b.r union all "
                "select 3, a.w || ' -> ' || b.w || ' -> ' || c.w || ' -> ' || a.w from e a join e b on a.m = b.w join e c on b.m = c.w "
                "where c.m = a.w and a.r < b.r and a.r < c.r and a.w <> b.w and b.w <> c.w", [("e", _edges)]))
_dept = ("select trim(department) as department, count(*) as n, median(sal) as med from facts where trim(department) <> '' "
         "and sal is not null group by 1")
_add("audit_salary_outliers", lambda s, d: checks.salary_outliers(people(s, d), CONFIG).select(
        "src_ord", "department", "salary", F.col("median").alias("median_salary")),
     people_sql("select k as src_ord, g.department, sal as salary, med as median_salary from facts f join g on trim(f.department) = g.department "
                "where g.n >= 5 and med > 0 and (sal > med * 2.5 or sal < med * 0.3)", [("g", _dept)]))
_add("audit_pay_equity", lambda s, d: checks.pay_equity_groups(people(s, d), CONFIG),
     people_sql("select job_title as title, trim(department) as department, count(*) as employees, min(sal) as min_salary, "
                "max(sal) as max_salary, median(sal) as median_salary, round((max(sal) - min(sal)) / median(sal) * 100, 1) as variance_pct "
                "from facts where sal is not null and trim(department) <> '' group by 1, 2 having count(*) >= 3 and median(sal) > 0 "
                "and (max(sal) - min(sal)) / median(sal) > 0.3"))
_add("audit_round_salaries", lambda s, d: checks.round_salaries(people(s, d)),
     people_sql("select k as src_ord, trim(worker_id) as worker_id, sal as salary, c as repeated_count from facts f join "
                "(select sal, count(*) as c from facts where act and sal is not null group by 1 having count(*) > 3) using (sal) "
                "left join g on trim(f.department) = g.department where act and (sal::bigint in (1, 10, 100, 1000, 10000, 12345, 99999, 999999) "
                "or ends_with(sal::bigint::varchar, '00000')) and (coalesce(med, 0) <= 0 or abs(sal - med) / med > 0.2)", [("g", _dept)]))

_cols = list(_B)
_sev = "case when blank_pct > 20 and field = 'worker_id' then 'CRITICAL' when blank_pct > 20 then 'MEDIUM' else 'LOW' end"
_complete_sql = (
    f"select *, {_sev} as severity from (select *, round(blank_count / total * 100, 2) as blank_pct, round((total - blank_count) / total * 100, 2) "
    "as filled_pct from (" + " union all ".join(
        f"select '{c}' as field, count(*) as total, count(*) filter ({_bl(c)}) as blank_count from people" for c in _cols) + "))")
_add("audit_completeness", lambda s, d: checks.completeness(people(s, d), 0.20), people_sql(_complete_sql))
_add("audit_blank_findings",
     lambda s, d: checks.blank_findings(checks.completeness(people(s, d), 0.20), 0.20).select("check_name", "field", "severity", "count", "pct"),
     people_sql(f"select 'High blank rate - ' || field as check_name, field, severity, blank_count as count, blank_pct as pct "
                f"from ({_complete_sql}) where blank_pct > 20"))
_add("audit_overall_completeness", lambda s, d: checks.overall_completeness(checks.completeness(people(s, d), 0.20)),
     people_sql(f"select round((sum(total) - sum(blank_count)) / sum(total) * 100, 1) as overall_completeness from ({_complete_sql})"))
_groups = "case " + " ".join(
    f"when field in ({', '.join(repr(x) for x in fs)}) then '{g}'" for g, fs in checks.FIELD_GROUPS.items()) + " end"
_add("audit_completeness_groups", lambda s, d: checks.completeness_groups(checks.completeness(people(s, d), 0.20)),
     people_sql(f"select {_groups} as field_group, field, total - blank_count as records_complete, total, blank_count, "
                "case when 100 - blank_pct >= 99 then 'Complete' when 100 - blank_pct >= 95 then 'Acceptable' when 100 - blank_pct >= 80 "
                f"then 'Needs Attention' else 'Critical Gap' end as status from ({_complete_sql}) where {_groups} is not null"))
_add("audit_table_checks", lambda s, d: checks.table_findings(people(s, d)).select("check_key", "field", "severity", "count", "pct"),
     people_sql("select 'status_high_pending' as check_key, 'worker_status' as field, 'MEDIUM' as severity, count(*) filter (st = 'pending') as count, "
                "round(count(*) filter (st = 'pending') / count(*) * 100, 1) as pct from facts having pct > 25 union all "
                "select 'age_uniformity', 'age', 'MEDIUM', count(*), 100.0 from facts having count(distinct age) / count(*) < 0.05"))
_add("audit_combined_fields",
     lambda s, d: checks.combined_fields(
         people(s, d).join(table(s, d, "orders").groupBy(F.col("o_custkey").alias("src_ord")).agg(
             F.min("o_orderpriority").alias("priority")), "src_ord")).select("field", "count", "pct"),
     people_sql("select 'code' as field, count(*) as count, 100.0::double as pct from people join p using (k) union all "
                "select 'priority', count(*), 100.0 from people join p using (k) union all "
                "select 'termination_date', count(*), 100.0 from people join p using (k) where termination_date <> ''",
                [("p", "select o_custkey as k, min(o_orderpriority) as priority from orders group by 1")]))
_add("audit_salary_distribution", lambda s, d: checks.salary_distribution(people(s, d)),
     people_sql(f"select b as bucket, count(sal) as count, round(count(sal) / {_ROWCOUNT} * 100, 2) as pct from (select unnest(['Under $30k', '$30k-$60k', "
                "'$60k-$100k', '$100k-$150k', '$150k-$200k', '$200k+']) as b) left join (select sal, case when sal < 30000 then 'Under $30k' "
                "when sal < 60000 then '$30k-$60k' when sal < 100000 then '$60k-$100k' when sal < 150000 then '$100k-$150k' when sal < 200000 "
                "then '$150k-$200k' else '$200k+' end as b from facts where sal >= 0) using (b) group by 1"))
_add("audit_status_distribution", lambda s, d: checks.status_distribution(people(s, d)),
     people_sql(f"select st as status_value, count(*) as count, round(count(*) / {_ROWCOUNT} * 100, 2) as pct from facts group by 1"))
_add("audit_salary_statistics", lambda s, d: checks.salary_statistics(people(s, d)),
     people_sql("select count(sal) as count, count(*) - count(sal) as missing, min(sal) as min, max(sal) as max, round(avg(sal), 2) as mean, "
                "median(sal) as median, count(*) filter (sal < 50000) as under_50k, count(*) filter (sal > 150000) as over_150k, "
                "round((count(*) - count(sal)) / count(*) * 100, 1) as missing_pct, round(count(*) filter (sal < 50000) / count(sal) * 100, 1) "
                "as under_50k_pct, round(count(*) filter (sal > 150000) / count(sal) * 100, 1) as over_150k_pct from facts"))


def raw_people(spark, sf_dir):
    """The table with two id columns and two hire date columns that map to one name."""
    rows = people(spark, sf_dir)
    return rows.withColumns({
        "employee_id": F.expr("case when src_ord % 9 = 0 then '' when src_ord % 14 = 0 then concat(worker_id, 'Z') else lower(worker_id) end"),
        "start_date": F.expr("case when src_ord % 6 = 0 then '' when src_ord % 25 = 0 then '1999-01-01' else hire_date end"),
    })


_RAW = [("rawp", "select *, case when k % 9 = 0 then '' when k % 14 = 0 then worker_id || 'Z' else lower(worker_id) end as employee_id, "
                 "case when k % 6 = 0 then '' when k % 25 = 0 then '1999-01-01' else hire_date end as start_date from people")]


def _conflict_sql(name, a, b):
    x, y = f"trim({a})", f"trim({b})"
    same = f"({x} = '' and {y} = '') or ({x} <> '' and {y} <> '' and lower({x}) = lower({y}))"
    part = f"({x} = '') <> ({y} = '')"
    return (f"select k as src_ord, '{name}' as duplicate_canonical_field, case when {same} then 'duplicate_same_value' when {part} then "
            f"'duplicate_blank_vs_value' else 'duplicate_conflicting_values' end as duplicate_classification, '{a}|{b}' as duplicate_source_columns, "
            f"{x} || '|' || {y} as duplicate_values, case when {same} then 'identical_values' when {part} and {x} <> '' then 'identical_values' "
            f"when {part} then 'first_non_blank' else 'conflict_primary_wins' end as retained_value_reason from rawp")


_conf_sql = _conflict_sql("worker_id", "worker_id", "employee_id") + " union all " + _conflict_sql("hire_date", "hire_date", "start_date")
_add("audit_canonical_conflicts", lambda s, d: checks.canonical_conflicts(raw_people(s, d)), people_sql(_conf_sql, _RAW))
_add("audit_conflict_summary", lambda s, d: checks.conflict_summary(checks.canonical_conflicts(raw_people(s, d))),
     people_sql("select duplicate_canonical_field, count(*) filter (duplicate_classification = 'duplicate_same_value') as same_value, "
                "count(*) filter (duplicate_classification = 'duplicate_blank_vs_value') as blank_vs_value, "
                f"count(*) filter (duplicate_classification = 'duplicate_conflicting_values') as conflicting_values from ({_conf_sql}) group by 1", _RAW))


def findings(spark, sf_dir):
    def build():
        return checks.all_findings(people(spark, sf_dir), AS_OF, raw=raw_people(spark, sf_dir))
    return samples.stored(spark, sf_dir, "findings", build)


_one = lambda key, field, sev, query: (
    f"select '{key}' as check_key, '{field}' as field, '{sev}' as severity, '' as value, count(*) as count from ({query}) having count(*) > 0")
_dup_sql = " union all ".join(
    f"select 'duplicate_{f}' as check_key, '{f}' as field, '{'MEDIUM' if f == 'email' else 'CRITICAL'}' as severity, '' as value, "
    f"sum(n)::bigint as count from (select count(*) as n from people where trim({f}) <> '' group by trim({f}) having count(*) > 1)"
    for f in ("worker_id", "email", "last4_ssn"))
_name_rows = ("select k from (select k, row_number() over (partition by {n} order by k) as rn, min(trim(worker_id)) over (partition by {n}) as a, "
              "max(trim(worker_id)) over (partition by {n}) as b from people where trim(worker_id) <> '') where a <> b").format(n=_name)
_outlier_rows = ("select k from facts f join g on trim(f.department) = g.department where g.n >= 5 and med > 0 and (sal > med * 2.5 or sal < med * 0.3)")
_equity_rows = ("select 1 from facts where sal is not null and trim(department) <> '' group by job_title, department having count(*) >= 3 and median(sal) > 0 "
                "and (max(sal) - min(sal)) / median(sal) > 0.3")
_round_rows = ("select k from facts f join (select sal, count(*) as c from facts where act and sal is not null group by 1 having count(*) > 3) using (sal) "
               "left join g on trim(f.department) = g.department where act and (sal::bigint in (1, 10, 100, 1000, 10000, 12345, 99999, 999999) "
               "or ends_with(sal::bigint::varchar, '00000')) and (coalesce(med, 0) <= 0 or abs(sal - med) / med > 0.2)")
_plan_rows = f"select k from people where trim(worker_id) in (select w from ({_plan_sql}) group by 1 having count(distinct p) > 1)"
_loop_rows = ("select 1 from e where w = m union all select 1 from e a join e b on a.m = b.w where b.m = a.w and a.r < b.r union all "
              "select 1 from e a join e b on a.m = b.w join e c on b.m = c.w where c.m = a.w and a.r < b.r and a.r < c.r and a.w <> b.w and b.w <> c.w")
_combined = " union all ".join(
    f"select 'combined_field' as check_key, '{c}' as field, 'LOW' as severity, '' as value, count(*) filter (h) as count from (select contains(trim({c}), '-') as h, "
    f"split_part(trim({c}), '-', 1) as a, substr(trim({c}), position('-' in trim({c})) + 1) as b from people where not {_bl(c)}) having count(*) >= 20 "
    "and count(*) filter (h) / count(*) >= 0.8 and count(distinct a) filter (h) < 20 and count(distinct b) filter (h) < 20" for c in _cols)
FINDINGS_SQL = " union all ".join([
    f"select check_key, field, severity, value, count(*) as count from ({_flag_sql}) group by 1, 2, 3, 4", _dup_sql,
    _one("status_high_pending", "worker_status", "MEDIUM", "select k from facts where st = 'pending' and (select count(*) filter (st = 'pending') / count(*) from facts) > 0.2505"),
    _one("age_uniformity", "age", "MEDIUM", "select k from people"), _combined,
    f"select 'high_blank_rate' as check_key, field, severity, '' as value, blank_count as count from ({_complete_sql}) where blank_pct > 20",
    _one("duplicate_name_different_id", "worker_id", "MEDIUM", _name_rows), _one("multiple_active_benefit_plans", "benefit_plan", "HIGH", _plan_rows),
    _one("manager_loop", "manager_id", "HIGH", _loop_rows), _one("salary_outlier", "department", "MEDIUM", _outlier_rows),
    _one("suspicious_round_salary", "salary", "LOW", _round_rows), _one("pay_equity_flag", "job_title", "HIGH", _equity_rows),
    "select case when duplicate_canonical_field = 'worker_id' then 'duplicate_canonical_worker_id_conflict' else 'duplicate_canonical_conflict' end as check_key, "
    "duplicate_canonical_field as field, case when duplicate_canonical_field = 'worker_id' then 'CRITICAL' else 'HIGH' end as severity, '' as value, "
    f"count(*) as count from ({_conf_sql}) where duplicate_classification = 'duplicate_conflicting_values' group by 1, 2, 3"])
_FIND_STEPS = _RAW + [("g", _dept), ("e", _edges), ("found", FINDINGS_SQL)]
_catalog_sql = "(values " + ", ".join(f"('{k}', '{n}', '{s}')" for k, (n, s) in checks.CATALOG.items()) + ") c(check_key, check_name, severity)"
_check_name = "case when check_key like 'duplicate!_%' escape '!' and field in ('worker_id', 'email', 'last4_ssn') and check_key = 'duplicate_' || field then 'Duplicate ' || field "
_check_name += "when check_key = 'combined_field' then 'Combined field detected - ' || field when check_key = 'high_blank_rate' then 'High blank rate - ' || field else check_name end"
_named_findings = f"(select f.check_key, {_check_name} as check_name, field, f.severity, value, count from found f join {_catalog_sql} using (check_key))"
_sev_rank = "case severity when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 else 4 end"

_add("audit_findings", lambda s, d: checks.all_findings(people(s, d), AS_OF, raw=raw_people(s, d)).select(
        "check_key", "field", "severity", "value", "count"),
     people_sql("select * from found", _FIND_STEPS))


def _detailed(spark, sf_dir):
    """Every finding with its section and the row numbers of its first records, and how many groups it shows."""
    found = finding_samples.detailed_findings(people(spark, sf_dir), AS_OF, raw=raw_people(spark, sf_dir))
    numbers = F.transform("sample_rows", lambda x: F.coalesce(F.get_json_object(x, "$.row_number"), F.get_json_object(x, "$.title"), F.lit("loop")))
    return found.select("check_key", "field", "severity", "value", "section", F.array_join(numbers, ",").alias("rows"), F.size("group_rows").alias("groups"))


_records = " union all ".join([
    f"select check_key, field, severity, value, k, f.at as n from ({_flag_sql}) f",
    *[f"select 'duplicate_{f}', '{f}', '{'MEDIUM' if f == 'email' else 'CRITICAL'}', '', k, 0 from people where trim({f}) in "
      f"(select trim({f}) from people where trim({f}) <> '' group by 1 having count(*) > 1)" for f in ("worker_id", "email", "last4_ssn")],
    *[f"select '{key}', '{field}', '{sev}', '', k, 0 from ({rows})" for key, field, sev, rows in (
        ("duplicate_name_different_id", "worker_id", "MEDIUM", _name_rows), ("multiple_active_benefit_plans", "benefit_plan", "HIGH", _plan_rows),
        ("salary_outlier", "department", "MEDIUM", _outlier_rows), ("suspicious_round_salary", "salary", "LOW", _round_rows),
        ("status_high_pending", "worker_status", "MEDIUM", "select k from facts where st = 'pending'"))],
    "select case when duplicate_canonical_field = 'worker_id' then 'duplicate_canonical_worker_id_conflict' else 'duplicate_canonical_conflict' end, "
    f"duplicate_canonical_field, case when duplicate_canonical_field = 'worker_id' then 'CRITICAL' else 'HIGH' end, '', src_ord, 0 from ({_conf_sql}) "
    "where duplicate_classification = 'duplicate_conflicting_values'",
    *[f"select 'high_blank_rate', '{c}', (select severity from ({_complete_sql}) where field = '{c}'), '', k, 0 from people where {_bl(c)}" for c in _cols]])
_section = " ".join(f"when check_key in ({', '.join(repr(k) for k in keys)}) then '{s}'" for s, keys in finding_samples.SECTIONS.items())
_equity_groups = _equity_rows.replace("select 1 from", "select job_title, department from")
_add("audit_finding_details", _detailed,
     people_sql("select f.check_key, f.field, f.severity, f.value, case when check_key in ("
                + ", ".join(repr(k) for k in finding_samples.CRITICAL_IF) + f") and f.severity = 'CRITICAL' then 'CRITICAL_CHECKS' {_section} else 'DUPLICATES' end as section, "
                "case check_key when 'pay_equity_flag' then (select coalesce(string_agg(job_title, ',' order by job_title, department), '') from "
                f"(select * from ({_equity_groups}) order by job_title, department limit 8)) when 'manager_loop' then array_to_string(list_resize(['loop'], least(f.count, 8)::int, 'loop'), ',') "
                "else coalesce(s.rows, '') end as rows, case check_key when 'pay_equity_flag' then least(f.count, 20) when 'manager_loop' then least(f.count, 20) else 0 end::integer as groups "
                "from found f left join (select check_key, field, severity, value, string_agg(k + 2, ',' order by k, n) as rows from (select *, row_number() over "
                f"(partition by check_key, field, severity, value order by k, n) as rn from ({_records})) where rn <= 8 group by 1, 2, 3, 4) s using (check_key, field, severity, value) where f.count > 0",
                _FIND_STEPS))
_add("audit_check_counts", lambda s, d: checks.check_counts(findings(s, d)),
     people_sql(f"select check_key, check_name, severity, coalesce(n, 0)::bigint as count from {_catalog_sql} left join (select check_key, sum(count) as n "
                "from found group by 1) using (check_key)", _FIND_STEPS))
_add("audit_severity_counts", lambda s, d: checks.severity_counts(findings(s, d)),
     people_sql("select " + ", ".join(f"count(*) filter (severity = '{x}') as {x.lower()}" for x in checks.SEVERITIES) + " from found", _FIND_STEPS))
_add("audit_grouped_findings", lambda s, d: checks.grouped_findings(findings(s, d)).select("check_key", "check_name", "severity", "count", "field"),
     people_sql(f"select check_key, check_name, severity, sum(count)::bigint as count, min(field) as field from {_named_findings} group by 1, 2, 3", _FIND_STEPS))
_add("audit_issue_strings", lambda s, d: checks.issue_strings(findings(s, d)).select(
        F.regexp_extract("issue", r"^(.*?: \d+)", 1).alias("issue")),
     people_sql(f"select '[' || severity || '] ' || check_name || ': ' || count as issue from {_named_findings}", _FIND_STEPS))
_add("audit_gate", lambda s, d: checks.evaluate_gate(findings(s, d)),
     people_sql("select 'BLOCKED' as gate_status, 'CRITICAL issues detected. Dataset is NOT safe for payroll or production use.' as gate_message, "
                "false as override_gate, true as critical_findings_present, true as corrections_generation_skipped, "
                f"false as approved_status_allowed from (select count(*) as c from ({_flag_sql}) where severity = 'CRITICAL') where c > 0"))

# ---------------------------------------------------------------- issues

BLANK = ["email", "salary", "termination_date"]


def all_issues(spark, sf_dir):
    def build():
        return issues.issue_frame(people(spark, sf_dir), AS_OF, raw=raw_people(spark, sf_dir), blank_fields=BLANK)
    return samples.stored(spark, sf_dir, "issues", build)


_ISSUE_NAMES = {
    "active_zero_salary": "Missing or Invalid Salary", "invalid_date_logic": "Invalid Dates",
    "active_with_termination_date": "Active Employee with Termination Date",
    "missing_required_identity": "Missing Required Identity Fields", "salary_suspicious_default": "Suspicious Salary Default",
}
_NO_ISSUE = ("impossible_dates", "status_hire_date_mismatch", "missing_manager", "ghost_employee_indicator",
             "phone_invalid", "hire_date_suspicious_default", "status_suspicious_value")
_named = " ".join(f"when '{k}' then '{v}'" for k, v in _ISSUE_NAMES.items()) + " " + " ".join(
    f"when '{k}' then '{n}'" for k, (n, _) in checks.CATALOG.items() if k not in _ISSUE_NAMES)
ISSUE_SQL = (
    f"select k, case check_key {_named} end as issue_name, severity from ({_flag_sql}) where check_key not in "
    f"({', '.join(repr(x) for x in _NO_ISSUE)}) "
    "union all select k, 'Invalid Phone Number', 'HIGH' from facts where trim(phone) <> '' and (length(dg) < 7 or length(dg) > 15) "
    "union all select k, 'Pending Status', 'HIGH' from facts where st = 'pending' "
    "union all select src_ord, 'Duplicate Worker ID - Source Column Conflict', 'CRITICAL' from "
    f"({_conflict_sql('worker_id', 'worker_id', 'employee_id')}) where duplicate_classification = 'duplicate_conflicting_values' "
    "union all select k, 'Duplicate Worker ID', 'CRITICAL' from people where trim(worker_id) in (select trim(worker_id) from people "
    "where trim(worker_id) <> '' group by 1 having count(*) > 1) "
    "union all select k, 'Duplicate Email', 'MEDIUM' from people where lower(trim(email)) in (select lower(trim(email)) from people "
    "where trim(email) <> '' group by 1 having count(*) > 1) "
    f"union all select k, 'Duplicate Name - Different Worker ID', 'MEDIUM' from (select k, min(trim(worker_id)) over (partition by {_name}) as a, "
    f"max(trim(worker_id)) over (partition by {_name}) as b from people where trim(worker_id) <> '') where a <> b "
    f"union all select k, 'Multiple Active Benefit Plans', 'HIGH' from people where trim(worker_id) in (select w from ({_plan_sql}) group by 1 "
    "having count(distinct p) > 1) "
    "union all select k, 'Suspicious Round Salary', 'LOW' from facts f join (select sal, count(*) as c from facts where act and sal is not null "
    "group by 1 having count(*) > 3) using (sal) left join g on trim(f.department) = g.department where act and (sal::bigint in (1, 10, 100, 1000, "
    "10000, 12345, 99999, 999999) or ends_with(sal::bigint::varchar, '00000')) and (coalesce(med, 0) <= 0 or abs(sal - med) / med > 0.2) "
    + " ".join(f"union all select k, 'Missing Data - {f.replace('_', ' ').title()}', 'MEDIUM' from people where {_bl(f)}" for f in BLANK)
)
_MORE = _RAW + [("g", _dept)]
_add("issue_frame", lambda s, d: issues.issue_frame(people(s, d), AS_OF, raw=raw_people(s, d), blank_fields=BLANK).select(
        (F.col("row_number") - 2).alias("k"), "issue_name", "severity"),
     people_sql(ISSUE_SQL, _MORE))
_add("issue_match_rows", lambda s, d: issues.match_issues_to_rows(
        all_issues(s, d).withColumn("row_number", F.when(F.col("row_number") % 2 == 0, F.col("row_number"))), people(s, d)).select(
        (F.col("row_number") - 2).alias("k"), "issue_name"),
     people_sql(f"select k, issue_name from ({ISSUE_SQL}) where k % 2 = 0 or k in (select min(k) from people where trim(worker_id) <> '' "
                "group by trim(worker_id) having count(*) = 1)", _MORE))
_rank = "case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end"
_crit = lambda n: f"bool_or(issue_name = '{n}' and severity = 'CRITICAL')"
_meta_sql = (
    f"select k, min({_rank}) as r, count(distinct issue_name) - (case when {_crit('Implausible Hourly Pay Rate')} or "
    f"{_crit('Implausible Annual Salary')} then bool_or(issue_name = 'Missing or Invalid Salary')::int + "
    f"bool_or(issue_name = 'Compensation Type Mismatch')::int else 0 end) as n, "
    "bool_or(issue_name = 'Duplicate Name - Different Worker ID' or starts_with(issue_name, 'Missing Data -')) as medium "
    f"from ({ISSUE_SQL}) group by 1")
_word = "case r when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end"
_add("review_metadata", lambda s, d: issues.review_metadata(all_issues(s, d)).select(
        (F.col("row_number") - 2).alias("k"), "review_status", "issue_count", "highest_severity"),
     people_sql(f"select k, case when r = 0 then 'Fix Now' else 'Review Required' end as review_status, n::integer as issue_count, "
                f"{_word} as highest_severity from ({_meta_sql})", _MORE))
_add("clean_data", lambda s, d: issues.clean_data(people(s, d), issues.review_metadata(all_issues(s, d))).select(
        F.col("src_ord").alias("k"), "worker_id", "review_status", "issue_count", "highest_severity", "manual_review_required"),
     people_sql(f"select k, worker_id, case when r is null then 'Clean' when r = 0 then 'Fix Now' else 'Review Required' end as review_status, "
                f"coalesce(n, 0)::integer as issue_count, case when r is null then '' else {_word} end as highest_severity, "
                f"case when r is null then 'No' else 'Yes' end as manual_review_required from people left join ({_meta_sql}) using (k)", _MORE))
_add("review_required", lambda s, d: issues.review_required(
        issues.clean_data(people(s, d), issues.review_metadata(all_issues(s, d)))).select(F.col("src_ord").alias("k"), "highest_severity"),
     people_sql(f"select k, {_word} as highest_severity from ({_meta_sql}) where r < 2 or (r = 2 and medium)", _MORE))
for _kind in issues.TEMPLATES:
    _wanted = ", ".join(repr(x) for x in issues.TEMPLATES[_kind][0])
    _extra = (" and not (issue_name in ('Implausible Hourly Pay Rate', 'Implausible Annual Salary') and severity <> 'CRITICAL')"
              if _kind == "salary" else "")
    _add(f"correction_template_{_kind}",
         lambda s, d, k=_kind: issues.correction_template(all_issues(s, d), k).select((F.col("row_number") - 2).alias("k"), "worker_id"),
         people_sql(f"select distinct k, trim(worker_id) as worker_id from ({ISSUE_SQL}) join people using (k) "
                    f"where issue_name in ({_wanted}){_extra}", _MORE))
_add("correction_template_salary_lead",
     lambda s, d: issues.correction_template(all_issues(s, d), "salary").groupBy("issue_name").agg(F.count(F.lit(1)).alias("records")),
     people_sql("select case p when 0 then 'Invalid Hourly Pay Rate' when 1 then 'Invalid Annual Salary' when 2 then 'Missing or Invalid Salary' "
                "when 3 then 'Missing or Invalid Pay Type' else 'Compensation Type Mismatch' end as issue_name, count(*) as records from (select k, "
                "min(case issue_name when 'Implausible Hourly Pay Rate' then 0 when 'Implausible Annual Salary' then 1 when 'Missing or Invalid Salary' "
                "then 2 when 'Missing or Invalid Pay Type' then 3 else 4 end) as p "
                f"from ({ISSUE_SQL}) where issue_name in ({', '.join(repr(x) for x in issues.TEMPLATES['salary'][0])}) and not (issue_name in "
                "('Implausible Hourly Pay Rate', 'Implausible Annual Salary') and severity <> 'CRITICAL') group by 1) group by 1", _MORE))
_IN = {
    "duplicates": ("Duplicate Worker ID - Source Column Conflict", "Duplicate Worker ID", "Duplicate Email", "Duplicate Name - Different Worker ID"),
    "identity": ("Missing Required Identity Fields", "Invalid Phone Number"), "dates": ("Invalid Dates",),
    "status": ("Active Employee with Termination Date", "Pending Status"),
    "salary": ("Missing or Invalid Salary", "Missing or Invalid Pay Type", "Compensation Type Mismatch", "Salary and Pay Rate Conflict",
               "Missing Standard Hours for Hourly Worker", "Implausible Hourly Pay Rate", "Implausible Annual Salary",
               "Annualized Compensation Mismatch", "Payroll Context Mismatch", "Suspicious Salary Default", "Suspicious Round Salary"),
}
_elsewhere = ", ".join(repr(n) for names in _IN.values() for n in names)
for _category in issues.CATEGORIES:
    _test = f"issue_name in ({', '.join(repr(n) for n in _IN[_category])})" if _category in _IN else f"issue_name not in ({_elsewhere})"
    _add(f"issues_{_category}", lambda s, d, c=_category: issues.category_frame(all_issues(s, d), c).select(
            "row_number", "worker_id", "first_name", "issue_name", "severity", "record_pay_rate"),
         people_sql(f"select k + 2 as row_number, trim(worker_id) as worker_id, trim(first_name) as first_name, issue_name, severity, "
                    f"trim(payrate) as record_pay_rate from ({ISSUE_SQL}) join people using (k) where {_test}", _MORE))
_add("executive_summary", lambda s, d: issues.executive_summary(findings(s, d)).select("severity", "issue_name", "records_affected"),
     people_sql("select severity, check_name as issue_name, case when check_key in ('status_no_terminated', 'status_high_pending', 'age_uniformity', "
                f"'combined_field') then 'Dataset Level' else count::varchar end as records_affected from {_named_findings}", _FIND_STEPS))
_add("fix_list", lambda s, d: issues.fix_list(findings(s, d)).drop("what_to_do"),
     people_sql(f"select check_name as issue_name, severity, count as records_affected, {_sev_rank} as priority_rank, case when severity = 'CRITICAL' "
                f"then 'Yes' else 'No' end as blocking from {_named_findings}", _FIND_STEPS))
_add("findings_index", lambda s, d: issues.findings_index(findings(s, d), all_issues(s, d)).drop("description"),
     people_sql(f"select check_name as issue_name, severity, count as records_affected, coalesce(n, 0) as detail_rows from {_named_findings} left join "
                f"(select issue_name as check_name, count(*) as n from ({ISSUE_SQL}) group by 1) using (check_name)", _FIND_STEPS))
_add("quality_score", lambda s, d: issues.quality_score(
    findings(s, d), checks.overall_completeness(checks.completeness(people(s, d), 0.20)),
    checks.evaluate_gate(findings(s, d)), people(s, d).agg(F.count(F.lit(1))).scalar()),
    people_sql("select 'Total Records' as metric, count(*)::varchar as value from people union all select 'Completeness %', "
               f"round((sum(total) - sum(blank_count)) / sum(total) * 100, 1)::varchar from ({_complete_sql}) union all "
               "select 'Gate Status', 'BLOCKED' union all " + " union all ".join(
                   f"select '{x.title()} Issues', count(*) filter (severity = '{x}')::varchar from found" for x in checks.SEVERITIES), _FIND_STEPS))
_add("issue_detail", lambda s, d: issues.issue_detail(all_issues(s, d)).select("issue_name", "severity", "row_number"),
     people_sql(f"select issue_name, severity, k + 2 as row_number from ({ISSUE_SQL})", _MORE))
