"""Registered queries of the pair audits, sanity checks and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pair_audits as pa
from ..operators import sanity, summaries
from ..operators import outputs as out
from ..operators.waves import wave_dates
from . import samples
from .gating import FIXES, MANIFEST_SQL, ZERO, _gated_steps, gated, gated_sql, low, num
from .samples import pairs, pairs_sql, snap_new, snap_old

QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_os, _ns = num("old_salary"), num("new_salary")
_moved = "(old_salary <> '' and new_salary <> '' and old_salary <> new_salary)"
_share = f"abs(({_ns} - {_os}) / nullif({_os}, 0))"
_extreme = f"(old_salary <> '' and new_salary <> '' and {_share} >= 0.5)"
_ratio = f"({_ns} / nullif({_os}, 0))"
_lead = "pair_id, match_source, old_worker_id, new_worker_id, old_full_name_norm"


def _two(fields):
    return ", ".join(f"old_{f}, new_{f}" for f in fields)


_add("duplicate_ids", lambda s, d: pa.preflight(
        snap_old(s, d).withColumn("worker_id", F.col("last4_ssn")),
        snap_new(s, d).withColumn("worker_id", F.col("last4_ssn")), pairs(s, d)),
     pairs_sql(" union all ".join([
         "select 'mapped_old' as side, last4_ssn as id, count(*) as c from snap_old group by 2 having count(*) > 1",
         "select 'mapped_new', last4_ssn, count(*) from snap_new where trim(last4_ssn) <> '' group by 2 having count(*) > 1",
         "select 'pairs_old', old_worker_id, count(*) from pairs group by 2 having count(*) > 1",
         "select 'pairs_new', new_worker_id, count(*) from pairs group by 2 having count(*) > 1"])))

_add("match_source_summary", lambda s, d: pa.match_source_summary(pairs(s, d)),
     pairs_sql("select coalesce(nullif(trim(match_source), ''), 'unknown') as match_source, "
               "count(*) as pair_count from pairs group by 1"))

for _group, _fields in pa.PAIR_GROUPS.items():
    _both = " or ".join(f"(old_{f} <> '' and new_{f} <> '' and old_{f} <> new_{f})" for f in _fields)
    _blank = " or ".join(f"coalesce(trim(old_{f}), '') <> coalesce(trim(new_{f}), '')" for f in _fields)
    _add(f"mismatch_{_group}", lambda s, d, g=_group: pa.mismatches(pairs(s, d), g),
         pairs_sql(f"select {_lead}, {_two(_fields)} from pairs where {_both}"))
    _add(f"mismatch_{_group}_listing", lambda s, d, g=_group: pa.mismatches(pairs(s, d), g),
         pairs_sql(f"select {_lead}, {_two(_fields)} from pairs where {_both}"))
    _add(f"mismatch_{_group}_blanks", lambda s, d, g=_group: pa.mismatches(pairs(s, d), g, "blank_counts"),
         pairs_sql(f"select {_lead}, {_two(_fields)} from pairs where {_blank}"))
_add("mismatch_pay_numeric", lambda s, d: pa.mismatches(pairs(s, d), "pay", "numeric"),
     pairs_sql(f"select {_lead}, {_two(('salary', 'payrate'))} from pairs where {_os} <> {_ns} "
               f"or {num('old_payrate')} <> {num('new_payrate')}"))

_add("hire_date_mismatch_by_prefix", lambda s, d: pa.hire_date_mismatch_by_prefix(pairs(s, d)),
     pairs_sql("select substr(old_worker_id, 1, 5) as old_id_prefix, count(*) as mismatch_count from pairs "
               "where old_hire_date <> '' and new_hire_date <> '' and old_hire_date <> new_hire_date group by 1"))

_variance = (f"select pair_id, old_worker_id, new_worker_id, old_full_name_norm, {_os} as old_salary_num, "
             f"{_ns} as new_salary_num, {_ns} - {_os} as salary_delta, case when {_share} > 0.1 then 'high' "
             f"when {_share} > 0.03 then 'medium' else 'low' end as severity_band from pairs where {_moved}")
_add("salary_variance", lambda s, d: pa.salary_variance(pairs(s, d)), pairs_sql(_variance))
_add("salary_variance_listing", lambda s, d: pa.salary_variance(pairs(s, d)),
     pairs_sql(_variance))

_add("salary_delta_distribution", lambda s, d: pa.salary_delta_distribution(pairs(s, d)),
     pairs_sql(f"select case when {_share} >= 0.5 then '>=50%' when {_share} >= 0.25 then '25-49%' "
               f"when {_share} >= 0.1 then '10-24%' when {_share} >= 0.03 then '3-9%' else '<3%' end as delta_band, "
               f"count(*) as cnt from pairs where {_moved} group by 1"))
_add("salary_ratio_clusters", lambda s, d: pa.salary_ratio_clusters(pairs(s, d)),
     pairs_sql(f"select round({_ratio}, 2) as ratio_rounded, count(*) as cnt from pairs where {_moved} group by 1 "
               "having count(*) > 50"))

_extreme_sql = (f"select pair_id, old_worker_id, new_worker_id, old_full_name_norm, old_salary, new_salary, "
                f"round({_ratio}, 3) as ratio, {_two(('worker_status', 'worker_type'))} from pairs where {_extreme}")
_add("extreme_salary_shifts", lambda s, d: pa.extreme_shifts(pairs(s, d)), pairs_sql(_extreme_sql))
_add("extreme_salary_shifts_listing", lambda s, d: pa.extreme_shifts(pairs(s, d)),
     pairs_sql(_extreme_sql))
_add("extreme_ratio_bins", lambda s, d: pa.extreme_ratio_bins(pairs(s, d)),
     pairs_sql(f"select round({_ratio}, 2) as ratio_bin, count(*) as cnt from pairs where {_extreme} group by 1"))
_add("roles_with_extremes", lambda s, d: pa.roles_with_extremes(pairs(s, d)),
     pairs_sql(f"select old_position, new_position, count(*) as cnt, round(avg({_ratio}), 3) as avg_ratio from pairs "
               f"where {_extreme} group by 1, 2"))
_aligned = lambda s: (
    f"old_{s} <> ''" if False else f"{s}_payrate <> '' and abs({num(s + '_salary')} - {num(s + '_payrate')} * 2080) "
    f"/ nullif({num(s + '_salary')}, 0) < 0.05")
_add("payrate_alignment", lambda s, d: pa.payrate_alignment(pairs(s, d)),
     pairs_sql(f"select count(*) as total_extreme, count(*) filter ({_aligned('old')}) as old_matches_hourly_2080, "
               f"count(*) filter ({_aligned('new')}) as new_matches_hourly_2080 from pairs where {_extreme}"))
_same = f"{_extreme} and old_position = new_position"
_add("same_role_extremes", lambda s, d: pa.same_role_extremes(pairs(s, d)),
     pairs_sql(f"select pair_id, old_worker_id, new_worker_id, old_full_name_norm, {_two(('position', 'salary'))}, "
               f"round({_ratio}, 3) as ratio from pairs where {_same}"))
_add("same_role_ratio", lambda s, d: pa.same_role_ratio(pairs(s, d)),
     pairs_sql(f"select old_position, count(*) as cnt, round(avg({_ratio}), 3) as avg_ratio from pairs "
               f"where {_same} group by 1"))

for _pack, _field in pa.PACKS.items():
    _keep = _extreme if _pack == "salary_extreme" else (
        f"old_{_field} <> '' and new_{_field} <> '' and old_{_field} <> new_{_field}")
    _money = _field == "salary"
    _delta = f"round({_ns} - {_os}, 2)" if _money else "null::double"
    _pct = f"round(({_ns} - {_os}) / nullif({_os}, 0) * 100, 2)" if _money else "null::double"
    _add(f"mismatch_pack_{_pack}", lambda s, d, p=_pack: pa.mismatch_pack(pairs(s, d), p),
         pairs_sql("select old_worker_id, new_worker_id, old_full_name_norm as full_name_old, new_full_name_norm as "
                   "full_name_new, match_source, case match_source when 'worker_id' then 'Tier 1 - Worker ID' "
                   "when 'last4_dob' then 'Tier 2 - Last4+DOB' else 'Unknown' end as match_tier, "
                   f"'{_field}' as field_name, old_{_field} as old_value, new_{_field} as new_value, "
                   f"{_delta} as delta_amount, {_pct} as delta_pct from pairs where {_keep}"))

_waves_step = _gated_steps(True)[0]
_add("wave_dates", lambda s, d: wave_dates(pairs(s, d)), pairs_sql("select * from waves", [_waves_step]))

_hire_moved = "coalesce(trim(old_hire_date), '') <> coalesce(trim(new_hire_date), '')"
_band = lambda r: (
    f"case when {r} >= 0.4 then 'critical' when {r} >= 0.25 then 'high' when {r} >= 0.1 then 'medium' else 'low' end")
_prefix_sql = (
    f"select *, hire_date_mismatch_count / matched_pairs_total as mismatch_rate, "
    f"{_band('hire_date_mismatch_count / matched_pairs_total')} as severity_band from (select "
    "substr(lower(trim(old_worker_id)), 1, 5) as old_id_prefix, count(*) as matched_pairs_total, "
    f"count(*) filter ({_hire_moved}) as hire_date_mismatch_count from pairs group by 1)")
_add("wave_summary", lambda s, d: pa.wave_summary(pairs(s, d)), pairs_sql(_prefix_sql))
_top_dates = (f"select new_hire_date, count(*) as cnt from pairs where {_hire_moved} group by 1")
_add("wave_top_dates", lambda s, d: pa.top_new_dates(pairs(s, d), 25),
     pairs_sql(_top_dates + " order by cnt desc, new_hire_date limit 25"))
_add("wave_rows", lambda s, d: pa.wave_rows(pairs(s, d)),
     pairs_sql(f"select p.*, w.matched_pairs_total, w.hire_date_mismatch_count, w.mismatch_rate, w.severity_band, "
               f"case when new_hire_date in (select new_hire_date from ({_top_dates} order by cnt desc, new_hire_date "
               f"limit 25)) then 'yes' else 'no' end as wave_candidate from (select {_lead}, old_hire_date, new_hire_date, "
               f"substr(lower(trim(old_worker_id)), 1, 5) as old_id_prefix from pairs where {_hire_moved}) p "
               f"join ({_prefix_sql}) w using (old_id_prefix)"))

_pct_sql = f"(case when {_os} = 0 then case when {_ns} > 0 then 'infinity'::double end else ({_ns} - {_os}) / {_os} end)"
_anom = (f"case when p is null then 'invalid' when p < 0 then 'negative' when p = 0 then 'no_change' "
         "when p >= 1 then 'over_100_percent' when p >= 0.5 then 'over_50_percent' when p >= 0.25 then 'over_25_percent' "
         "when p >= 0.15 then 'over_15_percent' else 'normal' end")
_anom_sql = (f"select *, {_anom} as anomaly_band from (select *, {_ns} - {_os} as salary_change, {_pct_sql} as p "
             f"from pairs where {_os} is not null and {_ns} is not null)")
_add("salary_anomalies", lambda s, d: pa.salary_anomalies(pairs(s, d)),
     pairs_sql(f"select {_lead}, old_salary, new_salary, salary_change, p as salary_change_pct, anomaly_band "
               f"from ({_anom_sql}) where anomaly_band <> 'normal'"))
_add("salary_anomaly_summary", lambda s, d: pa.salary_anomaly_summary(pairs(s, d)),
     pairs_sql(f"select anomaly_band, count(*) as count, count(*) / sum(count(*)) over () as percent_of_total "
               f"from ({_anom_sql}) group by 1"))
for _column in ("old_district", "old_position"):
    _add(f"salary_anomalies_by_{_column[4:]}", lambda s, d, c=_column: pa.salary_anomalies_by(pairs(s, d), c),
         pairs_sql(f"select {_column}, count(*) as anomaly_count from ({_anom_sql}) "
                   "where anomaly_band <> 'normal' group by 1"))


def _details(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return pa.system_details(
        {"q1": pa.match_source_summary(rows), "q5": pa.mismatches(rows, "hire_date")}, pa.DETAIL_TOPICS)


_add("system_details", _details, pairs_sql(
    "select 'Match Source Summary' as audit_topic, 'q1' as source_file, match_source, count(*)::varchar as pair_count "
    "from pairs group by match_source union all by name select 'Hire Date Issues' as audit_topic, 'q5' as source_file, "
    f"{_lead}, old_hire_date, new_hire_date from pairs where old_hire_date <> '' and new_hire_date <> '' "
    "and old_hire_date <> new_hire_date"))

# ---------------------------------------------------------------- sanity

_salary_band = ("case when a < 100 then '0-100' when a < 1000 then '100-1,000' when a < 5000 then '1,000-5,000' "
                "when a < 20000 then '5,000-20,000' else '20,000+' end")
_add("salary_delta_buckets", lambda s, d: sanity.salary_delta_buckets(pairs(s, d)),
     pairs_sql("select b.label as bucket_label, count(a) as count, count(*) filter (dd > 0) as increase_count, "
               "count(*) filter (dd < 0) as decrease_count, coalesce(round(avg(a), 2), 0.0) as avg_abs_delta, "
               "coalesce(round(quantile_cont(a, 0.5), 2), 0.0) as p50_abs_delta, "
               "coalesce(round(quantile_cont(a, 0.9), 2), 0.0) as p90_abs_delta "
               "from (select unnest(['0-100', '100-1,000', '1,000-5,000', '5,000-20,000', '20,000+']) as label) b "
               f"left join (select dd, abs(dd) as a, {_salary_band.replace('a <', 'abs(dd) <')} as label from "
               f"(select {_ns} - {_os} as dd from pairs) where dd <> 0) using (label) group by 1"))
_gap = ("abs(try_cast(nullif(trim(new_hire_date), '') as date) - try_cast(nullif(trim(old_hire_date), '') as date))")
_day_band = ("case when g <= 7 then '1-7' when g <= 30 then '8-30' when g <= 180 then '31-180' when g <= 365 then '181-365' "
             "when g <= 1095 then '366-1095 (1-3yr)' else '1096+ (3yr+)' end")
_add("hire_date_buckets", lambda s, d: sanity.hire_date_buckets(pairs(s, d)),
     pairs_sql("select label as days_diff_bucket, count(pair_id) as count, "
               "coalesce(string_agg(pair_id, '|' order by pair_id) filter (rn <= 3), '') as examples "
               "from (select unnest(['1-7', '8-30', '31-180', '181-365', '366-1095 (1-3yr)', '1096+ (3yr+)']) as label) "
               "left join (select pair_id, label, row_number() over (partition by label order by pair_id) as rn from "
               f"(select pair_id, {_day_band} as label from (select pair_id, {_gap} as g from pairs) where g > 0)) "
               "using (label) group by 1"))

_susp_cols = ("pair_id, match_source, old_worker_id, new_worker_id, old_full_name_norm, old_hire_date, new_hire_date, "
              "old_salary, new_salary")
_susp_sql = (
    f"select 'salary_suspicious_default' as issue_type, {_susp_cols}, 'old_salary=' || {_os}::bigint || "
    f"' is a known placeholder value' as notes from pairs where {_os} in (40000, 40003, 40013, 40073) "
    f"union all select case when starts_with(old_hire_date, '2026-02-') then 'hire_date_default_2026-02' else "
    f"'hire_date_default_2026-03' end, {_susp_cols}, 'old_hire_date=' || old_hire_date || "
    "' matches extraction-default prefix ''' || substr(old_hire_date, 1, 8) || '''' from pairs "
    "where starts_with(old_hire_date, '2026-02-') or starts_with(old_hire_date, '2026-03-') "
    f"union all select 'hire_date_wave', {_susp_cols.replace('new_hire_date', 'p.new_hire_date')}, 'new_hire_date=' || p.new_hire_date || ' shared by ' "
    "|| wave_count || '/' || format(chr(123) || chr(58) || chr(44) || chr(125), total_pairs) || ' pairs (' || "
    "format('{:.2f}', wave_count / total_pairs * 100) || '%) - possible import wave' "
    "from pairs p join waves w on trim(p.new_hire_date) = w.new_hire_date"
)
_add("suspicious_defaults", lambda s, d: sanity.suspicious_defaults(pairs(s, d)), pairs_sql(_susp_sql, [_waves_step]))
_add("suspicious_rates", lambda s, d: sanity.suspicious_rates(pairs(s, d)),
     pairs_sql(f"select replace(issue_type, '-', '_') as issue_key, count(*) as count, "
               f"round(count(*) / (select count(*) from pairs), 6) as rate from ({_susp_sql}) group by 1", [_waves_step]))
_add("suspicion_overview", lambda s, d: sanity.suspicion_overview(pairs(s, d)).withColumn(
        "examples", F.array_join("examples", "|")),
     pairs_sql(f"select issue_type, count(*) as rows, string_agg(pair_id, '|' order by pair_id) filter (rn <= 3) as examples "
               f"from (select *, row_number() over (partition by issue_type order by pair_id) as rn from ({_susp_sql})) "
               "group by 1", [_waves_step]))
_zero_pairs = f"({low('new_worker_status')} in ('active', '') and coalesce({_ns} = 0, true))"
_add("mismatch_counts", lambda s, d: sanity.mismatch_counts(pairs(s, d)),
     pairs_sql(f"select count(*) as total_pairs, count(*) filter ({_os} <> {_ns}) as salary, "
               f"count(*) filter ({_gap} > 0) as hire_date, count(*) filter ({low('old_worker_status')} <> '' and "
               f"{low('new_worker_status')} <> '' and {low('old_worker_status')} <> {low('new_worker_status')}) as status, "
               "count(*) filter (match_source in ('worker_id', 'pk', 'recon_id')) as det_count, "
               "round(count(*) filter (match_source in ('worker_id', 'pk', 'recon_id')) / count(*), 6) as det_rate, "
               f"count(*) filter ({_zero_pairs}) as active_zero_salary from pairs"))
_add("approval_metrics", lambda s, d: sanity.approval_metrics(gated(s, d)),
     gated_sql("select count(*) as total, count(*) filter (action = 'APPROVE') as approve_count, "
               "round(count(*) filter (action = 'APPROVE') / count(*), 6) as approve_rate, "
               f"count(*) filter (action = 'APPROVE' and {ZERO}) as active_zero_approved from gated"))


def _gate_result(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    verdict = sanity.evaluate_sanity_gate(sanity.collect_metrics(rows, gated(spark, sf_dir)))
    return sanity.verdict_table(spark, verdict)


_add("sanity_gate", _gate_result, gated_sql(
    f"select r is null as passed, coalesce(r, '') as reason from (select unnest(list_filter([ "
    "case when hd > 0.02 then format('hire_date_default_2026_02 rate {:.6f} > 0.02', hd) end, "
    "case when hdn > 500 then 'hire_date_default_2026_02 count' end, "
    "case when sd > 0.02 then format('salary_suspicious_default rate {:.6f} > 0.02', sd) end, "
    "case when sdn > 500 then 'salary_suspicious_default count' end, "
    "case when det < 0.95 then format('det_rate {:.4f} < min 0.95 (too few deterministic matches)', det) end, "
    "case when apr < 0.75 then format('approve_rate {:.4f} < min 0.75 (too many records need review)', apr) end, "
    "case when az > 0 then format('active_zero_approved {} > max 0 (active/$0 workers with corrections staged (APPROVE action))', az) end], "
    "lambda x: x is not null)) as r from (select "
    "round(count(*) filter (starts_with(old_hire_date, '2026-02-')) / count(*), 6) as hd, "
    "count(*) filter (starts_with(old_hire_date, '2026-02-')) as hdn, "
    "round(count(*) filter (os in (40000, 40003, 40013, 40073)) / count(*), 6) as sd, "
    "count(*) filter (os in (40000, 40003, 40013, 40073)) as sdn, "
    "round(count(*) filter (match_source in ('worker_id', 'pk', 'recon_id')) / count(*), 6) as det, "
    "round(count(*) filter (action = 'APPROVE') / count(*), 6) as apr, "
    f"count(*) filter (action = 'APPROVE' and {ZERO}) as az from gated))"))

_month_rows = ("select m as pattern, p.* from pairs p, (select unnest(['2026-02', '2026-03']) as m) "
               "where trim(old_hire_date) <> trim(new_hire_date) and (starts_with(old_hire_date, m) or starts_with(new_hire_date, m))")
_add("default_date_causes", lambda s, d: sanity.default_date_causes(pairs(s, d)),
     pairs_sql("select m as pattern, coalesce(n, 0)::bigint as total_rows, "
               "round(coalesce(n, 0) / (select count(*) from pairs) * 100, 4) as pct_of_all_pairs, "
               "'{' || coalesce(e, '') || '}' as match_source_breakdown_json "
               "from (select unnest(['2026-02', '2026-03']) as m) left join (select pattern as m, sum(c) as n, "
               "string_agg('\"' || match_source || '\": ' || c, ', ' order by c desc, match_source) as e from "
               f"(select pattern, match_source, count(*) as c from ({_month_rows}) group by 1, 2) group by 1) using (m)"))
_add("default_date_samples", lambda s, d: sanity.default_date_samples(pairs(s, d)),
     pairs_sql(f"select pattern, pair_id, old_worker_id, new_worker_id, old_hire_date, new_hire_date, match_source "
               f"from (select *, row_number() over (partition by pattern order by pair_id) as rn from ({_month_rows})) "
               "where rn <= 20"))

# ---------------------------------------------------------------- report aggregates

_pct = lambda a, b: f"coalesce(round({a} / nullif({b}, 0) * 100, 1), 0.0)"
_add("source_shares", lambda s, d: summaries.source_shares(pairs(s, d)),
     pairs_sql(f"select match_source, count(*) as count, {_pct('count(*)', '(select count(*) from pairs)')} as pct "
               "from pairs group by 1"))
_add("salary_change_stats", lambda s, d: summaries.salary_change_stats(pairs(s, d)),
     pairs_sql("select count(dd) as both_valid, count(m) as mismatches, count(*) filter (m > 0) as increases, "
               "count(*) filter (m < 0) as decreases, min(m) as min_delta, round(quantile_cont(m, 0.1), 2) as p10_delta, "
               "round(quantile_cont(m, 0.5), 2) as median_delta, round(avg(m), 2) as avg_delta, "
               "round(quantile_cont(m, 0.9), 2) as p90_delta, max(m) as max_delta from (select dd, nullif(dd, 0) as m "
               f"from (select {_ns} - {_os} as dd from pairs))"))
_add("gate_by_fix_type", lambda s, d: summaries.gate_by_fix_type(gated(s, d)),
     gated_sql("select fix_type, count(*) as total, count(*) filter (a = 'APPROVE') as approve, "
               f"count(*) filter (a = 'REVIEW') as review, {_pct(chr(99) + 'ount(*) filter (a = ' + chr(39) + 'APPROVE' + chr(39) + ')', 'count(*)')} as approve_pct from ("
               + " union all ".join(f"select '{f}' as fix_type, a_{f} as a from gated where f_{f}" for f in FIXES)
               + ") group by 1"))
_approved = "count(*) filter (action = 'APPROVE')"
_add("gate_by_source", lambda s, d: summaries.gate_by_source(gated(s, d)),
     gated_sql(f"select match_source, count(*) as total, {_approved} as approve, count(*) filter (action = 'REVIEW') as review, "
               f"count(*) filter (action = 'REJECT_MATCH') as reject_match, {_pct(_approved, 'count(*)')} as approve_pct "
               "from gated where n_fix > 0 group by 1"))
_add("confidence_bands", lambda s, d: summaries.confidence_bands(pairs(s, d)),
     pairs_sql("select case when confidence is null then 'missing' when confidence = 1 then 'exact' when confidence >= 0.97 "
               "then 'high' when confidence >= 0.8 then 'medium' else 'low' end as band, count(*) as pairs from pairs group by 1"))
_zero_active = f"({low('new_worker_status')} = 'active' and coalesce(ns = 0, true))"
_add("salary_report", lambda s, d: summaries.salary_report(gated(s, d)),
     gated_sql(f"select count(*) as total, count(*) filter (z) as n_excluded_active_zero, count(*) filter (not z) as n_included, "
               "count(*) filter (v > 0) as n_increase, count(*) filter (v < 0) as n_decrease, round(avg(v), 2) as mean_delta, "
               "round(median(v), 2) as median_delta, max(v) as max_increase, min(v) as max_decrease from "
               f"(select {_zero_active} as z, case when not {_zero_active} then salary_delta end as v from gated where f_salary)"))
_add("status_transitions", lambda s, d: summaries.status_transitions(gated(s, d)),
     gated_sql("select lower(trim(old_worker_status)) || ' → ' || lower(trim(new_worker_status)) as transition, count(*) as count "
               "from gated where f_status group by 1 order by count desc, transition limit 10"))
_add("hire_date_patterns", lambda s, d: summaries.hire_date_patterns(gated(s, d)),
     gated_sql("select r_hire_date as pattern, count(*) as count from gated where f_hire_date group by 1 "
               "order by count desc, pattern limit 8"))
_add("top_wave_dates", lambda s, d: summaries.top_wave_dates(gated(s, d)),
     gated_sql("select new_hire_date, count(*) as count from gated where contains(reason, 'hire_date_wave') group by 1 "
               "order by count desc, new_hire_date limit 10"))
_add("reject_reasons", lambda s, d: summaries.reject_reasons(gated(s, d)),
     gated_sql("select reason, count(*) as count from gated where action = 'REJECT_MATCH' group by 1 "
               "order by count desc, reason limit 5"))
_add("top_review_items", lambda s, d: summaries.top_review_items(gated(s, d)),
     gated_sql("select pair_id, old_full_name_norm, reason, fix_types, priority_score from gated where action = 'REVIEW' "
               "order by priority_score desc, pair_id limit 20"))
_add("review_by_fix_type", lambda s, d: summaries.review_by_fix_type(gated(s, d)),
     gated_sql("select fix_type, count(*) as count from ("
               + " union all ".join(f"select '{f}' as fix_type from gated where f_{f} and action = 'REVIEW'" for f in FIXES)
               + ") group by 1"))
_add("run_overview", lambda s, d: summaries.run_overview(gated(s, d)),
     gated_sql("select *, case when n_active_zero > 0 or n_wrong > 0 then 'BLOCKED' when safe_pct >= 80 then 'PASS' "
               "else 'WARNING' end as gate_status, greatest(0, least(100, round_even(safe_pct - least(n_wrong * 10.0 + "
               "least(n_active_zero * 0.1, 15.0) + case when safe_pct < 80 then 2.0 else 0.0 end, 45.0), 0)))::integer "
               f"as readiness_score from (select *, {_pct('n_safe', 'total_matched')} as safe_pct from (select "
               "count(*) as total_matched, count(*) filter (action = 'APPROVE') as n_safe, count(*) filter (action = 'REVIEW') as n_review, "
               "count(*) filter (action = 'REJECT_MATCH') as n_wrong, "
               + ", ".join(f"count(*) filter (f_{f}) as n_{f}" for f in ("salary", "status", "hire_date", "job_org"))
               + f", count(*) filter (confidence < 1) as n_fuzzy, count(*) filter ({_zero_active}) as n_active_zero, "
               + ", ".join(
                   f"count(*) filter (action = 'REVIEW' and {t}) as prio_{n}" for n, t in (
                       ("critical", "priority_score >= 70"), ("high", "priority_score between 40 and 69"),
                       ("medium", "priority_score between 20 and 39"), ("low", "priority_score < 20")))
               + " from gated))"))
_add("conversion_counts", lambda s, d: summaries.conversion_counts(gated(s, d)),
     gated_sql("select conversion_type, count(*) as count from gated where conversion_type is not null group by 1"))
_add("risk_rows", lambda s, d: summaries.risk_rows(gated(s, d)),
     gated_sql("select * from ("
               f"select 'Active employees with $0 salary' as risk, 'Investigate before load' as next_step, count(*) filter ({ZERO}) as count from gated "
               "union all select 'Records requiring human review', 'Complete review queue first', count(*) filter (action = 'REVIEW') from gated "
               "union all select 'Possible wrong-person matches', 'Manual investigation required', count(*) filter (action = 'REJECT_MATCH') from gated "
               "union all select 'Hire date wave detected', 'Verify bulk import date is correct', count(*) filter (contains(reason, 'hire_date_wave')) from gated "
               "union all select 'Salary changes > 15% variance', 'Spot check recommended', count(*) filter (contains(reason, 'salary_ratio_extreme')) from gated) where count > 0"))
_add("correction_counts", lambda s, d: summaries.correction_counts(out.corrections_manifest(gated(s, d))),
     gated_sql(f"select correction_type, count(*) as count from ({MANIFEST_SQL}) group by 1"))
_quality = lambda s: (
    f"select '{s}' as field_side, count(*) filter (trim({s}_salary) <> '' and (contains({s}_salary, '$') or "
    f"contains({s}_salary, ',') or try_cast(trim({s}_salary) as double) is null)) as bad_char_count, "
    f"count(*) filter (trim({s}_salary) = '') as blank_count, count(*) as total_rows_checked from pairs")
_add("salary_quality", lambda s, d: summaries.salary_quality(pairs(s, d)),
     pairs_sql(f"{_quality('old')} union all {_quality('new')}"))
_both_moved = lambda f: f"(old_{f} <> '' and new_{f} <> '' and old_{f} <> new_{f})"
_add("run_summary", lambda s, d: summaries.run_summary(pairs(s, d)),
     pairs_sql(f"select count(*) as total_matched, count(*) filter ({_moved}) as salary_mismatch, "
               f"count(*) filter ({_extreme}) as extreme_salary, count(*) filter ({_both_moved('hire_date')}) as hire_date_mismatch, "
               f"count(*) filter ({_both_moved('worker_status')}) as status_mismatch from pairs"))
_add("department_summary", lambda s, d: summaries.department_summary(out.review_queue(gated(s, d), ordered=False)),
     gated_sql("select coalesce(nullif(trim(old_district), ''), nullif(trim(new_district), ''), 'unknown') as department, "
               "count(*) as count, max(priority_score) as max_priority from gated where action = 'REVIEW' group by 1"))


def _bins(value: str, test: str) -> str:
    return (f"select bin, count(*) as count, min(v) as min_value, max(v) as max_value from (select v, least(floor((v - lo) / "
            f"((hi - lo) / 50)), 49)::integer as bin from (select v, min(v) over () as lo, max(v) over () as hi from "
            f"(select {value} as v from pairs) where {test})) group by 1")


_add("salary_delta_histogram", lambda s, d: summaries.salary_delta_histogram(pairs(s, d)),
     pairs_sql(_bins(f"{_ns} - {_os}", "v <> 0")))
_add("salary_ratio_histogram", lambda s, d: summaries.salary_ratio_histogram(pairs(s, d)),
     pairs_sql(_bins(f"case when {_ns} <> {_os} then {_ratio} end", "v > 0 and v < 5")))
_add("run_findings", lambda s, d: summaries.run_findings(gated(s, d)),
     gated_sql("select * from ("
               f"select 'CRITICAL' as severity, 'Active Employees with $0 Salary' as title, 'Salary corrections blocked; source data correction required' as impact, count(*) filter ({_zero_active}) as count from gated "
               "union all select 'HIGH', 'Wrong-Person Pairings (REJECT_MATCH)', 'Excluded from all corrections; require manual investigation', count(*) filter (action = 'REJECT_MATCH') from gated "
               "union all select 'HIGH', 'Pairs Requiring Human Review', 'Corrections held until reviewer approves', count(*) filter (action = 'REVIEW') from gated "
               "union all select 'HIGH', 'Low-Confidence Fuzzy Matches (< 0.70)', 'High risk of wrong-person corrections; verify before applying', count(*) filter (confidence < 0.7) from gated) where count > 0"))
_add("change_field_summary", lambda s, d: summaries.change_summary(gated(s, d)),
     gated_sql(" union all ".join(
         f"select '{summaries.FIELD_LABELS[f]}' as field, count(*) filter (f_{f}) as count, "
         f"{_pct(f'count(*) filter (f_{f})', 'count(*)')} as pct from gated" for f in FIXES)))
_add("recommendations", lambda s, d: summaries.recommendations(gated(s, d)).select("position", "count"),
     gated_sql("select * from ("
               f"select 1 as position, count(*) filter ({_zero_active}) as count from gated "
               "union all select 2, count(*) filter (action = 'REJECT_MATCH') from gated "
               "union all select 3, count(*) filter (action = 'REVIEW') from gated "
               "union all select 4, (count(*) filter (action = 'APPROVE') / count(*) < 0.8)::bigint from gated) where count > 0"))
_listed = [(g, f) for g, fs in summaries.PAIR_GROUPS.items() for f in fs if g != "Optional Fields"]
_add("pair_completeness", lambda s, d: summaries.pair_completeness(pairs(s, d)),
     pairs_sql('select *, n_total - n_blank as n_complete, case when n_blank = 0 then \'Complete\' when n_blank / n_total * 100 <= 5 '
               "then 'Acceptable' else 'Critical Gap' end as status from ("
               + " union all ".join(
                   f"select '{g}' as \"group\", '{f}' as field, count(*) as n_total, "
                   f"count(*) filter (coalesce(trim({f}::varchar), '') = '') as n_blank from pairs" for g, f in _listed) + ")"))
_topics = [("salary", "f_salary"), ("status", "f_status"), ("wrong_match", "action = 'REJECT_MATCH'"), ("active_zero", _zero_active)]
_add("topic_samples", lambda s, d: summaries.topic_samples(gated(s, d)),
     gated_sql("select topic, pair_id, old_worker_id, old_full_name_norm, old_salary, new_salary, old_worker_status, "
               "new_worker_status, reason, salary_delta from (select *, row_number() over (partition by topic order by "
               "case when topic = 'salary' then abs(salary_delta) end desc nulls last, pair_id) as rn from ("
               + " union all ".join(f"select '{t}' as topic, * from gated where {c}" for t, c in _topics)
               + ")) where rn <= 8"))
_prio = [("match_source <> 'worker_id'", 50, "non_worker_id_match"), ("trim(old_worker_status) <> trim(new_worker_status)", 40, "status_mismatch"),
         ("abs(sd) >= 5000", 30, "salary_delta_ge5000"), ("abs(sd) >= 1000 and abs(sd) < 5000", 20, "salary_delta_1000_4999"),
         ("trim(old_hire_date) <> trim(new_hire_date)", 15, "hire_date_mismatch"), ("old_position <> new_position", 10, "position_mismatch"),
         ("old_district <> new_district", 10, "district_mismatch"), ("old_location_state <> new_location_state", 10, "location_state_mismatch")]
_add("report_priority", lambda s, d: summaries.report_priority(pairs(s, d)),
     pairs_sql(f"select pair_id, match_source, old_worker_id, new_worker_id, {_two(('full_name_norm', 'salary', 'worker_status', 'hire_date', 'position', 'district', 'location_state'))}, "
               "nullif(sd, 0) as salary_delta, coalesce(nullif(concat_ws('|', "
               + ", ".join(f"case when {t} then '{r}' end" for t, _, r in _prio) + "), ''), 'none') as priority_reason, ("
               + " + ".join(f"case when {t} then {p} else 0 end" for t, p, _ in _prio)
               + f")::integer as priority_score from (select *, {_ns} - {_os} as sd from pairs)"))


def _warn(side: str, extra: str) -> str:
    t = f"snap_{side}"
    dup = lambda e, w: f"(select count(*) - count(distinct {e}) from {t} {w})"
    rows = [("missing_dob", f"count(*) filter (trim(dob) = '')"), ("duplicate_name_dob", f"any_value({dup(chr(40) + 'full_name_norm || dob' + chr(41), '')})"),
            ("missing_location_state", "count(*) filter (trim(location_state) = '')")]
    if extra:
        rows += [("missing_worker_id", "count(*) filter (trim(worker_id) = '')"),
                 ("duplicate_worker_id", f"any_value({dup('worker_id', '')})")]
    return " union all ".join(
        f"select '{side}' as side, '{w}' as warning, {e}::bigint as count, {_pct(e, 'count(*)')} as pct from {t}" for w, e in rows)


def _blanked(df):
    return df.withColumns({
        "dob": F.when(F.col("k") % 9 == 0, "").otherwise(F.col("dob")),
        "location_state": F.when(F.col("k") % 8 == 0, "").otherwise(F.col("location_state")),
        "worker_id": F.when(F.col("k") % 50 == 0, "W1").otherwise(F.col("worker_id")),
        "full_name_norm": F.col("last_name_norm"),
    })


_blank_sql = ("select * replace (case when k % 9 = 0 then '' else dob end as dob, case when k % 8 = 0 then '' else "
              "location_state end as location_state, case when k % 50 = 0 then 'W1' else worker_id end as worker_id, "
              "last_name_norm as full_name_norm) from ")
_add("preflight_warnings", lambda s, d: summaries.preflight_warnings(_blanked(snap_old(s, d)), _blanked(snap_new(s, d))),
     samples.with_sql(samples._snapshots_sql() + [("bo", _blank_sql + "snap_old"), ("bn", _blank_sql + "snap_new")],
                      "select * from (" + (_warn("old", "") + " union all " + _warn("new", "x"))
                      .replace("snap_old", "bo").replace("snap_new", "bn") + ") where count > 0"))
_add("upload_check", lambda s, d: summaries.upload_check(snap_old(s, d), ("worker_id", "dob", "address")).withColumn(
        "missing_columns", F.array_join("missing_columns", ",")),
     samples.snapshots_sql("select count(*) as rows, 22 as columns, 'address' as missing_columns, false as valid from snap_old"))
_add("mismatch_totals", lambda s, d: summaries.mismatch_totals(pairs(s, d)),
     pairs_sql("select count(*) filter (trim(old_worker_status) <> trim(new_worker_status)) as status, "
               "count(*) filter (lower(old_position) <> lower(new_position) or lower(old_district) <> lower(new_district) or "
               "lower(old_location_state) <> lower(new_location_state)) as job_org, "
               f"count(*) filter ({_hire_moved}) as hire_date, count(*) filter (match_source = 'worker_id') as by_worker_id from pairs"))
