"""Registered queries of the decisions and the tables made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate as g
from ..operators import outputs as out
from ..operators.waves import wave_dates
from . import samples
from .samples import PAIRED, pairs_sql

QUERIES, SQL = {}, {}


def decide(spark, sf_dir, with_waves=True):
    """The decisions computed from the stored pairs."""
    rows = samples.pairs(spark, sf_dir).drop("cand_ord")
    return g.gate(rows, waves=wave_dates(rows) if with_waves else None)


def gated(spark, sf_dir):
    """The stored decision table; a full run fans out to all its reports from it."""
    return samples.stored(spark, sf_dir, "gated", lambda: decide(spark, sf_dir))


def gated_without_waves(spark, sf_dir):
    return samples.stored(spark, sf_dir, "gated-plain", lambda: decide(spark, sf_dir, False))


# ---------------------------------------------------------------- SQL twin of the gate

def num(c: str) -> str:
    return f"try_cast(nullif(replace(replace(trim({c}), ',', ''), '$', ''), '') as double)"


def low(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


def diff(f: str) -> str:
    return f"({low('old_' + f)} <> {low('new_' + f)})"


FIXES = ("salary", "payrate", "status", "hire_date", "job_org")
_FIX_MIN = {"salary": 0.97, "payrate": 0.97, "status": 0.98, "hire_date": 0.95, "job_org": 0.95}
_SRC_MIN = ("(case match_source when 'recon_id' then 0.95 when 'pk' then 0.95 when 'last4_dob' then 0.97 "
            "when 'dob_name' then 0.97 when 'name_hire_date' then 0.97 else 0.95 end)")
_TERMINATED = ("'terminated', 'term', 'inactive', 'inactivated', 'separated', 'offboarded', 'resigned', "
               "'released', 'terminated (involuntary)', 'terminated (voluntary)'")


def _verdict(fix: str) -> tuple[str, str, str]:
    need = f"greatest({_SRC_MIN}, {_FIX_MIN[fix]})::double"
    action = f"case when match_source = 'worker_id' or confidence >= {need} then 'APPROVE' else 'REVIEW' end"
    reason = (
        "case when match_source = 'worker_id' then 'worker_id_auto_approve' "
        "when confidence is null then 'missing_confidence' "
        f"when confidence >= {need} then format('confidence_ok ({{:.3f}}>={{:.3f}})', confidence, {need}) "
        f"when confidence >= 0.8 then format('below_threshold ({{:.3f}}<{{:.3f}})', confidence, {need}) "
        "else format('low_confidence ({:.3f}<0.80)', confidence) end"
    )
    return action, reason, f"case when match_source <> 'worker_id' then {need} end"


def _gated_steps(waves: bool) -> list[tuple[str, str]]:
    near = lambda a, b, t: (
        f"coalesce({b} > 0 and abs({a} / {b} - {t}) / {t} <= 0.02, false)")
    nums = (
        f"select *, {num('old_salary')} as os, {num('new_salary')} as ns, {num('old_payrate')} as op, "
        f"{num('new_payrate')} as np, {diff('worker_status')} as f_status, {diff('hire_date')} as f_hire_date, "
        f"{diff('position')} or {diff('district')} or {diff('location_state')} as f_job_org, "
        "try_cast(nullif(trim(old_hire_date), '') as date) as ohd, "
        "try_cast(nullif(trim(new_hire_date), '') as date) as nhd from pairs"
    )
    wave_test = ("trim(new_hire_date) in (select new_hire_date from waves)" if waves else "false")
    flags = (
        "select *, ns - os as salary_delta, np - op as payrate_delta, "
        "case when os <> 0 then ns / os end as salary_ratio, coalesce(ns - os <> 0, false) as f_salary, "
        "coalesce(np - op <> 0, false) as f_payrate, abs(nhd - ohd) as gap, "
        f"{wave_test} as in_wave, "
        f"case when {near('os', 'np', 2080)} then 'annual_to_hourly' when {near('ns', 'op', 2080)} "
        f"then 'hourly_to_annual' when {near('ns', 'op', 26)} then 'biweekly_to_annual' "
        f"when {near('os', 'np', 26)} then 'annual_to_biweekly' end as conv from nums"
    )
    columns = []
    for fix in FIXES:
        a, r, m = _verdict(fix)
        if fix == "salary":
            test = "(salary_ratio < 0.85 or salary_ratio > 1.15)"
            a = f"case when {test} then 'REVIEW' else {a} end"
            r = (f"case when {test} then format('salary_ratio_extreme ({{:.4f}} outside [0.85, 1.15])', "
                 f"salary_ratio) else {r} end")
        if fix == "payrate":
            a = f"case when conv is not null then 'APPROVE' else {a} end"
            r = f"case when conv is not null then 'payrate_conversion:' || conv else {r} end"
        if fix == "status":
            test = f"({low('old_worker_status')} = 'active' and {low('new_worker_status')} in ({_TERMINATED}))"
            a = f"case when {test} then 'REVIEW' else {a} end"
            r = (f"case when {test} then 'active_to_terminated (active->' || {low('new_worker_status')} || ')' "
                 f"else {r} end")
        if fix == "hire_date":
            on = "match_source in ('worker_id', 'pk')"
            other = "(f_salary or f_payrate or f_status or f_job_org)"
            year = "gap in (365, 366, 730, 731)"
            a = (f"case when {on} and gap = 1 then 'APPROVE' when {on} and {year} and not {other} then 'APPROVE' "
                 f"when {on} and {year} then 'REVIEW' else {a} end")
            r = (f"case when {on} and gap = 1 then 'hire_date:off_by_one_day_pattern' "
                 f"when {on} and {year} and not {other} then 'hire_date:systematic_year_shift_pattern' "
                 f"when {on} and {year} then 'hire_date:year_shift_with_other_mismatches' else {r} end")
        columns += [f"{a} as a_{fix}", f"{r} as r_{fix}", f"{m} as m_{fix}"]
    fields = "select *, case when f_payrate then conv end as conversion_type, " + ", ".join(columns) + " from flags"
    listed = ", ".join(f"case when f_{f} then '{f}' end" for f in FIXES)
    reviews = ", ".join(
        f"case when f_{f} and a_{f} = 'REVIEW' then '{f}:' || r_{f} end" for f in FIXES)
    texts = (
        f"select *, concat_ws('|', {listed}) as fix_types, "
        "(f_salary::int + f_payrate::int + f_status::int + f_hire_date::int + f_job_org::int) as n_fix, "
        f"concat_ws('|', {reviews}, case when in_wave then 'hire_date_wave' end, "
        "case when name_change_detected then 'name_change_detected (' || old_last_name_norm || ' -> ' || "
        "new_last_name_norm || ')' end) as review_text, "
        "case when match_source = 'dob_name' and confidence < 0.75 then "
        "format('reject_match:dob_name_low_confidence ({:.3f}<0.75)', confidence) "
        "when match_source not in ('worker_id', 'pk', 'recon_id') and salary_ratio > 2.5 "
        "and (not f_payrate or conv is null) then "
        "format('reject_match:fuzzy_extreme_salary_ratio ({:.4f}>2.5)', salary_ratio) end as reject_text "
        "from fields"
    )
    final = (
        "select *, case when n_fix = 0 then case when in_wave then 'REVIEW' else 'APPROVE' end "
        "when reject_text is not null then 'REJECT_MATCH' when review_text <> '' then 'REVIEW' "
        "else 'APPROVE' end as action, "
        "case when n_fix = 0 then case when in_wave then 'hire_date_wave' else 'no_changes_detected' end "
        "when reject_text is not null then reject_text when review_text <> '' then review_text "
        "else 'all_fix_types_approved' end as reason from texts"
    )
    signed = lambda c, e: f"(case when {c} >= 0 then '+' else '' end || {e})"
    orb = lambda c: f"coalesce(nullif({low(c)}, ''), 'blank')"
    job = ("concat_ws('+', " + ", ".join(
        f"case when {diff(f)} then '{f}' end" for f in ("position", "district", "location_state")) + ")")
    summary = (
        "coalesce(nullif(concat_ws(' | ', "
        f"case when f_salary then 'salary:' || {signed('salary_delta', 'format(chr(123) || chr(58) || chr(44) || chr(125), salary_delta::bigint)')} end, "
        f"case when f_payrate then 'payrate:' || {signed('payrate_delta', 'format(chr(123) || chr(58) || chr(44) || chr(125), payrate_delta::bigint)')} || '.00' end, "
        f"case when f_status then 'status:' || {orb('old_worker_status')} || '->' || {orb('new_worker_status')} end, "
        f"case when f_hire_date then 'hire_date:' || {orb('old_hire_date')} || '->' || {orb('new_hire_date')} end, "
        f"case when f_job_org then 'job_org(' || {job} || ')' end), ''), 'no_changes')"
    )
    points = [
        ("f_status", 50, "status+50"), ("abs(salary_delta) >= 5000", 30, "sal>=5k+30"),
        ("abs(salary_delta) >= 1000", 15, "sal>=1k+15"), ("f_hire_date", 20, "hire_date+20"),
        (f"f_job_org and {diff('position')}", 10, "position+10"),
        (f"f_job_org and {diff('district')}", 8, "district+8"),
        (f"f_job_org and {diff('location_state')}", 6, "location+6"),
        ("match_source <> 'worker_id'", 10, "non_wid+10"), ("n_fix >= 2", 5, "multi_fix+5"),
    ]
    score = " + ".join(f"(case when {t} then {p} else 0 end)" for t, p, _ in points)
    labels = "concat_ws('|', " + ", ".join(f"case when {t} then '{l}' end" for t, _, l in points) + ")"
    conf_text = "round(confidence, 4)::varchar"
    money = lambda e: f"format(chr(123) || chr(58) || chr(44) || chr(125), ({e})::bigint)"
    salary_words = (
        "case when salary_ratio < 0.2 or salary_ratio > 5 then 'Salary appears to be a decimal shift - old shows $' "
        f"|| {money('os')} || ', new shows $' || {money('ns')} else 'Salary ' || "
        "case when salary_delta > 0 then 'increased' else 'decreased' end || ' $' || "
        f"{money('abs(salary_delta)')} end"
    )
    known = lambda c: f"coalesce(nullif(trim({c}), ''), 'unknown')"
    wave_only = "(contains(reason, 'hire_date_wave') and not f_hire_date)"
    changes = (
        f"concat_ws(', ', case when f_salary then {salary_words} end, "
        f"case when f_status then 'Status changed ' || {known('old_worker_status')} || ' to ' || {known('new_worker_status')} end, "
        f"case when f_hire_date then 'Hire date changed from ' || {known('old_hire_date')} || ' to ' || {known('new_hire_date')} end, "
        "case when f_job_org then case when old_position <> '' and new_position <> '' and "
        f"{diff('position')} then 'Job title changed from ' || old_position || ' to ' || new_position "
        "else 'Job title or organization changed' end end, "
        f"case when {wave_only} then 'Hire date ' || new_hire_date || ' matches a bulk import wave' end)"
    )
    explained = (
        "concat_ws(' ', 'Matched on ' || case match_source when 'worker_id' then 'Worker ID' "
        "when 'name_hire_date' then 'name and hire date' else match_source end || '.', "
        "case when match_source <> 'worker_id' then format('Confidence {:.2f}.', confidence) end, "
        "case when action = 'REJECT_MATCH' then concat_ws(' ', "
        "case when contains(reason, 'dob_name_low_confidence') then format('Confidence {:.2f} is below the 0.75 minimum "
        "for name/DOB matches - likely a wrong-person pairing.', confidence) "
        "when contains(reason, 'fuzzy_extreme_salary_ratio') then "
        "'Salary ratio between records is extreme - likely a wrong-person pairing.' "
        "else 'Flagged as likely wrong-person pairing.' end, "
        "case when changes <> '' then 'Changes noted: ' || changes || '.' end, 'Rejected - do not apply corrections.') "
        f"when n_fix = 0 and not {wave_only} then 'No field changes detected. Approved automatically.' "
        "else concat_ws(' ', case when n_fix > 0 and not f_salary then 'Salary unchanged.' end, "
        "case when changes <> '' then changes || case when action = 'REVIEW' then ' - flagged for review.' "
        "else '. Approved automatically.' end when action = 'REVIEW' then 'Flagged for review.' "
        "else 'Approved automatically.' end) end)"
    )
    gated_text = (
        f"select *, {explained} as explanation from (select *, {summary} as summary, ({score})::integer as priority_score, "
        f"{labels} as priority_labels, {conf_text} as confidence_text, {changes} as changes from decided)"
    )
    wave_steps = [(
        "waves",
        "select trim(new_hire_date) as new_hire_date, count(*) as wave_count, (select count(*) from pairs) as total_pairs "
        "from pairs where trim(new_hire_date) <> '' group by 1 "
        "having count(*) / (select count(*) from pairs) >= 0.01",
    )] if waves else []
    return wave_steps + [
        ("nums", nums), ("flags", flags), ("fields", fields), ("texts", texts), ("decided", final),
        ("gated", gated_text),
    ]


def gated_sql(body: str, waves: bool = True, more: list[tuple[str, str]] | None = None) -> str:
    return pairs_sql(body, _gated_steps(waves) + list(more or []))


ZERO = "(" + low("new_worker_status") + " in ('active', '') and coalesce(ns = 0, true))"


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


# ---------------------------------------------------------------- queries

_add("decision_counts",
     lambda s, d: decide(s, d).groupBy("match_source", "action").agg(F.count(F.lit(1)).alias("pairs")),
     gated_sql("select match_source, action, count(*) as pairs from gated group by all"))

_add("infer_fix_types",
     lambda s, d: samples.pairs(s, d).select("pair_id", F.array_join(g.infer_fix_types(), "|").alias("fix_types")),
     gated_sql("select pair_id, fix_types from gated"))

_add("classify_pairs",
     lambda s, d: decide(s, d).select(
         "pair_id", g.fix_text().alias("fix_types"), "action", "reason",
         F.coalesce("conversion_type", F.lit("")).alias("conversion_type")),
     gated_sql("select pair_id, fix_types, action, reason, coalesce(conversion_type, '') as conversion_type from gated"))

_add("classify_pairs_without_waves",
     lambda s, d: decide(s, d, False).select("pair_id", "action", "reason"),
     gated_sql("select pair_id, action, reason from gated", waves=False))

_add("classify_fields",
     lambda s, d: decide(s, d).select("pair_id", F.explode("per_fix").alias("fix_type", "v")).select(
         "pair_id", "fix_type", "v.action", "v.min_confidence", "v.confidence", "v.reason"),
     gated_sql(" union all ".join(
         f"select pair_id, '{f}' as fix_type, a_{f} as action, m_{f} as min_confidence, confidence, "
         f"r_{f} as reason from gated where f_{f}" for f in FIXES)))

_add("minimum_confidence",
     lambda s, d: samples.pairs(s, d).select("match_source").distinct().select(
         "match_source", F.explode(F.array(*[F.lit(f) for f in FIXES])).alias("fix_type")).select(
         "match_source", "fix_type",
         g.min_confidence(F.col("match_source"), F.col("fix_type"), g.load_policy(None)).alias("min_confidence")),
     gated_sql("select match_source, fix_type, case when match_source = 'worker_id' then 0.0::double else "
               f"greatest({_SRC_MIN}::double, case fix_type "
               + " ".join(f"when '{f}' then {m}::double" for f, m in _FIX_MIN.items())
               + " end) end as min_confidence from (select distinct match_source from pairs) "
               "cross join (select unnest(['salary', 'payrate', 'status', 'hire_date', 'job_org']) as fix_type)"))

_add("change_summary",
     lambda s, d: gated(s, d).select("pair_id", g.summary_text().alias("summary")),
     gated_sql("select pair_id, summary from gated"))

_add("pair_explanation",
     lambda s, d: gated(s, d).select("pair_id", g.explanation_text().alias("match_explanation")),
     gated_sql("select pair_id, explanation as match_explanation from gated"))

_add("priority_score",
     lambda s, d: gated(s, d).select(
         "pair_id", g.priority_score().alias("priority_score"), g.priority_labels().alias("priority_labels")),
     gated_sql("select pair_id, priority_score, priority_labels from gated"))

_WIDE = ("full_name_norm", "first_name_norm", "last_name_norm", "middle_name", "suffix", "worker_status",
         "worker_type", "hire_date", "position", "district", "location_state", "salary", "payrate")
_wide_pairs = ", ".join(f"old_{f}, new_{f}" for f in _WIDE)
_extra_sql = ", ".join(
    f"old_{f}, new_{f}, {diff(f)} as mm_{f}" for f in ("cost_center", "company", "department"))
_org_sql = " or ".join(diff(f) for f in ("cost_center", "company", "department"))
WIDE_SQL = (
    "select pair_id, match_source, confidence, action, reason, fix_types, summary, explanation as match_explanation, "
    f"priority_score, old_worker_id, new_worker_id, {_wide_pairs}, null::varchar as old_location, "
    "null::varchar as new_location, name_change_detected, salary_delta, "
    "case when salary_delta is not null then round(salary_ratio, 6) end as salary_ratio, payrate_delta, "
    "coalesce(conversion_type, '') as conversion_type, f_status as status_changed, f_hire_date as hire_date_changed, "
    "f_job_org as job_org_changed, case when f_hire_date then r_hire_date else '' end as hire_date_pattern, "
    "action = 'REVIEW' as needs_review, action as suggested_action, "
    + ", ".join(f"'' as comp_band_{c}" for c in ("status", "min", "mid", "max", "match"))
    + f", {_extra_sql}, {_org_sql} as mismatch_group_org from gated"
)


def wide(spark, sf_dir):
    return out.wide_compare(gated(spark, sf_dir))


_add("wide_compare", wide, gated_sql(WIDE_SQL))

_add("lookup_keys", lambda s, d: out.lookup_keys(samples.pairs(s, d)),
     pairs_sql("select pair_id, match_source, confidence, case when match_source = 'worker_id' then old_worker_id "
               "else '' end as match_key, old_worker_id, new_worker_id, old_recon_id, new_recon_id, "
               "old_full_name_norm, new_full_name_norm from pairs"))

_change_pairs = ", ".join(f"old_{f}, new_{f}" for f in out.CHANGE_FIELDS)
_min_list = ", ".join(f"case when f_{f} then m_{f} end" for f in FIXES)
_add("ui_pairs", lambda s, d: out.ui_pairs(gated_without_waves(s, d)),
     gated_sql(
         "select 'v1' as ui_contract_version, pair_id, match_source, old_worker_id, new_worker_id, fix_types, action, "
         f"reason, confidence_text as confidence, coalesce(least({_min_list})::varchar, '') as min_confidence, "
         "priority_score, summary, "
         + ", ".join(f"f_{f} as has_{f}_mismatch" for f in FIXES)
         + ", coalesce(round(salary_delta, 2)::varchar, '') as salary_delta, "
           "coalesce(round(payrate_delta, 4)::varchar, '') as payrate_delta, "
         + _change_pairs + ", '' as old_location, '' as new_location, old_worker_type, new_worker_type, "
         + _extra_sql + f", {_org_sql} as mismatch_group_org from gated", waves=False))

REVIEW_SQL = (
    "select pair_id, match_source, old_worker_id, new_worker_id, old_full_name_norm, fix_types, "
    "confidence_text as confidence, action, reason, priority_score, priority_labels, summary, "
    "explanation as match_explanation, coalesce(round(salary_delta, 2)::varchar, '') as salary_delta, "
    f"{_change_pairs} from gated where action = 'REVIEW'"
)
_add("review_queue", lambda s, d: out.review_queue(gated(s, d)), gated_sql(REVIEW_SQL))

_AS_OF = "2026-01-15"
for _kind, (_code, _values, _dated) in out.CORRECTIONS.items():
    _shown = ", ".join("'' as location" if n == "location" else f"coalesce({c}, '') as {n}" for n, c in _values.items())
    _add(f"corrections_{_kind}",
         lambda s, d, k=_kind: out.corrections(gated(s, d), k, _AS_OF),
         gated_sql(
             "select new_worker_id as worker_id, " + (f"'{_AS_OF}' as effective_date, " if _dated else "")
             + _shown + (", 'USD' as currency" if _kind == "salary" else "")
             + f", '{_code}' as reason, pair_id, match_source, confidence_text as confidence, summary from gated "
               f"where action = 'APPROVE' and f_{_kind} and a_{_kind} = 'APPROVE'"
             + (f" and not {ZERO}" if _kind == "salary" else "")))

_fix_reasons = "concat_ws('|', " + ", ".join(
    f"case when f_{f} and a_{f} = 'REVIEW' then '{f}:' || r_{f} end" for f in FIXES) + ")"
_fix_max = "greatest(" + ", ".join(f"case when f_{f} and a_{f} = 'REVIEW' then m_{f} end" for f in FIXES) + ")"
_add("review_needed", lambda s, d: out.review_needed(gated(s, d)),
     gated_sql(f"select new_worker_id as worker_id, pair_id, match_source, fix_types, 'REVIEW' as action, "
               f"{_fix_reasons} as reason, confidence_text as confidence, "
               f"coalesce({_fix_max}::varchar, '') as min_confidence, summary from gated where action = 'REVIEW'"))

HELD_SQL = (
    "select new_worker_id as worker_id, pair_id, match_source, fix_types, action as overall_action, "
    "case when action <> 'APPROVE' then 'overall_' || action else 'active_zero_salary_blocked' end as hold_reason, "
    "confidence_text as confidence, summary from gated where action <> 'APPROVE' "
    f"or (f_salary and a_salary = 'APPROVE' and {ZERO})"
)
_add("held_corrections", lambda s, d: out.held_corrections(gated(s, d)), gated_sql(HELD_SQL))

MANIFEST_SQL = " union all ".join(
    f"select '{k}' as correction_type, new_worker_id as worker_id, pair_id, match_source, fix_types, a_{k} as action, "
    f"confidence_text as confidence, summary, 'corrections_{k}.csv' as output_file from gated "
    f"where action = 'APPROVE' and f_{k} and a_{k} = 'APPROVE'" + (f" and not {ZERO}" if k == "salary" else "")
    for k in out.CORRECTIONS)
_add("corrections_manifest", lambda s, d: out.corrections_manifest(gated(s, d)), gated_sql(MANIFEST_SQL))

_words = "'salary': 'Salary', 'status': 'Status', 'hire_date': 'Hire Date', 'job_org': 'Job / Org', 'payrate': 'Payrate'"
FIX_WORDS_SQL = (
    "case when fix_types = '' then 'No Changes' else array_to_string(list_transform(string_split(fix_types, '|'), "
    f"lambda x: map_extract(map {{{_words}}}, x)[1]), ', ') end"
)
ACTION_SQL = "case action when 'APPROVE' then 'Safe' when 'REVIEW' then 'Needs Review' else 'Wrong Match' end"
_add("enhanced_manifest", lambda s, d: out.enhance_manifest(out.corrections_manifest(gated(s, d))),
     gated_sql(
         f"select correction_type, worker_id, pair_id, match_source, {FIX_WORDS_SQL} as fix_types, "
         f"{ACTION_SQL} as action, confidence, summary, output_file, case correction_type when 'salary' then "
         "'Update salary' when 'status' then 'Change status' when 'hire_date' then 'Update hire date' "
         f"else 'Update position / org' end as fix_description from ({MANIFEST_SQL})"))

_add("audit_trail", lambda s, d: out.audit_trail(gated(s, d), "2026-01-15T00:00:00Z"),
     gated_sql("select pair_id, action, reason, fix_types, match_source, confidence::varchar as confidence, "
               "conversion_type, null::varchar as comp_band_status, name_change_detected::varchar as name_change_detected, "
               "'2026-01-15T00:00:00Z' as recorded_at from gated"))

_add("action_counts", lambda s, d: out.action_counts(gated(s, d)),
     gated_sql("select count(*) as total, count(*) filter (action = 'APPROVE') as approve, "
               "count(*) filter (action = 'REVIEW') as review, "
               "count(*) filter (action = 'REJECT_MATCH') as reject_match from gated"))

_issue_base = (
    "concat_ws(', ', case when f_salary or f_payrate then 'Salary' end, case when f_status then 'Employee Status' end, "
    "case when f_hire_date then 'Hire Date' end, case when f_job_org then 'Job and Organization' end)"
)
_issue = (
    f"case when match_source <> 'worker_id' then coalesce(nullif({_issue_base}, ''), 'Review Required') || ', Identity' "
    f"else coalesce(nullif({_issue_base}, ''), 'Review Required') end"
)
FRIENDLY_SQL = (
    f"select old_full_name_norm as employee_name, {_issue} as issue_type, "
    "case when priority_score >= 90 then 'Critical' when priority_score >= 60 then 'High' "
    "when priority_score >= 30 then 'Medium' else 'Low' end as severity, "
    "coalesce(nullif(old_district, ''), nullif(new_district, ''), nullif(old_department, ''), "
    "nullif(new_department, ''), 'Unassigned') as department, summary as what_changed, "
    "explanation as recommended_action, pair_id, match_source, old_worker_id, new_worker_id, fix_types, reason, "
    "priority_score, name_change_detected from gated where action = 'REVIEW'"
)
_add("friendly_review", lambda s, d: out.friendly_review(gated(s, d)), gated_sql(FRIENDLY_SQL))

for _kind in ("salary", "status", "hire_date", "job_org"):
    _test = "f_salary or f_payrate" if _kind == "salary" else f"f_{_kind}"
    _add(f"friendly_slice_{_kind}",
         lambda s, d, k=_kind: out.text_slice(out.friendly_review(gated(s, d)), k).select(
             "pair_id", "employee_name", "severity", "fix_types"),
         gated_sql(f"select pair_id, employee_name, severity, fix_types from ({FRIENDLY_SQL} and ({_test}))"))


def _identity(spark, sf_dir):
    review = out.friendly_review(gated(spark, sf_dir))
    # The sample is one to one already; candidates that share no key stand in for conflicts.
    conflicts = samples.pairs(spark, sf_dir).where("match_source = 'name_hire_date'")
    return out.identity_conflicts(review, conflicts)


_identity_cols = ("employee_name, issue_type, severity, department, what_changed, recommended_action, pair_id, "
                  "match_source, old_worker_id, new_worker_id")
_add("identity_conflicts", _identity, gated_sql(
    f"select {_identity_cols} from (select *, row_number() over (partition by old_worker_id, new_worker_id, "
    f"employee_name order by src, pair_id) as rn from (select 0 as src, * replace ('Identity' as issue_type) from "
    f"(select {_identity_cols} from ({FRIENDLY_SQL}) where match_source <> 'worker_id' or name_change_detected) "
    "union all select 1, old_full_name_norm, 'Identity', 'High', coalesce(nullif(old_district, ''), 'Unassigned'), "
    "'Worker ID conflict requires identity review.', 'Confirm the correct employee identity before loading corrections.', "
    "pair_id, match_source, old_worker_id, new_worker_id from pairs where match_source = 'name_hire_date')) where rn = 1"))

for _kind, _cols in out.SHEETS.items():
    _list = ("pair_id, match_source, confidence, action, priority_score, old_worker_id, old_first_name_norm, "
             "old_last_name_norm, " + ", ".join(_cols) + ", fix_types, reason, summary")
    _add(f"sheet_{_kind}", lambda s, d, k=_kind: out.slim(wide(s, d), k),
         gated_sql(f"select {_list} from ({WIDE_SQL}) where contains(fix_types, '{_kind}')"))

_add("sheet_labels",
     lambda s, d: out.slim(wide(s, d), "status", labels=True),
     gated_sql(f'select pair_id as "Pair Id", match_source as "Match Source", confidence as "Confidence", '
               f'{ACTION_SQL} as "Action", priority_score as "Priority Score", old_worker_id as "Old Worker Id", '
               'old_first_name_norm as "Old First Name Norm", old_last_name_norm as "Old Last Name Norm", '
               'old_worker_status as "Old Worker Status", new_worker_status as "New Worker Status", '
               'old_worker_type as "Old Worker Type", new_worker_type as "New Worker Type", '
               f'{FIX_WORDS_SQL} as "Fix Types", reason as "Reason", summary as "Summary" '
               "from gated where f_status"))

_add("extra_field_mismatch",
     lambda s, d: out.extra_field_mismatch(wide(s, d)).select("pair_id", "mm_cost_center", "mm_company", "mm_department"),
     gated_sql(f"select pair_id, mm_cost_center, mm_company, mm_department from ({WIDE_SQL}) "
               "where mm_cost_center or mm_company or mm_department"))

_add("rejected_matches",
     lambda s, d: wide(s, d).where("action = 'REJECT_MATCH'").select(
         "pair_id", "old_worker_id", "new_worker_id", "match_source", "reason", "summary"),
     gated_sql("select pair_id, old_worker_id, new_worker_id, match_source, reason, summary from gated "
               "where action = 'REJECT_MATCH'"))

_add("active_zero_salary_pairs",
     lambda s, d: samples.pairs(s, d).where(out.active_zero()).select(
         "pair_id", "old_worker_id", "new_worker_status", "new_salary"),
     gated_sql(f"select pair_id, old_worker_id, new_worker_status, new_salary from gated where {ZERO}"))

_add("held_with_names",
     lambda s, d: out.held_with_names(out.held_corrections(gated(s, d)), wide(s, d)),
     gated_sql(f"select h.worker_id, coalesce(w.old_first_name_norm, '') as first_name, "
               "coalesce(w.old_last_name_norm, '') as last_name, h.pair_id, h.match_source, h.fix_types, "
               "h.overall_action, h.hold_reason, h.confidence, h.summary "
               f"from ({HELD_SQL}) h left join pairs w on w.old_worker_id = h.worker_id "
               "where regexp_matches(h.hold_reason, 'BLOCKED|REJECT_MATCH|active_zero_salary_blocked')"))

_steps_sql = ("concat_ws(', ', case when f_salary then 'review salary change' end, case when f_status then "
              "'confirm status' end, case when f_hire_date then 'verify hire date' end, case when f_job_org then "
              "'check position / org' end)")
_add("review_slim",
     lambda s, d: out.review_slim(out.review_queue(gated(s, d), ordered=False), wide(s, d)),
     gated_sql(f"select old_worker_id, old_first_name_norm, old_last_name_norm, {ACTION_SQL} as action, "
               f"{FIX_WORDS_SQL} as fix_types, summary, case when {_steps_sql} <> '' then 'Manually review: ' || "
               f"{_steps_sql} else 'Manually review' end as recommended_action, priority_score "
               "from gated where action = 'REVIEW'"))



def _plain(k):
    a, r, _ = _verdict(k)
    return a, r


for _kind in ("salary", "status", "hire_date", "job_org"):
    _a, _r = _plain(_kind)
    _add(f"single_audit_{_kind}",
         lambda s, d, k=_kind: out.single_type_audit(gated_without_waves(s, d), k)["corrections"].select(
             "worker_id", "pair_id", "reason", "confidence"),
         gated_sql(f"select new_worker_id as worker_id, pair_id, {_r} as reason, confidence::varchar as confidence "
                   f"from gated where f_{_kind} and {_a} = 'APPROVE'", waves=False))
    _add(f"single_audit_{_kind}_manifest",
         lambda s, d, k=_kind: out.single_type_audit(gated_without_waves(s, d), k)["manifest"].drop("summary"),
         gated_sql(f"select '{_kind}' as correction_type, new_worker_id as worker_id, pair_id, match_source, "
                   f"{_a} as action, confidence::varchar as confidence from gated where f_{_kind}", waves=False))

_add("strip_pii", lambda s, d: out.strip_pii(samples.pairs(s, d)).drop("cand_ord"),
     pairs_sql("select pair_id, match_source, source_score, exact_worker_id, name_change_detected, confidence, "
               + ", ".join(f"old_{c}, new_{c}" for c in PAIRED if c not in ("dob", "last4_ssn")) + " from pairs"))
