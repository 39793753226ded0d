"""Registered queries of deduplication, review lists, differences, bands and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bands, diff, resolve, review, summaries
from ..operators import outputs as out
from ..operators.dedupe import dedupe_best
from ..operators.match import candidate_order
from ..sources import sinks, snapshots
from ..sources.staging import stage_folder
from . import samples
from .scalars import LCS_SQL, SORTED_SQL
from .gating import gated, gated_sql
from .samples import pairs, pairs_sql, snap_new, snap_old, snapshots_sql, table, with_sql

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---------------------------------------------------------------- mapping and deduplication

# Orders read as a snapshot with repeated ids: one worker per customer, a third of them under one id.
_ORD = {
    "worker_id": "case when o_orderkey % 13 = 0 then '' when o_orderkey % 3 = 0 then 'Hot ' else concat('w', o_custkey) end",
    "recon_id": "case when o_orderkey % 7 = 0 then concat('R', o_orderkey % 500) else '' end",
    "worker_status": "case when o_orderstatus = 'F' then 'Active' when o_orderstatus = 'O' then 'active ' else 'leave' end",
    "payrate": "case when o_orderkey % 4 = 0 then '' else '12.5' end",
}


def repeated(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("src_ord"), *[F.expr(e).alias(c) for c, e in _ORD.items()],
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("hire_date"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.floor("o_totalprice").cast("string")).alias("salary"))


_REPEATED = [("rows", "select o_orderkey as k, " + ", ".join(f"{e} as {c}" for c, e in _ORD.items())
              + ", o_orderdate::date::varchar as hire_date, case when o_orderkey % 5 = 0 then '' else floor(o_totalprice)::bigint::varchar end as salary from orders")]
_rank = ("(lower(trim(worker_status)) = 'active')::int desc, try_cast(hire_date as date) desc nulls last, "
         "try_cast(nullif(salary, '') as double) desc nulls last, (salary <> '')::int desc, (payrate <> '')::int desc, k")


def _kept(source, column):
    return (f"select * exclude rn from (select *, row_number() over (partition by case when trim({column}) = '' then 'row' || k else "
            f"'id' || lower(trim({column})) end order by {_rank}) as rn from {source}) where rn = 1")


_add("dedupe_best", lambda s, d: dedupe_best(repeated(s, d)).select(F.col("src_ord").alias("k"), "worker_id", "recon_id", "salary"),
     with_sql(_REPEATED + [("once", _kept("rows", "worker_id"))], f"select k, worker_id, recon_id, salary from ({_kept('once', 'recon_id')})"))
_add("duplicate_row_count", lambda s, d: snapshots.duplicate_row_count(repeated(s, d), "worker_id"),
     with_sql(_REPEATED, "select sum(c)::bigint as duplicate_rows from (select count(*) as c from rows where trim(worker_id) <> '' "
                         "group by lower(trim(worker_id)) having count(*) > 1)"))


def uploaded(spark, sf_dir):
    """A file as users send it: odd headers, names in two fields, money with symbols."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        k.alias("src_ord"), F.expr("concat(' E', c_custkey)").alias("Employee-ID"),
        F.expr("case when c_custkey % 9 = 0 then 'Ana Maria' else concat('Fn', ' ', substr(n_name, 1, 3)) end").alias("First Name"),
        F.expr("concat(n_name, if(c_custkey % 5 = 0, ' Jr.', ''))").alias("Surname"),
        F.expr("concat(month(date_add(date'1950-01-01', int(c_custkey % 9000))), '/', day(date_add(date'1950-01-01', int(c_custkey % 9000))), '/', "
               "year(date_add(date'1950-01-01', int(c_custkey % 9000))))").alias("Date of Birth"),
        F.expr("case when c_custkey % 11 = 0 then 'n/k' when c_custkey % 12 = 0 then '' else concat('$', 40 + c_custkey % 50, ',000') end").alias("Base Salary"),
        F.expr("concat('Town, ', upper(substr(n_name, 1, 2)))").alias("Work Location"), F.col("c_mktsegment").alias("Dept"),
        F.lit(" Active ").alias("Emp Status"), F.expr("concat('123-45-', lpad(c_custkey % 10000, 4, '0'))").alias("SSN"))


def mapped(spark, sf_dir):
    named = snapshots.resolve_aliases(uploaded(spark, sf_dir), {"First Name": "first_name"})
    return snapshots.map_columns(named)


_MAPPED = [("m", (
    "select c_custkey as k, ' E' || c_custkey as worker_id, nm, case when c_custkey % 9 = 0 then 'ana maria' else 'fn ' || substr(lower(n_name), 1, 3) end as fn, "
    "trim(regexp_replace(regexp_replace(lower(n_name), '[^a-z ''-]', '', 'g'), ' +', ' ', 'g')) as ln, c_custkey % 5 = 0 as jr, "
    "(date '1950-01-01' + (c_custkey % 9000)::integer)::varchar as dob, case when c_custkey % 11 = 0 or c_custkey % 12 = 0 then null else "
    "(40 + c_custkey % 50) * 1000.0::double end as salary, case when c_custkey % 11 = 0 then 'n/k' when c_custkey % 12 = 0 then '(blank)' end as bad, "
    "upper(substr(n_name, 1, 2)) as st, c_mktsegment as district, lpad((c_custkey % 10000)::varchar, 4, '0') as l4 "
    "from (select *, n_name as nm from customer join nation on c_nationkey = n_nationkey)"))]
_add("map_snapshot", lambda s, d: mapped(s, d).select(
        F.col("src_ord").alias("k"), "worker_id", "full_name_norm", "first_name_norm", "last_name_norm", "suffix", "dob", "salary",
        "location_state", "district", "worker_status", "last4_ssn"),
     with_sql(_MAPPED, "select k, worker_id, fn || ' ' || ln || case when jr then ' jr' else '' end as full_name_norm, "
                       "split_part(fn, ' ', 1) as first_name_norm, ln as last_name_norm, case when jr then 'Jr.' end as suffix, dob, salary, "
                       "st as location_state, district, 'active' as worker_status, l4 as last4_ssn from m"))
_add("mapping_report", lambda s, d: snapshots.mapping_report(mapped(s, d)).withColumn(
        "salary_parse_failure_samples", F.array_join(F.array_sort("salary_parse_failure_samples"), "|")),
     with_sql(_MAPPED, "select count(*) as rows_in, 0::bigint as worker_id_nulls, count(*) as recon_id_nulls, count(*) filter (salary is null) as salary_nulls, "
                       "count(*) filter (salary is null) as salary_parse_failures, count(*) as hire_date_nulls, 0::bigint as location_state_nulls, "
                       "'(blank)|n/k' as salary_parse_failure_samples from m"))
_add("audit_aliases", lambda s, d: snapshots.audit_aliases(uploaded(s, d).withColumnsRenamed(
        {"Employee-ID": "emp_id", "Dept": "Department", "Base Salary": "annual salary"}).withColumn("status", F.lit("x"))).select(
        F.col("src_ord").alias("k"), "worker_id", "department", "salary", "worker_status"),
     with_sql(_MAPPED, "select k, worker_id, district as department, case when k % 11 = 0 then 'n/k' when k % 12 = 0 then '' else '$' || (40 + k % 50) || ',000' end "
                       "as salary, ' Active ' as worker_status from m"))
_add("pair_view", lambda s, d: snapshots.pair_view(pairs(s, d).drop("pair_id")).select("pair_id", "old_worker_id"),
     pairs_sql("select pair_id, old_worker_id from pairs"))
_add("safe_column_names", lambda s, d: snapshots.safe_column_names(
        table(s, d, "region").toDF(*[f'"{c};' for c in table(s, d, "region").columns])),
     "select * from region")



def quoted_csv(spark, sf_dir):
    """Documents written as quoted CSV, with line breaks, quotes and backslashes in their texts, and read as a snapshot."""
    path = _new_folder(spark, "quoted")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit('"'), "source", F.lit('", \\')).alias("source"), F.lit("").alias("blank"))
    rows.write.options(**sinks.CSV_OPTIONS).csv(path)
    return snapshots.read_snapshot(spark, path, numbering="none")


_add("read_quoted_csv", quoted_csv, "select doc_id::varchar as doc_id, text, '\"' || source || '\", \\' as source, '' as blank from documents")



def _new_folder(spark, name):
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_table(spark, sf_dir):
    """Pairs written by the CSV sink and read as a snapshot."""
    path = _new_folder(spark, "written")
    sinks.write_table(pairs(spark, sf_dir).select("pair_id", "old_worker_id", "new_full_name_norm", "old_salary"), path, "csv")
    return snapshots.read_snapshot(spark, path, numbering="none")


def written_queue(spark, sf_dir):
    """Pairs written with one folder per department and read back."""
    path = _new_folder(spark, "queue")
    sinks.write_partitioned_queue(pairs(spark, sf_dir).select("pair_id", "old_district", "new_district"), path)
    return spark.read.parquet(path).select("pair_id", "department", "dept_slug")


def run_history(spark, sf_dir):
    """Two runs appended to a history, with the pairs each of them had."""
    path = _new_folder(spark, "history")
    for run, rows in (("first", pairs(spark, sf_dir)), ("second", pairs(spark, sf_dir).where("match_source = 'pk'"))):
        sinks.append_run_history(spark, {"run_id": run, "pairs": rows.count()}, path)
    return spark.read.parquet(path).select("run_id", F.col("pairs").cast("bigint").alias("pairs"))


_add("written_table", written_table, pairs_sql("select pair_id, old_worker_id, new_full_name_norm, old_salary from pairs"))
_add("written_queue", written_queue, pairs_sql("select pair_id, old_district as department, lower(old_district) as dept_slug from pairs"))
_add("run_history", run_history, pairs_sql("select 'first' as run_id, count(*) as pairs from pairs union all "
                                           "select 'second', count(*) from pairs where match_source = 'pk'"))

# ---------------------------------------------------------------- review lists

_YEAR = "substr(dob, 1, 4)"
_SIDE = [(f"r_{s}", f"select k as row, trim(last4_ssn) as l4, recon_id, worker_id, lower(full_name_norm) as nm, dob, {_YEAR} as yr, "
                    f"substr(lower(last_name_norm), 1, 3) as p3, lower(location_state) as st from snap_{s}") for s in ("old", "new")]
_agree = lambda f: f"(o.{f} <> '' and o.{f} = n.{f})"
_sim = "(case when o.nm = '' or n.nm = '' then 0.0 when o.nm = n.nm then 1.0 else 1 - levenshtein(o.nm, n.nm) / greatest(length(o.nm), length(n.nm)) end)"
_signal = f"({_agree('dob')}::int + {_agree('yr')}::int + {_agree('p3')}::int + {_agree('st')}::int + ({_sim} >= 0.9)::int)"
_weighted = (f"(case when {_agree('dob')} then 3 when {_agree('yr')} then 2 else 0 end + case when {_agree('p3')} then 2 else 0 end + "
             f"case when {_agree('st')} then 1 else 0 end + case when {_sim} >= 0.9 then 2 else 0 end)")
_SHOWN = ["last4_ssn", "old_row", "new_row", "score", "confidence", "name_similarity"]
_SHORT = {"dob": "dob", "birth_year": "yr", "last_name_prefix3": "p3", "location_state": "st"}


def _evidence_side(side, fields):
    """Rows with all of the fields, and how many rows of the side share them."""
    keys = ", ".join(["l4", *fields])
    present = " and ".join(f"{f} <> ''" for f in ["l4", *fields])
    return f"(select *, count(*) over (partition by {keys}) as c from r_{side} where {present})"


def _review_sql(name, score, high, medium):
    """Every MEDIUM or HIGH pair under the first evidence set it agrees on, for keys that are unique on a side."""
    parts, earlier = [], []
    for fields in ([_SHORT[f] for f in e] for e in review.EVIDENCE[name]):
        before = "".join(f" and not ({e})" for e in earlier)
        same = " and ".join(f"o.{f} = n.{f}" for f in ["l4", *fields])
        parts.append(f"select o.l4, o.row as old_row, n.row as new_row, {score} as score, {_sim} as sim from {_evidence_side('old', fields)} o "
                     f"join {_evidence_side('new', fields)} n on {same} where (o.c = 1 or n.c = 1){before}")
        earlier.append(" and ".join(_agree(f) for f in fields))
    return with_sql(samples._snapshots_sql() + _SIDE,
                    f"select l4 as last4_ssn, old_row, new_row, score::integer as score, case when score >= {high} then 'HIGH' else 'MEDIUM' end as confidence, "
                    f"round(sim, 3) as name_similarity from ({' union all '.join(parts)}) where score >= {medium}")


def _review_pairs(score):
    return lambda s, d: review.review_pairs_last4(snap_old(s, d), snap_new(s, d), score=score, method="edit").select(*_SHOWN)


_add("review_pairs_signals", _review_pairs("signals"), _review_sql("signals", _signal, 4, 3))
_add("review_pairs_weighted", _review_pairs("weighted"), _review_sql("weighted", _weighted, 7, 4))
_add("review_pairs_uncapped", _review_pairs("signals"), _review_sql("signals", _signal, 4, 3))
QUERIES["review_pairs_sequence"] = lambda s, d: review.review_pairs_last4(snap_old(s, d), snap_new(s, d)).select(*_SHOWN)


def _grouped_sql(name, score, high, medium):
    """Members of keys that repeat on both sides, with the first of their best partners, from all pairs of a key."""
    parts = []
    for fields, e in (([_SHORT[f] for f in e], e) for e in review.EVIDENCE[name]):
        same = " and ".join(f"o.{f} = n.{f}" for f in ["l4", *fields])
        pairs = (f"(select concat_ws('|', o.l4, {', '.join('o.' + f for f in fields)}) as key, o.row as old_row, n.row as new_row, o.c as n_old, n.c as n_new, {score} as s, {_sim} as sim "
                 f"from {_evidence_side('old', fields)} o join {_evidence_side('new', fields)} n on {same} where o.c > 1 and n.c > 1)")
        parts += [f"select '{me}' as side, '{'+'.join(['last4_ssn', *e])}' as evidence, key, {me}_row as row, n_old, n_new, arg_min({other}_row, (-s, {other}_row)) as partner_row, "
                  f"max(s) as s, arg_min(sim, (-s, {other}_row)) as sim from {pairs} group by all" for me, other in (("old", "new"), ("new", "old"))]
    return with_sql(samples._snapshots_sql() + _SIDE,
                    f"select side, evidence, key, row, n_old, n_new, partner_row, s::integer as score, case when s >= {high} then 'HIGH' when s >= {medium} then 'MEDIUM' else 'LOW' end as confidence, "
                    f"round(sim, 3) as name_similarity from ({' union all '.join(parts)})")


for _name, _points, _high, _medium in (("signals", _signal, 4, 3), ("weighted", _weighted, 7, 4)):
    _add(f"grouped_evidence_{_name}", lambda s, d, n=_name: review.grouped_evidence(snap_old(s, d), snap_new(s, d), n, method="edit"),
         _grouped_sql(_name, _points, _high, _medium))


def _grouped_names(df):
    return df.withColumns({
        "full_name_norm": F.concat(F.lit("p"), F.col("k") % 500), "last_name_norm": F.concat(F.lit("ln"), F.col("k") % 3),
        "dob": F.date_format(F.expr("date_add(date'1950-01-01', int(k % 1000))"), "yyyy-MM-dd"),
        "recon_id": F.concat(F.lit("R"), F.col("k"))})


_GROUPED = [(f"g_{s}", f"select k as row, 'p' || (k % 500) as nm, (date '1950-01-01' + (k % 1000)::integer)::varchar as dob, 'ln' || (k % 3) as ln, worker_id, "
                       f"'R' || k as rid from snap_{s}") for s in ("old", "new")]


def _tier_sql(key, level, score, old, new):
    return (f"select '{level}' as confidence, {score} as score, o.row as old_row, n.row as new_row, o.rid, n.worker_id as nw, concat_ws('|', "
            "case when co.c > 1 then 'dup_in_old(' || co.c || ')' end, case when cn.c > 1 then 'dup_in_new(' || cn.c || ')' end) as notes "
            f"from {old} o join {new} n on {key.replace('#', 'o')} = {key.replace('#', 'n')} "
            f"join (select {key.replace('#.', '')} as x, count(*) as c from {old} group by 1) co on co.x = {key.replace('#', 'o')} "
            f"join (select {key.replace('#.', '')} as x, count(*) as c from {new} group by 1) cn on cn.x = {key.replace('#', 'o')} "
            "where co.c = 1 or cn.c = 1")


_key_a, _key_b = "#.nm || '|' || #.dob", "#.nm || '|' || substr(#.dob, 1, 4) || '|' || substr(#.ln, 1, 3)"
_uniq = lambda s: f"(select nm || '|' || dob as x, min(row) as row from g_{s} group by 1 having count(*) = 1)"
_TIERED = _GROUPED + [
    ("used", f"select o.row as o_row, n.row as n_row from {_uniq('old')} o join {_uniq('new')} n using (x)"),
    ("rest_old", "select * from g_old where row not in (select o_row from used)"),
    ("rest_new", "select * from g_new where row not in (select n_row from used)"),
    ("ta", _tier_sql(_key_a, "HIGH", 2, "g_old", "g_new")),
    ("tb", _tier_sql(_key_b, "MED", 1, "rest_old", "rest_new")),
]
_add("review_candidates_tiered",
     lambda s, d: review.review_candidates_tiered(_grouped_names(snap_old(s, d)), _grouped_names(snap_new(s, d)), r"^XW\d+$").select(
         "confidence", "score", "old_row", "new_row", "notes"),
     with_sql(samples._snapshots_sql() + _TIERED,
              "select confidence, score, old_row, new_row, case when n > 1 and hits = 1 then concat_ws('|', nullif(notes, ''), 'auto_preferred_wdX_id') "
              "when n > 1 and hits > 1 then concat_ws('|', nullif(notes, ''), 'multiple_wdX_candidates') else notes end as notes from (select *, "
              "count(*) over (partition by rid) as n, count(*) filter (regexp_matches(nw, '^XW\\d+$')) over (partition by rid) as hits, "
              "regexp_matches(nw, '^XW\\d+$') as pref from ta) where n <= 1 or hits <> 1 or pref "
              "union all select confidence, score, old_row, new_row, notes from tb"))


def _crowded_sql():
    """Members of keys that repeat on both sides; in tier A the single preferred id of a key is the partner of all its old rows."""
    parts = []
    for level, score, key, o, n in (("HIGH", 2, _key_a, "g_old", "g_new"), ("MED", 1, _key_b, "rest_old", "rest_new")):
        key = key.replace("#.", "")
        hits = "regexp_matches(worker_id, '^XW\\d+$')" if level == "HIGH" else "false"
        firsts = (f"(select * from (select {key} as key, count(*) as n_old, min(row) as first_old from {o} group by 1) join (select {key} as key, count(*) as n_new, min(row) as first_new, "
                  f"count(*) filter ({hits}) as hits, min(row) filter ({hits}) as pref from {n} group by 1) using (key) where n_old > 1 and n_new > 1)")
        shown = f"'{level}' as confidence, {score} as score, '{'1.0' if level == 'HIGH' else ''}' as name_similarity"
        parts.append(f"select 'old' as side, key, row, n_old, n_new, {shown}, case when hits = 1 then pref else first_new end as partner_row, "
                     f"case when hits = 1 then 'auto_preferred_wdX_id' when hits > 1 then 'multiple_wdX_candidates' end as notes from (select row, {key} as key from {o}) join {firsts} using (key)")
        parts.append(f"select 'new', key, row, n_old, n_new, {shown}, case when hits = 1 and not own then null else first_old end, null "
                     f"from (select row, {key} as key, {hits} as own from {n}) join {firsts} using (key)")
    return with_sql(samples._snapshots_sql() + _TIERED, " union all ".join(parts))


_add("crowded_candidates",
     lambda s, d: review.grouped_candidates(_grouped_names(snap_old(s, d)), _grouped_names(snap_new(s, d)), pattern=r"^XW\d+$"), _crowded_sql())


def decided(spark, sf_dir):
    """A reviewed list: the pairs with reviewer words and scores."""
    return pairs(spark, sf_dir).select(
        "old_worker_id", "new_worker_id", "old_dob", "new_dob", "old_full_name_norm", "match_source",
        F.expr("case match_source when 'worker_id' then 'skip' when 'pk' then 'Match ' when 'last4_dob' then 'yes' when 'dob_name' then 'no' "
               "when 'recon_id' then 'approved' else 'TRUE' end").alias("decision"),
        F.expr("case when match_source in ('pk', 'recon_id') then 'High' when match_source = 'name_hire_date' then 'med' else 'low' end").alias("confidence"),
        F.lit("0").alias("score"), F.lit("").alias("name_similarity"))


_add("finalize", lambda s, d: review.finalize(decided(s, d))[0].select("old_worker_id", "new_worker_id", "candidate_id"),
     pairs_sql("select old_worker_id, new_worker_id, substr(sha256(lower(old_worker_id) || '|' || lower(new_worker_id)), 1, 12) as candidate_id from pairs "
               "where match_source in ('pk', 'recon_id', 'name_hire_date') and old_dob = new_dob"))
_add("finalize_ambiguous", lambda s, d: review.finalize(decided(s, d).withColumn(
        "new_worker_id", F.when(F.col("match_source") == "recon_id", "SAME").otherwise(F.col("new_worker_id"))))[1].select("old_worker_id", "new_worker_id"),
     pairs_sql("select old_worker_id, 'SAME' as new_worker_id from pairs where match_source = 'recon_id' and old_dob = new_dob"))
_add("finalized_score", lambda s, d: summaries.finalized_score(
        review.finalize(decided(s, d))[0].withColumn("score", F.length("old_worker_id").cast("string"))),
     pairs_sql("select count(*) as finalized_count, round(avg(length(old_worker_id)), 4) as identity_confidence_score from pairs "
               "where match_source in ('pk', 'recon_id', 'name_hire_date') and old_dob = new_dob"))
_add("apply_decisions",
     lambda s, d: review.apply_decisions(
         pairs(s, d).where("match_source <> 'pk'").select("old_worker_id", "new_worker_id", "match_source"),
         decided(s, d).where("match_source in ('pk', 'dob_name')")),
     pairs_sql("select old_worker_id, new_worker_id, match_source from pairs"))
_add("merge_decisions",
     lambda s, d: review.merge_decisions(
         decided(s, d).select(F.col("old_worker_id").alias("old_recon_id"), F.nullif(F.col("decision"), F.lit("skip")).alias("decision")),
         pairs(s, d).where("match_source <> 'pk'").select(F.col("old_worker_id").alias("old_recon_id"), F.lit("fresh").alias("decision"), "new_worker_id")),
     pairs_sql("select old_worker_id as old_recon_id, case match_source when 'worker_id' then 'fresh' when 'pk' then 'Match ' when 'last4_dob' then 'yes' when 'dob_name' then 'no' "
               "when 'recon_id' then 'approved' else 'TRUE' end as decision, case when match_source <> 'pk' then new_worker_id end as new_worker_id from pairs"))
_add("confirmed_matches",
     lambda s, d: review.confirmed_matches(
         snap_old(s, d), snap_new(s, d),
         snap_old(s, d).select(F.col("src_ord").cast("string").alias("old_row_id"), F.col("src_ord").cast("string").alias("confirmed_new_row_id"),
                               F.when(F.col("k") % 3 == 0, "Confirm ").otherwise("skip").alias("decision"), F.lit("0.5").alias("confidence"))).select(
         "old_row_id", "new_row_id", "worker_id", "confidence", "old_full_name", "new_full_name"),
     snapshots_sql("select o.k as old_row_id, n.k as new_row_id, n.worker_id, 0.5::double as confidence, o.full_name_norm as old_full_name, "
                   "n.full_name_norm as new_full_name from snap_old o join snap_new n using (k) where k % 3 = 0"))
_add("suspicious_matches",
     lambda s, d: review.suspicious_matches(
         pairs(s, d).withColumn("new_full_name_norm", F.expr("if(old_worker_id like '%7', old_position, new_full_name_norm)")), method="edit").select("pair_id"),
     pairs_sql("select pair_id from (select *, case when old_worker_id like '%7' then old_position else new_full_name_norm end as nn from pairs) where "
               "old_last4_ssn <> '' and old_last4_ssn = new_last4_ssn and old_dob = new_dob and (case when old_full_name_norm = lower(nn) then 1 else "
               "1 - levenshtein(old_full_name_norm, lower(nn)) / greatest(length(old_full_name_norm), length(nn)) end) < 0.6"))
QUERIES["resolve_conflicting_candidates"] = lambda s, d: resolve.resolve_one_to_one(
    review.review_pairs_last4(snap_old(s, d), snap_new(s, d), method="edit").select(
        "old_worker_id", "new_worker_id", F.lit("last4_dob").alias("match_source"),
        candidate_order(F.col("old_row"), F.col("new_row")).alias("cand_ord"))).pairs.select("old_worker_id", "new_worker_id", "pair_id")

# ---------------------------------------------------------------- differences

_FIELDS = ["salary", "payrate", "worker_status", "hire_date", "position", "location_state", "cost_center"]


def _matches(spark, sf_dir):
    old, new = snap_old(spark, sf_dir), snap_new(spark, sf_dir)
    links = old.join(new.select("src_ord"), "src_ord", "left_semi").select(
        F.col("src_ord").alias("old_row_id"), F.col("src_ord").alias("new_row_id"))
    return old, new, links


def _diff(spark, sf_dir):
    return diff.diff_pairs(*_matches(spark, sf_dir), _FIELDS)


def _severity_sql(f):
    if f in ("salary", "payrate"):
        gap = f"abs(try_cast(nullif(o.{f}, '') as double) - try_cast(nullif(n.{f}, '') as double))"
        return f"case when {gap} <= 0.01 then 'green' when {gap} <= 1 then 'yellow' when {gap} > 1 then 'red' when (o.{f} = '') <> (n.{f} = '') then 'red' else 'yellow' end"
    return "'red'" if f in diff.HIGH_RISK_FIELDS else "'yellow'"


_DIFF_SQL = " union all ".join(
    f"select k as old_row_id, k as new_row_id, '{f}' as field, o.{f} as old_value, n.{f} as new_value, {_severity_sql(f)} as severity "
    f"from snap_old o join snap_new n using (k) where lower(trim(o.{f})) <> lower(trim(n.{f}))" for f in _FIELDS)
_add("diff_pairs", _diff, snapshots_sql(f"select * from ({_DIFF_SQL}) where severity <> 'green'"))
_TREND_ROWS = f"(select field, old_value, new_value, lpad(old_row_id::varchar, 19, '0') as rk from ({_DIFF_SQL}) where severity <> 'green')"
_TOTAL = f"(select count(distinct rk) from {_TREND_ROWS})"


def _trend_sql(kind, keys, delta, where):
    shown = {"field": "field", "old_value": "''" if delta else "old_value", "new_value": "''" if delta else "new_value"}
    return (f"select '{kind}' as pattern_type, {', '.join(f'{e} as {c}' for c, e in shown.items())}, {'delta' if delta else 'null::double'} as delta, count(*) as count, "
            f"round(count(*) / {_TOTAL} * 100, 1)::varchar || '%' as percent_of_matched, string_agg(rk, ', ' order by rk) filter (rn <= 3) as sample_record_keys "
            f"from (select *, row_number() over (partition by {keys} order by rk) as rn from (select *, try_cast(nullif(new_value, '') as double) - "
            f"try_cast(nullif(old_value, '') as double) as delta from {_TREND_ROWS}) where {where}) group by {keys} having count(*) >= 2")


_add("trends", lambda s, d: diff.trends(_diff(s, d).withColumn(
        "record_key", F.lpad(F.col("old_row_id").cast("string"), 19, "0"))).drop("possible_reason"),
     snapshots_sql(_trend_sql("repeated_numeric_difference", "field, delta", True, "field in ('salary', 'payrate') and delta is not null")
                   + " union all " + _trend_sql("repeated_value_change", "field, old_value, new_value", False, "true")))
_KEYS = {"worker_id": ("worker_id",), "recon_id": ("recon_id",), "name_dob": ("full_name_norm", "dob"), "last4_dob": ("last4_ssn", "dob")}


def _overlap_sql(name, parts):
    value = " || '|' || ".join(parts)
    one = lambda s: f"(select distinct {value} as v from snap_{s} where {value} <> '')"
    return (f"select '{name}' as key_name, (select count(*) from {one('old')}) as unique_old, (select count(*) from {one('new')}) as unique_new, "
            f"(select count(*) from {one('old')} join {one('new')} using (v)) as overlap, "
            + ", ".join(f"(select count(*) from snap_{s} where {value} = '') as blank_{s}, (select round(100 * count(*) filter ({value} = '') / count(*), 2) "
                        f"from snap_{s}) as blank_{s}_pct" for s in ("old", "new")))


_add("key_overlap", lambda s, d: diff.key_overlap(snap_old(s, d), snap_new(s, d), _KEYS),
     snapshots_sql(" union all ".join(_overlap_sql(n, p) for n, p in _KEYS.items())))
_add("shared_values", lambda s, d: diff.shared_values(snap_old(s, d), snap_new(s, d), "last_name_norm"),
     snapshots_sql("select distinct last_name_norm from snap_old where last_name_norm in (select last_name_norm from snap_new)"))
_add("keys_only_in_old", lambda s, d: diff.only_in(snap_old(s, d), snap_new(s, d), ["last4_ssn", "dob"]),
     snapshots_sql("select distinct last4_ssn, dob from snap_old where (last4_ssn, dob) not in (select (last4_ssn, dob) from snap_new)"))

# ---------------------------------------------------------------- compensation bands


def band_table(spark, sf_dir):
    """Bands from the part table: titles of a few words with limits, some with a state."""
    rows = table(spark, sf_dir, "part")
    return bands.load_bands(rows.select(
        F.col("p_type").alias("Title"), F.expr("if(p_size % 3 = 0, 'TX', '')").alias("state"),
        F.expr("string(p_size * 2000)").alias("min"), F.expr("string(p_size * 2000 + 30000)").alias("max"),
        F.col("p_partkey").alias("ord")), order="ord")


# Titles of pairs: as in the band table, with the words turned around, with a word more, with letters lost or changed, none.
_TITLED = ("case p_partkey % 6 when 0 then p_type when 1 then array_join(reverse(split(p_type, ' ')), '  ') when 2 then concat(p_type, ' EXTRA') "
           "when 3 then replace(replace(p_type, 'ED', 'D'), 'A', 'E') when 4 then concat(substring(p_type, 2, 99), ' I') else '' end")
_TITLED_SQL = ("case p_partkey % 6 when 0 then p_type when 1 then array_to_string(list_reverse(string_split(p_type, ' ')), ' ') when 2 then p_type || ' EXTRA' "
               "when 3 then replace(replace(p_type, 'ED', 'D'), 'A', 'E') when 4 then substr(p_type, 2, 99) || ' I' else '' end")


def positioned(spark, sf_dir):
    """Decided pairs whose titles come from the part table."""
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.expr(_TITLED).alias("t"))
    rows = gated(spark, sf_dir).withColumn("pk", F.expr("substring(old_worker_id, 2)").cast("bigint"))
    return rows.join(types, "pk").withColumns({
        "new_position": F.col("t"), "old_position": F.lit(""),
        "new_location_state": F.expr("if(pk % 2 = 0, 'tx', '')"), "old_location_state": F.lit("")})


_BANDS = [
    ("b", "select p_partkey as ord, lower(p_type) as tk, p_type as title, case when p_size % 3 = 0 then 'tx' else '' end as sk, p_size * 2000.0::double as lo, "
          "p_size * 2000.0::double + 30000 as hi from part"),
    ("pos", "select g.pair_id, g.new_salary, g.action, g.reason, t.tk, t.sk from (select *, substr(old_worker_id, 2)::bigint as pk from gated) g join "
            f"(select p_partkey as pk, lower({_TITLED_SQL}) as tk, case when p_partkey % 2 = 0 then 'tx' else '' end as sk from part) t using (pk)"),
    ("keys", "select distinct tk, sk from pos where tk <> ''"),
    ("two", f"select a.tk, b.tk as bt, {SORTED_SQL.format(t='a.tk')} as x, {SORTED_SQL.format(t='b.tk')} as y from (select distinct tk from keys) a, (select distinct tk from b) b"),
    ("alike", f"select *, length(x) + length(y) as both_, {LCS_SQL.format(x='x', y='y')} as common from two"),
    ("near", "select kk.tk, kk.sk, b.ord, b.sk as bsk, 1 - (both_ - 2 * common) / both_ as sc from keys kk join alike on alike.tk = kk.tk join b on b.tk = alike.bt"),
    ("pick", "select tk, sk, coalesce((select min(ord) from b where b.tk = keys.tk and b.sk = keys.sk and keys.sk <> ''), "
             "(select min(ord) from b where b.tk = keys.tk), "
             "(select arg_min(ord, (-sc, ord)) from near where near.tk = keys.tk and near.sk = keys.sk and near.bsk = keys.sk and keys.sk <> '' and sc >= 0.85), "
             "(select arg_min(ord, (-sc, ord)) from near where near.tk = keys.tk and near.sk = keys.sk and sc >= 0.85)) as ord from keys"),
]
_sal = "try_cast(nullif(p.new_salary, '') as double)"
_status = (f"case when b.ord is null or {_sal} is null then 'no_band_found' when {_sal} < b.lo then 'below_band_min' when {_sal} > b.hi then 'above_band_max' "
           "else 'within_band' end")
_add("comp_band_annotate",
     lambda s, d: bands.comp_band_annotate(positioned(s, d), band_table(s, d)).select(
         "pair_id", "comp_band_status", "comp_band_min", "comp_band_max", "comp_band_match", "action", "reason"),
     gated_sql(f"select pair_id, s as comp_band_status, lo as comp_band_min, hi as comp_band_max, coalesce(title, '') as comp_band_match, "
               "case when out then 'REVIEW' else action end as action, case when out then reason || '|comp_band:' || s || ' (' || title || ')' else reason end as reason "
               f"from (select *, s in ('below_band_min', 'above_band_max') and action <> 'REJECT_MATCH' as out from (select p.*, b.lo, b.hi, b.title, {_status} as s "
               "from pos p left join pick on pick.tk = p.tk and pick.sk = p.sk left join b on b.ord = pick.ord))", more=_BANDS))

# ---------------------------------------------------------------- sinks

_add("department_slugs", lambda s, d: sinks.department_slugs(
        table(s, d, "nation").withColumn("department", F.expr("if(n_nationkey % 2 = 0, concat(n_name, '!'), concat(substr(n_name, 1, 1), ' & co'))"))),
     "select department, case when n = 1 then base else base || '_' || n end as dept_slug from (select *, row_number() over (partition by base order by department) as n "
     "from (select department, trim(regexp_replace(lower(department), '[^a-z0-9]+', '_', 'g'), '_') as base from (select distinct case when n_nationkey % 2 = 0 then "
     "n_name || '!' else substr(n_name, 1, 1) || ' & co' end as department from nation)))")
_add("formula_safe_table", lambda s, d: sinks.formula_safe_table(table(s, d, "supplier").select(
        "s_suppkey", F.concat(F.get(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "")]), (F.col("s_suppkey") % 5).cast("int")), F.col("s_name")).alias("cell"))),
     "select s_suppkey, case when s_suppkey % 5 = 4 then s_name else '''' || ['=', '+', '-', '@', ''][(s_suppkey % 5)::integer + 1] || s_name end as cell from supplier")



_add("read_snapshot",
     lambda s, d: snapshots.read_snapshot(s, f"{d}/customer.parquet", "parquet").drop("c_acctbal"),
     "select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey, c_mktsegment, "
     "row_number() over (order by c_custkey) - 1 as src_ord from customer")


def _to_clean(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k, F.expr("concat(if(c_custkey % 2 = 0, 'Mike', 'Ann'), ' ', c_mktsegment)").alias("name"),
        F.expr("if(c_custkey % 3 = 0, string(20000 + c_custkey % 20000), '20200131')").alias("dob"),
        F.expr("concat('Big Town, ', if(c_custkey % 2 = 0, 'Texas', 'NY'))").alias("location"),
        F.expr("concat(c_custkey, ' Main Street')").alias("address"), F.expr("lpad(c_custkey % 10000, 4, '0')").alias("last4_ssn"),
        F.lit("Full-Time").alias("worker_type"))


_add("clean_columns", lambda s, d: snapshots.clean_columns(_to_clean(s, d)).select(
        "c_custkey", "full_name_norm", "dob", "location_city", "location_state", "address_norm", "last4_ssn", "worker_type", "birth_year",
        "last_name_prefix3", "recon_id"),
     "select *, substr(dob, 1, 4) as birth_year, substr(split_part(full_name_norm, ' ', 2), 1, 3) as last_name_prefix3, "
     "substr(sha1(full_name_norm || '|' || dob || '|' || last4_ssn), 1, 12) as recon_id from (select c_custkey, "
     "case when c_custkey % 2 = 0 then 'michael ' else 'ann ' end || lower(c_mktsegment) as full_name_norm, "
     "case when c_custkey % 3 = 0 then (date '1899-12-30' + (20000 + c_custkey % 20000)::integer)::varchar else '2020-01-31' end as dob, "
     "'big town' as location_city, case when c_custkey % 2 = 0 then 'tx' else 'ny' end as location_state, c_custkey || ' main st' as address_norm, "
     "lpad((c_custkey % 10000)::varchar, 4, '0') as last4_ssn, 'regular' as worker_type from customer)")
_add("trim_empty_columns",
     lambda s, d: out.trim_empty_columns(pairs(s, d).select("pair_id", "old_suffix", "new_suffix", "old_middle_name", "old_payrate"),
                                         ["old_suffix", "new_suffix", "old_middle_name"]),
     pairs_sql("select pair_id, old_middle_name, old_payrate from pairs"))
_add("wave_table", lambda s, d: summaries.wave_table(gated(s, d)),
     gated_sql("select new_hire_date, count(*) as count from gated group by 1 having count(*) >= greatest(2, floor((select count(*) from gated) * 0.01)) "
               "order by count desc, new_hire_date limit 6"))


def _run_stats(spark, sf_dir):
    g = gated(spark, sf_dir)
    old, new = snap_old(spark, sf_dir), snap_new(spark, sf_dir)
    left = old.join(g.select(F.col("old_worker_id").alias("worker_id")), "worker_id", "left_anti")
    right = new.join(g.select(F.col("new_worker_id").alias("worker_id")), "worker_id", "left_anti")
    friendly = out.friendly_review(g)
    identity = out.identity_conflicts(friendly, pairs(spark, sf_dir).limit(0))
    return summaries.run_stats(g, friendly, identity, left, right, {"passed": True, "reasons": []}, "r1")


_add("run_stats", _run_stats, gated_sql(
    "select 'r1' as run_id, (select count(*) from gated) as total_matched_pairs, (select count(*) from gated where action = 'APPROVE') as auto_approved_pairs, "
    "count(*) as review_required_pairs, (select count(*) from snap_old where k not in (select old_k from links)) as unmatched_from_old_system, "
    "(select count(*) from snap_new where k not in (select new_k from links)) as unmatched_from_new_system, count(*) filter (f_salary or f_payrate) as salary_issues, "
    "count(*) filter (f_status) as employee_status_issues, count(*) filter (f_hire_date) as hire_date_issues, count(*) filter (f_job_org) as job_and_organization_issues, "
    "count(*) filter (match_source <> 'worker_id' or name_change_detected) as identity_conflicts, 'Yes' as gate_passed, '' as gate_reason, "
    "(select count(*) from snap_old where k not in (select old_k from links)) + (select count(*) from snap_new where k not in (select new_k from links)) as total_unmatched "
    "from gated where action = 'REVIEW'"))
