"""Two snapshots and an audit table derived from the given tables.

Each derived table is defined twice, as a DataFrame and as DuckDB text, so that
a registered query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import TIERS, match_report, pair_rows, tiered_match
from ..operators.resolve import resolve_one_to_one
from ..sources.staging import materialize

EXTRAS = ("cost_center", "company", "department")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes from a table dealt by ``spread_in_tasks``.
TASK_ROWS = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key: a file of small rows is a task or two, however much is computed for each row."""
    return rows.repartition(key)


def spread_in_tasks(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key, so many to a task however many there are.

    For tables of much work per row: without a number of tasks Spark merges the
    dealt rows again by their few bytes, and a task's rows grow with the table.
    """
    return rows.repartition(max(2, -(-rows.count() // TASK_ROWS)), key)


def _padded(key: str, digits: int) -> tuple[str, str]:
    """A key with leading zeros, never cut, for Spark and DuckDB."""
    return (f"lpad({key}, greatest({digits}, length({key})), '0')", f"lpad(({key})::varchar, greatest({digits}, length(({key})::varchar))::integer, '0')")


_K6, _S6, _S4 = _padded("k", 6), _padded("s_suppkey", 6), _padded("s_suppkey", 4)
# Row numbers of new-only rows follow those of any number of customers.
HIRED_FROM = 1_000_000_000_000

# Column -> (Spark expression, DuckDB expression) over customer joined with nation, k = c_custkey.
_SAME = object()
OLD = {
    "worker_id": (f"concat('W', {_K6[0]})", f"'W' || {_K6[1]}"),
    "recon_id": (f"if(k % 5 = 0, concat('R', {_K6[0]}), '')", f"case when k % 5 = 0 then 'R' || {_K6[1]} else '' end"),
    "full_name_norm": ("lower(c_name)", _SAME),
    "first_name_norm": ("concat('fn', k % 90)", "'fn' || (k % 90)"),
    "last_name_norm": ("concat('ln', k % 800)", "'ln' || (k % 800)"),
    "middle_name": ("if(k % 6 = 0, 'q', '')", "case when k % 6 = 0 then 'q' else '' end"),
    "suffix": ("''", _SAME),
    "dob": ("string(date_add(date'1950-01-01', int(k * 37 % 14000)))",
            "(date '1950-01-01' + (k * 37 % 14000)::integer)::varchar"),
    "hire_date": ("string(date_add(date'2005-01-01', int(k * 13 % 6000)))",
                  "(date '2005-01-01' + (k * 13 % 6000)::integer)::varchar"),
    "last4_ssn": ("lpad(k * 7919 % 10000, 4, '0')", "lpad((k * 7919 % 10000)::varchar, 4, '0')"),
    "salary": ("string(40000 + k * 977 % 90000)", "(40000 + k * 977 % 90000)::varchar"),
    "payrate": ("if(k % 4 = 0, string(20 + k % 30), '')",
                "case when k % 4 = 0 then (20 + k % 30)::varchar else '' end"),
    "position": ("concat('P', k % 12)", "'P' || (k % 12)"),
    "district": ("c_mktsegment", _SAME),
    "location_state": ("upper(substr(n_name, 1, 2))", _SAME),
    "worker_status": ("case when k % 10 < 8 then 'active' when k % 10 = 8 then 'inactive' else 'pending' end",
                      _SAME),
    "worker_type": ("if(k % 9 = 0, 'contingent', 'regular')",
                    "case when k % 9 = 0 then 'contingent' else 'regular' end"),
    "cost_center": ("concat('CC', k % 50)", "'CC' || (k % 50)"),
    "company": ("concat('CO', k % 3)", "'CO' || (k % 3)"),
    "department": ("c_mktsegment", _SAME),
}
# Expressions over the old columns; a column not listed is unchanged.
NEW = {
    "worker_id": ("if(k % 17 between 1 and 5, concat('X', worker_id), worker_id)",
                  "case when k % 17 between 1 and 5 then 'X' || worker_id else worker_id end"),
    "recon_id": ("if(k % 17 = 1, '', recon_id)", "case when k % 17 = 1 then '' else recon_id end"),
    "full_name_norm": (
        "case when k % 17 = 3 then concat(full_name_norm, ' jr') "
        "when k % 17 = 5 then concat(full_name_norm, ' x') else full_name_norm end",
        "case when k % 17 = 3 then full_name_norm || ' jr' "
        "when k % 17 = 5 then full_name_norm || ' x' else full_name_norm end"),
    "last_name_norm": ("if(k % 61 = 0, concat('mc', last_name_norm), last_name_norm)",
                       "case when k % 61 = 0 then 'mc' || last_name_norm else last_name_norm end"),
    "dob": ("if(k % 17 = 5, string(date_add(date(dob), 1)), dob)",
            "case when k % 17 = 5 then (dob::date + 1)::varchar else dob end"),
    "last4_ssn": ("if(k % 17 in (4, 5), '9999', last4_ssn)",
                  "case when k % 17 in (4, 5) then '9999' else last4_ssn end"),
    "hire_date": (
        "case when k % 11 = 0 then string(date_add(date(hire_date), 1)) "
        "when k % 23 = 0 then string(date_add(date(hire_date), 365)) "
        "when k % 31 = 0 then '2026-02-01' when k % 67 = 0 then '' else hire_date end",
        "case when k % 11 = 0 then (hire_date::date + 1)::varchar "
        "when k % 23 = 0 then (hire_date::date + 365)::varchar "
        "when k % 31 = 0 then '2026-02-01' when k % 67 = 0 then '' else hire_date end"),
    "salary": (
        "case when k % 7 = 0 then string(int(salary) + int(salary) div 20) "
        "when k % 97 = 0 then string(int(salary) * 3) when k % 113 = 0 then '0' "
        "when k % 71 = 0 then '' else salary end",
        "case when k % 7 = 0 then (salary::integer + salary::integer // 20)::varchar "
        "when k % 97 = 0 then (salary::integer * 3)::varchar when k % 113 = 0 then '0' "
        "when k % 71 = 0 then '' else salary end"),
    "payrate": (
        "case when payrate = '' then '' when k % 13 = 0 then string(int(payrate) + 1) "
        "when k % 52 = 8 then string(int(salary) div 2080) else payrate end",
        "case when payrate = '' then '' when k % 13 = 0 then (payrate::integer + 1)::varchar "
        "when k % 52 = 8 then (salary::integer // 2080)::varchar else payrate end"),
    "position": ("if(k % 19 = 0, 'P99', position)", "case when k % 19 = 0 then 'P99' else position end"),
    "location_state": ("if(k % 37 = 0, 'ZZ', location_state)",
                       "case when k % 37 = 0 then 'ZZ' else location_state end"),
    "worker_status": ("if(k % 43 = 0, 'terminated', worker_status)",
                      "case when k % 43 = 0 then 'terminated' else worker_status end"),
    "worker_type": ("if(k % 59 = 0, 'contractor', worker_type)",
                    "case when k % 59 = 0 then 'contractor' else worker_type end"),
    "cost_center": ("if(k % 47 = 0, 'CC99', cost_center)",
                    "case when k % 47 = 0 then 'CC99' else cost_center end"),
}
# New-only rows, one per supplier.
HIRED_ONLY = {
    "worker_id": (f"concat('S', {_S6[0]})", f"'S' || {_S6[1]}"),
    "full_name_norm": ("lower(s_name)", _SAME),
    "last_name_norm": ("concat('sup', s_suppkey % 800)", "'sup' || (s_suppkey % 800)"),
    "dob": ("'1980-01-01'", _SAME), "hire_date": ("'2015-01-01'", _SAME),
    "last4_ssn": _S4,
    "salary": ("'50000'", _SAME), "location_state": ("'ZZ'", _SAME),
    "worker_status": ("'active'", _SAME), "worker_type": ("'regular'", _SAME),
    "district": ("'SUPPLY'", _SAME),
}


def _pick(pair: tuple, duck: bool) -> str:
    return pair[1] if duck and pair[1] is not _SAME else pair[0]


def snap_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = spread(table(spark, sf_dir, "customer"), "c_custkey").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    people = people.withColumn("k", F.col("c_custkey"))
    return people.select(
        F.col("k").alias("src_ord"), "k", *[F.expr(_pick(e, False)).alias(c) for c, e in OLD.items()]
    )


def snap_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = snap_old(spark, sf_dir).where("k % 41 <> 0")
    moved = old.select(
        "src_ord", "k", *[F.expr(_pick(NEW[c], False)).alias(c) if c in NEW else F.col(c) for c in OLD]
    )
    hired = spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(
        F.expr(f"{HIRED_FROM} + s_suppkey").alias("src_ord"), F.expr(f"{HIRED_FROM} + s_suppkey").alias("k"),
        *[F.expr(_pick(HIRED_ONLY[c], False) if c in HIRED_ONLY else "''").alias(c) for c in OLD],
    )
    return moved.unionByName(hired)


def _select_list(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} as {c}" for c, e in exprs.items())


def _snapshots_sql() -> list[tuple[str, str]]:
    old = _select_list({c: _pick(e, True) for c, e in OLD.items()})
    new = _select_list({c: _pick(NEW[c], True) if c in NEW else c for c in OLD})
    hired = _select_list({c: _pick(HIRED_ONLY[c], True) if c in HIRED_ONLY else "''" for c in OLD})
    return [
        ("snap_old", f"select k, {old} from (select c_custkey as k, * from customer "
                     "join nation on c_nationkey = n_nationkey)"),
        ("snap_new", f"select k, {new} from snap_old where k % 41 <> 0 union all by name "
                     f"select {HIRED_FROM} + s_suppkey as k, {hired} from supplier"),
    ]


def _key_sql(columns: tuple[str, ...]) -> str:
    parts = [f"lower(trim({c}))" if c in ("worker_id", "recon_id") else f"trim({c})" for c in columns]
    return f"nullif({parts[0]}, '')" if len(parts) == 1 else " || '|' || ".join(parts)


def _tiers_sql() -> list[tuple[str, str]]:
    steps, before = [], []
    for i, (source, columns) in enumerate(TIERS):
        sides = []
        for side in ("old", "new"):
            used = "".join(
                f" and k not in (select {side}_k from tier{j})" for j in before
            )
            sides.append(
                f"(select {_key_sql(columns)} as x, min(k) as {side}_k from snap_{side} "
                f"where trim(worker_id) <> '' and {_key_sql(columns)} is not null{used} "
                "group by 1 having count(*) = 1)"
            )
        steps.append((
            f"tier{i}",
            f"select old_k, new_k, '{source}' as match_source, {i} as tier "
            f"from {sides[0]} o join {sides[1]} n using (x)",
        ))
        before.append(i)
    union = " union all ".join(f"select * from tier{i}" for i in before)
    return steps + [("links", union)]


PAIRED = [c for c in OLD]


def _pairs_sql() -> tuple[str, str]:
    sides = ", ".join(f"o.{c} as old_{c}, n.{c} as new_{c}" for c in PAIRED)
    similar = (
        "case when old_full_name_norm = new_full_name_norm then 1.0 "
        "else 2.0 * length(old_full_name_norm) / "
        "(length(old_full_name_norm) + length(new_full_name_norm)) end"
    )
    same = lambda f: f"(case when old_{f} <> '' and old_{f} = new_{f} then 1 else 0 end)"
    score = (
        f"round(({similar}) * 0.5 + {same('dob')} * 0.2::double + {same('last4_ssn')} * 0.2::double "
        f"+ {same('location_state')} * 0.1::double, 4)"
    )
    return (
        "pairs",
        "select *, substr(sha256(old_worker_id || '|' || new_worker_id), 1, 12) as pair_id, "
        f"case when match_source in ('worker_id', 'recon_id') then 1.0::double else {score} end as confidence, "
        "old_last_name_norm <> '' and new_last_name_norm <> '' "
        "and old_last_name_norm <> new_last_name_norm as name_change_detected, "
        "case match_source when 'worker_id' then 100 when 'recon_id' then 90 when 'pk' then 80 "
        "when 'last4_dob' then 70 when 'dob_name' then 60 else 50 end::integer as source_score, "
        "(case when old_worker_id = new_worker_id then 1 else 0 end)::integer as exact_worker_id "
        f"from (select l.match_source, l.tier, l.old_k, l.new_k, {sides} from links l "
        "join snap_old o on o.k = l.old_k join snap_new n on n.k = l.new_k)",
    )


def with_sql(steps: list[tuple[str, str]], body: str) -> str:
    ctes = ", ".join(f"{name} as materialized ({query})" for name, query in steps)
    return f"with {ctes} {body}"


def snapshots_sql(body: str) -> str:
    return with_sql(_snapshots_sql(), body)


def links_sql(body: str) -> str:
    return with_sql(_snapshots_sql() + _tiers_sql(), body)


def pairs_sql(body: str, more: list[tuple[str, str]] | None = None) -> str:
    return with_sql(_snapshots_sql() + _tiers_sql() + [_pairs_sql()] + list(more or []), body)


def match_all(spark: SparkSession, sf_dir: str):
    return tiered_match(snap_old(spark, sf_dir), snap_new(spark, sf_dir))


def compute_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match, pair and resolve; what a full run does before any report."""
    old, new = snap_old(spark, sf_dir), snap_new(spark, sf_dir)
    candidates = materialize(pair_rows(tiered_match(old, new), old, new, EXTRAS), "candidates")
    return resolve_one_to_one(candidates).pairs


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table of this session that several reports read, built on first use.

    A full run stores the pairs and the decisions once and fans out from them.
    """
    key = (spark.conf.get("spark.app.id", ""), sf_dir, name)
    if key not in _STORED:
        _STORED[key] = materialize(build(), name)
    return _STORED[key]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "pairs", lambda: compute_pairs(spark, sf_dir))


def forget() -> None:
    """Make the next use build the stored tables again."""
    _STORED.clear()


__all__ = [
    "EXTRAS", "compute_pairs", "forget", "links_sql", "match_all", "match_report", "pairs",
    "pairs_sql", "snap_new", "snap_old", "snapshots_sql", "spread", "spread_in_tasks", "stored", "table", "with_sql",
]
