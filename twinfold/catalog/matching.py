"""Registered queries of the matching step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match
from . import samples
from .samples import links_sql, pairs_sql, snap_new, snap_old

QUERIES, SQL = {}, {}


def _tier1(spark, sf_dir):
    old, new = snap_old(spark, sf_dir), snap_new(spark, sf_dir)
    links, old_left, new_left = match.unique_key_join(old, new, ("worker_id",), "worker_id")
    part = lambda df, label: df.select(F.lit(label).alias("part"), F.col("src_ord").alias("k"))
    return part(links.withColumnRenamed("old_row", "src_ord"), "matched").unionByName(
        part(old_left, "old_left")).unionByName(part(new_left, "new_left"))


QUERIES["unique_key_join"] = _tier1
SQL["unique_key_join"] = links_sql("""
select 'matched' as part, old_k as k from tier0
union all select 'old_left', k from snap_old where k not in (select old_k from tier0)
union all select 'new_left', k from snap_new where k not in (select new_k from tier0)""")

QUERIES["tiered_match"] = lambda s, d: samples.match_all(s, d).links.select(
    F.col("old_row").alias("old_k"), F.col("new_row").alias("new_k"), "match_source")
SQL["tiered_match"] = links_sql("select old_k, new_k, match_source from links")


def _unmatched(spark, sf_dir):
    result = samples.match_all(spark, sf_dir)
    rows = lambda df, side: df.select(F.lit(side).alias("side"), "worker_id", "unmatched_reason")
    return rows(result.unmatched_old, "old").unionByName(rows(result.unmatched_new, "new"))


QUERIES["unmatched_rows"] = _unmatched
SQL["unmatched_rows"] = links_sql("""
select 'old' as side, worker_id, case when trim(worker_id) = '' then 'no_id' else 'no_match_found' end
  as unmatched_reason from snap_old where k not in (select old_k from links)
union all select 'new', worker_id, case when trim(worker_id) = '' then 'no_id' else 'no_match_found' end
  from snap_new where k not in (select new_k from links)""")

QUERIES["match_report"] = lambda s, d: match.match_report(samples.match_all(s, d))
SQL["match_report"] = links_sql(
    "select (select count(*) from links) as matched_total, "
    + ", ".join(f"(select count(*) from links where match_source = '{t}') as matched_by_{t}"
                for t, _ in match.TIERS)
    + ", (select count(*) from snap_old where k not in (select old_k from links)) as unmatched_old"
      ", (select count(*) from snap_new where k not in (select new_k from links)) as unmatched_new"
)

QUERIES["pair_confidence"] = lambda s, d: samples.pairs(s, d).select(
    "pair_id", "match_source", "confidence", "name_change_detected")
SQL["pair_confidence"] = pairs_sql(
    "select pair_id, match_source, confidence, name_change_detected from pairs")

_COLUMNS = [f"{p}_{c}" for c in samples.PAIRED for p in ("old", "new")]
QUERIES["resolved_pairs"] = lambda s, d: samples.compute_pairs(s, d).select(
    "pair_id", "match_source", "source_score", "exact_worker_id", *_COLUMNS)
SQL["resolved_pairs"] = pairs_sql(
    "select pair_id, match_source, source_score, exact_worker_id, " + ", ".join(_COLUMNS) + " from pairs")
