"""Distributions of the mismatches, suspicious defaults, and the gate on them."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blanks import folded, text
from ..functions.dates import day_gap
from ..functions.numbers import (
    DAY_BUCKETS, SALARY_BUCKETS, bucket_day_gap, bucket_salary_delta, parse_money,
)
from ..policy import load_policy
from .gate import fixed
from .outputs import active_zero
from .quantiles import exact_quantiles
from .ranking import examples, first_n
from .waves import wave_dates

# Placeholder salaries and hire date prefixes of extraction defaults.
PLACEHOLDER_SALARIES = (40000.0, 40003.0, 40013.0, 40073.0)
DEFAULT_PREFIXES = ("2026-02-", "2026-03-")
DETERMINISTIC = ("worker_id", "pk", "recon_id")
_LISTED = ("pair_id", "match_source", "old_worker_id", "new_worker_id", "old_full_name_norm",
           "old_hire_date", "new_hire_date", "old_salary", "new_salary")


def _labels(df: DataFrame, buckets, name: str) -> DataFrame:
    """The fixed list of bucket labels as a table, so that empty buckets appear too."""
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(b[0]).alias(name)) for i, b in enumerate(buckets)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("b")).select("b.*")


def salary_delta_buckets(pairs: DataFrame) -> DataFrame:
    """Per bucket of the absolute change: count, direction, mean, median and 90th percentile.

    Equal deltas are counted before the quantiles are taken, so a bucket that
    holds most pairs sends one row per distinct delta and task.
    """
    delta = parse_money("new_salary") - parse_money("old_salary")
    counted = (
        pairs.select(delta.alias("d")).where("d <> 0").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"size": F.abs("d"), "bucket_label": bucket_salary_delta(F.abs("d"))})
    )
    stats = counted.groupBy("bucket_label").agg(
        F.sum("n").alias("count"),
        F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("increase_count"),
        F.sum(F.when(F.col("d") < 0, F.col("n")).otherwise(0)).alias("decrease_count"),
        F.bround(F.sum(F.col("size") * F.col("n")) / F.sum("n"), 2).alias("avg_abs_delta"),
    )
    shares = {"p50_abs_delta": 0.5, "p90_abs_delta": 0.9}
    ranked = exact_quantiles(counted, ["bucket_label"], "size", "n", shares)
    stats = stats.join(ranked, "bucket_label").withColumns({name: F.bround(name, 2) for name in shares})
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("count", "increase_count", "decrease_count")}
    zero |= {c: F.coalesce(c, F.lit(0.0)) for c in ("avg_abs_delta", "p50_abs_delta", "p90_abs_delta")}
    labels = _labels(pairs, SALARY_BUCKETS, "bucket_label")
    return labels.join(stats, "bucket_label", "left").withColumns(zero).orderBy("at").drop("at")


def hire_date_buckets(pairs: DataFrame, sample: int = 3) -> DataFrame:
    """Per bucket of the day gap: count and the first example pairs."""
    rows = pairs.select("pair_id", day_gap("old_hire_date", "new_hire_date").alias("gap")).where("gap > 0")
    rows = rows.withColumn("days_diff_bucket", bucket_day_gap(F.col("gap")))
    counts = rows.groupBy("days_diff_bucket").agg(F.count(F.lit(1)).alias("count"))
    few = examples(rows, ["days_diff_bucket"], "pair_id", "pair_id", sample)
    labels = _labels(pairs, DAY_BUCKETS, "days_diff_bucket")
    joined = labels.join(counts, "days_diff_bucket", "left").join(few, "days_diff_bucket", "left")
    return joined.select(
        "days_diff_bucket", F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce(F.array_join("examples", "|"), F.lit("")).alias("examples"), "at",
    ).orderBy("at").drop("at")


def _grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def suspicious_defaults(pairs: DataFrame, min_rate: float = 0.01) -> DataFrame:
    """One row per pair and suspicion: placeholder salary, default hire date, wave date."""
    salary, hired = parse_money("old_salary"), text("old_hire_date")
    found = F.array_compact(F.array(
        F.when(salary.isin(*PLACEHOLDER_SALARIES), F.struct(
            F.lit("salary_suspicious_default").alias("issue_type"),
            F.concat(F.lit("old_salary="), fixed(salary, 0), F.lit(" is a known placeholder value")).alias("notes"))),
        _default_date(hired),
    ))
    listed = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _LISTED]
    flagged = pairs.select(*listed, F.explode(found).alias("f")).select("f.issue_type", *_LISTED, "f.notes")
    waves = wave_dates(pairs, min_rate).withColumnRenamed("new_hire_date", "_wave")
    rate = F.concat(fixed(F.col("wave_count") / F.col("total_pairs") * 100, 2), F.lit("%"))
    # At most 1 / min_rate dates can hold that share each; without a bound on that, sizes decide how to join.
    waves = F.broadcast(waves) if min_rate >= 0.0001 else waves
    wave_rows = pairs.select(*listed).join(waves, text("new_hire_date") == F.col("_wave")).select(
        F.lit("hire_date_wave").alias("issue_type"), *_LISTED,
        F.concat(
            F.lit("new_hire_date="), F.col("_wave"), F.lit(" shared by "), _grouped(F.col("wave_count")),
            F.lit("/"), _grouped(F.col("total_pairs")), F.lit(" pairs ("), rate,
            F.lit(") - possible import wave"),
        ).alias("notes"),
    )
    return flagged.unionByName(wave_rows)


def _default_date(hired: Column) -> Column:
    """The first matching prefix only."""
    chain = F.lit(None)
    for prefix in reversed(DEFAULT_PREFIXES):
        note = F.concat(
            F.lit("old_hire_date="), hired, F.lit(f" matches extraction-default prefix {prefix!r}"))
        chain = F.when(hired.startswith(prefix), F.struct(
            F.lit("hire_date_default_" + prefix.rstrip("-")).alias("issue_type"), note.alias("notes"),
        )).otherwise(chain)
    return chain


def suspicious_rates(pairs: DataFrame, min_rate: float = 0.01) -> DataFrame:
    """Count and share of all pairs per kind of suspicion."""
    total = pairs.agg(F.count(F.lit(1))).scalar()
    counts = suspicious_defaults(pairs, min_rate).groupBy(
        F.replace("issue_type", F.lit("-"), F.lit("_")).alias("issue_key")
    ).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("rate", F.bround(F.col("count") / total, 6))


def mismatch_counts(pairs: DataFrame) -> DataFrame:
    """One row: mismatches per field, deterministic share, active records without pay."""
    salary = parse_money("new_salary") != parse_money("old_salary")
    old_status, new_status = folded("old_worker_status"), folded("new_worker_status")
    status = (old_status != "") & (new_status != "") & (old_status != new_status)
    deterministic = folded("match_source").isin(*DETERMINISTIC)
    total = F.count(F.lit(1))
    return pairs.agg(
        total.alias("total_pairs"), F.count_if(salary).alias("salary"),
        F.count_if(day_gap("old_hire_date", "new_hire_date") > 0).alias("hire_date"),
        F.count_if(status).alias("status"), F.count_if(deterministic).alias("det_count"),
        F.coalesce(F.bround(F.try_divide(F.count_if(deterministic), total), 6), F.lit(0.0)).alias("det_rate"),
        F.count_if(active_zero()).alias("active_zero_salary"),
    )


def approval_metrics(gated: DataFrame) -> DataFrame:
    """One row: approved pairs, their share, and approved active records without pay."""
    approved, total = F.col("action") == "APPROVE", F.count(F.lit(1))
    return gated.agg(
        total.alias("total"), F.count_if(approved).alias("approve_count"),
        F.coalesce(F.bround(F.try_divide(F.count_if(approved), total), 6), F.lit(0.0)).alias("approve_rate"),
        F.count_if(approved & active_zero()).alias("active_zero_approved"),
    )


def collect_metrics(pairs: DataFrame, gated: DataFrame | None = None) -> dict:
    """The figures the gate needs: one aggregate row and a handful of issue kinds."""
    row = mismatch_counts(pairs).first()
    health = {"det_rate": row["det_rate"], "active_zero_salary": row["active_zero_salary"]}
    if gated is not None:
        approval = approval_metrics(gated).first()
        health |= {k: approval[k] for k in ("approve_rate", "approve_count", "active_zero_approved")}
    kinds = {r["issue_key"]: {"count": r["count"], "rate": r["rate"]} for r in suspicious_rates(pairs).toLocalIterator()}
    return {
        "total_pairs": row["total_pairs"],
        "mismatch_counts": {k: row[k] for k in ("salary", "hire_date", "status")},
        "suspicious": kinds, "health_metrics": health,
    }


def evaluate_sanity_gate(metrics: dict, policy: dict | None = None) -> dict:
    """Pass or fail with reasons, and which outputs a failure blocks."""
    rules = load_policy(policy)["sanity_gate"]
    outputs = ("corrections", "workbook", "exports")
    if not rules.get("enabled"):
        return {"passed": True, "reasons": ["sanity_gate_disabled"],
                "blocked_outputs": dict.fromkeys(outputs, False), "metrics": {}, "health_checks": {}}
    rates, counts = rules["block_if_rate_greater_than"], rules["block_if_count_greater_than"]
    suspicious, reasons, measured = metrics.get("suspicious", {}), [], {}
    for key in sorted({*rates, *counts, *suspicious}):
        found = suspicious.get(key, {"count": 0, "rate": 0.0})
        measured[key] = {**found, "rate_threshold": rates.get(key), "count_threshold": counts.get(key)}
        if key in rates and found["rate"] > rates[key]:
            reasons.append(f"{key} rate {found['rate']:.6f} > {rates[key]}")
        if key in counts and found["count"] > counts[key]:
            reasons.append(f"{key} count {found['count']:,} > {counts[key]:,}")

    limits, health = rules["health_thresholds"], metrics.get("health_metrics", {})
    checks = {}

    def check(name, value, passed, threshold, reason):
        checks[name] = {"value": value, "threshold": threshold, "passed": passed}
        if not passed:
            reasons.append(reason)

    det, low = float(health.get("det_rate", 0.0)), float(limits["min_det_rate"])
    check("det_rate", det, det >= low, f">= {low}",
          f"det_rate {det:.4f} < min {low:.2f} (too few deterministic matches)")
    floor, rate = float(limits["min_approve_rate"]), health.get("approve_rate")
    check("approve_rate", "not_computed" if rate is None else rate, rate is None or rate >= floor, f">= {floor}",
          "" if rate is None else f"approve_rate {rate:.4f} < min {floor:.2f} (too many records need review)")
    staged = health.get("active_zero_approved")
    label = ("active/$0 workers with corrections staged (APPROVE action)" if staged is not None
             else "active workers with $0 salary detected")
    value = int(health.get("active_zero_salary", 0) if staged is None else staged)
    most = int(limits["max_active_zero_salary"])
    check("active_zero_salary", int(health.get("active_zero_salary", 0)), value <= most,
          f"corrections staged <= {most}", f"active_zero_approved {value:,} > max {most:,} ({label})")
    passed = not reasons
    blocked = {o: not passed and bool(rules.get(f"block_{o}")) for o in outputs}
    return {"passed": passed, "reasons": reasons, "blocked_outputs": blocked, "metrics": measured,
            "health_checks": checks}


def verdict_table(spark: SparkSession, verdict: dict) -> DataFrame:
    """One line per reason of a verdict, or a single line without one; the verdict itself is a few values."""
    lines = [(verdict["passed"], r) for r in verdict["reasons"]] or [(verdict["passed"], "")]
    return spark.createDataFrame(lines, "passed boolean, reason string")


def _default_month_rows(pairs: DataFrame, months: list[str]) -> DataFrame:
    """Hire date mismatches with a default month on either side, one row per month."""
    old, new = text("old_hire_date"), text("new_hire_date")
    hit = F.filter(
        F.array(*[F.lit(m) for m in months]),
        lambda m: F.startswith(F.col("old_hire_date"), m) | F.startswith(F.col("new_hire_date"), m),
    )
    return pairs.where(old != new).withColumn("pattern", F.explode(hit))


def default_date_causes(pairs: DataFrame, policy: dict | None = None) -> DataFrame:
    """Per default month: mismatching pairs, their share, and the sources they came from."""
    months = load_policy(policy)["sanity_gate"]["patterns"]["hire_date_default_months"]
    total = pairs.agg(F.count(F.lit(1))).scalar()
    by_source = _default_month_rows(pairs, months).groupBy(
        "pattern", F.coalesce("match_source", F.lit("unknown")).alias("source")
    ).agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "source", "n")))
    found = by_source.groupBy("pattern").agg(F.sum("n").alias("n"), entries.alias("e"))
    known = pairs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in months])).alias("pattern"))
    pieces = F.transform("e", lambda x: F.concat(F.lit('"'), x["source"], F.lit('": '), x["n"].cast("string")))
    breakdown = F.concat(F.lit("{"), F.array_join(pieces, ", "), F.lit("}"))
    return known.join(found, "pattern", "left").select(
        "pattern", F.coalesce("n", F.lit(0)).alias("total_rows"),
        F.bround(F.coalesce("n", F.lit(0)) / total * 100, 4).alias("pct_of_all_pairs"),
        F.coalesce(breakdown, F.lit("{}")).alias("match_source_breakdown_json"),
    )


def default_date_samples(pairs: DataFrame, policy: dict | None = None, n: int = 20) -> DataFrame:
    months = load_policy(policy)["sanity_gate"]["patterns"]["hire_date_default_months"]
    rows = _default_month_rows(pairs, months).select(
        "pattern", "pair_id", "old_worker_id", "new_worker_id", "old_hire_date", "new_hire_date", "match_source")
    return first_n(rows, ["pattern"], ["pair_id"], n)


def suspicion_overview(pairs: DataFrame, n: int = 3) -> DataFrame:
    """Per kind of suspicion its rows and first example pairs."""
    rows = suspicious_defaults(pairs)
    counts = rows.groupBy("issue_type").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(examples(rows, ["issue_type"], "pair_id", "pair_id", n), "issue_type")


