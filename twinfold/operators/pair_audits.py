"""Fixed audit queries over the pair table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import changed_both_present, changed_trimmed, text
from ..functions.numbers import anomaly_band, delta_band, number, rate_band, severity_band
from ..functions.text import id_prefix
from .outputs import both

LEAD = ("pair_id", "match_source", "old_worker_id", "new_worker_id", "old_full_name_norm")
PAIR_GROUPS = {
    "pay": ("salary", "payrate"),
    "status": ("worker_status", "worker_type"),
    "job_org": ("position", "district", "location_state"),
    "hire_date": ("hire_date",),
}
# Fixed value: a ratio listed as a cluster occurs more often than this.
CLUSTER_MIN = 50


def old_salary() -> Column:
    return number("old_salary")


def new_salary() -> Column:
    return number("new_salary")


def salary_share() -> Column:
    """Relative salary change, NULL when it cannot be computed."""
    return F.try_divide(new_salary() - old_salary(), old_salary())


def salary_multiple() -> Column:
    return F.try_divide(new_salary(), old_salary())


def extreme_shift() -> Column:
    """Both salaries present and the change is at least half of the old one."""
    present = (F.col("old_salary") != "") & (F.col("new_salary") != "")
    return F.coalesce(present & (F.abs(salary_share()) >= 0.50), F.lit(False))


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    present = df.where(text(column) != "")
    return present.groupBy(column).agg(F.count(F.lit(1)).alias("c")).where("c > 1")


def preflight(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """Repeated ids in both snapshots and on both sides of the pairs."""
    parts = [
        duplicate_ids(df, column).select(F.lit(name).alias("side"), F.col(column).alias("id"), "c")
        for name, df, column in (
            ("mapped_old", old, "worker_id"), ("mapped_new", new, "worker_id"),
            ("pairs_old", pairs, "old_worker_id"), ("pairs_new", pairs, "new_worker_id"))
    ]
    return reduce(DataFrame.unionByName, parts)


def require_one_to_one(pairs: DataFrame) -> None:
    """Fail when an id occurs in more than one pair."""
    for column in ("old_worker_id", "new_worker_id"):
        n = duplicate_ids(pairs, column).count()
        if n:
            raise ValueError(f"the pair table has {n} repeated {column} values")


def match_source_summary(pairs: DataFrame) -> DataFrame:
    source = F.coalesce(F.nullif(text("match_source"), F.lit("")), F.lit("unknown"))
    return pairs.groupBy(source.alias("match_source")).agg(F.count(F.lit(1)).alias("pair_count"))


def mismatches(pairs: DataFrame, group: str, mode: str = "both_present", top: int | None = None) -> DataFrame:
    """Pairs whose fields of a group differ.

    ``both_present`` compares texts when both sides have one; ``blank_counts``
    also takes a value against a blank; ``numeric`` compares parsed numbers.
    """
    fields = PAIR_GROUPS[group]
    tests = {
        "both_present": lambda f: changed_both_present(f"old_{f}", f"new_{f}"),
        "blank_counts": lambda f: changed_trimmed(f"old_{f}", f"new_{f}"),
        "numeric": lambda f: F.coalesce(number(f"old_{f}") != number(f"new_{f}"), F.lit(False)),
    }
    test = reduce(lambda a, b: a | b, [tests[mode](f) for f in fields])
    rows = pairs.where(test).select(*LEAD, *both(fields))
    return rows.orderBy("pair_id").limit(top) if top else rows


def hire_date_mismatch_by_prefix(pairs: DataFrame) -> DataFrame:
    rows = pairs.where(changed_both_present("old_hire_date", "new_hire_date"))
    return rows.groupBy(F.substring("old_worker_id", 1, 5).alias("old_id_prefix")).agg(
        F.count(F.lit(1)).alias("mismatch_count"))


def _salary_changed(pairs: DataFrame) -> DataFrame:
    return pairs.where(changed_both_present("old_salary", "new_salary"))


def salary_variance(pairs: DataFrame, top: int | None = None) -> DataFrame:
    rows = _salary_changed(pairs).select(
        "pair_id", "old_worker_id", "new_worker_id", "old_full_name_norm",
        old_salary().alias("old_salary_num"), new_salary().alias("new_salary_num"),
        (new_salary() - old_salary()).alias("salary_delta"),
        severity_band(F.col("old_salary"), F.col("new_salary")).alias("severity_band"),
    )
    return rows.orderBy("pair_id").limit(top) if top else rows


def salary_delta_distribution(pairs: DataFrame) -> DataFrame:
    band = delta_band(F.col("old_salary"), F.col("new_salary"))
    return _salary_changed(pairs).groupBy(band.alias("delta_band")).agg(F.count(F.lit(1)).alias("cnt"))


def salary_ratio_clusters(pairs: DataFrame, more_than: int = CLUSTER_MIN, top: int | None = None) -> DataFrame:
    ratio = F.round(salary_multiple(), 2).alias("ratio_rounded")
    counts = _salary_changed(pairs).groupBy(ratio).agg(F.count(F.lit(1)).alias("cnt"))
    counts = counts.where(F.col("cnt") > more_than)
    return counts.orderBy(F.desc("cnt"), "ratio_rounded").limit(top) if top else counts


def extreme_shifts(pairs: DataFrame, top: int | None = None) -> DataFrame:
    rows = pairs.where(extreme_shift()).select(
        "pair_id", "old_worker_id", "new_worker_id", "old_full_name_norm", "old_salary", "new_salary",
        F.round(salary_multiple(), 3).alias("ratio"), *both(["worker_status", "worker_type"]))
    return rows.orderBy("pair_id").limit(top) if top else rows


def extreme_ratio_bins(pairs: DataFrame, top: int | None = None) -> DataFrame:
    ratio = F.round(salary_multiple(), 2).alias("ratio_bin")
    counts = pairs.where(extreme_shift()).groupBy(ratio).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "ratio_bin").limit(top) if top else counts


def roles_with_extremes(pairs: DataFrame, top: int | None = None) -> DataFrame:
    counts = pairs.where(extreme_shift()).groupBy("old_position", "new_position").agg(
        F.count(F.lit(1)).alias("cnt"), F.round(F.avg(salary_multiple()), 3).alias("avg_ratio"))
    return counts.orderBy(F.desc("cnt"), "old_position", "new_position").limit(top) if top else counts


def payrate_alignment(pairs: DataFrame) -> DataFrame:
    """Does an extreme salary equal the pay rate times the hours of a year on either side?"""
    def aligned(side: str) -> Column:
        salary, rate = number(f"{side}_salary"), number(f"{side}_payrate")
        gap = F.try_divide(F.abs(salary - rate * 2080), salary)
        return F.coalesce((F.col(f"{side}_payrate") != "") & (gap < 0.05), F.lit(False))

    return pairs.where(extreme_shift()).agg(
        F.count(F.lit(1)).alias("total_extreme"),
        *[F.count_if(aligned(s)).alias(f"{s}_matches_hourly_2080") for s in ("old", "new")])


def _same_role(pairs: DataFrame) -> DataFrame:
    return pairs.where(extreme_shift() & (F.col("old_position") == F.col("new_position")))


def same_role_extremes(pairs: DataFrame, top: int | None = None) -> DataFrame:
    rows = _same_role(pairs).select(
        "pair_id", "old_worker_id", "new_worker_id", "old_full_name_norm", *both(["position", "salary"]),
        F.round(salary_multiple(), 3).alias("ratio"))
    return rows.orderBy("pair_id").limit(top) if top else rows


def same_role_ratio(pairs: DataFrame) -> DataFrame:
    return _same_role(pairs).groupBy("old_position").agg(
        F.count(F.lit(1)).alias("cnt"), F.round(F.avg(salary_multiple()), 3).alias("avg_ratio"))


# Tier names printed in the mismatch packs.
TIER_LABELS = {
    "worker_id": "Tier 1 - Worker ID", "last4_dob": "Tier 2 - Last4+DOB",
    "last4_birthyear_lname3": "Tier 3 - Last4+BirthYear+LName3", "fallback": "Tier 4 - Fallback",
}
PACKS = {
    "pay": "salary", "hire_date": "hire_date", "status": "worker_status",
    "position": "position", "salary_extreme": "salary",
}


def mismatch_pack(pairs: DataFrame, pack: str) -> DataFrame:
    """Long mismatch table of one field, the same columns for every pack."""
    field = PACKS[pack]
    keep = extreme_shift() if pack == "salary_extreme" else changed_both_present(f"old_{field}", f"new_{field}")
    tier = None
    for source, label in TIER_LABELS.items():
        test = F.col("match_source") == source
        tier = F.when(test, label) if tier is None else tier.when(test, label)
    money = field == "salary"
    missing = F.lit(None).cast("double")
    return pairs.where(keep).select(
        "old_worker_id", "new_worker_id", F.col("old_full_name_norm").alias("full_name_old"),
        F.col("new_full_name_norm").alias("full_name_new"), "match_source",
        tier.otherwise("Unknown").alias("match_tier"), F.lit(field).alias("field_name"),
        F.col(f"old_{field}").alias("old_value"), F.col(f"new_{field}").alias("new_value"),
        (F.round(new_salary() - old_salary(), 2) if money else missing).alias("delta_amount"),
        (F.round(salary_share() * 100, 2) if money else missing).alias("delta_pct"),
    )


def wave_summary(pairs: DataFrame) -> DataFrame:
    """Per id prefix: pairs, hire date mismatches, rate and band; one aggregate."""
    moved = changed_trimmed("old_hire_date", "new_hire_date")
    counts = pairs.groupBy(id_prefix("old_worker_id").alias("old_id_prefix")).agg(
        F.count(F.lit(1)).alias("matched_pairs_total"), F.count_if(moved).alias("hire_date_mismatch_count"))
    rate = F.col("hire_date_mismatch_count") / F.col("matched_pairs_total")
    return counts.withColumn("mismatch_rate", rate).withColumn("severity_band", rate_band(F.col("mismatch_rate")))


def top_new_dates(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """How many mismatches share each new hire date."""
    rows = pairs.where(changed_trimmed("old_hire_date", "new_hire_date"))
    counts = rows.groupBy("new_hire_date").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "new_hire_date").limit(n) if n else counts


def wave_rows(pairs: DataFrame, top: int = 25) -> DataFrame:
    """Mismatch rows with the figures of their id prefix and a wave candidate flag.

    The list of top dates has at most ``top`` rows, so it may be broadcast; the
    prefix table has no such bound and is left to the optimizer.
    """
    rows = mismatches(pairs, "hire_date", "blank_counts").withColumn(
        "old_id_prefix", id_prefix("old_worker_id"))
    top_dates = top_new_dates(pairs, top).select("new_hire_date", F.lit("yes").alias("_top"))
    joined = rows.join(wave_summary(pairs), "old_id_prefix", "left").join(
        F.broadcast(top_dates), "new_hire_date", "left")
    return joined.withColumn("wave_candidate", F.coalesce("_top", F.lit("no"))).drop("_top")


def _with_anomaly(pairs: DataFrame) -> DataFrame:
    valid = pairs.where(old_salary().isNotNull() & new_salary().isNotNull())
    # A change from zero has no finite share: up is over the top band, none is invalid.
    share = F.when(
        old_salary() == 0.0,
        F.when(new_salary() > 0, F.lit(float("inf"))).when(new_salary() < 0, F.lit(float("-inf"))),
    ).otherwise(salary_share())
    return valid.withColumns({"salary_change": new_salary() - old_salary(), "salary_change_pct": share}).withColumn(
        "anomaly_band", anomaly_band(F.col("salary_change_pct")))


def salary_anomalies(pairs: DataFrame) -> DataFrame:
    rows = _with_anomaly(pairs).where("anomaly_band <> 'normal'")
    return rows.select(*LEAD, *both(["salary"]), "salary_change", "salary_change_pct", "anomaly_band")


def salary_anomaly_summary(pairs: DataFrame) -> DataFrame:
    counts = _with_anomaly(pairs).groupBy("anomaly_band").agg(F.count(F.lit(1)).alias("count"))
    # The band table has at most eight rows; its total is taken from itself.
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percent_of_total", F.col("count") / total)


def salary_anomalies_by(pairs: DataFrame, column: str) -> DataFrame:
    # Counted in the aggregate: a filter on the band is moved below the columns it is made of and parses the salaries for every band.
    rows = _with_anomaly(pairs).where(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count_if(F.col("anomaly_band") != "normal").alias("anomaly_count"))
    return counts.where("anomaly_count > 0")


def system_details(frames: dict[str, DataFrame], topics: dict[str, str]) -> DataFrame:
    """Union of audit outputs with their topic and source; missing columns become NULL."""
    parts = []
    for source, df in frames.items():
        lead = [F.lit(topics.get(source, source)).alias("audit_topic"), F.lit(source).alias("source_file")]
        parts.append(df.select(*lead, *[F.col(c).cast("string").alias(c) for c in df.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# Topics of the combined detail table.
DETAIL_TOPICS = {
    "q0": "Duplicate Worker IDs", "q1": "Match Source Summary", "q2": "Salary Issues",
    "q3": "Status Issues", "q4": "Job and Organization Issues", "q5": "Hire Date Issues",
    "q16": "Hire Date Wave Analysis", "q17": "Salary Anomaly Analysis",
}


