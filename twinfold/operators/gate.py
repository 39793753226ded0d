"""Decisions per field and per pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import as_col, changed, folded, text
from ..functions.dates import day_gap, pattern_of
from ..functions.numbers import conversion_of, money_delta, parse_confidence, parse_money, plain_text
from ..policy import auto_approve_sources, load_policy
from .waves import flag_waves

FIX_TYPES = ("salary", "payrate", "status", "hire_date", "job_org")

# Statuses that mean the worker left.
TERMINATED = (
    "terminated", "term", "inactive", "inactivated", "separated", "offboarded", "resigned",
    "released", "terminated (involuntary)", "terminated (voluntary)",
)
# Decision limits.
RATIO_LOW, RATIO_HIGH, REJECT_RATIO, REJECT_CONFIDENCE = 0.85, 1.15, 2.5, 0.75
DETERMINISTIC = ("worker_id", "pk", "recon_id")


def fixed(value: Column, digits: int) -> Column:
    """Number text with a fixed count of decimals and no grouping."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def differs(field: str) -> Column:
    return changed(f"old_{field}", f"new_{field}")


def fix_tests() -> dict[str, Column]:
    nonzero = lambda f: F.coalesce(money_delta(f"old_{f}", f"new_{f}") != 0, F.lit(False))
    return {
        "salary": nonzero("salary"),
        "payrate": nonzero("payrate"),
        "status": differs("worker_status"),
        "hire_date": differs("hire_date"),
        "job_org": differs("position") | differs("district") | differs("location_state"),
    }


def _listed(tests: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def infer_fix_types() -> Column:
    """Array of the field groups that changed, in fixed order."""
    return _listed(fix_tests())


def _by_name(key: Column, values: dict[str, float], default: float) -> Column:
    chain = F.lit(float(default))
    for name, value in reversed(values.items()):
        chain = F.when(key == name, float(value)).otherwise(chain)
    return chain


def source_floor(source: Column, policy: dict) -> Column:
    """Least confidence a match source asks for; 0 for auto-approved sources."""
    rules = policy["confidence_policy"]["match_source"]
    values = {
        name: 0.0 if rule.get("auto_approve") else rule.get("min_confidence", 0.95)
        for name, rule in rules.items() if name != "_default"
    }
    return _by_name(source, values, rules["_default"].get("min_confidence", 0.95))


def _field_floor(fix_type: str, policy: dict) -> float:
    rules = policy["confidence_policy"]["fix_type"]
    return float(rules.get(fix_type, rules["_default"]).get("min_confidence", 0.95))


def min_confidence(source: Column, fix_type: Column, policy: dict) -> Column:
    """The stricter of the source's and the field's threshold; 0 for auto-approved sources."""
    rules = policy["confidence_policy"]["fix_type"]
    values = {n: r.get("min_confidence", 0.95) for n, r in rules.items() if n != "_default"}
    field = _by_name(fix_type, values, rules["_default"].get("min_confidence", 0.95))
    strictest = F.greatest(source_floor(source, policy), field)
    return F.when(source.isin(*auto_approve_sources(policy)), 0.0).otherwise(strictest)


def normal_source() -> Column:
    return F.coalesce(F.nullif(folded("match_source"), F.lit("")), F.lit("unknown"))


def classify_field(fix_type: str, policy: dict) -> Column:
    """Struct (action, min_confidence, confidence, reason) for one field of a pair."""
    source = normal_source()
    return classify_threshold(
        _field_floor(fix_type, policy), policy, source, parse_confidence("confidence"), source_floor(source, policy))


def classify_threshold(field_floor: float, policy: dict, source: Column, score: Column, floor: Column) -> Column:
    """The verdict for a field with this threshold, from prepared source, score and source threshold."""
    needed = F.greatest(floor, F.lit(field_floor))
    low = float(policy["confidence_policy"]["low_confidence_floor"])
    auto = source.isin(*auto_approve_sources(policy))
    enough = F.coalesce(score >= needed, F.lit(False))
    name = (
        F.when(enough, "confidence_ok (").when(score >= low, "below_threshold (")
        .otherwise("low_confidence (")
    )
    limit = F.when(enough | (score >= low), fixed(needed, 3)).otherwise(f"{low:.2f}")
    measured = F.concat(
        name, fixed(score, 3), F.when(enough, ">=").otherwise("<"), limit, F.lit(")")
    )
    reason = (
        F.when(auto, "worker_id_auto_approve").when(score.isNull(), "missing_confidence")
        .otherwise(measured)
    )
    return F.struct(
        F.when(auto | enough, "APPROVE").otherwise("REVIEW").alias("action"),
        F.when(~auto, needed).alias("min_confidence"),
        score.alias("confidence"),
        reason.alias("reason"),
    )


def _override(base: Column, test: Column, action: Column | str, reason: Column) -> Column:
    action = F.lit(action) if isinstance(action, str) else action
    replaced = F.struct(
        action.alias("action"), base["min_confidence"].alias("min_confidence"),
        base["confidence"].alias("confidence"), reason.alias("reason"),
    )
    return F.when(F.coalesce(test, F.lit(False)), replaced).otherwise(base)


def _overridden(base: dict[str, Column]) -> dict[str, Column]:
    """The field verdicts after the overrides of each field."""
    ratio = F.col("_ratio")
    extreme = (ratio < RATIO_LOW) | (ratio > RATIO_HIGH)
    extreme_reason = F.concat(
        F.lit("salary_ratio_extreme ("), fixed(ratio, 4),
        F.lit(f" outside [{RATIO_LOW:.2f}, {RATIO_HIGH:.2f}])"),
    )
    old_status, new_status = F.col("_old_status"), F.col("_new_status")
    leaving = (old_status == "active") & new_status.isin(*TERMINATED)
    leaving_reason = F.concat(
        F.lit("active_to_terminated ("), old_status, F.lit("->"), new_status, F.lit(")")
    )
    pattern, conversion = F.col("_pattern"), F.col("conversion_type")
    return {
        "salary": _override(base["salary"], extreme, "REVIEW", extreme_reason),
        "payrate": _override(
            base["payrate"], conversion.isNotNull(), "APPROVE",
            F.concat(F.lit("payrate_conversion:"), conversion),
        ),
        "status": _override(base["status"], leaving, "REVIEW", leaving_reason),
        "hire_date": _override(
            base["hire_date"], pattern.isNotNull(), pattern["action"], pattern["reason"]
        ),
        "job_org": base["job_org"],
    }


def reject_reason(source: Column, score: Column, ratio: Column, conversion: Column) -> Column:
    """Why the two records look like different people, else NULL."""
    value = F.coalesce(score, F.lit(0.0))
    weak = (source == "dob_name") & (value < REJECT_CONFIDENCE)
    apart = ~source.isin(*DETERMINISTIC) & (ratio > REJECT_RATIO) & conversion.isNull()
    return F.when(
        weak,
        F.concat(
            F.lit("reject_match:dob_name_low_confidence ("), fixed(value, 3),
            F.lit(f"<{REJECT_CONFIDENCE:.2f})"),
        ),
    ).when(
        apart,
        F.concat(
            F.lit("reject_match:fuzzy_extreme_salary_ratio ("), fixed(ratio, 4),
            F.lit(f">{REJECT_RATIO:.1f})"),
        ),
    )


def name_change_reason() -> Column:
    old, new = text("old_last_name_norm"), text("new_last_name_norm")
    flagged = folded(F.col("name_change_detected").cast("string")).isin("true", "1", "yes")
    named = F.concat(F.lit("name_change_detected ("), old, F.lit(" -> "), new, F.lit(")"))
    return F.when(flagged & (old != "") & (new != ""), named).when(flagged, "name_change_detected")


def gate(
    pairs: DataFrame, policy: dict | None = None, waves: DataFrame | None = None, min_rate: float = 0.01
) -> DataFrame:
    """Add fix_types, per_fix, action, reason, conversion_type and the deltas to every pair.

    Everything is a column expression over one row; the only join is with the
    short list of wave dates. Values used more than once are columns of an
    earlier projection, so they are computed once per row. Reports that filter
    on the decision should read a stored result: a filter on ``action`` would
    otherwise carry the whole decision down to the scan a second time.
    """
    policy = load_policy(policy)
    if "name_change_detected" not in pairs.columns:
        pairs = pairs.withColumn("name_change_detected", F.lit(False))
    col = F.col
    rows = flag_waves(pairs, waves, min_rate).withColumns({
        "_source": normal_source(), "_score": parse_confidence("confidence"),
        "_old_salary": parse_money("old_salary"), "_new_salary": parse_money("new_salary"),
        "_old_rate": parse_money("old_payrate"), "_new_rate": parse_money("new_payrate"),
        "_old_status": folded("old_worker_status"), "_new_status": folded("new_worker_status"),
        "_days": day_gap("old_hire_date", "new_hire_date"),
        "_f_hire_date": differs("hire_date"),
        "_f_job_org": differs("position") | differs("district") | differs("location_state"),
    })
    rows = rows.withColumns({
        "salary_delta": col("_new_salary") - col("_old_salary"),
        "payrate_delta": col("_new_rate") - col("_old_rate"),
        "_ratio": F.try_divide(col("_new_salary"), col("_old_salary")),
        "_f_status": col("_old_status") != col("_new_status"),
        "_floor": source_floor(col("_source"), policy),
        "_conversion": conversion_of(*[col(f"_{s}_{f}") for f in ("salary", "rate") for s in ("old", "new")]),
    })
    rows = rows.withColumns({
        "_f_salary": F.coalesce(col("salary_delta") != 0, F.lit(False)),
        "_f_payrate": F.coalesce(col("payrate_delta") != 0, F.lit(False)),
    })
    changes = {f: col(f"_f_{f}") for f in FIX_TYPES}
    others = reduce(lambda a, b: a | b, [t for f, t in changes.items() if f != "hire_date"])
    # Fields with the same threshold share a verdict; rows without such a change need none.
    floors = {f: _field_floor(f, policy) for f in FIX_TYPES}
    shared = {v: f"_v{i}" for i, v in enumerate(sorted(set(floors.values())))}
    verdicts = {
        name: F.when(
            reduce(lambda a, b: a | b, [changes[f] for f in FIX_TYPES if floors[f] == value]),
            classify_threshold(value, policy, col("_source"), col("_score"), col("_floor")))
        for value, name in shared.items()
    }
    rows = rows.withColumns({
        "fix_types": _listed(changes),
        "conversion_type": F.when(changes["payrate"], col("_conversion")),
        "_pattern": pattern_of(col("_days"), col("_source"), others),
        **verdicts,
    })
    gates = _overridden({f: col(shared[v]) for f, v in floors.items()})
    rows = rows.withColumns({f"_g_{f}": F.when(changes[f], g) for f, g in gates.items()})
    field_reasons = [
        F.when(changes[f] & (col(f"_g_{f}.action") == "REVIEW"), F.concat(F.lit(f + ":"), col(f"_g_{f}.reason")))
        for f in FIX_TYPES
    ]
    entries = F.array_compact(F.array(*[
        F.when(changes[f], F.struct(F.lit(f).alias("key"), col(f"_g_{f}").alias("value"))) for f in FIX_TYPES
    ]))
    rows = rows.withColumns({
        "per_fix": F.map_from_entries(entries),
        "_reject": reject_reason(col("_source"), col("_score"), col("_ratio"), col("conversion_type")),
        "_review": F.concat_ws(
            "|", *field_reasons, F.when(col("in_wave"), "hire_date_wave"), name_change_reason()
        ),
    })
    unchanged = F.size("fix_types") == 0
    case = (
        F.when(unchanged & col("in_wave"), _verdict("REVIEW", F.lit("hire_date_wave")))
        .when(unchanged, _verdict("APPROVE", F.lit("no_changes_detected")))
        .when(col("_reject").isNotNull(), _verdict("REJECT_MATCH", col("_reject")))
        .when(col("_review") != "", _verdict("REVIEW", col("_review")))
        .otherwise(_verdict("APPROVE", F.lit("all_fix_types_approved")))
    )
    rows = rows.withColumn("_case", case).withColumns({
        "action": col("_case.action"), "reason": col("_case.reason"), "salary_ratio": col("_ratio"),
    })
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def _verdict(action: str, reason: Column) -> Column:
    return F.struct(F.lit(action).alias("action"), reason.alias("reason"))


def has_fix(name: str) -> Column:
    return F.array_contains(F.col("fix_types"), name)


def fix_text() -> Column:
    return F.array_join("fix_types", "|")


def _signed(value: Column, digits: int) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), F.format_number(value, digits))


def _or_blank(c: str, blank: str) -> Column:
    return F.coalesce(F.nullif(folded(c), F.lit("")), F.lit(blank))


def summary_text() -> Column:
    """Short list of what changed, or 'no_changes'."""
    arrow = lambda label, f: F.concat(
        F.lit(label + ":"), _or_blank(f"old_{f}", "blank"), F.lit("->"), _or_blank(f"new_{f}", "blank")
    )
    parts_changed = F.array_join(
        F.array_compact(F.array(*[
            F.when(differs(f), f) for f in ("position", "district", "location_state")
        ])), "+",
    )
    parts = F.concat_ws(
        " | ",
        F.when(has_fix("salary"), F.concat(F.lit("salary:"), _signed(F.col("salary_delta"), 0))),
        F.when(has_fix("payrate"), F.concat(F.lit("payrate:"), _signed(F.col("payrate_delta"), 2))),
        F.when(has_fix("status"), arrow("status", "worker_status")),
        F.when(has_fix("hire_date"), arrow("hire_date", "hire_date")),
        F.when(has_fix("job_org"), F.concat(F.lit("job_org("), parts_changed, F.lit(")"))),
    )
    return F.when(parts == "", "no_changes").otherwise(parts)


# Source names used in explanations and the decimal-shift limits.
EXPLAIN_SOURCES = {
    "worker_id": "Worker ID", "name_hire_date": "name and hire date", "name": "name only",
    "name_dob": "name and date of birth", "hire_date": "hire date only",
}
SHIFT_LOW, SHIFT_HIGH = 0.2, 5.0


def explanation_text(policy: dict | None = None) -> Column:
    """One plain sentence or two about the pair and its decision."""
    policy = load_policy(policy)
    raw_source, source = text("match_source"), folded("match_source")
    label = None
    for key, words in EXPLAIN_SOURCES.items():
        label = F.when(source == key, words) if label is None else label.when(source == key, words)
    label = label.when(raw_source == "", "unknown source").otherwise(raw_source)
    score = parse_confidence("confidence")
    confidence = F.when(
        ~source.isin(*auto_approve_sources(policy)),
        F.when(score.isNull(), "Confidence not recorded.").otherwise(
            F.concat(F.lit("Confidence "), fixed(score, 2), F.lit("."))
        ),
    )

    known = lambda c: F.coalesce(F.nullif(text(c), F.lit("")), F.lit("unknown"))
    # The delta and ratio exist only when both sides parse, so the dollars do too.
    dollars = lambda side: F.concat(
        F.lit("$"), F.format_number(F.regexp_replace(F.col(f"{side}_salary"), "[$,]", "").try_cast("double"), 0)
    )
    delta, ratio = F.col("salary_delta"), F.col("salary_ratio")
    shifted = F.coalesce((ratio < SHIFT_LOW) | (ratio > SHIFT_HIGH), F.lit(False))
    salary = F.when(
        shifted,
        F.concat(
            F.lit("Salary appears to be a decimal shift - old shows "), dollars("old"),
            F.lit(", new shows "), dollars("new"),
        ),
    ).otherwise(
        F.concat(
            F.lit("Salary "), F.when(delta > 0, "increased").otherwise("decreased"),
            F.lit(" $"), F.format_number(F.abs(delta), 0),
        )
    )
    old_title, new_title = text("old_position"), text("new_position")
    retitled = (old_title != "") & (new_title != "") & differs("position")
    job = F.when(
        retitled, F.concat(F.lit("Job title changed from "), old_title, F.lit(" to "), new_title)
    ).otherwise("Job title or organization changed")
    wave_only = F.col("reason").contains("hire_date_wave") & ~has_fix("hire_date")
    new_hired = text("new_hire_date")
    wave = F.when(
        new_hired != "", F.concat(F.lit("Hire date "), new_hired, F.lit(" matches a bulk import wave"))
    ).otherwise("Hire date matches a bulk import wave")

    changes = F.concat_ws(
        ", ",
        F.when(has_fix("salary"), salary),
        F.when(has_fix("status"), F.concat(
            F.lit("Status changed "), known("old_worker_status"), F.lit(" to "), known("new_worker_status"))),
        F.when(has_fix("hire_date"), F.concat(
            F.lit("Hire date changed from "), known("old_hire_date"), F.lit(" to "), known("new_hire_date"))),
        F.when(has_fix("job_org"), job),
        F.when(wave_only, wave),
    )
    some = F.size("fix_types") > 0
    reason = F.col("reason")
    signal = (
        F.when(
            reason.contains("dob_name_low_confidence"),
            F.concat(
                F.lit("Confidence "), fixed(F.coalesce(score, F.lit(0.0)), 2),
                F.lit(" is below the 0.75 minimum for name/DOB matches - likely a wrong-person pairing."),
            ),
        )
        .when(
            reason.contains("fuzzy_extreme_salary_ratio"),
            "Salary ratio between records is extreme - likely a wrong-person pairing.",
        )
        .otherwise("Flagged as likely wrong-person pairing.")
    )
    rejected = F.concat_ws(
        " ", signal,
        F.when(changes != "", F.concat(F.lit("Changes noted: "), changes, F.lit("."))),
        F.lit("Rejected - do not apply corrections."),
    )
    review = F.col("action") == "REVIEW"
    ending = F.when(
        changes != "",
        F.concat(changes, F.when(review, " - flagged for review.").otherwise(". Approved automatically.")),
    ).otherwise(F.when(review, "Flagged for review.").otherwise("Approved automatically."))
    decided = F.concat_ws(" ", F.when(some & ~has_fix("salary"), "Salary unchanged."), ending)
    body = (
        F.when(F.col("action") == "REJECT_MATCH", rejected)
        .when(~some & ~wave_only, "No field changes detected. Approved automatically.")
        .otherwise(decided)
    )
    return F.concat_ws(" ", F.concat(F.lit("Matched on "), label, F.lit(".")), confidence, body)


def _points(policy: dict, exempt_auto: bool) -> list[tuple[Column, int, str]]:
    """(test, points, label) of every contribution to the review priority."""
    size = F.abs(F.col("salary_delta"))
    source = folded("match_source")
    unscored = parse_confidence("confidence").isNull()
    if exempt_auto:
        unscored = unscored & ~source.isin(*auto_approve_sources(policy))
    return [
        (has_fix("status"), 50, "status+50"),
        (size >= 5000, 30, "sal>=5k+30"),
        (size >= 1000, 15, "sal>=1k+15"),
        (has_fix("hire_date"), 20, "hire_date+20"),
        (has_fix("job_org") & differs("position"), 10, "position+10"),
        (has_fix("job_org") & differs("district"), 8, "district+8"),
        (has_fix("job_org") & differs("location_state"), 6, "location+6"),
        (source != "worker_id", 10, "non_wid+10"),
        (unscored, 10, "no_conf+10"),
        (F.size("fix_types") >= 2, 5, "multi_fix+5"),
    ]


def priority_score(policy: dict | None = None, exempt_auto: bool = True) -> Column:
    parts = [F.when(t, p).otherwise(0) for t, p, _ in _points(load_policy(policy), exempt_auto)]
    return reduce(lambda a, b: a + b, parts)


def priority_labels(policy: dict | None = None) -> Column:
    return F.concat_ws("|", *[F.when(t, l) for t, _, l in _points(load_policy(policy), True)])


def as_text(c: Column | str, digits: int) -> Column:
    """Rounded number as text, '' for NULL."""
    return F.coalesce(plain_text(F.bround(as_col(c), digits)), F.lit(""))
