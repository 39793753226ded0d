"""Compensation bands: finding the band of a job and judging the new salary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import folded, text
from ..functions.numbers import parse_money
from ..functions.similarity import indel_ratio
from ..functions.text import squeeze
from .alike import indel_bound, near_texts
from .match import token_sort

# Header synonyms of a band file and the similarity floor.
BAND_ALIASES = {
    "title": "job_title", "role": "job_title", "state": "location_state", "min": "band_min",
    "mid": "band_mid", "max": "band_max", "min_salary": "band_min", "max_salary": "band_max",
}
SIMILAR = 0.85
_BAND = ("job_title", "band_min", "band_mid", "band_max")


def norm_title(c: Column | str) -> Column:
    return squeeze(folded(c))


def load_bands(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Band table with numeric limits, normalised title and state, and its file order."""
    names = [c.strip().lower() for c in raw.columns]
    renamed = [BAND_ALIASES.get(n, n) for n in names]
    # A column that already has the standard name keeps it against a synonym.
    bands = raw.toDF(*[r if n == r or r not in names else n for n, r in zip(names, renamed)])
    for needed in ("job_title", "band_min", "band_max"):
        if needed not in bands.columns:
            raise ValueError(f"band table is missing required column {needed!r}")
    absent = {c: F.lit(None).cast("string") for c in ("band_mid", "location_state") if c not in bands.columns}
    bands = bands.withColumns(absent) if absent else bands
    return bands.select(
        "job_title", *[parse_money(F.col(c).cast("string")).alias(c) for c in ("band_min", "band_mid", "band_max")],
        norm_title("job_title").alias("title_key"), folded("location_state").alias("state_key"),
        (F.col(order) if order else F.monotonically_increasing_id()).cast("long").alias("band_ord"),
    )


def similar_titles(keys: DataFrame, bands: DataFrame) -> DataFrame:
    """(title_key, band_title, score) of titles whose sorted words are alike enough.

    The ratio is computed for the distinct titles that ``near_texts`` brings together; no similar pair is lost.
    """
    titles = keys.select("title_key").distinct().withColumn("title", token_sort("title_key"))
    known = bands.select(F.col("title_key").alias("band_title")).distinct().withColumn("title", token_sort("band_title"))
    near = near_texts(titles, known, indel_bound(SIMILAR))
    scored = near.select("title", "other", indel_ratio(F.col("title"), F.col("other")).alias("score")).where(F.col("score") >= SIMILAR)
    alike = titles.join(scored, "title").join(known.select("band_title", F.col("title").alias("other")), "other")
    return alike.select("title_key", "band_title", "score")


def comp_band_lookup(keys: DataFrame, bands: DataFrame) -> DataFrame:
    """Band of each distinct (title_key, state_key).

    Exact title and state, then exact title, then similar title in the state,
    then similar title anywhere; ties go to the first band in file order.
    """
    band = F.struct(*_BAND)
    first = F.min_by(band, "band_ord")
    exact_both = bands.where("state_key <> ''").groupBy("title_key", "state_key").agg(first.alias("b1"))
    exact_title = bands.groupBy("title_key").agg(first.alias("b2"))

    near = similar_titles(keys.join(exact_title, "title_key", "left_anti"), bands)
    options = near.join(bands.withColumnRenamed("title_key", "band_title"), "band_title")
    best = F.max_by(band, F.struct(F.col("score"), -F.col("band_ord")))
    near_state = options.where("state_key <> ''").groupBy("title_key", "state_key").agg(best.alias("b3"))
    near_any = options.groupBy("title_key").agg(best.alias("b4"))
    found = (
        keys.join(exact_both, ["title_key", "state_key"], "left").join(exact_title, "title_key", "left")
        .join(near_state, ["title_key", "state_key"], "left").join(near_any, "title_key", "left")
    )
    return found.select("title_key", "state_key", F.coalesce("b1", "b2", "b3", "b4").alias("band"))


def comp_band_annotate(pairs: DataFrame, bands: DataFrame) -> DataFrame:
    """Add the band columns; a salary outside its band sends the pair to review."""
    pick = lambda f: F.coalesce(
        F.nullif(text(f"new_{f}"), F.lit("")), text(f"old_{f}"))
    rows = pairs.withColumns({
        "title_key": norm_title(pick("position")), "state_key": folded(pick("location_state")),
    })
    keys = rows.where("title_key <> ''").select("title_key", "state_key").distinct()
    rows = rows.join(comp_band_lookup(keys, bands), ["title_key", "state_key"], "left")
    salary, band = parse_money("new_salary"), F.col("band")
    status = (
        F.when(band.isNull() | salary.isNull(), "no_band_found")
        .when(salary < band["band_min"], "below_band_min")
        .when(salary > band["band_max"], "above_band_max").otherwise("within_band")
    )
    rows = rows.withColumns({
        "comp_band_status": status, "comp_band_min": band["band_min"], "comp_band_mid": band["band_mid"],
        "comp_band_max": band["band_max"],
        "comp_band_match": F.coalesce(band["job_title"], F.lit("")),
    })
    outside = F.col("comp_band_status").isin("below_band_min", "above_band_max") & (
        F.col("action") != "REJECT_MATCH")
    note = F.concat(F.lit("comp_band:"), F.col("comp_band_status"), F.lit(" ("), F.col("comp_band_match"), F.lit(")"))
    return rows.withColumns({
        "action": F.when(outside, "REVIEW").otherwise(F.col("action")),
        "reason": F.when(outside, F.concat_ws("|", F.nullif(text("reason"), F.lit("")), note)).otherwise(F.col("reason")),
    }).drop("title_key", "state_key", "band")
