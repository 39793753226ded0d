"""Reading snapshots and bringing them to the canonical column set."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import dates, numbers, text
from ..functions.blanks import as_col, blank_strict, folded, null_if_blank
from .aliases import AUDIT_ALIASES, SNAPSHOT_ALIASES
from .quoted_csv import read_records

ROW = "src_ord"

SNAPSHOT_INPUT = (
    "first_name", "last_name", "position", "dob", "hire_date", "location", "salary", "payrate",
    "worker_status", "worker_type", "district", "last4_ssn", "address", "worker_id", "recon_id",
    "middle_name",
)
MAPPED_COLUMNS = (
    "worker_id", "recon_id", "first_name", "last_name", "full_name_norm", "first_name_norm",
    "last_name_norm", "middle_name", "suffix", "dob", "hire_date", "last4_ssn", "worker_status",
    "worker_type", "position", "district", "location", "location_state", "address", "salary",
    "payrate",
)


def read_snapshot(
    spark: SparkSession, path: str, fmt: str = "csv", blank_as_null: bool = False, numbering: str = "file"
) -> DataFrame:
    """Scan a file as text columns with trimmed headers and a ``src_ord`` number.

    Quotes in CSV files may hold separators, line breaks and doubled quotes; a
    backslash is a character like any other. Large files are read in splits,
    wherever their line breaks are (``quoted_csv``).

    ``numbering="file"`` gives the position in the files; for other formats it
    costs a second scan and a join with the list of splits. ``"split"`` gives
    unique numbers that follow the file order inside a split only; ``"none"``
    leaves the column out.
    """
    if fmt == "csv":
        # An empty cell stays an empty string unless the caller wants NULL.
        df = read_records(spark, path, ROW)
        names = df.columns[:-1]
        values = [F.nullif(c, F.lit("")) if blank_as_null else F.coalesce(c, F.lit("")) for c in (df[k] for k in _quoted(names))]
        columns = [v.alias(n.strip()) for v, n in zip(values, names)]
        return df.select(*columns, *([] if numbering == "none" else [ROW]))
    df = spark.read.format(fmt).load(path)
    values = [df[c].cast("string") for c in _quoted(df.columns)]
    if blank_as_null:
        values = [F.nullif(v, F.lit("")) for v in values]
    columns = [v.alias(n.strip()) for v, n in zip(values, df.columns)]
    if numbering == "none":
        return df.select(*columns)
    if numbering == "split":
        return df.select(*columns, F.monotonically_increasing_id().alias(ROW))
    return number_rows(df.select(*columns, F.col("_metadata")))


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``src_ord``, the zero-based position of the row in its files.

    Each input split is counted, the counts are summed over the splits in file
    order, and every row adds its place inside the split. The only table that
    is ordered as a whole has one row per split; it is joined without a hint,
    so it is broadcast only while it is small.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    ).drop("_metadata")
    splits = placed.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    numbered = placed.join(offsets, ["_file", "_block"])
    position = F.col("_before") + F.col("_seq") - F.col("_first")
    return numbered.withColumn(ROW, position).drop("_file", "_block", "_seq", "_first", "_before")


def canonical_header(name: str) -> str:
    return re.sub(r"[\s\-]+", "_", name.strip().lower())


def resolve_aliases(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Rename headers to standard names; the first claimant of a name keeps it."""
    table = {**SNAPSHOT_ALIASES, **{canonical_header(k): v for k, v in (overrides or {}).items()}}
    taken, renames = set(df.columns), {}
    for column in df.columns:
        target = table.get(canonical_header(column))
        if target and target not in taken:
            renames[column] = target
            taken.add(target)
    return df.withColumnsRenamed(renames)


def audit_sources(columns: list[str]) -> dict[str, list[str]]:
    """Canonical audit name -> the input columns that map to it, in order."""
    sources: dict[str, list[str]] = {}
    for column in columns:
        plain = column.strip().lower().replace(" ", "_")
        sources.setdefault(AUDIT_ALIASES.get(plain, plain), []).append(column)
    return sources


def audit_aliases(df: DataFrame, keep: tuple[str, ...] = (ROW,)) -> DataFrame:
    """Canonical audit columns; several inputs with one name collapse to the first non-null."""
    inputs = [c for c in df.columns if c not in keep]
    merged = [
        F.coalesce(*[F.col(f"`{c}`") for c in group]).alias(name)
        for name, group in audit_sources(inputs).items()
    ]
    return df.select(*[F.col(k) for k in keep if k in df.columns], *merged)


def ensure_columns(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def safe_column_names(df: DataFrame) -> DataFrame:
    """Strip quotes, semicolons and line breaks from headers."""
    return df.toDF(*[re.sub(r'[";\r\n]', "", c) for c in df.columns])


def require_columns(df: DataFrame, columns: tuple[str, ...] | list[str], what: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def mapped_columns(has_middle: bool = True) -> dict[str, Column]:
    """Expressions that turn the standard input columns into the canonical ones."""
    lower_norm = lambda c: F.lower(text.norm_str(c))
    result = {
        "worker_id": F.nullif(F.col("worker_id"), F.lit("")),
        "recon_id": F.nullif(F.col("recon_id"), F.lit("")),
        "first_name": text.norm_str("first_name"),
        "last_name": text.norm_str("last_name"),
        "full_name_norm": text.full_name_norm("first_name", "last_name"),
        "dob": dates.date_text(dates.parse_date("dob")),
        "hire_date": dates.date_text(dates.parse_date("hire_date")),
        "last4_ssn": F.nullif(text.extract_last4("last4_ssn"), F.lit("")),
        "worker_status": lower_norm("worker_status"),
        "worker_type": lower_norm("worker_type"),
        "position": text.norm_str("position"),
        "district": text.norm_str("district"),
        "location": text.norm_str("location"),
        "location_state": F.nullif(text.extract_state("location"), F.lit("")),
        "address": text.norm_str("address"),
        "salary": numbers.parse_money("salary"),
        "payrate": numbers.parse_money("payrate"),
    }
    middle = "middle_name" if has_middle else F.lit(None).cast("string")
    result.update(text.name_components("first_name", "last_name", middle))
    return result


def map_columns(df: DataFrame, extras: list[str] | tuple[str, ...] = (), aliases: dict | None = None) -> DataFrame:
    """The canonical table before deduplication, with ``src_ord`` and the raw salary text."""
    df = ensure_columns(resolve_aliases(df, aliases), list(SNAPSHOT_INPUT) + list(extras))
    mapped = mapped_columns()
    extra = [text.norm_str(e).alias(e) for e in extras if e not in MAPPED_COLUMNS]
    return df.select(
        ROW, *[mapped[c].alias(c) for c in MAPPED_COLUMNS], *extra, F.col("salary").alias("salary_raw")
    )


def clean_columns(df: DataFrame) -> DataFrame:
    """The alternative cleaning: nicknames, flexible dates, city and state, address, blocking keys, a hashed id."""
    source = next((c for c in ("full_name_norm", "full_name", "name") if c in df.columns), None)
    has = lambda c, make: make(c) if c in df.columns else F.lit("")
    name = F.lit("") if source is None else F.col(source) if source == "full_name_norm" else text.nickname_name(source)
    place = text.split_location("location") if "location" in df.columns else None
    address = F.col("address_norm") if "address_norm" in df.columns else has("address", text.norm_address)
    cleaned = df.withColumns({
        "full_name_norm": name,
        "dob": has("dob", dates.parse_date_flexible), "hire_date": has("hire_date", dates.parse_date_flexible),
        "location_city": F.lit("") if place is None else place["city"],
        "location_state": has("location_state", text.norm_state) if place is None else place["state"],
        "address_norm": address, "last4_ssn": has("last4_ssn", text.extract_last4_strict),
        "worker_type": has("worker_type", text.norm_worker_type),
    })
    cleaned = cleaned.withColumns({
        "last_name_norm": text.last_token("full_name_norm"), "birth_year": F.substring("dob", 1, 4),
        "recon_id": text.recon_hash("full_name_norm", "dob", "last4_ssn"),
    })
    return cleaned.withColumn("last_name_prefix3", text.name_prefix("last_name_norm"))


def mapping_report(mapped: DataFrame) -> DataFrame:
    """One row of null counts, duplicate ids and salary parse failures."""
    failed = F.col("salary").isNull()
    sample = F.when(failed, F.coalesce(null_if_blank("salary_raw"), F.lit("(blank)")))
    blank = lambda c: F.count_if(blank_strict(c))
    base = mapped.agg(
        F.count(F.lit(1)).alias("rows_in"),
        blank("worker_id").alias("worker_id_nulls"),
        blank("recon_id").alias("recon_id_nulls"),
        F.count_if(failed).alias("salary_nulls"),
        F.count_if(failed).alias("salary_parse_failures"),
        F.count_if(F.col("hire_date").isNull()).alias("hire_date_nulls"),
        F.count_if(F.col("location_state").isNull()).alias("location_state_nulls"),
    )
    firsts = (
        mapped.select(sample.alias("sample"), ROW).where("sample is not null")
        .groupBy("sample").agg(F.min(ROW).alias("at")).orderBy("at").limit(10)
        .agg(F.sort_array(F.collect_list(F.struct("at", "sample"))).alias("found"))
    )
    samples = firsts.select(F.col("found.sample"))
    return base.withColumn("salary_parse_failure_samples", samples.scalar())


def duplicate_row_count(df: DataFrame, column: str) -> DataFrame:
    """How many rows share a non-blank normalised id with another row."""
    counts = df.where(~blank_strict(column)).groupBy(folded(column)).count().where("count > 1")
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"))


def input_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Name, size and SHA-256 of each input file."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def pair_view(pairs: DataFrame, old_key: str = "old_worker_id", new_key: str = "new_worker_id") -> DataFrame:
    """Always expose ``pair_id``, first; a missing one is derived from the entity keys."""
    if "pair_id" not in pairs.columns:
        made = text.pair_id(F.coalesce(as_col(old_key), F.lit("")), F.coalesce(as_col(new_key), F.lit("")))
        pairs = pairs.withColumn("pair_id", made)
    return pairs.select("pair_id", *[c for c in pairs.columns if c != "pair_id"])
