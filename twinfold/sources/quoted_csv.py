"""CSV with line breaks in quotes, read in splits.

Lines are read by Spark's text source, which cuts files anywhere. What a split
does to the question "is a quoted field open here?" is a function of two
states: a first pass reads every split once for both and writes one row per
split. A window over these rows tells which splits begin inside a quoted field
and how many records begin before each. The second pass joins the lines of a
record within its split; only the pieces of records that reach over the edge of
a split are shuffled. Records are then parsed by ``from_csv``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .staging import materialize

#: A line that begins outside quotes and ends outside quotes: fields that are quoted (text after the closing quote
#: belongs to the field), plain or empty. A quote inside a plain field is a character like any other.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
_CLOSED_LINE = re.compile(rf"(?:{_FIELD},)*+{_FIELD}", re.S)
#: The rest of a quoted field that is open, up to its closing quote and the next separator.
_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,]*+(,|$)', re.S)


def _ends_open(line: str, begins_open: bool) -> bool:
    """Whether a quoted field is open after the line."""
    at = 0
    if begins_open:
        rest = _REST.match(line)
        if rest is None:
            return True
        if not rest.group(1):
            return False
        at = rest.end()
    return _CLOSED_LINE.fullmatch(line, at) is None


def _open_at_starts(lines: pa.Array, begins_open: bool) -> tuple[np.ndarray, bool]:
    """For every line whether a quoted field is open at its start, and whether one is after the last."""
    state = np.zeros(len(lines) + 1, bool)
    state[0] = begins_open
    # Only lines with quotes can change the state.
    marked = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    now, at = begins_open, 0
    for k, line in zip(marked.tolist(), lines.take(pa.array(marked)).to_pylist()):
        state[at:k + 1] = now
        now, at = _ends_open(line, now), k + 1
    state[at:] = now
    return state[:-1], now


def _is_blank(lines: pa.Array) -> np.ndarray:
    return pc.equal(pc.utf8_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)


def _split_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int] | None, pa.RecordBatch | None]]:
    """((file, block), lines) in file order, then nothing once; a split may come in several pieces."""
    for batch in batches:
        if batch.num_rows:
            file, block = (batch.column(k).to_numpy() for k in (1, 2))
            turn = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            cuts = [0, *turn.tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                yield (int(file[low]), int(block[low])), batch.slice(low, high - low)
    yield None, None


_FIGURES = "path string, file long, block long, closed_to boolean, open_to boolean, starts_closed long, starts_open long"


def _split_figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, for a start outside and inside quotes: whether its end is inside, and how many records begin in it."""
    key = path = None
    states, starts = [False, True], [0, 0]
    for here, part in _split_runs(batches):
        if key is not None and here != key:
            row = [path, *key, *states, *starts]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [f.split()[0] for f in _FIGURES.split(", ")])
            states, starts = [False, True], [0, 0]
        if here is None:
            return
        key, path = here, part.column(3)[0].as_py()
        solid = ~_is_blank(part.column(0))
        # Once both starts have led to one state they stay together.
        together = states[0] == states[1]
        for k in (0,) if together else (0, 1):
            inside, states[k] = _open_at_starts(part.column(0), states[k])
            starts[k] += int((~inside & solid).sum())
            if together:
                states[1], starts[1] = states[0], starts[1] + int((~inside & solid).sum())


def _records(open_splits: set[tuple[int, int]], pieces: bool):
    """(file, block, place, text) of the records that lie in one split, or of the ``pieces`` of those that do not.

    ``place`` counts the records that begin in the split; a piece of a record from before has -1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, place, held = None, False, -1, []

        def out(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n), pa.array([key[1]] * n), pa.array([p for p, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())],
                ["file", "block", "place", "text"])

        for here, part in _split_runs(batches):
            if here != key:
                # The last record of a split is whole if it began here and no field is open.
                if held and (inside or place < 0) == pieces:
                    yield out([(place, "\n".join(held))])
                key, place, held, inside = here, -1, [], here in open_splits
            if here is None:
                return
            lines = part.column(0)
            open_, inside = _open_at_starts(lines, inside)
            begins = ~open_ & ~_is_blank(lines)
            number = place + np.cumsum(begins)
            own = np.flatnonzero(begins | open_)  # blank lines between records belong to none
            done = []
            for n, line in zip(number[own].tolist(), lines.take(pa.array(own)).to_pylist()):
                if n != place:
                    if held and (place < 0) == pieces:
                        done.append((place, "\n".join(held)))
                    place, held = n, []
                held.append(line)
            if done:
                yield out(done)

    return run


def _placed(figures: DataFrame) -> DataFrame:
    """The splits with whether they begin and end inside quotes, and the records before them in their file and in all."""
    here = Window.partitionBy("path").orderBy("block")
    flips = (F.col("closed_to") & ~F.col("open_to")).cast("long")
    fixed = F.col("closed_to") == F.col("open_to")
    so_far = figures.withColumn("flips", F.sum(flips).over(here))
    so_far = so_far.withColumn("fixed", F.last(F.when(fixed, F.struct("closed_to", "flips")), ignorenulls=True).over(here))
    odd = F.pmod(F.col("flips") - F.coalesce("fixed.flips", F.lit(0)), F.lit(2)) == 1
    ends = so_far.withColumn("ends_open", F.coalesce("fixed.closed_to", F.lit(False)) != odd)
    ends = ends.withColumn("begins_open", F.lag("ends_open", 1, False).over(here))
    counted = ends.withColumn("starts", F.when(F.col("begins_open"), F.col("starts_open")).otherwise(F.col("starts_closed")))
    before = lambda w: F.coalesce(F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per split: the only table that is ordered as a whole.
    all_files = Window.orderBy("path", "block")
    counted = counted.withColumns({"in_file": before(here), "in_all": before(all_files)})
    header = ((F.col("in_file") == 0) & (F.col("starts") > 0)).cast("long")
    headers = F.sum(header).over(all_files.rowsBetween(Window.unboundedPreceding, 0))
    return counted.select("file", "block", "begins_open", "ends_open", "in_file", (F.col("in_all") - headers).alias("first"))


def header_names(spark: SparkSession, path: str) -> list[str]:
    """The column names of the first record, which may itself hold line breaks."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
    return reader.option("quote", '"').option("escape", '"').csv(path).columns


def read_records(spark: SparkSession, path: str, number: str, null_value: str | None = None) -> DataFrame:
    """The records of CSV files with a header as text columns, with their place in the files as ``number``.

    Lines end with a line feed, or with a carriage return before it. Lines without any text between records are left
    out. Missing fields of a short record are null, fields too many are left out; a quote that is never closed makes
    the rest of its file one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("path"))
    splits = materialize(_placed(materialize(lines.mapInArrow(_split_figures, _FIGURES), "csv-splits")), "csv-places")
    # A pair of numbers per split that begins inside quotes, of which a terabyte has 8,000 at the very most.
    open_splits = {(r["file"], r["block"]) for r in splits.where("begins_open").toLocalIterator()}
    schema = "file long, block long, place long, text string"
    records = lines.drop("path").mapInArrow(_records(open_splits, False), schema)
    at = splits.select("file", "block", "in_file", "first")
    rows = records.join(at, ["file", "block"]).select((F.col("in_file") + F.col("place")).alias("own"), (F.col("first") + F.col("place")).alias(number), "text")
    edge = splits.where("begins_open or ends_open").select("file", "block", "in_file", "first")
    if edge.limit(1).count():
        torn = lines.drop("path").join(edge.select("file", "block"), ["file", "block"], "left_semi").select("value", "file", "block")
        pieces = torn.mapInArrow(_records(open_splits, True), schema).join(edge, ["file", "block"])
        pieces = pieces.select("file", "block", (F.col("in_file") + F.col("place")).alias("own"), (F.col("first") + F.col("place")).alias(number), "text")
        whole = pieces.groupBy("file", "own", number).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        rows = rows.unionByName(whole.select("own", number, F.array_join("parts.text", "\n").alias("text")))
    names = header_names(spark, path)
    kinds = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
    options = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\0" if null_value is None else null_value, "multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = F.from_csv(F.regexp_replace("text", "\r$", ""), kinds.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    rows = rows.where("own > 0").select(parsed.alias("fields"), number)
    return rows.select(*[F.col(f"fields.c{k}").alias(n) for k, n in enumerate(names)], number)
