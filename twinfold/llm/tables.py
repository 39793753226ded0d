"""Shared helpers: reading the given tables, storing steps, columns of any input, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for a local master without ``spark.checkpoint.dir``, as in tests.
LOCAL_FOLDER = "file:///tmp/checkpoints/twinfold-llm"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors reach."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    return LOCAL_FOLDER


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` once nothing reads them any more."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    jvm = spark.sparkContext._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        if uuid_part(parent) and parent.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``new_path`` once nothing reads it any more."""
    if uuid_part(path) and path.startswith(shared_folder(spark)):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def uuid_part(path: str) -> bool:
    tail = path.rsplit("-", 1)[-1]
    return len(tail) == 32 and all(c in "0123456789abcdef" for c in tail)


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column of this name as ``kind``; NULL if the input has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with a suffix as long as the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of rows that come sorted by their first ``n_keys`` columns, integers without nulls."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        turn = np.zeros(batch.num_rows, bool)
        columns = [batch.column(k).to_numpy() for k in range(n_keys)]
        for c in columns:
            turn[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            here = tuple(int(c[low]) for c in columns)
            if held and here != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = here
            held.append(batch.slice(low, high - low))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): ``root`` is the smallest node reachable.

    Alternating large-star and small-star rounds, each stored. A hub's rows are
    only ever joined to one minimum per node, so a large join partition can be
    split, and minima are combined before they are shuffled.
    """
    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    now = stored(edges.select("a", "b").where("a <> b").distinct(), "links")
    before = state(now)
    while before["n"]:
        last, now = now, stored(small(large(now)), "links")
        drop_table(last)
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
