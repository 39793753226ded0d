"""Approximate nearest neighbours along shifted Hilbert curves.

Every curve projects the vectors by a random rotation onto a few directions,
shifts them, and orders them by their Hilbert key. Spark range-partitions the
keys, which gives every vector its rank on every curve, and cuts each curve
into units of equal length. A query meets the vectors of its own unit and of
the units next to it, on all curves; distances are then exact, and the nearest
over all curves are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinfold.llm.tables import column, stored

CURVES, DIRECTIONS, BITS, SEED = 24, 8, 3, 11
#: Share of all vectors that a query meets on one curve, and at least so many.
WINDOW_SHARE, WINDOW_LEAST = 0.05, 128
#: Vectors of one unit at most.
UNIT_ROWS = 4096
#: Vectors that centre and spread of the projections are estimated from.
SAMPLE = 4000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with ``bits`` bits per coordinate, by Skilling's transform."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            inverted = (x[:, i] & q) != 0
            x[inverted, 0] ^= low
            swap = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip[(x[:, dims - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


class Curves:
    """Rotations, centres, spreads and shifts of all curves, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, curves: int, directions: int, bits: int, seed: int = SEED):
        random = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.bits, k = bits, min(directions, dims)
        self.maps, self.low, self.scale = [], [], []
        for _ in range(curves):
            rotation = np.linalg.qr(random.normal(size=(dims, dims)))[0][:, :k]
            projected = sample @ rotation
            spread = np.maximum(projected.std(axis=0), 1e-12)
            # Three spreads to each side fill two thirds of the cube; the shift places them in it.
            self.maps.append(rotation)
            self.low.append(projected.mean(axis=0) - 3 * spread - 3 * spread * random.random(k))
            self.scale.append(1 / (9 * spread))

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        place = (vectors @ self.maps[curve] - self.low[curve]) * self.scale[curve]
        cells = np.clip(np.floor(place * (1 << self.bits)), 0, (1 << self.bits) - 1).astype(np.int64)
        return hilbert_keys(cells, self.bits)


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, each pair once: an id, and a finite vector that is not zero, in doubles."""
    vector = column(embeddings, "embedding", "array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(column(embeddings, "vec_id", "long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    return stored(rows.distinct(), "vectors")


def _classes(vectors: DataFrame, query_every: int, k: int) -> DataFrame:
    """(row, vector, ids, asks): different vectors, the ``k`` + 1 smallest ids of each, and whether a query is among all its ids.

    More ids of one vector can't be among the nearest, so copies are never compared.
    """
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = vectors.where(F.pmod("vec_id", F.lit(query_every)) == 0).select("vector").distinct().withColumn("asks", F.lit(True))
    found = few.join(asking, "vector", "left").select(F.monotonically_increasing_id().alias("row"), "vector", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    return stored(found, "vector-classes")


def _rank_rows(vectors: DataFrame, curves: Curves, n_curves: int) -> DataFrame:
    """(curve, row, rank): the place of every vector on every curve."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                for c in range(n_curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curves.keys(x, c)), batch.column(0)], ["curve", "key", "row"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.column(0), batch.column(1), places], ["part", "curve", "row", "place"])

    order = ["curve", "key", "row"]
    ranged = vectors.select("row", "vector").mapInArrow(keys, "curve int, key long, row long").repartitionByRange(*order)
    ordered = stored(ranged.sortWithinPartitions(*order).select("curve", "row").mapInArrow(number, "part int, curve int, row long, place long"), "ordered")
    # One row per range partition and curve in it: a rank is the rows before the partition plus the place within it.
    spans = ordered.groupBy("part", "curve").agg(F.min("place").alias("first"), F.count("*").alias("n")).collect()
    before, shifts = dict.fromkeys(range(n_curves), 0), []
    for s in sorted(spans, key=lambda s: (s["curve"], s["part"])):
        shifts.append((s["part"], s["curve"], before[s["curve"]] - s["first"]))
        before[s["curve"]] += s["n"]
    shift = vectors.sparkSession.createDataFrame(shifts, "part int, curve int, shift long")
    return ordered.join(F.broadcast(shift), ["part", "curve"]).select("curve", "row", (F.col("place") + F.col("shift")).alias("rank"))


def _nearest_in_units(k: int):
    """Rows come sorted by (curve, unit, asking): the vectors of a unit, then the queries that meet it."""
    def nearest(members: pa.Array, x: np.ndarray, ask_rows: np.ndarray, asks: np.ndarray):
        squares = (x ** 2).sum(axis=1)
        sizes = np.diff(members.offsets.to_numpy())
        all_ids, first = members.flatten().to_numpy(), np.cumsum(sizes) - sizes
        out = ([], [], [])
        for at in range(0, len(asks), 256):
            q = asks[at:at + 256]
            rough = squares[None] + (q ** 2).sum(axis=1)[:, None] - 2 * q @ x.T
            kth = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            slack = 1e-9 * (squares.max() + (q ** 2).sum(axis=1)) + 1e-300
            for row in range(len(q)):
                near = np.flatnonzero(rough[row] <= kth[row] + slack[row])
                exact = np.sqrt(((x[near] - q[row]) ** 2).sum(axis=1))
                n = sizes[near]
                ids = all_ids[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[near], n)]
                exact = np.repeat(exact, n)
                best = np.lexsort((ids, exact))[:k]
                out[0].append(np.full(len(best), ask_rows[at + row]))
                out[1].append(ids[best])
                out[2].append(exact[best])
        return [np.concatenate(o) for o in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            asking = t["asking"].to_numpy(zero_copy_only=False)
            if asking.any() and not asking.all():
                own = t.filter(pa.array(~asking)).combine_chunks()
                members = own["ids"].combine_chunks()
                members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
                q, v, d = nearest(members, _matrix(own["vector"]), t["row"].to_numpy()[asking], _matrix(t["vector"])[asking])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["row", "vec_id", "score"])

        key = None
        for batch in batches:
            curve, unit = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = [0, *(np.flatnonzero((curve[1:] != curve[:-1]) | (unit[1:] != unit[:-1])) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                here = (int(curve[low]), int(unit[low]))
                if held and here != key:
                    yield from done()
                    held = []
                key = here
                held.append(batch.slice(low, high - low))
        if held:
            yield from done()

    return run


def nearest(
    embeddings: DataFrame, query_every: int = 100, k: int = 10, curves: int = CURVES, window_share: float = WINDOW_SHARE,
    window_least: int = WINDOW_LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every vector whose id is divisible by ``query_every``.

    A query meets at least ``window_share`` of all different vectors (and ``window_least``) on each curve. Without any
    structure in the vectors a smaller share finds fewer of the true neighbours. Nearness is the Euclidean distance
    in doubles, ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components, vectors
    without id, and vectors of another length than most of the sample take no part. Equal vectors are placed once and
    listed by their ids. Of rows that repeat an id, a neighbour is listed once, at its smallest distance, and never for
    a query of the same id. Other columns are ignored; an empty table gives an empty one.
    """
    spark = embeddings.sparkSession
    usable = usable_vectors(embeddings)
    classes = _classes(usable, query_every, k)
    sample = [r["vector"] for r in classes.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(v) for v in sample]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n))
    classes = classes.where(F.size("vector") == dims)
    n = classes.count()
    fitted = Curves(np.array([v for v in sample if len(v) == dims]), curves, DIRECTIONS, BITS)
    window = max(window_least, int(np.ceil(window_share * n)))
    unit = int(min(UNIT_ROWS, max(1, -(-window // 4))))
    reach, last = -(-window // (2 * unit)), (n - 1) // unit
    places = _rank_rows(classes, fitted, curves).select("row", "curve", F.floor(F.col("rank") / unit).cast("int").alias("unit"))
    met = F.sequence(F.greatest(F.col("unit") - reach, F.lit(0)), F.least(F.col("unit") + reach, F.lit(last)))
    asks = F.when(F.col("asks"), F.transform(met, lambda u: F.struct(u.alias("unit"), F.lit(True).alias("asking"))))
    own = F.array(F.struct(F.col("unit").alias("unit"), F.lit(False).alias("asking")))
    rows = places.join(classes, "row").select("curve", "row", "vector", "ids", F.explode(F.concat(own, F.coalesce(asks, F.array()))).alias("at"))
    rows = rows.select("curve", F.col("at.unit").alias("unit"), F.col("at.asking").alias("asking"), "row", "vector", F.when(~F.col("at.asking"), F.col("ids")).alias("ids"))
    dealt = rows.repartition("curve", "unit").sortWithinPartitions("curve", "unit", "asking")
    found = dealt.mapInArrow(_nearest_in_units(k + 1), "row long, vec_id long, score double")
    best = found.groupBy("row", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    queries = usable.where(F.pmod("vec_id", F.lit(query_every)) == 0).select(F.col("vec_id").alias("query_id"), "vector")
    queries = queries.join(classes.where("asks").select("row", "vector"), "vector").select("query_id", "row")
    answers = queries.join(best.drop("place"), "row").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
