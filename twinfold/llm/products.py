"""Exact search for the largest inner products of integer vectors.

Vectors are range-partitioned by descending length and cut into chunks. Every
query first meets the chunk of the longest vectors, which gives its threshold:
the score that a better vector has to reach. It then meets only chunks whose
longest vector can reach that threshold (Cauchy-Schwarz). Within a chunk,
partial sums over the leading directions of an SVD grow step by step; a vector
whose partial sum plus the product of the residual lengths stays below the
threshold is dropped, and the scores of the others are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinfold.llm.tables import column, stored

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Components in a chunk of vectors, and in a block of queries.
CHUNK_VALUES = 1 << 18
#: Vectors and queries of one matrix of scores.
V_SLICE, Q_SLICE = 1024, 512
#: Components of the sample that the rotation is fitted on; it decides what is pruned, never what is found.
SAMPLE_VALUES = 1 << 19
#: Steps of a factor of two in the length that a query still needs.
STEPS = 16
#: Rounding of a sum of products, as a share of the product of the lengths.
SLACK = 1e-9
#: Sums of products of integers below this are exact in doubles.
EXACT = 2.0 ** 53
_LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(embeddings: DataFrame, query_every: int, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, dims, norm, asks, vector) of the rows that take part, with floor(scale * x) for every component x, as doubles."""
    vector = F.transform(column(embeddings, "embedding", "array<double>"), lambda x: F.lit(float(scale)) * x)
    rows = embeddings.select(column(embeddings, "vec_id", "long").alias("vec_id"), vector.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & ~bad)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1)
            whole = np.floor(values.flatten().to_numpy(zero_copy_only=False))
            offsets = values.offsets.to_numpy() - values.offsets[0].as_py()
            sizes = np.diff(offsets)
            # Scaled by the largest component first, so that squares can't overflow.
            owner = np.repeat(np.arange(len(sizes)), sizes)
            most = np.zeros(len(sizes))
            np.maximum.at(most, owner, np.abs(whole))
            norm = most * np.sqrt(np.bincount(owner, weights=(whole / np.where(most > 0, most, 1)[owner]) ** 2, minlength=len(sizes)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(norm), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(whole))],
                ["vec_id", "dims", "norm", "vector"])

    floored = rows.mapInArrow(floors, "vec_id long, dims int, norm double, vector array<double>")
    asks = F.coalesce(F.pmod("vec_id", F.lit(query_every)) == 0, F.lit(False))
    return stored(floored.select(F.monotonically_increasing_id().alias("row"), "vec_id", "dims", "norm", asks.alias("asks"), "vector"), "integer-vectors")


def rotations(vectors: DataFrame, values: int = SAMPLE_VALUES) -> dict[int, np.ndarray]:
    """The right singular vectors, leading ones first, by vector length, fitted on a bounded sample of the rows."""
    total = vectors.agg(F.sum("dims")).first()[0] or 0
    some = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < min(1.0, values / max(1, total)) * (1 << 20))
    groups: dict[int, list] = {}
    left = values
    for r in some.select("dims", "vector").limit(values).toLocalIterator():
        left -= r["dims"] + 1
        if left < 0:
            break
        groups.setdefault(r["dims"], []).append(r["vector"])
    out = {}
    for dims, rows in groups.items():
        # With fewer rows than components there is little to fit; all rotations together are no larger than the sample.
        if 1 < dims <= len(rows):
            x = np.array(rows)
            x = x / max(1.0, np.abs(x).max())
            out[dims] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def length_chunks(vectors: DataFrame, values: int = CHUNK_VALUES) -> DataFrame:
    """``vectors`` with ``chunk``: ranges of one vector size in descending length, numbered in that order, of at most ``values`` components."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, dims, held = TaskContext.get().partitionId() << 32, -1, None, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for k, d in enumerate(batch.column(batch.schema.get_field_index("dims")).to_pylist()):
                if d != dims or held + d > values:
                    chunk, dims, held = chunk + 1, d, 0
                held += max(1, d)
                out[k] = part + chunk
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "chunk"])

    total = vectors.agg(F.sum(F.greatest("dims", F.lit(1)))).first()[0] or 0
    order = [F.col("dims"), F.col("norm").desc(), F.col("row")]
    ranged = vectors.repartitionByRange(max(1, -(-total // values)), *order).sortWithinPartitions(*order)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return stored(ranged.mapInArrow(number, f"{fields}, chunk long"), "length-chunks")


def _exact(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray, in_doubles: bool) -> np.ndarray:
    """Inner products of pairs of rows; beyond the range of a long, its end."""
    if in_doubles:
        return np.concatenate([np.einsum("ij,ij->i", q[qi[at:at + 65536]], v[vi[at:at + 65536]]) for at in range(0, max(1, len(qi)), 65536)]).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(q[x].tolist(), v[y].tolist())) for x, y in zip(qi, vi))
    return np.array([min(max(s, _LONG[0]), _LONG[1]) for s in sums], np.int64).reshape(-1)


def _best(qi: np.ndarray, vi: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of every query: highest score, then smallest id."""
    order = np.lexsort((ids[vi], ~score, qi))  # ~x falls as x grows, without overflow
    qi, vi, score = qi[order], vi[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], qi[1:] != qi[:-1]])) if len(qi) else np.zeros(0, np.int64)
    place = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
    return qi[place < k], vi[place < k], score[place < k]


def search(q: np.ndarray, q_rows: np.ndarray, least: np.ndarray, v: np.ndarray, v_rows: np.ndarray, ids: np.ndarray, rotation: np.ndarray | None,
           k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score): the ``k`` best of ``v`` (by descending length) for each of ``q`` that score at least ``least``; none is its own row."""
    dims = v.shape[1]
    stops = [s for s in sorted({dims // 4, dims // 2, 3 * dims // 4}) if s > 0] if rotation is not None else []
    found: list[list[np.ndarray]] = [[], [], []]
    with np.errstate(all="ignore"):
        rv = v @ rotation if stops else v
        v_left = np.sqrt(np.cumsum(rv[:, ::-1] ** 2, axis=1)[:, ::-1])
        v_norm = v_left[:, 0] if dims else np.zeros(len(v))
        for q0 in range(0, len(q), Q_SLICE):
            own, own_rows, bar = q[q0:q0 + Q_SLICE], q_rows[q0:q0 + Q_SLICE], least[q0:q0 + Q_SLICE].copy()
            rq = own @ rotation if stops else own
            q_left = np.sqrt(np.cumsum(rq[:, ::-1] ** 2, axis=1)[:, ::-1])
            q_norm = q_left[:, 0] if dims else np.zeros(len(own))
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for v0 in range(0, len(v), V_SLICE):
                at = slice(v0, min(len(v), v0 + V_SLICE))
                longest = v_norm[at].max()
                if (q_norm * longest * (1 + SLACK) < bar).all():
                    break  # all further vectors are shorter
                slack = SLACK * np.outer(v_norm[at], q_norm)
                alive, share, partial, done = None, 1.0, 0.0, 0
                for stop in stops:
                    partial = partial + rv[at, done:stop] @ rq[:, done:stop].T
                    done = stop
                    alive = ~(partial + np.outer(v_left[at, stop], q_left[:, stop]) + slack < bar)
                    share = alive.mean()
                    if share <= 0.05:
                        break
                in_doubles = bool(longest * q_norm.max() < EXACT)
                if in_doubles and share > 0.05:
                    dense = v[at] @ own.T
                    dense[v_rows[at][:, None] == own_rows[None, :]] = -np.inf
                    # What is not among the k highest of this slice needs no sorting.
                    high = np.partition(dense, max(0, len(dense) - k), axis=0)[max(0, len(dense) - k)]
                    vi, qi = np.nonzero((dense >= np.maximum(high, bar)) & (dense > -np.inf))
                    score = dense[vi, qi].astype(np.int64)
                else:
                    vi, qi = np.nonzero(alive if alive is not None else np.ones((at.stop - v0, len(own)), bool))
                    other = v_rows[at][vi] != own_rows[qi]
                    vi, qi = vi[other], qi[other]
                    score = _exact(own, v[at], qi, vi, in_doubles)
                    reached = ~(score < bar[qi])
                    vi, qi, score = vi[reached], qi[reached], score[reached]
                if len(qi):
                    best = _best(*(np.concatenate([a, b]) for a, b in zip(best, (qi, vi + v0, score))), ids, k)
                    full = np.flatnonzero(np.bincount(best[0], minlength=len(own)) == k)
                    last = np.searchsorted(best[0], full, "right") - 1
                    bar[full] = np.maximum(bar[full], best[2][last].astype(float))
            for out, x in zip(found, (best[0] + q0, best[1], best[2])):
                out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


_UNIT = ["chunk", "level", "sub"]


def _in_units(turns: dict[int, np.ndarray], k: int):
    """Rows come sorted by unit, then queries before vectors, then descending length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            asking = t["asking"].to_numpy(zero_copy_only=False)
            if asking.all() or not asking.any():
                return
            def side(mask):
                own = t.filter(pa.array(mask)).combine_chunks()
                vector = own["vector"].chunk(0) if isinstance(own["vector"], pa.ChunkedArray) else own["vector"]
                return own, vector.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            queries, q = side(asking)
            vectors, v = side(~asking)
            ids = vectors["vec_id"].fill_null(_LONG[1]).to_numpy()
            qi, vi, score = search(
                q, queries["row"].to_numpy(), queries["least"].fill_null(-np.inf).to_numpy(), v, vectors["row"].to_numpy(), ids, turns.get(v.shape[1]), k)
            yield pa.RecordBatch.from_arrays(
                [queries["row"].combine_chunks().take(pa.array(qi)), queries["vec_id"].combine_chunks().take(pa.array(qi)),
                 vectors["vec_id"].combine_chunks().take(pa.array(vi)), vectors["row"].combine_chunks().take(pa.array(vi)), pa.array(score)],
                ["query_row", "query_id", "vec_id", "row", "score"])

        key = None
        for batch in batches:
            at = batch.schema.get_field_index
            columns = [batch.column(at(c)).to_numpy() for c in _UNIT]
            turn = np.zeros(batch.num_rows, bool)
            for c in columns:
                turn[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                here = tuple(int(c[low]) for c in columns)
                if held and here != key:
                    yield from done()
                    held = []
                key = here
                held.append(batch.slice(low, high - low))
        if held:
            yield from done()

    return run


def _meet(chunks: DataFrame, spans: DataFrame, queries: DataFrame, turns: dict[int, np.ndarray], k: int, values: int) -> DataFrame:
    """(query_row, query_id, vec_id, row, score): the ``k`` best of every chunk of ``spans`` (dims, chunk, reach) for the queries it can serve.

    ``queries`` have ``level``, the length that they still need; a chunk serves the levels up to its reach. Queries of
    one level are dealt to blocks, so that a unit is one chunk and one block, whatever their numbers.
    """
    counts = queries.groupBy("dims", "level").agg(F.count("*").alias("n"))
    # Levels that are rare go together, from the least one on, so that a chunk meets about as many units as there are blocks of queries.
    ahead = Window.partitionBy("dims").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    block = F.greatest(F.floor(F.lit(values) / F.greatest("dims", F.lit(1))), F.lit(1))
    counts = counts.withColumn("set", F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) / block))
    whole = Window.partitionBy("dims", "set")
    subs = F.ceil(F.sum("n").over(whole) / block).cast("int")
    counts = stored(counts.select("dims", "level", F.min("level").over(whole).alias("least_level"), subs.alias("subs")), "levels")
    # One row per vector size and level, of which a size has 16,384 at most.
    sets = counts.select("dims", F.col("least_level").alias("level"), "subs").distinct()
    pairs = spans.join(F.broadcast(sets), "dims").where("level <= reach")
    units = stored(pairs.select("dims", "chunk", "level", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")), "units")
    asked = queries.join(F.broadcast(counts), ["dims", "level"]).withColumn("level", F.col("least_level"))
    asked = asked.withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    shape = ["chunk", "level", "sub", "row", "vec_id", "norm", "vector", "least", "asking"]
    left = asked.withColumn("asking", F.lit(True)).join(units, ["dims", "level", "sub"]).select(shape)
    right = chunks.drop("dims").withColumns({"least": F.lit(None).cast("double"), "asking": F.lit(False)}).join(units, "chunk").select(shape)
    dealt = left.unionByName(right).repartition(*_UNIT).sortWithinPartitions(*_UNIT, F.col("asking").desc(), F.col("norm").desc(), "row")
    return dealt.mapInArrow(_in_units(turns, k), "query_row long, query_id long, vec_id long, row long, score long")


def _level(length: Column) -> Column:
    """A length as whole steps of its logarithm; -1 below one."""
    return F.when(length >= 1, F.floor(F.log2(length) * STEPS)).otherwise(-1).cast("int")


def largest_products(embeddings: DataFrame, query_every: int = 50, k: int = 5, scale: int = SCALE, values: int = CHUNK_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products with each row whose id is divisible by ``query_every``.

    Every component x counts as floor(scale * x). Candidates are all rows but the query's own; ties go to the smaller
    id. Rows whose vector is null or holds null or non-finite components (also after scaling) take no part. A row
    without id is no query, but a candidate, last among ties. Rows that repeat an id or a vector are rows of their own:
    each queries, and each is listed. Vectors meet vectors of their own size only; those without components score 0.
    A score beyond the range of a long counts as the end of that range. Other columns are ignored; an empty table
    gives an empty one.
    """
    vectors = integer_vectors(embeddings, query_every, scale)
    turns = rotations(vectors)
    chunks = length_chunks(vectors, values)
    spans = stored(chunks.groupBy("dims", "chunk").agg(F.max("norm").alias("longest")), "spans")
    heads = stored(spans.groupBy("dims").agg(F.min("chunk").alias("chunk")), "heads")
    queries = vectors.where("asks").drop("asks")
    first = stored(_meet(
        chunks, heads.withColumn("reach", F.lit(0)), queries.withColumns({"level": F.lit(0), "least": F.lit(None).cast("double")}), turns, k, values), "from-heads")
    bars = first.groupBy("query_row").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n"))
    bars = bars.select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
    waiting = queries.join(bars, "row", "left")
    waiting = waiting.withColumn("level", F.coalesce(_level(F.try_divide("least", "norm")), F.lit(-1)))
    waiting = stored(waiting, "waiting")
    others = spans.join(heads, ["dims", "chunk"], "left_anti").select("dims", "chunk", (_level(F.col("longest")) + 1).alias("reach"))
    rest = _meet(chunks, others, waiting, turns, k, values)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
