"""SimHash near-duplicates with a generalised pigeonhole index.

Fingerprints that differ in at most ``max_distance`` bits are linked. The 64
bits are grouped into parts, correlated bits together. Part i gets its own
threshold t_i (-1 skips it) with sum(t_i) = max_distance - parts + 1: two
fingerprints within ``max_distance`` must then differ in at most t_i bits of
some part. Thresholds come from dynamic programming over the candidates and
probes each part is expected to cost. A fingerprint is stored under its value
in every used part, and probes all values within t_i of it.

Fingerprints estimate a similarity; ``deduplicated`` counts it. Two texts are
near copies if the sets of their five-word shingles agree by 0.8 or more
(Jaccard). At 0.8 a fingerprint differs in about 10 of its 64 bits, where the
pigeonhole index would meet nearly every pair, so candidates come from bands of
minima of the same shingles' hashes instead. Each candidate link is verified on
the whole sets before components are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column, components, free_name, grouped, stored
from twinfold.llm.words import LOWER, SOLID, extend, mix, text_blocks, word_codes, word_spans

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
#: Fingerprints that the parts and thresholds are estimated from.
SAMPLE = 2000
#: Rows under one value that one task compares; a larger group is dealt in blocks.
GROUP_ROWS = 8192
#: Row numbers of removed rows are broadcast up to so many (8 MB), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Near copies: words of a shingle, and the share of all shingles of two texts that both must have.
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Candidates agree in all minima of some band: of pairs at 0.8, all but 2 in 10,000 do.
BANDS, MINIMA = 28, 6
#: Pairs whose shingles are in memory at a time.
VERIFIED_PAIRS = 256
#: Nodes of a block; two blocks are compared at once, by so many of their common shingles at a time.
BLOCK_NODES, BLOCK_SHINGLES = 256, 1 << 14
#: Shingles whose hashes and bits are in memory at a time.
SLICE = 1 << 15
_SPACE = np.uint8(32)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent hashes of the same shingles; number 0 is the hash itself."""
    if not k:
        return hashes
    h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2 ** 64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def block_fingerprints(data: np.ndarray, offsets: np.ndarray, n_words: int = SHINGLE_WORDS, count: int = 1) -> np.ndarray:
    """``count`` fingerprints of each text of a block as unsigned 64-bit numbers, one row per text."""
    n = len(offsets) - 1
    lowered = LOWER[data]
    starts, ends, doc = word_spans(lowered, offsets, SOLID)
    if not len(starts):
        return np.zeros((n, count), np.uint64)
    lengths = ends - starts
    # One buffer of all words, each followed by one space.
    places = np.cumsum(lengths + 1) - (lengths + 1)
    spaced = np.full(int((lengths + 1).sum()), _SPACE)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    spaced[np.repeat(places, lengths) + within] = lowered[np.repeat(starts, lengths) + within]
    buffer = spaced.tobytes()
    stops = places + lengths
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    # A text of fewer words than a shingle has one shingle of all of them.
    shingles = np.where(words == 0, 0, np.maximum(1, words - n_words + 1))
    base = np.cumsum(shingles) - shingles
    stop = base + shingles
    total = int(shingles.sum())
    ones = np.zeros((n, count, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, total, SLICE):  # a slice may hold parts of texts
        at = np.arange(low, min(low + SLICE, total))
        of = np.searchsorted(stop, at, side="right")
        word = at - base[of] + first[of]
        last = np.minimum(word + n_words, first[of] + words[of]) - 1
        hashes = np.array([digest(buffer[s:e], 42) for s, e in zip(places[word].tolist(), stops[last].tolist())], np.uint64)
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        for k in range(count):
            ones[of[begins], k] += np.add.reduceat(_bit_matrix(_mixed(hashes, k)), begins, axis=0, dtype=np.int32)
    set_bits = (2 * ones > shingles[:, None, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=2).view(">u8").reshape(n, count).astype(np.uint64)


def fingerprints(docs: DataFrame, n_words: int = SHINGLE_WORDS, carried: tuple[str, ...] = (), names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """doc_id, the ``carried`` long columns, and one column per name: fingerprints of every row's whole text as signed longs.

    The first is that of the shingle hashes, the others are of the same hashes mixed anew. A null text is empty: zero.
    """
    ids = ["doc_id", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_fingerprints(data, offsets, n_words, len(names)) for _, _, data, offsets in text_blocks(batch.column(len(ids)))]
            fps = np.concatenate(parts) if parts else np.empty((0, len(names)), np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(f.view(np.int64)) for f in fps.T.copy())], [*ids, *names])

    slim = docs.select(*[column(docs, c, "long").alias(c) for c in ids], column(docs, "text", "string").alias("text"))
    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in [*ids, *names]))


# -- parts and thresholds ----------------------------------------------------

def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def group_bits(fps: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0 (highest) to 63 in ``parts`` groups of nearly equal size, correlated bits together."""
    bits = _bit_matrix(fps).astype(float)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits ** 2).sum(axis=0))
    spread[spread == 0] = 1
    alike = np.abs(bits.T @ bits) / np.outer(spread, spread)
    free, groups = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [free.pop(0)]
        while len(group) < size:
            group.append(free.pop(int(np.argmax(alike[np.ix_(free, group)].mean(axis=1)))))
        groups.append(sorted(group))
    return groups


def _within(fps: np.ndarray, group: list[int], most: int) -> list[float]:
    """Share of pairs of the sample that differ in at most 0, 1, ..., ``most`` bits of the group."""
    values = _bit_matrix(fps)[:, group].astype(np.float32)
    ones = values.sum(axis=1)
    apart = np.bincount((ones[:, None] + ones[None, :] - 2 * (values @ values.T)).astype(np.int64).ravel(), minlength=most + 1)
    apart[0] -= len(fps)  # each with itself
    pairs = max(1, len(fps) * (len(fps) - 1))
    # Too rare for the sample: as if bits agreed independently.
    share = values.mean(axis=0)
    chance = np.zeros(len(group) + 1)
    chance[0] = 1
    for p in 2 * share * (1 - share):
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return [max(float(apart[:t + 1].sum()) / pairs, float(chance[:t + 1].sum())) for t in range(most + 1)]


def plan(fps: np.ndarray, rows: int, max_distance: int) -> list[tuple[list[int], int]]:
    """The cheapest parts with their thresholds for ``rows`` fingerprints, estimated from a sample of them."""
    if len(fps) < 2:
        fps = np.array([0, 0], np.uint64)
    best_cost, best = np.inf, []
    for parts in range(1, max_distance + 3):
        groups = group_bits(fps, parts)
        total = max_distance - parts + 1
        costs = []
        for group in groups:
            near = _within(fps, group, min(3, max_distance))
            probes = [sum(comb(len(group), k) for k in range(t + 1)) for t in range(len(near))]
            # One probe row costs about as much as 100 comparisons of a candidate.
            costs.append({-1: 0.0} | {t: 100.0 * rows * (p + 1) + 0.5 * rows * rows * c for t, (p, c) in enumerate(zip(probes, near))})
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (c, chosen) in reach.items():
                for t, more in cost.items():
                    if spent + t not in step or c + more < step[spent + t][0]:
                        step[spent + t] = (c + more, [*chosen, t])
            reach = step
        if total in reach and reach[total][0] < best_cost:
            best_cost, best = reach[total][0], list(zip(groups, reach[total][1]))
    return best


def index_rows(nodes: DataFrame, plans: list[list[tuple[list[int], int]]], names: tuple[str, ...]) -> DataFrame:
    """(turn, part, value, node, probe) and the fingerprints: each node under the values of its parts and, as a probe, under those near them.

    ``turn`` numbers the fingerprint that a part belongs to.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(node), 16384):
                cut = slice(at, at + 16384)
                own, n = [pa.array(x[cut]) for x in (node, *fps)], len(node[cut])
                for turn, parts in enumerate(plans):
                    fp = fps[turn][cut].view(np.uint64)
                    for k, (group, t) in enumerate(parts):
                        if t < 0:
                            continue
                        value = np.zeros(n, np.int64)
                        for bit in group:
                            value = (value << 1) | ((fp >> np.uint64(63 - bit)) & np.uint64(1)).astype(np.int64)
                        flips = [sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(len(group)), r)]
                        for flip in flips:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, turn, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(value ^ np.int64(flip)),
                                 own[0], pa.array(np.full(n, flip != 0)), *own[1:]], ["turn", "part", "value", "node", "probe", *names])

    kinds = "turn int, part int, value long, node long, probe boolean, " + ", ".join(f"{f} long" for f in names)
    return nodes.select("node", *names).mapInArrow(run, kinds)


# -- links -------------------------------------------------------------------

def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for links between nodes 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == root).all():
            return root
        root = new


@dataclass
class Rows:
    """Index rows: node, the node's fingerprints (one row each), whether it is a probe, and the turn."""

    node: np.ndarray
    fps: np.ndarray
    probe: np.ndarray
    turn: np.ndarray

    def take(self, which) -> Rows:
        return Rows(self.node[which], self.fps[which], self.probe[which], self.turn[which])

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("node", "fps", "probe", "turn")))


def forest(rows: Rows, max_distance: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the near nodes of one group, each node to its component's first: never all pairs."""
    nodes, first, place = np.unique(rows.node, return_index=True, return_inverse=True)
    stored_ = np.unique(place[~rows.probe])
    if len(nodes) < 2 or not len(stored_):
        return rows.node[:0], rows.node[:0]
    root = np.arange(len(nodes))
    keys = rows.fps[first]
    own = np.ascontiguousarray(keys[:, rows.turn[0]])
    step = max(1, 2_000_000 // (len(stored_) * keys.shape[1]))
    for at in range(0, len(nodes), step):
        x, y = np.nonzero(np.bitwise_count(own[at:at + step, None] ^ own[None, stored_]) <= max_distance)
        x, y = x + at, stored_[y]
        near = np.bitwise_count(keys[x] ^ keys[y]).sum(axis=1) <= total
        x, y = root[x[near]], root[y[near]]
        if (x != y).any():
            root = _roots(len(nodes), np.concatenate([np.arange(len(nodes)), x]), np.concatenate([root, y]))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _small_groups(size: np.ndarray, rows: Rows, max_distance: int, total: int):
    """The same links for many small groups at once: rows d apart in one group are compared together."""
    group = np.repeat(np.arange(len(size)), size)
    own = rows.fps[np.arange(len(rows.turn)), rows.turn]
    ones, others = [], []
    for d in range(1, int(size.max(initial=1))):
        one = np.flatnonzero((group[:-d] == group[d:]) & ~(rows.probe[:-d] & rows.probe[d:]) & (np.bitwise_count(own[:-d] ^ own[d:]) <= max_distance))
        one = one[np.bitwise_count(rows.fps[one] ^ rows.fps[one + d]).sum(axis=1) <= total]
        ones.append(one)
        others.append(one + d)
    if not ones:
        return rows.node[:0], rows.node[:0]
    root = _roots(len(rows.node), np.concatenate(ones), np.concatenate(others))
    moved = np.flatnonzero(rows.node != rows.node[root])
    return rows.node[moved], rows.node[root[moved]]


_GROUP = ("turn", "part", "value", "one", "other")


def _link_groups(max_distance: int, total: int, names: tuple[str, ...]):
    """Rows come sorted by group; a group may run on into the next batch."""
    def links(rows: Rows, bounds):
        size = np.diff(bounds)
        small = size <= 32
        out = []
        if small.any():
            out.append(_small_groups(size[small], rows.take(np.repeat(small, size)), max_distance, total))
        for k in np.flatnonzero(~small):
            out.append(forest(rows.take(slice(bounds[k], bounds[k + 1])), max_distance, total))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        held_key = None

        def emit(found):
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            array = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            keys = [array(n) for n in _GROUP]
            rows = Rows(array("node"), np.stack([array(f) for f in names], axis=1).view(np.uint64), array("probe").astype(bool), keys[0])
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
            first_key, last_key = tuple(int(k[0]) for k in keys), tuple(int(k[-1]) for k in keys)
            if held and held_key != first_key:
                yield from emit([forest(Rows.joined(held), max_distance, total)])
                held = []
            if len(cuts) == 2:
                held.append(rows)
            else:
                begin = 0
                if held:
                    yield from emit([forest(Rows.joined([*held, rows.take(slice(0, cuts[1]))]), max_distance, total)])
                    begin = 1
                if len(cuts) - 1 > begin + 1:
                    low, high = cuts[begin], cuts[-2]
                    yield from emit(links(rows.take(slice(low, high)), cuts[begin:-1] - low))
                held = [rows.take(slice(cuts[-2], None))]
            held_key = last_key
        if held:
            yield from emit([forest(Rows.joined(held), max_distance, total)])

    return run


def links(
    nodes: DataFrame, max_distance: int = MAX_DISTANCE, group_rows: int = GROUP_ROWS, names: tuple[str, ...] = ("fp",), total: int | None = None,
) -> DataFrame:
    """(a, b) between different nodes: enough of the near ones to connect all of them.

    ``nodes`` holds node (a long) and its fingerprints ``names``. Two nodes are near if some fingerprint differs in at most
    ``max_distance`` bits and all of them in at most ``total`` (by default any number). A value with more than
    ``group_rows`` rows is cut into blocks by a hash, and every two blocks meet in a task of their own, so no pair is
    lost and no task holds the whole group.
    """
    total = 64 * len(names) if total is None else total
    sample = nodes.select(*names).orderBy(F.xxhash64(*names), *names).limit(SAMPLE).collect()
    n = nodes.count()
    plans = [plan(np.array([r[f] for r in sample], np.int64).view(np.uint64), n, max_distance) for f in names]
    rows = index_rows(nodes, plans, names)
    key = list(_GROUP[:3])
    counts = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    crowded = stored(counts.select(*key, F.ceil(F.col("n") / (group_rows // 2)).cast("int").alias("blocks")), "crowded")
    carried = ["node", "probe", *names]
    if crowded.isEmpty():
        dealt = rows.select(*key, F.lit(0).alias("one"), F.lit(0).alias("other"), *carried)
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
        dealt = (
            rows.join(crowded, key, "left").select(*key, *carried, own.alias("own"), blocks.alias("blocks"))
            .select(*key, *carried, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
            .select(*key, F.least("own", "met").alias("one"), F.greatest("own", "met").alias("other"), *carried)
        )
    return dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_link_groups(max_distance, total, names), "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; ``component_id`` is the smallest doc_id reachable over links.

    A null text counts as empty; repeated rows stay repeated; rows without doc_id link like others, and a component of
    only such rows has a null ``component_id``. Other columns are ignored. An empty table gives an empty one.
    """
    marked = stored(fingerprints(docs, n_words), "fingerprints")
    nodes = stored(marked.select("fp", F.col("fp").alias("node")).distinct(), "nodes")  # equal fingerprints are one node: copies are never paired
    linked = stored(components(links(nodes, max_distance)), "roots")
    roots = stored(nodes.join(linked, "node", "left").select("fp", F.coalesce("root", "node").alias("root")), "components")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# -- near copies ---------------------------------------------------------------

_SEEDS = mix(np.arange(1, BANDS * MINIMA + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int = COPY_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of the different shingles of each text of a block, in order; a text of fewer words has one of all of them."""
    lowered = LOWER[data]
    starts, ends, doc = word_spans(lowered, offsets, SOLID)
    codes = word_codes(lowered, starts, ends)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(words) - words
    n = np.where(words == 0, 0, np.maximum(1, words - n_words + 1))
    of = np.repeat(np.arange(len(n)), n)
    word = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
    last = first[of] + words[of] - 1
    found = mix(codes[word])
    for k in range(1, n_words):
        found = np.where(word + k <= last, extend(found, codes[np.minimum(word + k, last)]), found)
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    return of[new], found[new]


def block_sketches(data: np.ndarray, offsets: np.ndarray, n_words: int = COPY_WORDS) -> np.ndarray:
    """One row per text of a block: two codes of its whole set of shingles, then one of the minima of each band."""
    of, found = shingle_sets(data, offsets, n_words)
    out = np.zeros((len(offsets) - 1, 2 + BANDS), np.uint64)
    if not len(of):
        return out
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    texts = of[begins]
    for k in range(2):
        out[texts, k] = np.add.reduceat(mix(found ^ _SEEDS[BANDS * MINIMA + k]), begins)
    for band in range(BANDS):
        code = np.full(len(texts), band, np.uint64)
        for k in range(band * MINIMA, (band + 1) * MINIMA):
            code = extend(code, np.minimum.reduceat((found ^ _SEEDS[k]) * _FACTORS[k], begins))
        out[texts, 2 + band] = code
    return out


def _sketches(rows: DataFrame, n_words: int, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(2)):
                codes = block_sketches(data, offsets, n_words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(low, high - low) for k in (0, 1)] + [pa.array(c) for c in codes.T.copy()], ["doc_id", "_row", *names])

    slim = rows.select(column(rows, "doc_id", "long").alias("doc_id"), "_row", column(rows, "text", "string").alias("text"))
    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "_row", *names]))


def similarities(ones: pa.Array, others: pa.Array, n_words: int = COPY_WORDS) -> np.ndarray:
    """Of each pair of texts, how many of the different shingles of both are in both, as a share."""
    def sets(texts):
        found = [(low, *shingle_sets(data, offsets, n_words)) for low, _, data, offsets in text_blocks(texts)]
        return [low + of for low, of, _ in found], [codes for _, _, codes in found]

    n = len(ones)
    if not n:
        return np.zeros(0)
    (a, x), (b, y) = sets(ones), sets(others)
    pair, code = np.concatenate([*a, *b]), np.concatenate([*x, *y])
    order = np.lexsort((code, pair))
    pair, code = pair[order], code[order]
    twice = (pair[1:] == pair[:-1]) & (code[1:] == code[:-1])
    both = np.bincount(pair[1:][twice], minlength=n)
    return both / np.maximum(1, np.bincount(pair, minlength=n) - both)


def _verified(pairs: DataFrame, texts: DataFrame, n_words: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose ``texts`` agree by ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VERIFIED_PAIRS):
                a, b, one, other = batch.slice(at, VERIFIED_PAIRS).columns
                near = pa.array(similarities(one, other, n_words) >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([a.filter(near), b.filter(near)], ["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("one"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("other"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(run, "a long, b long")


def block_similarities(ones: pa.Array, others: pa.Array, n_words: int = COPY_WORDS) -> np.ndarray:
    """The ``similarities`` of every text of one block with every text of another, as a matrix."""
    def sets(texts):
        found = [(low, *shingle_sets(data, offsets, n_words)) for low, _, data, offsets in text_blocks(texts)]
        return np.concatenate([low + of for low, of, _ in found] or [np.zeros(0, int)]), np.concatenate([c for *_, c in found] or [np.zeros(0, np.uint64)])

    (a, x), (b, y) = sets(ones), sets(others)
    common = np.intersect1d(x, y)
    both = np.zeros((len(ones), len(others)), np.float32)
    for low in range(0, len(common), BLOCK_SHINGLES):
        part = common[low:low + BLOCK_SHINGLES]
        held = []
        for of, codes, n in ((a, x, len(ones)), (b, y, len(others))):
            at = np.minimum(np.searchsorted(part, codes), len(part) - 1)
            there = part[at] == codes
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[of[there], at[there]] = 1
            held.append(matrix)
        both += held[0] @ held[1].T
    sizes = [np.bincount(of, minlength=n) for of, n in ((a, len(ones)), (b, len(others)))]
    return both / np.maximum(1, sizes[0][:, None] + sizes[1][None, :] - both)


def _near_across(left: DataFrame, texts: DataFrame, n_words: int, least: float) -> DataFrame:
    """(a, b): enough of the near pairs of nodes of one key in different components to connect all that are near.

    ``left`` holds the members of the keys with several components (key, node, root, main, hub). Those outside the
    main component meet all others in blocks: a row per node and block that it meets, never one per pair.
    """
    members = left.where("node <> hub")
    small = F.col("root") != F.col("main")
    sizes = members.groupBy("key").agg(F.count_if(small).alias("n_one"), F.count("*").alias("n_other")).where("n_one > 0")
    blocks = sizes.select("key", *[F.ceil(F.col(f"n_{s}") / BLOCK_NODES).cast("int").alias(f"blocks_{s}") for s in ("one", "other")])
    rows = members.join(blocks, "key").join(texts, "node")
    # A node's block by a hash of its own.
    own = lambda side: F.pmod(F.xxhash64("node"), F.col(f"blocks_{side}")).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{side}") - 1))
    one = rows.where(small).select("key", own("one").alias("i"), every("other").alias("j"), F.lit(0).alias("side"), "node", "root", "text")
    other = rows.select("key", every("one").alias("i"), own("other").alias("j"), F.lit(1).alias("side"), "node", "root", "text")
    dealt = one.unionByName(other).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, 3):
            side = t["side"].to_numpy()
            parts = [t.filter(pa.array(side == k)) for k in (0, 1)]
            if not all(p.num_rows for p in parts):
                continue
            a, b = (p["node"].to_numpy() for p in parts)
            x, y = (p["root"].to_numpy() for p in parts)
            text = [p["text"].combine_chunks() for p in parts]
            near = block_similarities(*text, n_words) >= least - 1e-12
            near &= x[:, None] != y[None, :]
            parent: dict[int, int] = {}

            def find(r):
                while parent.get(r, r) != r:
                    r = parent[r]
                return r

            links = []
            for i, j in zip(*(k.tolist() for k in np.nonzero(near))):
                p, q = find(int(x[i])), find(int(y[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((i, j))
            if links:
                i, j = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def copy_roots(rows: DataFrame, nodes: DataFrame, bands: list[str], n_words: int, least: float) -> DataFrame:
    """(node, root) of the nodes with a near copy; ``root`` is the smallest node that verified links reach.

    First every node is verified against the smallest of each of its bands' values. Where that leaves the nodes of a
    value in several components, every pair across them is verified too, block against block: the components are those
    of all verified candidates, but a large group of near copies costs about as many rows as it has members.
    """
    banded = nodes.select("node", F.explode(F.array(*bands)).alias("key"))
    keys = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").select("key", "hub")
    members = stored(banded.join(keys, "key"), "bands")
    wanted = stored(members.select("node").distinct(), "candidates")
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = rows.select(F.col("_row").alias("node"), column(rows, "text", "string").alias("text"))
    texts = stored(texts.join(chosen, "node", "left_semi"), "texts")
    first = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = stored(_verified(first, texts, n_words, least), "verified")
    roots = stored(components(near), "roots")

    members = stored(_rooted(members, roots), "rooted")
    shares = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    split = shares.agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main")).where("parts > 1").select("key", "main")
    left = stored(members.join(split, "key"), "split")
    # The smallest node has been compared with all others of the value.
    more = stored(_near_across(left, texts, n_words, least), "verified")
    if more.isEmpty():
        return roots
    return stored(components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")


def deduplicated(docs: DataFrame, n_words: int = COPY_WORDS, least: float = COPY_SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one with the smallest doc_id, of equal ones the first stored.

    Near copies share ``least`` or more of their different shingles. Rows without doc_id come after those with one. Texts
    with the same set of shingles are one node, as are texts without words. Other edge cases are those of ``near_duplicates``.
    """
    whole, bands = ["set0", "set1"], [f"band{k}" for k in range(BANDS)]
    # A column of the input that is named like the row number steps aside.
    renamed = {c: free_name(docs, "row_of_input") if c.lower() == "_row" else c for c in docs.columns}
    rows = stored(docs.withColumnsRenamed(renamed).withColumn("_row", F.monotonically_increasing_id()), "rows")
    marked = stored(_sketches(rows, n_words, [*whole, *bands]), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    alike = marked.groupBy(*whole).agg(F.min(place).alias("first"), *[F.min(b).alias(b) for b in bands])
    nodes = stored(alike.select(F.col("first._row").alias("node"), "first", *bands), "nodes")
    linked = copy_roots(rows, nodes, bands, n_words, least)
    roots = _rooted(nodes.select("node", "first"), linked)
    first = roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    gone = stored(marked.select("_row").join(first, "_row", "left_anti"), "duplicates")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, "_row", "left_anti").select(*[F.col(f"`{new}`").alias(c) for c, new in renamed.items()])
