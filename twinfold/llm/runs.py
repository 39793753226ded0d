"""Periodic runs of words by block convolution.

At every dyadic scale B a text is cut into blocks of B words. Number-theoretic
transforms give, modulo a prime, the sum of squared differences between a block
and the text at each distance of B to 2B - 1 after it (1 to 15 at the smallest
scale); a sum of zero is a distance at which the block may occur again. A run of
period p and length 3p or more holds a block of its scale whole, with its next
occurrence at distance p, so none is missed. These places are then extended to
maximal stretches and verified word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column
from twinfold.llm.words import mix

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The smallest blocks; with ``LEAST_WORDS`` they reach all shorter periods.
FIRST_BLOCK = 8
#: Words of the texts that are worked on together; a longer text is worked on alone.
GROUP_WORDS = 200_000
#: 119 * 2**23 + 1 has roots of unity of every order that is needed; four times it is below 2**32.
PRIME, ROOT = 998_244_353, 3
#: Values of a matrix that is transformed at once.
SLICE = 1 << 16
_P, _P2, _32 = np.uint64(PRIME), np.uint64(2 * PRIME), np.uint64(32)


@cache
def _twiddles(half: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root of order 2 * half, as a column, and their quotients by the prime scaled by 2**32."""
    root = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    powers = np.ones(1, np.uint64)
    while len(powers) < half:
        powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), PRIME)) % _P])
    return powers[:, None], ((powers << _32) // _P)[:, None]


def _times(x: np.ndarray, twiddles: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """x times the twiddles modulo the prime, below twice the prime, for x below 2**32."""
    w, quotient = twiddles
    return x * w - ((x * quotient) >> _32) * _P


def _below(x: np.ndarray, bound: np.uint64) -> np.ndarray:
    """x less ``bound`` where that is not negative: the difference wraps to a large number where it is."""
    return np.minimum(x, x - bound)


def transform(x: np.ndarray) -> np.ndarray:
    """The transform of every column, its frequencies in bit-reversed order and below twice the prime."""
    size, columns = x.shape
    half = size // 2
    while half:
        v = x.reshape(-1, 2, half, columns)
        a, b = v[:, 0], v[:, 1]
        out = np.empty_like(v)
        out[:, 0] = _below(a + b, _P2)
        out[:, 1] = _times(a - b + _P2, _twiddles(half, False))
        x = out.reshape(size, columns)
        half //= 2
    return x


def back(x: np.ndarray) -> np.ndarray:
    """The inverse of ``transform`` times the number of rows, below the prime."""
    size, columns = x.shape
    half = 1
    while half < size:
        v = x.reshape(-1, 2, half, columns)
        a, b = v[:, 0], _times(v[:, 1], _twiddles(half, True))
        out = np.empty_like(v)
        out[:, 0] = _below(a + b, _P2)
        out[:, 1] = _below(a - b + _P2, _P2)
        x = out.reshape(size, columns)
        half *= 2
    return _below(x, _P)


def _modulo(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


@cache
def _opposite(size: int) -> np.ndarray:
    """Where the frequency -k stands for the one that stands at each place, both bit-reversed."""
    place = np.zeros(1, np.int64)
    while len(place) < size:
        place = np.concatenate([2 * place, 2 * place + 1])
    return place[(-place) % size]


def block_matches(flat: np.ndarray, size: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance): where blocks of ``size`` numbers of ``flat`` may occur from ``after`` blocks on, for less than one block more.

    The last two blocks of ``flat`` are only looked into. Zero sums modulo the prime: every true occurrence is among them.
    """
    n = len(flat) // size - 2
    values = _modulo(flat.astype(np.uint64))
    prefix = np.concatenate([[0], np.cumsum(_modulo(values * values))]).astype(np.uint64)
    norms = prefix[size:] - prefix[:-size]
    wide = max(1, SLICE // (2 * size))
    blocks, distances = [], []
    for low in range(0, n, wide):
        high = min(n, low + wide)
        x = np.zeros((2 * size, high - low + 2), np.uint64)
        x[:size] = values[low * size:(high + 2) * size].reshape(-1, size).T
        f = transform(x)
        # A block in the second half of a window turns the sign of its odd frequencies, which are the second half here.
        k = high - low
        first, second = f[:, after:after + k], f[:, after + 1:after + 1 + k]
        window = np.concatenate([first[:size] + second[:size], first[size:] + _P2 - second[size:]])
        products = _modulo(_modulo(window) * _below(f[_opposite(2 * size), :k], _P))
        both = back(products)[:size]
        own = norms[low * size:high * size:size]
        there = norms[(low + after) * size:(high + after) * size].reshape(k, size).T
        # 2 * size * (own + there) / 2 equals 2 * size * the products' sum where all differences vanish.
        at, block = np.nonzero(_modulo(_modulo(own[None, :] + there) * np.uint64(size)) == both)
        blocks.append(block + low)
        distances.append(at + after * size)
    return (np.concatenate(blocks), np.concatenate(distances)) if blocks else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Extension:
    """How far two places of ``words`` agree, by prefix sums of powers; a caller verifies what it keeps."""

    def __init__(self, words: np.ndarray, multiplier: int = 0x9E3779B97F4A7C15):
        powers = np.full(len(words) + 1, multiplier, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.astype(np.uint64)) * self.powers[:-1], dtype=np.uint64)])

    def reach(self, place: np.ndarray, distance: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """The longest length up to ``limit`` at which the words after ``place`` (before, for a ``step`` of -1) equal those ``distance`` on."""
        low, high = np.zeros(len(place), np.int64), limit.astype(np.int64)
        scale = self.powers[distance]
        while (low < high).any():
            middle = (low + high + 1) // 2
            begin = place if step > 0 else place - middle
            end = begin + middle
            same = (self.sums[end] - self.sums[begin]) * scale == self.sums[end + distance] - self.sums[begin + distance]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _stretches(words: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Maximal stretches of one text that keep the period, read word by word."""
    same = np.concatenate([[False], words[:-distance] == words[distance:], [False]])
    turns = np.flatnonzero(same[1:] != same[:-1])
    return [(int(a), int(b) + distance) for a, b in zip(turns[::2], turns[1::2])]


def _wanted(length, distance):
    return length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * distance)


def find_runs(texts: list[np.ndarray], multiplier: int = 0x9E3779B97F4A7C15) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start and period; texts are arrays of word numbers from 1."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.concatenate([*texts, np.zeros(0, np.int64)])
    starts = np.cumsum(sizes) - sizes
    extension = None
    size = FIRST_BLOCK
    while (sizes >= max(LEAST_WORDS, LEAST_PERIODS * size)).any():
        own = np.flatnonzero(sizes >= max(LEAST_WORDS, LEAST_PERIODS * size))
        n_blocks = -(-sizes[own] // size)
        first = np.cumsum(n_blocks) - n_blocks
        flat = np.zeros((int(n_blocks.sum()) + 2) * size, np.int64)
        n = sizes[own]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat[inner + np.repeat(first * size, n)] = words[inner + np.repeat(starts[own], n)]
        for after in (0, 1) if size == FIRST_BLOCK else (1,):
            block, distance = block_matches(flat, size, after)
            text = np.searchsorted(first, block, "right") - 1
            place = (block - first[text]) * size
            inside = (distance > 0) & (place + size + distance <= n[text])
            block, distance, text, place = block[inside], distance[inside], text[inside], place[inside]
            if not len(block):
                continue
            # Blocks in a row that occur again at one distance are one stretch.
            order = np.lexsort((block, distance))
            block, distance, text, place = block[order], distance[order], text[order], place[order]
            begins = np.ones(len(block), bool)
            begins[1:] = (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1) | (text[1:] != text[:-1])
            ends = np.append(begins[1:], True)
            extension = extension or Extension(words, multiplier)
            d, t = distance[begins], text[begins]
            base = starts[own][t]
            head, tail = place[begins], place[ends] + size
            low = head - extension.reach(base + head, d, head, -1)
            high = tail + d + extension.reach(base + tail, d, n[t] - d - tail, 1)
            long = _wanted(high - low, d)
            for k, a, b, p in zip(own[t[long]].tolist(), low[long].tolist(), high[long].tolist(), d[long].tolist()):
                # A stretch of a multiple of its smallest period is the same stretch: the smallest distance stays.
                found[k][a, b] = min(p, found[k].get((a, b), p))
        size *= 2
    out = []
    for words_, seen in zip(texts, found):
        if any(not np.array_equal(words_[a:b - p], words_[a + p:b]) for (a, b), p in seen.items()):
            # A false place or a clash of the sums: this text's periods are read word by word.
            seen = {}
            for p in range(1, len(words_) // LEAST_PERIODS + 1):
                for a, b in _stretches(words_, p):
                    if _wanted(b - a, p):
                        seen.setdefault((a, b), p)
        out.append(sorted((a, b - a, p) for (a, b), p in seen.items()))
    return out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]], list[np.ndarray]]]:
    """(first row, words, word numbers) of rows that are worked on together."""
    first, words, numbers, held = 0, [], [], 0
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    for k, text in enumerate(texts):
        # Bytes are split at exactly the ASCII white space.
        own = (text or "").encode().split()
        if words and held + len(own) > GROUP_WORDS:
            yield first, words, numbers
            first, words, numbers, held = k, [], [], 0
            number = defaultdict(count(1).__next__)
        words.append(own)
        numbers.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
        held += len(own)
    if words:
        yield first, words, numbers


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(dropped).tolist()) if not n]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: Column | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are the maximal runs of characters other than ASCII white space of the whole ``text`` (by default the column
    of that name). A run is a maximal stretch of at least 24 words and three of its smallest periods that keeps that
    period. ``collapsed`` joins by single spaces the words that no run holds after its first period. A null or empty
    text has no words, no runs and an empty ``collapsed``. Rows are independent: repeated ids or rows give one row
    each. Other columns are ignored, missing kept ones are null; an empty table gives an empty one. A text of any
    length is worked on whole in one task.
    """
    own = column(docs, "text", "string") if text is None else text
    names = [f"kept_{k}" for k in range(len(keep))]
    kept = [(F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("long")).alias(n) for c, n in zip(keep, names)]
    slim = docs.select(*kept, own.alias("text"))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, numbers in _groups(batch.column(len(names)).to_pylist()):
                runs = find_runs(numbers)
                rows = [{"start": a, "length": n, "period": p} for own_runs in runs for a, n, p in own_runs]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, len(words)) for k in range(len(names))), pa.array([len(w) for w in words], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows, kind)), pa.array([_collapsed(w, r) for w, r in zip(words, runs)], pa.string())],
                    [*names, "n_words", "runs", "collapsed"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema[:len(names)]),
                        "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the first. Null without runs."""
    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, better)


def run_digests(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` gives as doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(""))
    best = found.select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame) -> Column:
    """The text of ``documents`` in which, where ten divides the id's crc32, the words from one on repeat their first few."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(column(docs, "doc_id", "long").cast("string"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    repeats = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(repeats, F.lit(1), (n - a).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(planted, " ")).otherwise(text)
