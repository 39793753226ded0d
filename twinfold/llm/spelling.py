"""Spelling variants grouped by range searches in k-d trees over letter-count vectors.

One inserted, deleted or replaced letter changes the counts by at most two in
L1. A tree per word length, fitted on a bounded sample, deals the words to
cells; a word also asks every cell of its own length within distance two and of
the next length within one, by the distance to the cell's box. In its task a
cell gets a tree of its own, searched the same way; pairs within reach are
compared letter by letter. A word's form is its most frequent near word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column, drop_table, stored

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as the word.
FORM_RATIO = 2
#: Words that the dealing trees are fitted on, and the words meant for a cell.
SAMPLE_WORDS, CELL_WORDS = 200_000, 4096
#: Points of a leaf of the search trees, and dimensions at most; further letters share them.
LEAF, DIMENSIONS = 48, 64
#: Different words that a task counts before it hands them on, and pairs compared at once.
HELD_WORDS, PAIRS = 300_000, 1 << 18


def planted_slips(doc_id: int | None, word: str) -> str:
    """The word without one letter where 97 divides the crc32 of the id and the word."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 97 else word[:h % len(word)] + word[h % len(word) + 1:]


def word_counts(docs: DataFrame, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n): how often every word stands in the whole texts, A-Z lowered; ``change`` may alter a word of a document."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                # Bytes are lowered in ASCII only.
                words = LETTERS.findall(text.encode().lower().decode())
                if change is None:
                    held.update(words)
                else:
                    for word, n in Counter(words).items():
                        held[change(doc_id, word)] += n
                if len(held) > HELD_WORDS:
                    yield rows()
        if held:
            yield rows()

    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tree:
    """A k-d tree over integer points. Without ``tight`` its boxes fill the space, so that any point has a leaf."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.nodes: list[tuple | None] = []
        self.leaves: list[np.ndarray] = []
        dims = points.shape[1]
        far = np.iinfo(np.int32).max
        todo = [(np.arange(len(points)), np.full(dims, -far), np.full(dims, far))]
        self.nodes.append(None)
        at = 0
        while at < len(todo):
            own, low, high = todo[at]
            x = points[own]
            spread = x.max(axis=0) - x.min(axis=0) if len(own) else np.zeros(dims)
            if len(own) <= leaf or not spread.any():
                self.nodes[at] = (len(self.leaves),)
                self.leaves.append(own)
            else:
                axis = int(np.argmax(np.where(spread > 0, x.var(axis=0), -1)))
                values = np.sort(x[:, axis])
                cut = values[(len(values) - 1) // 2]
                cut = cut if cut < values[-1] else values[np.searchsorted(values, cut) - 1]
                inside = x[:, axis] <= cut
                bounds = [(low[axis], high[axis])]
                for part, l, h in ((own[inside], low[axis], cut), (own[~inside], cut + 1, high[axis])):
                    if tight:
                        l, h = points[part, axis].min(), points[part, axis].max()
                    bounds.append((l, h))
                    lows, highs = low.copy(), high.copy()
                    lows[axis], highs[axis] = l, h
                    todo.append((part, lows, highs))
                    self.nodes.append(None)
                self.nodes[at] = (axis, bounds, len(todo) - 2)
            todo[at] = None
            at += 1

    def visit(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``points``) for every leaf whose box is within L1 distance ``reach`` of some points."""
        def outside(x, bound):
            return np.maximum(np.maximum(bound[0] - x, x - bound[1]), 0)

        todo = [(0, np.arange(len(points)), np.zeros(len(points), np.int64))]
        while todo:
            node, rows, cost = todo.pop()
            if not len(rows):
                continue
            if len(self.nodes[node]) == 1:
                yield self.nodes[node][0], rows
                continue
            axis, (before, *sides), child = self.nodes[node]
            x = points[rows, axis].astype(np.int64)
            cost = cost - outside(x, before)
            for k, side in enumerate(sides):
                now = cost + outside(x, side)
                near = now <= reach
                todo.append((child + k, rows[near], now[near]))


def _letters(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _counts(places: np.ndarray, dims: int) -> np.ndarray:
    n = len(places)
    flat = np.arange(n, dtype=np.int64)[:, None] * dims + places
    return np.bincount(flat.ravel(), minlength=n * dims).reshape(n, dims)


class Dealer:
    """The cells of every word length: a tree over the counts of the most frequent letters of a sample."""

    def __init__(self, sample: list[str], share: float, cell: int = CELL_WORDS):
        seen = Counter("".join(sample))
        self.letters = np.sort(np.array([ord(c) for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:DIMENSIONS - 1]], np.uint32))
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        # A leaf of a tree stands for about ``cell`` words of the table.
        leaf = max(8, int(cell * share))
        self.trees = {n: Tree(self.points(words, n), leaf, False) for n, words in by_length.items() if len(words) > leaf}

    def points(self, words: list[str], length: int) -> np.ndarray:
        letters = _letters(words, length)
        at = np.searchsorted(self.letters, letters)
        known = np.append(self.letters, 0)[at] == letters
        return _counts(np.where(known, at, len(self.letters)), len(self.letters) + 1)

    def cells(self, points: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells of a word length within ``reach``."""
        tree = self.trees.get(length)
        if tree is None:
            return np.arange(len(points)), np.zeros(len(points), np.int64)
        found = [(rows, np.full(len(rows), leaf)) for leaf, rows in tree.visit(points, reach)]
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def _dealt(dealer: Dealer):
    """(length, cell, kind, word, n): a word in its cell (0), and asking cells of its length (1) and of the next (2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for length in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == length))
                points = dealer.points(part.column(0).to_pylist(), length)
                rows, cell = dealer.cells(points, length, 0)
                home = np.zeros(len(points), np.int64)
                home[rows] = cell
                for kind, reach in ((0, None), (1, 2), (2, 1)):
                    rows, cell = (np.arange(len(points)), home) if kind == 0 else dealer.cells(points, length + kind - 1, reach)
                    if kind == 1:
                        # Each pair of cells meets once, in the later one.
                        later = cell > home[rows]
                        rows, cell = rows[later], cell[later]
                    some = part.take(pa.array(rows))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, length + (kind == 2), np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), some.column(0), some.column(1)],
                        ["length", "cell", "kind", "word", "n"])

    return run


def _classes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different points, and the rows of each: an order of all rows, and where each point's rows begin in it (and end)."""
    order = np.lexsort(points.T)
    ranked = points[order]
    first = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])) if len(order) else np.zeros(0, np.int64)
    return ranked[first], order, np.append(first, len(order))


def _pairs(a: np.ndarray, b: np.ndarray, a_classes, b_classes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All rows of the classes ``a`` with all rows of the classes ``b``, in slices."""
    (_, a_order, a_first), (_, b_order, b_first) = a_classes, b_classes
    a_size, b_size = np.diff(a_first)[a], np.diff(b_first)[b]
    # Each row of a class of ``a`` with a whole class of ``b``.
    a_row = np.repeat(a_first[a] - (np.cumsum(a_size) - a_size), a_size) + np.arange(int(a_size.sum()))
    b_begin, b_n = np.repeat(b_first[b], a_size), np.repeat(b_size, a_size)
    ends = np.cumsum(b_n)
    low = 0
    while low < len(a_row):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        n = b_n[low:high]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(a_order[a_row[low:high]], n), b_order[np.repeat(b_begin[low:high], n) + inner]
        low = high


def near_pairs(asking: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``asking``, row of ``members``) one edit apart; letters of words of one length, or of one less for ``asking``.

    The same array for both gives each pair once.
    """
    own = asking is members
    length = asking.shape[1]
    step = members.shape[1] - length
    letters, place = np.unique(np.concatenate([asking.ravel(), members.ravel()]), return_inverse=True)
    dims = min(len(letters), DIMENSIONS)
    place = place % dims
    a = _classes(_counts(place[:asking.size].reshape(asking.shape), dims))
    b = a if own else _classes(_counts(place[asking.size:].reshape(members.shape), dims))
    a_class = np.zeros(len(asking), np.int64)
    a_class[a[1]] = np.repeat(np.arange(len(a[0])), np.diff(a[2]))
    real = np.float32 if length < 2000 else np.float64  # exact up to 2 ** 24
    ap, bp = a[0].astype(real), b[0].astype(real)
    a_square, b_square = (ap ** 2).sum(axis=1), (bp ** 2).sum(axis=1)
    # Whole differences that sum up to the step: L1 distance and squared distance are both 2 (both 1 with a step).
    wanted = 1 if step else 2
    alike = len(letters) > dims  # letters that share a dimension
    tree = Tree(b[0], LEAF, True)
    for leaf, rows in tree.visit(a[0], wanted):
        points = tree.leaves[leaf]
        square = a_square[rows][:, None] + b_square[points][None, :] - 2 * (ap[rows] @ bp[points].T)
        close = square == wanted
        if alike and not step:
            close |= square == 0
        x, y = np.nonzero(close)
        x, y = rows[x], points[y]
        if own:
            once = x <= y
            x, y = x[once], y[once]
        for i, j in _pairs(x, y, a, b):
            u, v = asking[i], members[j]
            if step:
                ahead, behind = u != v[:, :length], u != v[:, 1:]
                first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), length)
                last = np.where(behind.any(axis=1), length - 1 - behind[:, ::-1].argmax(axis=1), -1)
                near = last < first
            else:
                near = (u != v).sum(axis=1) == 1
            if own:
                # Rows of one class come up in both orders.
                near &= (i < j) | (a_class[i] != a_class[j])
            i, j = i[near], j[near]
            if len(i):
                yield i, j


class _Best:
    """Per row: how many near words, and the most frequent of them (of equal ones the smallest)."""

    def __init__(self, n: int):
        self.count, self.most, self.word = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, None, object)

    def add(self, rows: np.ndarray, near: np.ndarray, near_n: np.ndarray) -> None:
        order = np.lexsort((near, -near_n, rows))
        rows, near, near_n = rows[order], near[order], near_n[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        self.count += np.bincount(rows, minlength=len(self.count))
        for r, n, w in zip(rows[first].tolist(), near_n[first].tolist(), near[first].tolist()):
            if n > self.most[r] or (n == self.most[r] and w < self.word[r]):
                self.most[r], self.word[r] = n, w


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by length and cell; what each cell finds is added up per word."""
    held: list[pa.RecordBatch] = []

    def done():
        t = pa.Table.from_batches(held).combine_chunks()
        kind = t["kind"].to_numpy()
        if not (kind == 0).any():
            return
        length = t["length"][0].as_py()
        parts = [t.filter(pa.array(kind == k)) for k in (0, 1, 2)]
        words = [p["word"].to_pylist() for p in parts]
        n = [p["n"].to_numpy() for p in parts]
        members = _letters(words[0], length)
        rank = [np.array(w, object) for w in words]
        best = [_Best(len(w)) for w in words]
        for k, other in ((0, members), (1, _letters(words[1], length)), (2, _letters(words[2], length - 1) if words[2] else None)):
            if other is None or not len(other):
                continue
            for i, j in near_pairs(other, members):
                best[k].add(i, rank[0][j], n[0][j])
                best[0].add(j, rank[k][i], n[k][i])
        for w, b in zip(words, best):
            some = np.flatnonzero(b.count)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w[k] for k in some.tolist()], pa.string()), pa.array(b.count[some]), pa.array(b.most[some]), pa.array(b.word[some].tolist(), pa.string())],
                    ["word", "n_near", "form_n", "form"])

    key = None
    for batch in batches:
        length, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((length[1:] != length[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            here = (int(length[low]), int(cell[low]))
            if held and here != key:
                yield from done()
                held = []
            key = here
            held.append(batch.slice(low, high - low))
    if held:
        yield from done()


def near_words(words: DataFrame, sample_words: int = SAMPLE_WORDS, cell: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, form, form_n): every word of ``words`` (word, n; each word once) with near words, and the most frequent of these."""
    total = words.count()
    share = min(1.0, sample_words / max(1, total))
    some = words.select("word").where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * sample_words)
    dealer = Dealer([r["word"] for r in some.toLocalIterator()], share, cell)
    rows = words.select("word", "n", F.char_length("word").alias("length"))
    dealt = rows.mapInArrow(_dealt(dealer), "length int, cell int, kind int, word string, n long")
    found = dealt.repartition("length", "cell").sortWithinPartitions("length", "cell").mapInArrow(_searched, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: paths are halved each round, and words that have arrived leave."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("arrived")), "forms")
    while now.where(~F.col("arrived")).limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("arrived").alias("done"))
        moved = now.where(~F.col("arrived")).join(ahead, "root", "left")
        moved = moved.select("word", F.coalesce("further", "root").alias("root"), F.coalesce("done", F.lit(True)).alias("arrived"))
        last, now = now, stored(now.where("arrived").unionByName(moved), "roots")
        drop_table(last)
    return now.select("word", "root")


def spelling_groups(words: DataFrame, form_ratio: int = FORM_RATIO, sample_words: int = SAMPLE_WORDS, cell: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n; each word once, none empty).

    Words are near if one inserted, deleted or replaced code point parts them. ``form`` is the near word of largest n
    (ties: smallest by code points) if that n is at least ``form_ratio`` times the word's; ``root`` is where following
    the forms ends, the word itself without one. An empty table gives an empty one.
    """
    near = stored(near_words(words, sample_words, cell), "near-words")
    all_words = words.join(near, "word", "left")
    follows = F.col("form_n") >= form_ratio * F.col("n")
    all_words = all_words.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n"))
    all_words = stored(all_words, "word-forms")
    roots = _roots(all_words.where("form is not null").select("word", "form"))
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(
    docs: DataFrame, change: Callable[[int | None, str], str] | None = None, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``spelling_groups`` of the words of ``docs`` with at least ``least_letters`` letters and ``least_count`` occurrences.

    Words are maximal runs of Latin-1 letters (and the two signs among them) of the whole texts with A-Z lowered; a
    null or empty text has none, repeated rows count again, other columns are ignored.
    """
    counted = word_counts(docs, change).where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))
    return spelling_groups(stored(counted, "word-counts"))
