"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then overlap checks.

The index holds the test items; every passage of every training document is a
query. Impacts are divided by the item's own BM25 score, so a passage that
holds the whole item scores 1 and one threshold serves all items. All items at
or above it are retrieved: a passage whose bound stays below is skipped, and
within the others whole blocks of postings are skipped by their maxima. A
retrieved item counts only if its question and its answer both overlap the text
around a passage that retrieved it; where such texts overlap, they are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column, stored
from twinfold.llm.words import ALNUM, LOWER, code_of, text_blocks, word_codes, word_spans

#: Words of a passage, and from one passage to the next.
PASSAGE, STRIDE = 64, 32
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.5
#: Shared word runs of this length count as overlap, and this share of the words must lie in them.
RUN_WORDS, OVERLAP = 4, 0.6
K1, B = 1.2, 0.75
#: Words of a piece of an item: most of it lies in one passage, wherever it begins.
PIECE = 48
#: Postings of one block, and into how many ranges of pieces the bounds of whole passages are taken.
BLOCK, RANGES = 64, (1, 8, 64)
#: Items of one broadcast index; more items are searched in several passes.
SHARD_ITEMS = 20_000
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; without one of three words, the last third of the words."""
    sentences = [w for w in map(item_words, _SENTENCE.split(text or "")) if w]
    if len(sentences) > 1 and len(sentences[-1]) >= 3:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = [w for s in sentences for w in s]
    cut = len(words) - max(1, len(words) // 3)
    return (words[:cut], words[cut:]) if len(words) > 1 else (words, words)


def pieces(question: list[str], answer: list[str]) -> list[list[str]]:
    """The words of an item in pieces that fit a passage; an item without two sides has its words on both."""
    words = question if question is answer else [*question, *answer]
    n = -(-len(words) // PIECE)
    cuts = [len(words) * j // n for j in range(n + 1)] if n else []
    return [words[low:high] for low, high in zip(cuts, cuts[1:])]


@dataclass
class Statistics:
    """Pieces of all items, their mean length, and in how many of them a word stands."""

    n: int
    mean: float
    frequency: dict[str, int]


class Index:
    """Postings by term over pieces of items, pieces in order, in blocks that know their largest impact.

    A long item is cut into pieces that fit a passage; finding one retrieves the item. ``statistics`` are those of all
    items where these are a part of them.
    """

    def __init__(self, items: list[tuple[int, list[str], list[str]]], threshold: float = THRESHOLD, statistics: Statistics | None = None):
        self.ids = [i for i, _, _ in items]
        self.sides = [tuple(np.array([code_of(w) for w in side], np.uint64) for side in (q, a)) for _, q, a in items]
        texts, self.item = [], []
        for k, (_, q, a) in enumerate(items):
            for piece in pieces(q, a):
                texts.append(piece)
                self.item.append(k)
        self.lengths = [len(q) if q is a else len(q) + len(a) for _, q, a in items]
        counts: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(texts):
            for w in dict.fromkeys(words):
                counts.setdefault(w, []).append((k, words.count(w)))
        if statistics is None:
            statistics = Statistics(len(texts), sum(map(len, texts)) / max(1, len(texts)), {w: len(found) for w, found in counts.items()})
        mean, n, own, raw = statistics.mean, len(texts), np.zeros(len(texts)), {}
        size = np.array([len(t) for t in texts], float)
        for w, found in sorted(counts.items()):  # sums in one order, whatever the shard
            frequency = statistics.frequency[w]
            idf = np.log(1 + (statistics.n - frequency + 0.5) / (frequency + 0.5))
            k = np.array([k for k, _ in found])
            tf = np.array([c for _, c in found], float)
            raw[w] = (k, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[k] / mean)))
            own[k] += raw[w][1]
        code = {w: code_of(w) for w in raw}
        terms = sorted(raw, key=code.get)
        self.codes = np.array([code[w] for w in terms], np.uint64)
        self.postings = [(raw[w][0].tolist(), (raw[w][1] / own[raw[w][0]]).tolist()) for w in terms]
        self.block_max = [[max(x[at:at + BLOCK]) for at in range(0, len(x), BLOCK)] for _, x in self.postings]
        self.most = np.array([max(b) for b in self.block_max] or [0.0])
        self.threshold = threshold
        # Largest impacts of every term within coarse ranges of pieces; the last row is for words in no item.
        self.ranges = []
        for wanted in RANGES:
            of = np.arange(n) * wanted // max(1, n)
            table = np.zeros((len(terms) + 1, wanted), np.float32)
            for t, (k, x) in enumerate(self.postings):
                np.maximum.at(table[t], of[k], np.array(x, np.float32))
            self.ranges.append(table)

    def may_match(self, passages: np.ndarray) -> np.ndarray:
        """Which rows of terms could reach the threshold, by the maxima of ever smaller ranges. Repeats count once."""
        passages = np.sort(passages, axis=1)
        passages[:, 1:][passages[:, 1:] == passages[:, :-1]] = len(self.codes)
        left = np.arange(len(passages))
        for table in self.ranges:
            bound = np.zeros((len(left), table.shape[1]), np.float32)
            for k in range(passages.shape[1]):
                bound += table[passages[left, k]]
            left = left[bound.max(axis=1) >= self.threshold - 1e-3]
        return left

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items that a passage of these terms scores at or above the threshold: block-max WAND, document at a time."""
        need = self.threshold - 1e-9
        at = dict.fromkeys(terms, 0)
        found = []
        while True:
            live = sorted((self.postings[t][0][at[t]], t) for t in at if at[t] < len(self.postings[t][0]))
            bound, pivot = 0.0, None
            for k, (_, t) in enumerate(live):
                bound += self.most[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            upto = live[:pivot + 1]
            # Bound by the blocks that hold the pivot.
            block_bound, block_end = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else 1 << 60
            for _, t in upto:
                p = self.postings[t][0]
                b = at[t] // BLOCK
                while (b + 1) * BLOCK <= len(p) and p[min(len(p), (b + 1) * BLOCK) - 1] < item:
                    b += 1
                if b * BLOCK < len(p):
                    block_bound += self.block_max[t][b]
                    block_end = min(block_end, p[min(len(p), (b + 1) * BLOCK) - 1] + 1)
            if block_bound < need:
                for _, t in upto:
                    self._skip(at, t, max(block_end, item + 1))
            elif upto[0][0] == item:
                score = sum(self.postings[t][1][at[t]] for _, t in upto)
                if score >= need:
                    found.append((item, score))
                for _, t in upto:
                    at[t] += 1
            else:
                for first, t in upto:
                    if first < item:
                        self._skip(at, t, item)

    def _skip(self, at: dict[int, int], t: int, item: int) -> None:
        p = self.postings[t][0]
        k = at[t]
        while k < len(p) and p[min(len(p), (k // BLOCK + 1) * BLOCK) - 1] < item:
            k = (k // BLOCK + 1) * BLOCK
        while k < len(p) and p[k] < item:
            k += 1
        at[t] = k


def overlap(side: np.ndarray, text: np.ndarray) -> float:
    """Share of the words of ``side`` that lie in runs of ``RUN_WORDS`` words found in ``text``, order kept."""
    run = min(RUN_WORDS, len(side))
    if not run or len(text) < run:
        return 0.0
    there = {w.tobytes() for w in np.lib.stride_tricks.sliding_window_view(text, run)}
    hit = np.zeros(len(side), bool)
    for k, w in enumerate(np.lib.stride_tricks.sliding_window_view(side, run)):
        if w.tobytes() in there:
            hit[k:k + run] = True
    return float(hit.mean())


def block_matches(index: Index, data: np.ndarray, offsets: np.ndarray, passage: int = PASSAGE, stride: int = STRIDE):
    """(row, item place, score, question overlap, answer overlap, first word) of every verified item of each row."""
    lowered = LOWER[data]
    starts, ends, doc = word_spans(lowered, offsets, ALNUM)
    if not len(starts) or not len(index.codes):
        return []
    codes = word_codes(lowered, starts, ends)
    term = np.searchsorted(index.codes, codes)
    term[term == len(index.codes)] = 0
    term[index.codes[term] != codes] = -1
    term[term < 0] = len(index.codes)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(words) - words
    # Passages of every document: each stride until one reaches the end.
    n = np.where(words > 0, 1 + np.maximum(0, -(-(words - passage) // stride)), 0)
    row = np.repeat(np.arange(len(words)), n)
    low = first[row] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * stride
    high = np.minimum(low + passage, first[row] + words[row])
    places: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for at in range(0, len(low), 8192):
        place = low[at:at + 8192, None] + np.arange(passage)
        some = np.where(place < high[at:at + 8192, None], term[np.minimum(place, len(term) - 1)], len(index.codes))
        for p in index.may_match(some).tolist():
            terms = np.unique(some[p])
            for piece, score in index.search(terms[terms < len(index.codes)].tolist()):
                places.setdefault((int(row[at + p]), index.item[piece]), []).append((int(low[at + p]), score))
    out = []
    for (r, item), found in places.items():
        margin = index.lengths[item]
        windows: list[list] = []  # begin, end, best score and its first place; places come in order
        for at, score in found:
            begin, end = max(int(first[r]), at - margin), min(int(first[r] + words[r]), at + passage + margin)
            if not windows or begin > windows[-1][1]:
                windows.append([begin, end, score, at])
                continue
            windows[-1][1] = end
            if score > windows[-1][2]:
                windows[-1][2:] = score, at
        # The best window in which both sides overlap, the first of equal ones.
        for begin, end, score, at in sorted(windows, key=lambda w: (-w[2], w[0])):
            question, answer = (overlap(side, codes[begin:end]) for side in index.sides[item])
            if question >= OVERLAP and answer >= OVERLAP:
                out.append((r, item, score, question, answer, at - int(first[r])))
                break
    return out


def _items(items: DataFrame) -> DataFrame:
    return items.select(
        column(items, "item_id", "long").alias("item_id"), column(items, "text", "string").alias("text"),
        column(items, "question", "string").alias("question"), column(items, "answer", "string").alias("answer"),
    )


def _sides(text: str | None, question: str | None, answer: str | None) -> tuple[list[str], list[str]]:
    return question_and_answer(text) if question is None or answer is None else (item_words(question), item_words(answer))


def _piece_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, word, size): every different word of every piece; a null word has the size of the piece."""
    for batch in batches:
        rows = []
        for shard, *texts in zip(*(c.to_pylist() for c in batch.columns)):
            for piece in pieces(*_sides(*texts)):
                rows += [(shard, None, len(piece)), *((shard, w, 0) for w in dict.fromkeys(piece))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], ["shard", "word", "size"])


def _indexes(items: DataFrame, threshold: float, shard_items: int) -> Iterator[Index]:
    """One index per shard of at most about ``shard_items`` items, each collected and broadcast on its own.

    How many pieces there are, how long, and in how many a word stands is counted over all items, so scores are the
    same for any number of shards.
    """
    items = _items(items)
    n = items.count()
    shards = -(-n // shard_items) if n else 0
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, shards))))
    words = None
    if shards > 1:
        rows = stored(items.select("shard", "text", "question", "answer").mapInArrow(_piece_words, "shard long, word string, size long"), "piece-words")
        total = rows.where("word is null").agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
        counts = rows.where("word is not null").groupBy("shard", "word").agg(F.count("*").alias("own"))
        words = stored(counts.join(counts.groupBy("word").agg(F.sum("own").alias("frequency")), "word"), "piece-frequencies")
    for k in range(shards):
        rows = []
        for r in items.where(F.col("shard") == k).toLocalIterator():
            rows.append((r["item_id"], *_sides(r["text"], r["question"], r["answer"])))
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        statistics = None
        if words is not None:
            own = words.where(F.col("shard") == k).select("word", "frequency").toLocalIterator()
            statistics = Statistics(total["n"], total["size"] / max(1, total["n"]), {r["word"]: r["frequency"] for r in own})
        yield Index(rows, threshold, statistics)


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): the test items that each row holds.

    ``items`` has item_id and text, or question and answer. Every passage of the whole text is a query. A null or
    empty text, or one without words, matches nothing, and an item without words is never found; repeated rows
    and items are matched like any others; other columns are ignored; empty tables give an empty one.
    """
    slim = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    out = None
    for index in _indexes(items, threshold, shard_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for low, high, data, offsets in text_blocks(batch.column(1)):
                    found = block_matches(index, data, offsets)
                    rows = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(low, high - low).take(rows), pa.array([index.ids[f[1]] for f in found], pa.int64()),
                         *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4)), pa.array([f[5] for f in found], pa.int64())],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; no shuffle. Edge cases as in ``matches``."""
    place = docs.columns.index("text")
    for index in _indexes(items, threshold, shard_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for low, _, data, offsets in text_blocks(batch.column(place)):
                    for found in block_matches(shared.value, data, offsets):
                        keep[low + found[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
