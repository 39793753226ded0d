"""Stupid-backoff scores against the n-gram counts of the whole corpus.

Documents are dealt into chunks by a hash. Each chunk sends its different
n-grams with their counts to the count tables, which are partitioned by the
n-gram's code; every partition adds the counts up and joins them back to the
chunks that asked, in the order they asked. A chunk then has the corpus counts
of all its n-grams, and sums the scores of each document. So what is shuffled are the different
n-grams of a chunk, not the places where they stand, and a very common n-gram
is one entry per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column
from twinfold.llm.words import ALNUM, LOWER, extend, text_blocks, word_codes, word_spans

ORDER = 2
#: Factor for every step back, and the least count of an n-gram of two words or more in the tables.
ALPHA, LEAST_COUNT = 0.4, 2
#: Characters of a chunk, and of the corpus for each partition of the count tables, on average.
CHUNK_CHARS, TABLE_CHARS = 6_000_000, 8_000_000


def document_grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order 1..n the code of the n-gram that ends at each word (0 where none does), and the words of each document."""
    codes, counts = [], []
    for low, high, data, offsets in text_blocks(texts):
        lowered = LOWER[data]
        starts, ends, doc = word_spans(lowered, offsets, ALNUM)
        codes.append(word_codes(lowered, starts, ends))
        counts.append(np.bincount(doc, minlength=high - low))
    words = np.concatenate(codes) if codes else np.empty(0, np.uint64)
    count = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    grams = [np.maximum(words, 1)]
    for n in range(2, order + 1):
        gram = np.zeros(len(words), np.uint64)
        gram[1:] = np.maximum(extend(grams[-1][:-1], words[1:]), 1)
        gram[place < n - 1] = 0
        grams.append(gram)
    return grams, count


def _narrow(values: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs; the first byte says how many."""
    most = int(values.max(initial=0))
    width = max(1, (most.bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _codes_out(codes: np.ndarray) -> bytes:
    """Sorted codes as differences."""
    return _narrow(np.diff(codes, prepend=np.uint64(0)))


def _codes_in(data: bytes) -> np.ndarray:
    return np.cumsum(_wide(data), dtype=np.uint64)


def chunk_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of some documents in the order of their codes, and how often each occurs."""
    grams, _ = document_grams(texts, order)
    codes, counts = np.unique(np.concatenate(grams), return_counts=True)
    return (codes[1:], counts[1:]) if len(codes) and codes[0] == 0 else (codes, counts)


_ASKED = "bucket int, chunk int, codes binary, counts binary"


def _ask(order: int, bits: int):
    """Rows come sorted by chunk: a chunk's n-grams and counts, cut by the first bits of the codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        chunk = None

        def asked() -> pa.RecordBatch:
            codes, counts = chunk_grams(pa.concat_arrays(held), order)
            cuts = np.append(np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else 0, len(codes))
            some = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int32()),
                 pa.array([_codes_out(codes[cuts[b]:cuts[b + 1]]) for b in some], pa.binary()),
                 pa.array([_narrow(counts[cuts[b]:cuts[b + 1]]) for b in some], pa.binary())],
                ["bucket", "chunk", "codes", "counts"])

        for batch in batches:
            chunks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    if held and chunk != int(chunks[low]):
                        yield asked()
                        held = []
                    chunk = int(chunks[low])
                    held.append(batch.column(2).slice(low, high - low))
        if held:
            yield asked()

    return run


_TOLD = "chunk int, bucket int, counts binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: add up a bucket's counts, and tell every asking chunk those of its n-grams, in their order."""
    held: list[tuple[int, bytes, bytes]] = []
    bucket = None

    def told() -> Iterator[pa.RecordBatch]:
        codes = [_codes_in(c) for _, c, _ in held]
        table, place = np.unique(np.concatenate(codes), return_inverse=True)
        totals = np.zeros(len(table), np.uint64)
        np.add.at(totals, place, np.concatenate([_wide(n) for _, _, n in held]))
        cuts = np.cumsum([len(c) for c in codes])[:-1]
        for (chunk, _, _), own in zip(held, np.split(place, cuts)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([bucket], pa.int32()), pa.array([_narrow(totals[own])], pa.binary())], ["chunk", "bucket", "counts"])

    for batch in batches:
        for b, chunk, codes, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held and b != bucket:
                yield from told()
                held = []
            bucket = b
            held.append((chunk, codes, counts))
    if held:
        yield from told()


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least_count: int = LEAST_COUNT) -> DataFrame:
    """(doc_id, n_words, log_score, word_score) of every row; scores are natural logarithms, ``word_score`` per word.

    The score of a word is the share of its n-gram in the count of the words before it, if the corpus has the
    n-gram at least ``least_count`` times, else ``alpha`` times the score with one word less before it; a single
    word has its share of all words. Counts cover the whole texts of all rows. A null or empty text, or one without
    words, has a ``log_score`` of 0 and a null ``word_score``; repeated rows are counted and scored each time;
    other columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    slim = docs.select(column(docs, "doc_id", "long").alias("doc_id"), text.alias("text"))
    size, total = _measure(slim)
    chunks = max(1, math.ceil(size / CHUNK_CHARS))
    bits = max(0, math.ceil(math.log2(max(1, size / TABLE_CHARS))))
    dealt = slim.select(F.pmod(F.xxhash64("text", "doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text").repartition("chunk")
    asked = dealt.sortWithinPartitions("chunk").mapInArrow(_ask(order, bits), _ASKED)
    told = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, _TOLD)
    def finish(own: pa.Table, counts: pa.Table) -> pa.Table:
        codes, _ = chunk_grams(own["text"].combine_chunks(), order)
        answers = sorted(zip(counts["bucket"].to_pylist(), counts["counts"].to_pylist()))
        count = np.concatenate([_wide(n) for _, n in answers]) if answers else np.empty(0, np.uint64)
        if len(count) != len(codes):
            raise RuntimeError(f"a chunk of {len(codes)} n-grams was told {len(count)} counts")
        words, scores = [], []
        for batch in own.to_batches(max_chunksize=512):  # blocks of whole documents keep the arrays small
            grams, n = document_grams(batch.column(batch.schema.get_field_index("text")), order)
            seen = [np.zeros(len(g)) if not len(codes) else np.where(g == 0, 0.0, count[np.minimum(np.searchsorted(codes, g), len(codes) - 1)].astype(float)) for g in grams]
            value = np.log(np.maximum(seen[0], 1.0) / max(total, 1))
            for k in range(1, order):
                context = np.concatenate([[1.0], seen[k - 1][:-1]])[:len(value)]
                longer = np.log(np.maximum(seen[k], 1.0) / np.maximum(context, 1.0))
                # Where a document begins there is no longer n-gram, and that is no step back.
                value = np.where(seen[k] >= least_count, longer, np.where(grams[k] == 0, value, value + math.log(alpha)))
            ends = np.cumsum(n)
            # Each document is summed on its own, so its score does not depend on its neighbours.
            scores += [float(value[e - m:e].sum()) for e, m in zip(ends.tolist(), n.tolist())]
            words += n.tolist()
        return pa.table({
            "doc_id": own["doc_id"].cast(pa.int64()), "n_words": pa.array(words, pa.int64()), "log_score": pa.array(scores, pa.float64()),
            "word_score": pa.array([s / n if n else None for s, n in zip(scores, words)], pa.float64()),
        })

    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, log_score double, word_score double")


def _measure(slim: DataFrame) -> tuple[int, int]:
    """Bytes and words of the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = words = 0
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                inside = ALNUM[LOWER[data]]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                inner = offsets[1:-1][offsets[1:-1] < len(data)]
                begins[inner] = inside[inner]
                size, words = size + len(data), words + int(begins.sum())
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([words], pa.int64())], ["size", "words"])

    total = slim.select("text").mapInArrow(run, "size long, words long").agg(F.sum("size").alias("size"), F.sum("words").alias("words")).first()
    return total["size"] or 0, total["words"] or 0
