"""Packing documents into sequences: first-fit decreasing on a tournament tree, in randomised groups.

A document becomes its token ids and an end id. Whatever exceeds the capacity
is cut off in full pieces; what remains is packed. Pieces are dealt to groups
by a hash, and each group is packed on its own: pieces in decreasing length,
each into the first bin that still has room, which a tournament tree over the
bins' free room finds in logarithmic time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column
from twinfold.llm.words import LOWER, SOLID, text_blocks, word_codes, word_spans

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Pieces packed together; the memory of a task is bounded by this, whatever its partition holds.
GROUP_PIECES = 20_000
#: Words whose ids a Python worker remembers.
MEMO_WORDS = 2_000_000
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b",.;:!?", np.uint8))


class WordEncoder:
    """Ids of whole texts through a tokenizer that never lets a token cross white space.

    Each different word is encoded once per worker and remembered; a text's ids are its words' ids in order.
    The tokenizer lowers A-Z and parts letters from the marks behind them, so words are remembered in lower
    case and without such marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.codes = np.empty(0, np.uint64)  # sorted
        self.entry = np.empty(0, np.int32)
        self.begin = np.zeros(1, np.int64)  # where each entry's ids begin, and where all end
        self.entry_length = np.zeros(0, np.int64)
        self.ids = np.empty(1 << 20, np.uint32)
        self.recent: dict[int, int] = {}

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and how many each has."""
        one = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(one.ids, np.uint32)
        ends = np.flatnonzero(self.word_end[ids])
        if len(ends) == len(words):
            return ids, np.diff(ends, prepend=-1)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _learn(self, codes: np.ndarray, words: list[str]) -> np.ndarray:
        """Entries of words that are new."""
        # Words of letters only are one unit to the tokenizer, whose last token is marked, so they can be encoded together.
        plain = np.array([_PLAIN.fullmatch(w) is not None for w in words], bool)
        lengths, ids = np.zeros(len(words), np.int64), []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain = int(plain.sum())
        for low, high, step in ((0, n_plain, 4096), (n_plain, len(words), 1024)):
            for at in range(low, high, step):
                some = order[at:min(high, at + step)]
                more, lengths[some] = self._ids([words[i] for i in some.tolist()])
                ids.append(more)
        new = np.concatenate(ids)
        first, known = int(self.begin[-1]), len(self.entry_length)
        if first + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[:first], np.empty(first + len(new), np.uint32)])
        self.ids[first:first + len(new)] = new
        begin = np.empty(len(words), np.int64)
        begin[order] = first + np.cumsum(lengths[order]) - lengths[order]
        self.begin = np.concatenate([self.begin[:-1], begin, [first + len(new)]])
        self.entry_length = np.concatenate([self.entry_length, lengths])
        entries = np.arange(known, known + len(words), dtype=np.int32)
        self.recent.update(zip(codes.tolist(), entries.tolist()))
        if 8 * len(self.recent) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
            self.entry = np.concatenate([self.entry, np.fromiter(self.recent.values(), np.int32, len(self.recent))])
            order = np.argsort(self.codes, kind="stable")
            self.codes, self.entry, self.recent = self.codes[order], self.entry[order], {}
        return entries

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes, example, place = np.unique(word_codes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.begin) > MEMO_WORDS:
            self.forget()
        entries = np.full(len(codes), -1, np.int32)
        at = np.searchsorted(self.codes, codes)
        inside = np.flatnonzero(at < len(self.codes))
        inside = inside[self.codes[at[inside]] == codes[inside]]
        entries[inside] = self.entry[at[inside]]
        missing = np.flatnonzero(entries < 0)
        if self.recent:
            entries[missing] = [self.recent.get(c, -1) for c in codes[missing].tolist()]
            missing = missing[entries[missing] < 0]
        if len(missing):
            buffer = data.tobytes()
            new = [buffer[s:e].decode() for s, e in zip(starts[example[missing]].tolist(), ends[example[missing]].tolist())]
            entries[missing] = self._learn(codes[missing], new)
        return entries[place]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and how many each text has."""
        if b"<|" not in data.tobytes():  # else a special token's text could come from capitals
            data = LOWER[data]
        starts, ends, doc = word_spans(data, offsets, SOLID)
        # A letter and a mark behind it, the word's last byte: two words.
        two = np.flatnonzero((ends - starts > 1) & _MARK[data[ends - 1]])
        two = two[_LETTER[data[ends[two] - 2]]]
        if len(two):
            starts, ends = np.insert(starts, two + 1, ends[two] - 1), np.insert(ends, two, ends[two] - 1)
            doc = np.insert(doc, two, doc[two])
        entries = self._entries(data, starts, ends)
        begin = self.begin[entries]
        length = self.entry_length[entries]
        total = int(length.sum())
        first = np.cumsum(length) - length
        ids = self.ids[np.arange(total) + np.repeat(begin - first, length)]
        return ids, np.bincount(doc, weights=length, minlength=len(offsets) - 1).astype(np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str | None) -> WordEncoder:
    """The worker's encoder; without a path, the public tokenizer of that name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length, the CRC-32 of its ids and the document's length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(1)):
                ids, lengths = encode(data, offsets)
                # Put the end id behind every document.
                total = lengths + 1
                begin = np.cumsum(total) - total
                full = np.full(int(total.sum()), END_ID, "<u4")
                full[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
                n = -(-total // capacity)
                doc = np.repeat(np.arange(high - low), n)
                start = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * capacity
                size = np.minimum(capacity, total[doc] - start)
                at = begin[doc] + start
                crc = [zlib.crc32(full[a:a + s]) for a, s in zip(at.tolist(), size.tolist())]
                columns = [batch.column(0).slice(low, high - low).take(pa.array(doc)), pa.array(start), pa.array(size),
                           pa.array(crc, pa.int64()), pa.array(total[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(full)), pa.int32()), pa.array(full.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return slim.mapInArrow(run, _PIECE + (", ids array<int>" if with_ids else ""))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Inner nodes of the tree hold the most room below them; a search goes left where it can."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    whole = int((sizes >= capacity).sum())
    bins[order[:whole]] = np.arange(whole)
    rest = order[whole:]
    leaves = 1 << max(0, len(rest) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for i, size in zip(rest.tolist(), sizes[rest].tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i], offsets[i] = whole + at - leaves, capacity - room[at]
        room[at] -= size
        at //= 2
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at //= 2
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
         with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and the offset each is put at.

    A null text is empty: its document is the end id alone. Repeated rows and ties are packed like any
    others, rows without doc_id keep a null one, other columns are ignored, an empty table gives no rows.
    ``with_ids`` adds the token ids themselves. No document is cut but at multiples of ``capacity``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 40

        def packed(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal next_id
            rows = pa.Table.from_batches(group).combine_chunks()
            sizes = rows["length"].to_numpy()
            bins, offsets = first_fit_decreasing(sizes, capacity)
            sequences = next_id + bins
            next_id += int(bins.max()) + 1
            rows = rows.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))
            return rows.to_batches()[0]

        group, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(batch.num_rows - at, group_pieces - n)
                group.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == group_pieces:
                    yield packed(group)
                    group, n = [], 0
        if n:
            yield packed(group)

    cut = pieces(docs, tokenizer, capacity, with_ids)
    dealt = cut.withColumn("deal", F.xxhash64("doc_id", "start", "ids_crc32"))
    dealt = dealt.repartition("deal").sortWithinPartitions("deal", "doc_id", "start", "doc_tokens").drop("deal")
    return dealt.mapInArrow(run, _PIECE + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long")
