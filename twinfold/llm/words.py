"""Words of Arrow text columns as numpy arrays.

A batch is cut into blocks of documents of about ``BLOCK_BYTES``; within a
block all work is on arrays: where words start and end, which document they
belong to, and a 64-bit code per word or n-gram. Texts are never cut, so one
long document can make a larger block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)

_BYTES = np.arange(256)
#: A-Z in lower case, every other byte as it is.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are in lower case.
ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: Bytes of ``[^\x20\x09-\x0D]``.
SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def text_blocks(texts: pa.Array, block_bytes: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of rows of ``block_bytes`` (``BLOCK_BYTES``); a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        after = int(np.searchsorted(offsets, offsets[first] + (block_bytes or BLOCK_BYTES), "right")) - 1
        after = min(n, max(after, first + 1))
        yield first, after, data[offsets[first]:offsets[after]], offsets[first:after + 1] - offsets[first]
        first = after


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes, and the document it stands in; documents part words."""
    inside = word_byte[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.full(max(n, 64), _MULTIPLIER)
        _POWERS[0] = 1
        _POWERS = np.multiply.accumulate(_POWERS)
    return _POWERS


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of the bytes of each word: a polynomial modulo 2**64, then mixed."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    terms = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)].astype(np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(terms), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    terms += np.uint64(1)
    terms *= _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _MIX_1)


def code_of(word: str) -> int:
    """The code that ``word_codes`` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_codes(data, np.array([0]), np.array([len(data)]))[0])


def counts_per_document(documents: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(documents, minlength=n).astype(np.int64)


def extend(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The codes of n-grams from those of their first words and of their last word."""
    return mix(context * _MULTIPLIER + words)
