"""License scans: a generalised suffix automaton of licence tokens gives matching statistics, chained into spans.

The automaton accepts every run of words of every licence text. A document's
words are streamed through it; after each word the state knows the longest run
ending there that some licence has. Places where a short phrase ends are read
off the states. Runs of at least ``LEAST`` words that cannot be longer are
chained per licence, in order and with bounded gaps, into spans; a licence
counts if its spans cover enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinfold.llm.decontaminate import item_words
from twinfold.llm.tables import column
from twinfold.llm.words import ALNUM, LOWER, code_of, text_blocks, word_codes, word_spans

#: The phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public licence notices, label and text.
NOTICES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see "
            "https://www.gnu.org/licenses/."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
             "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
               "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
               "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
               "limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
            "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
            "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: A run of so many words counts for a span; gaps of up to so many words are chained; so much of a notice must be covered.
LEAST, GAP, COVER = 4, 8, 0.6


class Automaton:
    """The suffix automaton of several word sequences. State 0 accepts the empty run."""

    def __init__(self, texts: list[list[str]]):
        self.word = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (text, place after the run) of the runs first met here
        for k, text in enumerate(texts):
            last = 0
            for place, w in enumerate(text, 1):
                last = self._extend(last, self.word[w])
                self.ends[last].append((k, place))
        # A state's runs also end where those of the states linked to it end.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends = [sorted(set(e)) for e in self.ends]
        self.ends[0] = []

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, w: int, old: int) -> int:
        """A state for only those runs of ``old`` that end a run of ``state`` and w."""
        copy = self._state(self.length[state] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        while state >= 0 and self.next[state].get(w) == old:
            self.next[state][w] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # another text had this run
            old = self.next[last][w]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, w, old)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            old = self.next[last][w]
            self.link[new] = old if self.length[old] == self.length[last] + 1 else self._split(last, w, old)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest known run that ends with word w, after one of ``length`` words that ended in ``state``."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        follow = self.next[state].get(w)
        return (0, 0) if follow is None else (follow, length + 1)


class Scanner:
    """The automaton of phrases and notices with what reading off its states needs; built once, sent to every task."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices=NOTICES):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.notices = [(label, item_words(text)) for label, text in notices]
        self.automaton = Automaton([p for p, _ in self.phrases] + [t for _, t in self.notices])
        codes = sorted((code_of(w), k) for w, k in self.automaton.word.items())
        self.codes = np.array([c for c, _ in codes], np.uint64)
        self.words = np.array([k for _, k in codes], np.int64)
        n = len(self.phrases)
        # Phrases that end wherever a state's longest runs end.
        self.phrase_at: list[list[int]] = [[] for _ in self.automaton.link]
        for k, (phrase, _) in enumerate(self.phrases):
            state, length = 0, 0
            for w in phrase:
                state, length = self.automaton.step(state, length, self.automaton.word[w])
            self.phrase_at[state].append(k)
        for state in sorted(range(1, len(self.automaton.link)), key=lambda s: self.automaton.length[s]):
            self.phrase_at[state] = self.phrase_at[state] + self.phrase_at[self.automaton.link[state]]
        self.notice_ends = [[(k - n, e) for k, e in ends if k >= n] for ends in self.automaton.ends]

    def scan(self, words: list[int], first: int, places: list, runs: list) -> None:
        """Stream a run of known words that starts at word ``first`` of its document."""
        step, phrase_at = self.automaton.step, self.phrase_at
        state = length = 0
        for k, w in enumerate(words, first):
            before = (state, length)
            state, length = step(state, length, w)
            if before[1] >= LEAST and length <= before[1]:
                runs.append((k - before[1], *before))
            for p in phrase_at[state]:
                n = len(self.phrases[p][0])
                if length >= n:
                    places.append((k - n + 1, p))
        if length >= LEAST:
            runs.append((first + len(words) - length, state, length))

    def spans(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share) of notices: runs chained in order, gaps up to ``GAP`` words."""
        by_notice: dict[int, list[tuple[int, int, int]]] = {}
        for at, state, length in runs:
            for k, end in self.notice_ends[state]:
                by_notice.setdefault(k, []).append((at, end - length, length))
        out = []
        for k, found in by_notice.items():
            label, text = self.notices[k]
            found.sort()
            # best[i]: most words covered by a chain that ends with run i, and where it began
            best: list[tuple[int, int]] = []
            low = 0
            for i, (at, start, length) in enumerate(found):
                while found[low][0] + found[low][2] + GAP < at:
                    low += 1
                covered, begin = length, at
                for j in range(low, i):
                    at_j, start_j, length_j = found[j]
                    # Runs may overlap: only new words count.
                    new = min(at + length - at_j - length_j, start + length - start_j - length_j, length)
                    if new > 0 and at >= at_j and start >= start_j and at - at_j - length_j <= GAP and start - start_j - length_j <= GAP:
                        if best[j][0] + new > covered:
                            covered, begin = best[j][0] + new, best[j][1]
                best.append((covered, begin))
            for (covered, begin), (at, _, length) in zip(best, found):
                share = min(1.0, covered / len(text))
                if share >= COVER:
                    out.append((label, begin, at + length - 1, share))
        # Of chains that begin at the same word, the best.
        chosen: dict[tuple[str, int], tuple[str, int, int, float]] = {}
        for s in sorted(out, key=lambda s: (s[3], s[2])):
            chosen[s[0], s[1]] = s
        return sorted(chosen.values(), key=lambda s: (s[1], s[0]))


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,last_word:long,share:double>>"
)


def scan_block(scanner: Scanner, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    lowered = LOWER[data]
    starts, ends, doc = word_spans(lowered, offsets, ALNUM)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    places: list[list] = [[] for _ in range(n)]
    runs: list[list] = [[] for _ in range(n)]
    if len(starts):
        codes = word_codes(lowered, starts, ends)
        at = np.searchsorted(scanner.codes, codes)
        at[at == len(scanner.codes)] = 0
        known = scanner.codes[at] == codes
        word = scanner.words[at]
        # Runs of at least two known words of one document; nothing shorter can hold a phrase or a span.
        inner = known.copy()
        inner[1:] &= known[:-1] & (doc[1:] == doc[:-1])
        inner[0] = False
        begin = np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]])) - 1
        stop = np.flatnonzero(inner & ~np.concatenate([inner[1:], [False]])) + 1
        for low, high in zip(begin.tolist(), stop.tolist()):
            d = doc[low]
            scanner.scan(word[low:high].tolist(), low - int(first[d]), places[d], runs[d])
    out = []
    for d in range(n):
        spans = scanner.spans(runs[d]) if runs[d] else []
        base = sorted({scanner.phrases[p][1] for _, p in places[d]})
        labels = sorted({*base, *(s[0] for s in spans)})
        starts_ = [s for s, _ in places[d]]
        out.append((int(counts[d]), len(starts_), min(starts_, default=None), max(starts_, default=None), ",".join(base), ",".join(labels),
                    max((s[3] for s in spans), default=0.0), spans))
    return out


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document: words, places and labels of the base phrases, all labels, score and spans.

    ``score`` is the largest share of a notice that a span covers, 0 without spans. A null or empty text has no
    words, no places, empty labels and a score of 0; ties, repeated rows and rows without doc_id are kept as they
    come; other columns are ignored; an empty table gives an empty one.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, notices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(1)):
                rows = scan_block(scanner.value, data, offsets)
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds[:-1])]
                found = [[dict(zip(("label", "first_word", "last_word", "share"), s)) for s in r[-1]] for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns, pa.array(found, spans)], names)

    slim = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return slim.mapInArrow(run, _SCHEMA)
