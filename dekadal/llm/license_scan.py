"""License scans: a generalised suffix automaton of licence tokens.

The automaton holds the token strings of all templates. Documents stream through it and yield matching statistics (at
each word: the length of the longest template substring ending there). Long matches are chained, in template order, to
spans that cover a template. Phrases are templates too: a phrase ends at a word where the matched string has it as a
suffix, which the automaton's suffix links tell without a second search.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._text import ALNUM_LOWER, LOWER, hash_word, map_texts, run_hashes, runs, table, tuned

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Tokens of a run that are stepped one after another.
PIECE = 4096

# The phrases of the contract and excerpts of public licence texts and notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("proprietary", "All rights reserved. This software is proprietary and confidential. Unauthorized copying of this file, via any medium is strictly prohibited"),
]


def words(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Automaton:
    """Generalised suffix automaton over token ids, with transitions completed through the suffix links.

    ``goto[s, a]`` is the state after reading token a in state s with a match of length l; the new length is
    ``min(l, cap[s, a]) + 1``, or 0 where ``cap`` is -1.
    """

    def __init__(self, strings: list[list[str]]):
        self.vocab = {w: i for i, w in enumerate(sorted({w for s in strings for w in s}))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.place = [-1], [0], [()]
        for k, s in enumerate(strings):
            last = 0
            for i, w in enumerate(s):
                last = self._add(last, self.vocab[w])
                self.place[last] += ((k, i),)
        n, m = len(self.next), len(self.vocab)
        self.goto, self.cap = np.zeros((n, m), np.int32), np.full((n, m), -1, np.int32)
        for s in sorted(range(n), key=self.length.__getitem__):
            if s:
                self.goto[s], self.cap[s] = self.goto[self.link[s]], self.cap[self.link[s]]
            for a, t in self.next[s].items():
                self.goto[s, a], self.cap[s, a] = t, self.length[s]

        self.matches = self._matches()

    def _matches(self) -> list[list[tuple[int, int, list[int]]]]:
        """Per state the strings that hold a suffix of what the state reads: (string, length of the longest such suffix, its
        last places in the string). A state's places are its own and those of the states whose links lead to it."""
        ends: list[dict[int, set[int]]] = [{} for _ in self.link]
        by_length = sorted(range(len(self.link)), key=self.length.__getitem__)
        for s in reversed(by_length):
            for k, i in self.place[s]:
                ends[s].setdefault(k, set()).add(i)
            if self.link[s] > 0:
                for k, own in ends[s].items():
                    ends[self.link[s]].setdefault(k, set()).update(own)
        found: list[dict[int, tuple[int, list[int]]]] = [{} for _ in self.link]
        for s in by_length[1:]:
            found[s] = found[self.link[s]] | {k: (self.length[s], sorted(own)) for k, own in ends[s].items()}
        return [[(k, n, own) for k, (n, own) in sorted(f.items())] for f in found]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.place.append(())
        return len(self.next) - 1

    def _split(self, p: int, q: int, a: int) -> int:
        """The state of strings of length at most length[p] + 1 in q; q itself if it has no longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._state(self.length[p] + 1)
        self.next[c], self.link[c], self.link[q] = dict(self.next[q]), self.link[q], c
        while p >= 0 and self.next[p].get(a) == q:
            self.next[p][a] = c
            p = self.link[p]
        return c

    def _add(self, last: int, a: int) -> int:
        if a in self.next[last]:  # another template has this prefix
            return self._split(last, self.next[last][a], a)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and a not in self.next[p]:
            self.next[p][a] = new
            p = self.link[p]
        self.link[new] = self._split(p, self.next[p][a], a) if p >= 0 else 0
        return new

    def walk(self, ids: list[int]) -> int:
        s = 0
        for a in ids:
            s = self.next[s][a]
        return s

    def statistics(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of many token runs, one step of all runs at a time: states and lengths per token.

        Long runs are stepped in pieces, side by side. No match is longer than the longest template, so a piece that begins
        that many tokens early, from nothing, is in the run's own state when its tokens come.
        """
        state, length = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
        pieces = -(-size // PIECE)
        run = np.repeat(np.arange(len(start)), pieces)
        at = PIECE * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))  # in its run
        early = np.minimum(at, max(self.length))
        start, size = start[run] + at - early, np.minimum(PIECE, size[run] - at) + early
        order = np.argsort(-size, kind="stable")
        start, size, early = start[order], size[order], early[order]
        s, n = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, "left"))  # runs longer than step
            at = start[:live] + step
            a, s0 = ids[at], s[:live]
            cap = self.cap[s0, a]
            n[:live] = np.where(cap < 0, 0, np.minimum(n[:live], cap) + 1)
            s[:live] = self.goto[s0, a]
            own = early[:live] <= step
            state[at[own]], length[at[own]] = s[:live][own], n[:live][own]
        return state, length


class Scanner:
    """Labels of licences in documents. min_match: words of a match that chaining takes; max_gap: words between two
    matches of one chain; min_words and min_cover: what a chain must cover to count as a label."""

    def __init__(
        self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, min_match: int = 4,
        max_gap: int = 8, min_words: int = 8, min_cover: float = 0.5,
    ):
        self.templates = [(label, words(t)) for label, t in templates]
        self.phrases = [(words(p), label) for p, label in phrases.items()]
        self.sam = Automaton([t for _, t in self.templates] + [p for p, _ in self.phrases])
        self.min_match, self.max_gap, self.min_words, self.min_cover = min_match, max_gap, min_words, min_cover
        names = sorted(self.sam.vocab, key=hash_word)
        self.hashes = np.array([hash_word(w) for w in names], np.uint64)
        self.ids = np.array([self.sam.vocab[w] for w in names], np.int32)
        link, self.ends = self.sam.link, []
        for p, label in self.phrases:
            top = self.sam.walk([self.sam.vocab[w] for w in p])
            below = np.zeros(len(link), bool)
            for s in sorted(range(len(link)), key=self.sam.length.__getitem__):
                below[s] = s != top and link[s] >= 0 and (link[s] == top or below[link[s]])
            self.ends.append((top, below, len(p), label))

    def chains(self, at: np.ndarray, state: np.ndarray, length: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share) of one document's chains of long matches.

        Every template that holds a match is credited with it. Where chains of several templates overlap, those that cover
        the most words stay, all of them on a tie, since templates share long passages.
        """
        by_template: dict[int, list[tuple[int, int, list[int]]]] = {}
        for i in np.flatnonzero(length >= self.min_match).tolist():
            for k, most, ends in self.sam.matches[state[i]]:
                size = min(most, int(length[i]))
                if size >= self.min_match and k < len(self.templates):
                    by_template.setdefault(k, []).append((int(at[i]) + 1, size, ends))
        found = [(k, *c) for k, rows in by_template.items() for c in self.chain(rows)]
        long = [c for c in found if c[3] >= self.min_words or c[3] >= self.min_cover * len(self.templates[c[0]][1])]
        best: list[tuple[int, int, int, int]] = []
        taken = bytearray(max((c[2] for c in long), default=0))  # words of the chains that cover more
        for _, tied in groupby(sorted(long, key=lambda c: -c[3]), key=lambda c: c[3]):
            stay = [c for c in tied if taken.find(1, c[1], c[2]) < 0]
            for c in stay:
                taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
            best += stay
        return sorted((self.templates[k][0], first, stop, n / len(self.templates[k][1])) for k, first, stop, n in best)

    def chain(self, rows: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, covered words) of one template's matches (word after it, length, last places in
        the template), by rising word. A match counts where it is longest; it joins the chain before it if the gap is small
        and it has a place in the template not before that chain's; of several places, it takes the first."""
        out: list[tuple[int, int, int]] = []
        open_: list[int] | None = None  # first, stop, covered, place in the template
        for j, (stop, size, ends) in enumerate(rows):
            if j + 1 < len(rows) and rows[j + 1][0] == stop + 1 and rows[j + 1][1] == size + 1:
                continue
            place = next((e for e in ends if open_ and e >= open_[3]), None)
            if open_ and place is not None and stop - size - open_[1] <= self.max_gap:
                new = max(0, min(size, stop - open_[1], place - open_[3]))
                open_ = [open_[0], stop, open_[2] + new, place]
                continue
            if open_:
                out.append((open_[0], open_[1], open_[2]))
            open_ = [stop - size, stop, size, ends[0]]
        return [*out, (open_[0], open_[1], open_[2])] if open_ else out

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> dict:
        buf = LOWER[buf]
        starts, ends, wo = runs(buf, offs, ALNUM_LOWER)
        h = run_hashes(buf, starts, ends)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[slot] == h
        new = known.copy()  # a run of known words ends with its document
        new[1:] &= ~known[:-1]
        heads = wo[:-1][np.diff(wo) > 0]
        new[heads] = known[heads]
        place = np.flatnonzero(known)
        run = np.flatnonzero(new[place])
        state, length = self.sam.statistics(self.ids[slot[place]], run, np.diff(np.append(run, len(place))))
        docs = len(offs) - 1
        n_base, first, last = np.zeros(docs, np.int64), np.full(docs, np.iinfo(np.int64).max), np.full(docs, -1)
        base: list[set] = [set() for _ in range(docs)]
        doc = np.searchsorted(wo, place, "right") - 1
        for top, below, size, label in self.ends:
            hit = np.flatnonzero(below[state] | ((state == top) & (length >= size)))
            begin = place[hit] - size + 1 - wo[doc[hit]]
            np.add.at(n_base, doc[hit], 1)
            np.minimum.at(first, doc[hit], begin)
            np.maximum.at(last, doc[hit], begin)
            for d in np.unique(doc[hit]):
                base[d].add(label)
        spans: list[list] = [[] for _ in range(docs)]
        for d in np.unique(doc[length >= self.min_match]):
            own = slice(*np.searchsorted(doc, [d, d + 1]))
            spans[d] = self.chains(place[own] - wo[d], state[own], length[own])
        none = n_base == 0
        labels = [b | {s[0] for s in x} for b, x in zip(base, spans, strict=True)]
        score = [min(1.0, 0.5 * bool(b) + 0.5 * min(1.0, max([s[3] for s in x], default=0.0)) + 0.25 * (bool(x) and not b)) for b, x in zip(base, spans, strict=True)]
        return {
            "n_words": np.diff(wo),
            "n_base": n_base,
            "first_word": pa.array(first, mask=none),
            "last_word": pa.array(last, mask=none),
            "base_labels": [",".join(sorted(b)) for b in base],
            "labels": [",".join(sorted(x)) for x in labels],
            "score": score,
            "spans": [",".join(f"{a}:{b}:{c}" for a, b, c, _ in x) for x in spans],
        }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(df: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row, with the licence spans (``label:first word:word after the last``) and labels of its text.

    No shuffle: the automaton (a few thousand states, fixed by the templates) goes to the tasks with the function.
    Null and empty texts have no words, no labels and score 0; a null id passes through; repeated rows stay, and an empty
    table gives none. Chains that cover equally many words of the same place all count. A very long text is scanned whole,
    in memory of some 30 bytes a byte. Extra columns are not read.
    """
    return map_texts(df, SCHEMA, (scanner or Scanner()).scan, [id_col], text)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(tuned(spark), sf_dir, "documents"))
