"""Licence scans with a generalised suffix automaton.

The automaton holds the word sequences of all templates. A file's words are
streamed through it and give matching statistics: at each word the longest
suffix read so far that is a factor of a template. Maximal long matches of one
template are chained (in order in both, with short gaps); the chain's covered
share of the template is its score, each disjoint chain of SHARE a span. Words that cannot be inside a long match
(their neighbours form no pair that occurs in a template) are skipped by a
vectorised test that loses no match of LEAST words.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, Words, arrow_map, only, slices, to_batch

#: The phrases that every scan counts.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of public licences.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Shortest match that counts, longest gap in a chain (words), and the covered share that earns a label.
LEAST, GAP_WORDS, SHARE = 4, 20, 0.8
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAPS = np.zeros(256, bool)
_GAPS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def word_list(text: str) -> list[bytes]:
    return _WORD.findall(LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes())


class Automaton:
    """Suffix automaton of several sequences of small ints; state 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, last position) of each state's strings
        for k, seq in enumerate(sequences):
            last = 0
            for pos, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].append((k, pos))
        # a state's strings end wherever those of the states below it in the link tree do
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]].extend(self.ends[v])
        self.ends[0] = []
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: state and match length after each symbol."""
        v, n = 0, 0
        for c in seq:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield v, n


def _touches(spans: list[tuple[int, int]], first: int, last: int) -> bool:
    """Whether first..last meets one of the sorted, disjoint spans."""
    i = bisect_right(spans, (last, 1 << 62))
    return i > 0 and spans[i - 1][1] >= first


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.label, self.sizes, seqs = [], [], []
        vocab: dict[bytes, int] = {}
        for label, texts in templates.items():
            for t in texts:
                seqs.append([vocab.setdefault(w, len(vocab)) for w in word_list(t)])
                self.label.append(label)
                self.sizes.append(len(seqs[-1]))
        self.phrases = [([vocab.setdefault(w, len(vocab)) for w in word_list(p)], label) for p, label in phrases.items()]
        self.automaton = Automaton(seqs)
        words = list(vocab)
        h = Words(pa.array([w.decode() for w in words]), gap=_GAPS).hash
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[h >> np.uint64(48)] = True
        self.pairs = np.zeros((len(vocab), len(vocab)), bool)
        for s in seqs:
            self.pairs[s[:-1], s[1:]] = True

    def chains(self, seq: np.ndarray, at: int, found: dict[int, list[tuple[int, int, int]]]) -> None:
        """Adds the maximal matches of a run of words, by template: (file position, template position, length)."""
        stats = list(self.automaton.stream(seq.tolist()))
        for i, (v, n) in enumerate(stats):
            if n >= LEAST and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                for t, end in self.automaton.ends[v]:
                    found.setdefault(t, []).append((at + i - n + 1, end - n + 1, n))

    def best(self, found: dict[int, list[tuple[int, int, int]]]) -> list[tuple[float, int, int, int]]:
        """Per template the best chain, and every other one of SHARE that shares no word of the file with one taken: covered share, template, first and last word in the file."""
        out = []
        for t, ms in found.items():
            ms.sort()
            taken: list[tuple[int, int]] = []
            while ms:
                more = []
                for n, f, e in self._tops(ms):
                    good = n / self.sizes[t] >= SHARE
                    if (good or not taken and not more) and not _touches(more, f, e):
                        insort(more, (f, e))
                        out.append((min(1.0, n / self.sizes[t]), t, f, e))
                    if not good:
                        break
                taken += more
                ms = [m for m in ms if not _touches(more, m[0], m[0] + m[2] - 1)] if more else []
        return out

    def _tops(self, ms: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The best chain from each match that opens chains: covered words, first and last word; the best first."""
        gain: list[tuple[int, int]] = []  # covered words, and the match that opens the chain
        for j, (f, p, n) in enumerate(ms):
            top = (n, j)
            for i in range(j - 1, -1, -1):
                f0, p0, n0 = ms[i]
                if f - (f0 + n0) > GAP_WORDS + 200:
                    break
                over = max(0, f0 + n0 - f, p0 + n0 - p)
                if f > f0 and p > p0 and f - (f0 + n0) <= GAP_WORDS and over < n and gain[i][0] + n - over > top[0]:
                    top = (gain[i][0] + n - over, gain[i][1])
            gain.append(top)
        last: dict[int, int] = {}
        for j, (n, k) in enumerate(gain):
            if k not in last or n > gain[last[k]][0]:
                last[k] = j
        return [(gain[j][0], ms[k][0], ms[j][0] + ms[j][2] - 1) for k, j in sorted(last.items(), key=lambda x: (-gain[x[1]][0], x[1]))]

    def scan(self, b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column("text"), lower=True, gap=_GAPS)
        n = len(w.count)
        ids = np.full(len(w.hash) + 1, -1)
        near = np.flatnonzero(self.maybe[w.hash >> np.uint64(48)])
        k = np.minimum(np.searchsorted(self.hashes, w.hash[near]), len(self.hashes) - 1)
        hit = self.hashes[k] == w.hash[near]
        ids[near[hit]] = self.ids[k[hit]]
        left = w.left()
        n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        base: dict[int, set[str]] = {}
        for phrase, label in self.phrases:
            p = np.flatnonzero((ids[:-1] == phrase[0]) & (left >= len(phrase)))
            for j, c in enumerate(phrase[1:], 1):
                p = p[ids[p + j] == c]
            d = np.searchsorted(w.at, p, "right") - 1
            for i, at in zip(d.tolist(), (p - w.at[d]).tolist(), strict=True):
                n_base[i] += 1
                first[i] = at if first[i] < 0 else min(first[i], at)
                last[i] = max(last[i], at)
                base.setdefault(i, set()).add(label)
        # runs of at least LEAST - 1 pairs that occur in templates
        pair = np.zeros(len(w.hash) + 1, bool)
        q = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (left >= 2))
        pair[q] = self.pairs[ids[q], ids[q + 1]]
        edge = np.diff(np.concatenate([[0], pair.view(np.int8), [0]]))
        found: dict[int, dict] = {}
        for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if z - a >= LEAST - 1:
                d = int(np.searchsorted(w.at, a, "right")) - 1
                self.chains(ids[a : z + 1], a - int(w.at[d]), found.setdefault(d, {}))
        labels, score, spans = [], np.zeros(n), [""] * n
        for i in range(n):
            own = set(base.get(i, ()))
            if found.get(i):
                best = self.best(found[i])
                score[i] = max(x[0] for x in best)
                good = sorted((self.label[t], f, e) for s, t, f, e in best if s >= SHARE)
                own |= {x[0] for x in good}
                spans[i] = ",".join(f"{a}:{f}-{e}" for a, f, e in good)
            labels.append(",".join(sorted(own)))
        none = first < 0
        return to_batch(_OUT, doc_id=b.column("doc_id"), n_words=w.count, n_base=n_base, first_word=pa.array(first, mask=none), last_word=pa.array(last, mask=none), base_labels=[",".join(sorted(base.get(i, ()))) for i in range(n)], labels=labels, score=score, spans=spans)


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs(doc_id, text) -> a row each: phrase places, labels, the best covered share of a template, and labelled spans (label:first-last word).

    A null text is empty: no words, null places, empty labels, score 0.
    Repeated rows are scanned one by one, alike. Of chains that cover as much of
    a template the one that begins first counts. No rows, no rows; extra columns
    are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, phrases)
        for b in slices(batches):
            yield s.scan(b)

    return arrow_map(only(docs, doc_id="bigint", text="string"), run, _OUT)


def op8_licences(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def licence_base(spark, sf_dir: str) -> DataFrame:
    """The phrase counts of op8_licences, which SQL can express."""
    return op8_licences(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENCE_BASE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) t(words, label)),
h AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: list_slice(w, i + 1, i + len(words)) = words)) AS k FROM d, p),
a AS (SELECT doc_id, count(*) AS n, min(k) AS x, max(k) AS y, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(x AS BIGINT) AS first_word, CAST(y AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN a USING (doc_id)
"""
