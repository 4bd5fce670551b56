"""Operator 13: licence scans with a generalised suffix automaton.

All templates (licence notices and the base phrases) are token sequences of one generalised suffix automaton, built once and
broadcast; its size is that of the templates, a parameter. Every text is streamed through it in blocks: the
automaton's state gives, for each word, the longest run of words ending there that some template has
(matching statistics). A base phrase stands where the run is at least as long as the phrase and the state's
chain of suffix links has it. Runs of at least ``least`` words that the next word does not extend are
chained per template, in the order of both text and template and with gaps of at most ``gap`` words in the text; a
chain that covers at least ``covered`` of its template is a span of it.

Texts are lower-cased (A-Z); words are runs of digits, letters a-z and characters beyond ASCII. A task holds
one block of a text and the open chains, whatever the text's length; nothing is shuffled. Null texts are empty, empty
texts have no words. Repeated rows and null ids keep their rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phrases of the registered query and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

#: Sentences of published licence notices, by label.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]

WORD_BYTES = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: A-Z to lower case, all that is no word character to a blank.
SHAPE = bytes(b if b in WORD_BYTES else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_in(text: bytes) -> list[bytes]:
    return text.translate(SHAPE).split()


def blocks_of(text: pa.Buffer, size: int) -> Iterator[list[bytes]]:
    """The words of a text, some ``size`` bytes at a time; no word is cut."""
    view, at = memoryview(text), 0
    while at < len(view):
        end = min(at + size, len(view))
        piece = bytes(view[at:end]).translate(SHAPE)
        while end < len(view) and piece[-1] != 32:  # up to the end of the last word
            more = bytes(view[end : end + 64]).translate(SHAPE)
            cut = more.find(b" ")
            more = more[: cut + 1] if cut >= 0 else more
            piece, end = piece + more, end + len(more)
        at = end
        yield piece.split()


class Automaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, number of tokens up to here)
        self.whole = []  # the state of each sequence
        for k, tokens in enumerate(sequences):
            last = 0
            for i, t in enumerate(tokens):
                last = self.extend(last, t)
                self.ends[last].append((k, i + 1))
            self.whole.append(last)
        self.below: list[list[int]] = [[] for _ in self.next]
        for v, u in enumerate(self.link):
            if u >= 0:
                self.below[u].append(v)
        self._places: dict[int, list[tuple[int, int]]] = {}

    def state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def split(self, p: int, t: int) -> int:
        """The state of the string of p and t, whose successor by t may hold longer ones too."""
        q = self.next[p][t]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            return self.split(last, t)
        new = self.state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        self.link[new] = self.split(p, t) if p >= 0 else 0
        return new

    def places(self, v: int) -> list[tuple[int, int]]:
        """All (sequence, end) where the strings of state v end."""
        if v not in self._places:
            found, todo = [], [v]
            while todo:
                u = todo.pop()
                found += self.ends[u]
                todo += self.below[u]
            self._places[v] = sorted(found)
        return self._places[v]


@dataclass
class Scan:
    """What one text has: base places as (word, phrase), and of each template spans as (first word, word after the last,
    share covered)."""

    n_words: int = 0
    places: list[tuple[int, int]] = field(default_factory=list)
    best: float = 0.0
    spans: dict[int, list[tuple[int, int, float]]] = field(default_factory=dict)


class Scanner:
    """Streams texts through the automaton of phrases and templates."""

    def __init__(self, phrases=None, templates=None, least: int = 4, gap: int = 12, covered: float = 0.6):
        self.phrases = [(label, words_in(t.encode())) for label, t in (PHRASES if phrases is None else phrases)]
        self.templates = [(label, words_in(t.encode())) for label, t in (TEMPLATES if templates is None else templates)]
        if least < 2 or any(len(p) < 2 for _, p in self.phrases):
            raise ValueError("phrases and matches have two words at least")
        self.least, self.gap, self.covered = least, gap, covered
        self.vocabulary: dict[bytes, int] = {}
        every = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in self.phrases + self.templates]
        self.automaton = a = Automaton(every)
        own = {}
        for k, (_, ws) in enumerate(self.phrases):
            own.setdefault(a.whole[k], []).append((k, len(ws)))
        self.phrases_at = []  # of each state: the phrases that its strings may end with, from the chain of suffix links
        for v in range(len(a.next)):
            got, u = [], v
            while u > 0:
                got += own.get(u, [])
                u = a.link[u]
            self.phrases_at.append(got)

    def scan(self, blocks: Iterator[list[bytes]]) -> Scan:
        a, out = self.automaton, Scan()
        after, link, length, phrases_at, least = a.next, a.link, a.length, self.phrases_at, self.least
        v = run = 0
        chains: dict[int, list[tuple]] = {}  # of each template: (end in text, end in template, words covered, first word)
        for words in blocks:
            ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
            known = np.concatenate([[False], ids >= 0, [False]])
            edges = np.flatnonzero(known[1:] != known[:-1])
            if run and not known[1]:
                self.matched(out, chains, v, run, out.n_words)
                v = run = 0
            for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if end - first == 1 and 0 < first and end < len(words):
                    continue  # a word alone
                for i, t in enumerate(ids[first:end].tolist(), out.n_words + first):
                    if t not in after[v]:
                        self.matched(out, chains, v, run, i)
                        while v and t not in after[v]:
                            v = link[v]
                        run = length[v]
                    if t in after[v]:
                        v, run = after[v][t], run + 1
                    for k, n in phrases_at[v]:
                        if n <= run:
                            out.places.append((i + 1 - n, k))
                if end < len(words):
                    self.matched(out, chains, v, run, out.n_words + end)
                    v = run = 0
            out.n_words += len(words)
        self.matched(out, chains, v, run, out.n_words)
        for k, open_ in chains.items():
            self.closed(out, k, open_)
        if out.places:  # a phrase is a template of its own
            out.best = 1.0
        return out

    def matched(self, out: Scan, chains: dict, v: int, run: int, end: int) -> None:
        """A longest run of ``run`` words before ``end`` is met: of each template that has it, it extends the best chain that it
        fits. Words that overlap the chain's end in the text or the template count once."""
        if run < self.least:
            return
        for k, at in self.automaton.places(v):
            k -= len(self.phrases)
            if k < 0:
                continue
            floor, open_ = end - run - self.gap, chains.setdefault(k, [])
            best = (run, end - run)
            for c_end, c_at, got, first in open_:
                new = min(run, end - c_end, at - c_at)
                if new > 0 and c_end >= floor and got + new > best[0]:
                    best = (got + new, first)
            self.closed(out, k, [c for c in open_ if c[0] < floor])  # runs begin in order: no later one can extend these
            chains[k] = [c for c in open_ if c[0] >= floor] + [(end, at, *best)]

    def closed(self, out: Scan, k: int, ended: list[tuple]) -> None:
        """Of the template's spans that overlap, the one that covers most stays."""
        for end, _, got, first in ended:
            share = got / len(self.templates[k][1])
            out.best = max(out.best, share)
            if share < self.covered:
                continue
            spans = out.spans.setdefault(k, [])
            while spans and first < spans[-1][1] and spans[-1][2] < share:
                spans.pop()
            if not spans or first >= spans[-1][1]:
                spans.append((first, end, share))

    def labels(self, found: Scan) -> tuple[list[str], list[str]]:
        base = {self.phrases[k][0] for _, k in found.places}
        return sorted(base), sorted(base | {self.templates[k][0] for k in found.spans})


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "doc_id long, label string, kind string, first_word long, n_words long, score double"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20, **settings) -> DataFrame:
    """One row for each of ``docs``: counts of the base phrases and the labels; ``settings`` are those of Scanner."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(**settings))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            rows = []
            for t in batch.column(1):
                x = scanner.scan(blocks_of(t.as_buffer(), block))
                at = [p for p, _ in x.places]
                base, every = scanner.labels(x)
                rows.append((x.n_words, len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), min(1.0, x.best)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in FOUND.split(", ")])

    return _texts(docs, id_col, text_col).mapInArrow(task, FOUND)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20, **settings) -> DataFrame:
    """(doc_id, label, kind, first_word, n_words, score): a row for each base place (kind base) and template span."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(**settings))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = s.scan(blocks_of(t.as_buffer(), block))
                rows += [(i, s.phrases[k][0], "base", at, len(s.phrases[k][1]), 1.0) for at, k in x.places]
                rows += [(i, s.templates[k][0], "template", a, b - a, share) for k, spans in x.spans.items() for a, b, share in spans]
            names = [c.split()[0] for c in SPANS.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return _texts(docs, id_col, text_col).mapInArrow(task, SPANS)
