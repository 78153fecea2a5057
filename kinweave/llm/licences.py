"""Licence scans: a generalised suffix automaton of licence tokens reads whole texts.

All template texts go into one suffix automaton over words. Streaming a text through it
gives matching statistics: at each word, the longest run ending there that some template
holds. Maximal runs of `MIN_MATCH` words or more are chained per licence (templates in
order, gaps of at most `MAX_GAP` words), and a chain that covers enough of its template
becomes a span with a label and a coverage between 0 and 1.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Only places where two
neighbouring words are neighbours in some template are streamed: elsewhere no match of
two words exists, so nothing is lost. Base places are consecutive words of a phrase.

Null and empty texts have no words, places or labels and score 0; rows stay as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import arrow_map, id_and_text
from kinweave.llm.words import ALNUM, LOWER, Texts, slices

#: Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and opening sentences of public licences, with labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

MIN_MATCH, MAX_GAP = 3, 10
MIN_COVERAGE, MIN_WORDS = 0.75, 5
LONG_CHAIN = 15

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans string"
)


def tokens(text: str) -> list[bytes]:
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    part = Texts(np.array([0, len(raw)]), raw)
    _, start, end = part.spans(ALNUM[raw])
    return [raw[s:e].tobytes() for s, e in zip(start, end)]


class SuffixAutomaton:
    """All runs of words of several sequences; each state knows where they occur."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, before: int, word: int, state: int) -> int:
        twin = self._state(self.length[before] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = twin
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = twin
            before = self.link[before]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if (known := self.next[last].get(word)) is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, before = self._state(self.length[last] + 1, 0, {}), last
        while before >= 0 and word not in self.next[before]:
            self.next[before][word] = new
            before = self.link[before]
        if before >= 0:
            known = self.next[before][word]
            fits = self.length[known] == self.length[before] + 1
            self.link[new] = known if fits else self._split(before, word, known)
        return new

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the matches that the next word doesn't prolong."""
        state, length = 0, 0
        for place, word in enumerate(words):
            to = self.next[state].get(word)
            if to is None:
                if length >= MIN_MATCH:
                    yield place, length, state
                while state > 0 and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                to = self.next[state].get(word)
            state, length = (0, 0) if to is None else (to, length + 1)
        if length >= MIN_MATCH:
            yield len(words), length, state


class Scanner:
    """Templates and phrases, ready to read texts."""

    def __init__(self, templates: list[tuple[str, str]]):
        sequences = [tokens(text) for _, text in templates]
        phrases = [tokens(phrase) for phrase in PHRASES]
        known = sorted({word for sequence in [*sequences, *phrases] for word in sequence})
        raw = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum([len(word) for word in known])
        hashes = Texts(np.array([0, len(raw)]), raw).hashes(ends - [len(word) for word in known], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {word: place for place, word in enumerate(known)}
        self.labels = [label for label, _ in templates]
        self.sizes = [len(sequence) for sequence in sequences]
        as_numbers = [[number[word] for word in sequence] for sequence in sequences]
        self.automaton = SuffixAutomaton(as_numbers)
        self.pairs = np.unique([a * len(known) + b for sequence in as_numbers for a, b in zip(sequence, sequence[1:])])
        self.n_known = len(known)
        self.phrases = [([number[word] for word in words], label) for words, label in zip(phrases, PHRASES.values())]

    def numbers(self, part: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word among the template words, or -1."""
        value = part.hashes(start, end)
        at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        return np.where(self.hashes[at] == value, self.order[at], -1)

    def streams(self, text: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, end word) of runs whose neighbours are neighbours in a template."""
        both = (number[:-1] >= 0) & (number[1:] >= 0) & (text[:-1] == text[1:])
        near = np.zeros(len(both) + 2, bool)
        near[1:-1] = both & np.isin(number[:-1] * self.n_known + number[1:], self.pairs)
        first = np.flatnonzero(near[1:] & ~near[:-1])
        last = np.flatnonzero(near[:-1] & ~near[1:])
        for a, b in zip(first, last):
            if b - a + 1 >= MIN_MATCH:
                yield int(text[a]), int(a), int(b) + 1

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """(first word, end word, label, coverage) of the spans in one text.

        Each place of a match in a template goes on with the best chain that ends near
        before it, or begins a chain; chains that it doesn't continue stay open until they
        are `MAX_GAP` words away. Of chains that overlap in a template the best one stays.
        """
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        full: dict[int, set[tuple[int, int, int]]] = {}
        for start, end, state in found:
            near: dict[int, list[tuple[int, int, int, int]]] = {}
            for template, place in sorted(self.automaton.ends[state]):
                if template not in near:
                    near[template] = [chain for chain in open_.get(template, []) if start - chain[1] <= MAX_GAP]
                    open_[template] = list(near[template])
                first, covered = start, end - start
                for chain in near[template]:
                    if place > chain[3]:
                        more = chain[2] + max(0, min(end - max(start, chain[1]), place - chain[3]))
                        if (more, -chain[0]) > (covered, -first):
                            first, covered = chain[0], more
                open_[template].append((first, end, covered, place))
                if covered >= LONG_CHAIN or (covered >= MIN_WORDS and covered >= MIN_COVERAGE * self.sizes[template]):
                    full.setdefault(template, set()).add((covered, first, end))
        best: dict[tuple[str, int], tuple[int, int, str, float]] = {}
        for template, chains in sorted(full.items()):
            label, taken = self.labels[template], []
            for covered, first, end in sorted(chains, key=lambda chain: (-chain[0], chain[1], -chain[2])):
                at = bisect_left(taken, (first, end))
                if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < end):
                    continue
                taken.insert(at, (first, end))
                share = min(1.0, covered / self.sizes[template])
                if (label, first) not in best or best[label, first][3] < share:
                    best[label, first] = first, end, label, share
        return sorted(best.values())


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(list(templates))


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of `docs`: base places and labels, all labels, spans and a score.

    The score is the best coverage of a template, at least 0.5 where a base phrase stands.
    """
    given = tuple(templates if templates is not None else TEMPLATES)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        machine = scanner(given)
        for rows, part in slices(batch):
            part = Texts(part.offsets, LOWER[part.data])
            text, start, end = part.spans(ALNUM[part.data])
            number = machine.numbers(part, start, end)
            n_words = part.per_text(text)
            begin = np.concatenate([[0], np.cumsum(n_words)])
            places: list[list[int]] = [[] for _ in range(part.n)]
            base: list[set[str]] = [set() for _ in range(part.n)]
            for words, label in machine.phrases:
                n = max(0, len(number) - len(words) + 1)
                hit = text[:n] == text[len(words) - 1 :][:n]
                for step, word in enumerate(words):
                    hit = hit & (number[step : step + n] == word)
                for at in np.flatnonzero(hit):
                    places[text[at]].append(int(at - begin[text[at]]))
                    base[text[at]].add(label)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for which, first, last in machine.streams(text, number):
                offset = first - int(begin[which])
                found.setdefault(which, []).extend(
                    (offset + stop - length, offset + stop, state)
                    for stop, length, state in machine.automaton.matches(number[first:last].tolist())
                )
            spans = [machine.chains(found[row]) if row in found else [] for row in range(part.n)]
            yield {
                "doc_id": rows.column("doc_id"),
                "n_words": n_words,
                "n_base": [len(p) for p in places],
                "first_word": [min(p, default=None) for p in places],
                "last_word": [max(p, default=None) for p in places],
                "base_labels": [",".join(sorted(b)) for b in base],
                "labels": [",".join(sorted(b | {s[2] for s in found})) for b, found in zip(base, spans)],
                "score": [max([0.5 * bool(b), *(s[3] for s in found)]) for b, found in zip(base, spans)],
                "spans": [",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in found) for found in spans],
            }

    return arrow_map(id_and_text(docs), work, SCHEMA)
