"""Word-piece lengths by a linear longest-match automaton (no piece is ever built).

The vocabulary is a trie. Each node has a failure link and the number of pieces that
greedy longest match has settled when it follows that link, both computed once. Reading
a word then takes one step per byte, plus failure steps that settle at least one piece
each, so it is linear in the word. A batch's different words are read in step by numpy,
one byte column at a time, and each is read once however often it stands in the batch.

A word is `[^\\x20\\x09-\\x0D]+`, read with the vocabulary's word-start sign before it.
A byte that no piece begins with counts as one unknown piece, and reading starts anew
behind it. Null and empty texts have no words and no pieces; rows stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import arrow_map, id_and_text
from kinweave.llm.words import NOT_SPACE, slices

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, n_words long, n_pieces long, n_unknown long, longest_word_pieces long"
_ROOT = 0


class Automaton:
    """Trie, failure links and settled counts of a set of byte-string pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = _ROOT
            for byte in piece:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = children[node][byte] = len(children)
                    children.append({})
                    ends.append(False)
                node = nxt
            ends[node] = bool(piece)
        n = len(children)
        # fail -1: behind the settled pieces stands a byte that no piece begins with.
        fail, settled = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        level = [_ROOT]
        while level:
            below = []
            for parent in level:
                for byte, node in children[parent].items():
                    below.append(node)
                    if ends[node]:
                        fail[node], settled[node] = _ROOT, 1
                        continue
                    at, count = fail[parent], settled[parent]
                    while at >= 0 and byte not in children[at]:
                        at, count = fail[at], count + settled[at]
                    if at >= 0 and parent != _ROOT:
                        fail[node], settled[node] = children[at][byte], count
            level = below
        edges = sorted((node << 8 | byte, child) for node, below in enumerate(children) for byte, child in below.items())
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([c for _, c in edges], np.int64)
        self.fail, self.settled, self.ends = fail, settled, np.array(ends)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child for each byte, or -1."""
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.child[at], -1) if len(self.edge) else np.full(len(node), -1)

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(pieces, unknown bytes among them) of each span of `data` with `first` before it."""
        n = len(start)
        node, pieces, unknown = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(start - end, kind="stable")
        length = (end - start)[order]
        for column in range(-len(first), int(length[0]) if n else 0):
            live = order[: np.searchsorted(-length, -max(column, 0), "left")] if column >= 0 else order
            byte = np.full(len(live), first[column], np.int64) if column < 0 else data[start[live] + column].astype(np.int64)
            self._read(node, pieces, unknown, live, byte)
        self._finish(node, pieces, unknown)
        return pieces, unknown

    def _read(self, node: np.ndarray, pieces: np.ndarray, unknown: np.ndarray, live: np.ndarray, byte: np.ndarray) -> None:
        while len(live):
            at = node[live]
            to = self.step(at, byte)
            went = to >= 0
            node[live[went]] = to[went]
            live, byte, at = live[~went], byte[~went], at[~went]
            failing = self.fail[at] >= 0
            pieces[live[failing]] += self.settled[at[failing]]
            node[live[failing]] = self.fail[at[failing]]
            lost = ~failing
            if lost.any():
                # At the root the byte itself is unknown; deeper, settle one piece or one
                # unknown byte and read the others again.
                self._skip(node, pieces, unknown, live[lost & (at == _ROOT)])
                deep = lost & (at != _ROOT)
                for word, value in zip(live[deep], byte[deep]):
                    self._again(node, pieces, unknown, word, value)
            live, byte = live[failing], byte[failing]

    @staticmethod
    def _skip(node: np.ndarray, pieces: np.ndarray, unknown: np.ndarray, live: np.ndarray) -> None:
        pieces[live] += 1
        unknown[live] += 1
        node[live] = _ROOT

    def _again(self, node: np.ndarray, pieces: np.ndarray, unknown: np.ndarray, word: int, byte: int | None) -> None:
        path, size = self._path(int(node[word]))
        one = np.array([word])
        if size:
            pieces[word] += 1
            node[word] = _ROOT
        else:
            self._skip(node, pieces, unknown, one)
        for value in path[size or 1 :] + ([] if byte is None else [int(byte)]):
            self._read(node, pieces, unknown, one, np.array([value]))

    def _path(self, node: int) -> tuple[list[int], int]:
        """The bytes from the root to a node, and the length of the longest piece they begin with."""
        if not hasattr(self, "_parent"):
            self._parent = np.zeros(len(self.fail), np.int64)
            self._parent[self.child] = self.edge
        path, after = [], None
        while node != _ROOT:
            if after is None and self.ends[node]:
                after = len(path)
            edge = int(self._parent[node])
            path.append(edge & 255)
            node = edge >> 8
        return path[::-1], 0 if after is None else len(path) - after

    def _finish(self, node: np.ndarray, pieces: np.ndarray, unknown: np.ndarray) -> None:
        live = np.flatnonzero(node != _ROOT)
        while len(live):
            at = node[live]
            failing = self.fail[at] >= 0
            pieces[live[failing]] += self.settled[at[failing]]
            node[live[failing]] = self.fail[at[failing]]
            for word in live[~failing]:
                self._again(node, pieces, unknown, word, None)
            live = live[node[live] != _ROOT]


def byte_level_vocabulary(name: str = DEFAULT_VOCABULARY) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, its printable stand-ins undone."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        content = json.load(file)
    special = {token["content"] for token in content.get("added_tokens", [])}
    return [bytes(byte_of[c] for c in piece) for piece in content["model"]["vocab"] if piece not in special]


@lru_cache(maxsize=2)
def automaton(name: str) -> Automaton:
    return Automaton(byte_level_vocabulary(name))


def piece_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, word_start: bytes = b" ") -> DataFrame:
    """One row per row of `docs`: its words, their pieces, unknown bytes, the longest word's pieces.

    `vocabulary` names a public byte-level vocabulary, which executors load by themselves.
    """

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        machine = automaton(vocabulary)
        for rows, part in slices(batch):
            text, start, end = part.spans(NOT_SPACE[part.data])
            _, sample, which = np.unique(part.hashes(start, end), return_index=True, return_inverse=True)
            pieces, unknown = machine.count(part.data, start[sample], end[sample], word_start)
            longest = np.zeros(part.n, np.int64)
            np.maximum.at(longest, text, pieces[which])
            yield {
                "doc_id": rows.column("doc_id"),
                "n_words": part.per_text(text),
                "n_pieces": part.per_text(text, pieces[which]),
                "n_unknown": part.per_text(text, unknown[which]),
                "longest_word_pieces": longest,
            }

    return arrow_map(id_and_text(docs), work, SCHEMA)
