"""Removal of word windows that occur elsewhere, with suffix automata.

The reference is the corpus itself, so its automata cannot be broadcast whole: the reference is dealt into shards by
anchor (see ``repeats``), and the stretches of each document that may match are sent to the shards that hold an equal
anchor. In a shard the suffix automaton of its reference stretches is built with the number of occurrences of each state,
and each stretch streams through it: the matching statistics tell, at every word, whether the window ending there occurs
at least twice. Spans of such windows are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ordertide.llm.repeats import Frame, removed_flags, with_stretches
from ordertide.llm.text import Words, blocks, table

LENGTH, ANCHOR = 35, 12


class SuffixAutomaton:
    """Suffix automaton of several sequences; ``count`` is how often a state's strings occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict, count: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(count)
        return len(self.link) - 1

    def add(self, sequence: list, weight: int) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.count[last] += weight

    def _extend(self, last: int, symbol) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, symbol, known)
        new = self._state(self.length[last] + 1, 0, {}, 0)
        p = last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def _split(self, p: int, symbol, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 0)
        self.link[q] = clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def finish(self) -> None:
        """Occurrences of longer strings count for their suffixes."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list, length: int) -> Iterator[bool]:
        """For each window of ``length`` symbols of a sequence: whether it occurs twice or more in the reference."""
        state, matched = 0, 0
        for k, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            while state and self.length[self.link[state]] >= length:
                state = self.link[state]
                matched = self.length[state]
            if k >= length - 1:
                yield matched >= length and self.count[state] > 1


def matching_statistics(frame: Frame, content: np.ndarray, span: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Flags of the windows that occur more than once among the spans of their anchor."""
    sizes = span["n"].astype(np.int64)
    lengths = sizes + frame.length - 1
    begin = np.cumsum(lengths) - lengths
    out_at = np.cumsum(sizes) - sizes
    flags = np.zeros(int(sizes.sum()), bool)
    order = np.argsort(span["group"], kind="stable")
    cut = np.append(np.flatnonzero(np.append(True, np.diff(span["group"][order]) != 0)), len(order))
    weight = span["weight"].tolist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        members = order[a:b].tolist()
        if len(members) == 1:
            continue
        automaton = SuffixAutomaton()
        sequences = {k: content[begin[k]:begin[k] + lengths[k]].tolist() for k in members}
        for k in members:
            automaton.add(sequences[k], weight[k])
        automaton.finish()
        for k in members:
            if weight[k] == 1:  # others are settled
                flags[out_at[k]:out_at[k] + sizes[k]] = list(automaton.repeated(sequences[k], frame.length))
    return flags


FRAME = Frame(LENGTH, ANCHOR, "words", False, matching_statistics)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2).to_pylist()
        for lo, hi, data, offsets in blocks(batch, "text"):
            words = Words(data, offsets)
            raw = data.tobytes()
            removed, digest = [], []
            start, end = words.start.tolist(), words.end.tolist()
            for k in range(hi - lo):
                a, b = int(words.first[k]), int(words.first[k + 1])
                kept = range(a, b)
                if lists[lo + k]:
                    gone = removed_flags(b - a, lists[lo + k])
                    kept = (np.flatnonzero(~gone) + a).tolist()
                removed.append(b - a - len(kept))
                digest.append(hashlib.sha256(b" ".join([raw[start[i]:end[i]] for i in kept])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeated_windows(docs: DataFrame) -> DataFrame:
    """Per document the words removed because a window of 35 words over them also starts anywhere else.

    Null texts have no words; rows that repeat (same id and text) count as two places, as everywhere; a null id is an id
    like others. An empty table gives no rows.
    """
    return with_stretches(docs, FRAME).mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_automaton_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"))
