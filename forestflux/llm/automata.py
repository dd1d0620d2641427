"""Substring removal by suffix automata of reference shards, against which documents are streamed for matching statistics.

A shard is what the contexts of some anchors (see windows) hold: every part of the corpus that can repeat a window around them. A task
builds the suffix automaton of each anchor's contexts, weighted by how often each occurs, and streams the same contexts through it. The
matching statistic at a word is the longest match that ends there; shortened to the window's length along suffix links it leads to the
state whose number of ends says how often the window occurs. Windows with two or more go, wherever they stand.

Shards meet the documents that can match them by a shuffle. To broadcast the automata of all shards to all documents would cost their
product; here each word is streamed only through the shards that hold its own anchors.

Words are the runs of characters other than the six ASCII blanks, unchanged.

Defined cases: null or empty texts have no words; texts with fewer words than a window stay; repeated rows remove each other's windows,
as they are occurrences elsewhere; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import merge_spans
from .windows import WORD_BYTES, Scheme, repeated_spans, with_spans

LENGTH, GRAM = 35, 8


class SuffixAutomaton:
    """Of several sequences; `ends` counts, for each state, the weighted places where its strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def add(self, sequence: list, weight: int) -> None:
        nexts, link, length, ends = self.next, self.link, self.length, self.ends
        last = 0
        for symbol in sequence:
            known = nexts[last].get(symbol)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self._clone(known, last, symbol)
                ends[last] += weight
                continue
            state = len(length)
            nexts.append({})
            length.append(length[last] + 1)
            ends.append(weight)
            link.append(0)
            p = last
            while p >= 0 and symbol not in nexts[p]:
                nexts[p][symbol] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][symbol]
                link[state] = q if length[p] + 1 == length[q] else self._clone(q, p, symbol)
            last = state

    def _clone(self, q: int, p: int, symbol) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(length)
        nexts.append(nexts[q].copy())
        length.append(length[p] + 1)
        self.ends.append(0)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        """Sums the ends of every state into the states of its suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def window_counts(self, sequence: list, window: int) -> list[int]:
        """How often each window of the sequence occurs in what was added, by matching statistics."""
        nexts, link, length, ends = self.next, self.link, self.length, self.ends
        out, state, matched = [], 0, 0
        for at, symbol in enumerate(sequence):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if at >= window - 1:
                out.append(ends[state] if matched >= window else 0)
        return out


def automaton_kernel(scheme: Scheme, anchor: np.ndarray, lead: np.ndarray, parts: list[bytes], least: np.ndarray, n: np.ndarray):
    """How often every window of every context occurs, as runs of window starts; 2 stands for two or more."""
    out: list[tuple[int, int, int, int]] = []
    edges = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)] if len(anchor) else []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a == 1:  # one chain of states, all with the same ends
            size = len(parts[a]) // WORD_BYTES
            first, last = max(0, int(lead[a]) - scheme.reach), min(int(lead[a]), size - scheme.length)
            if n[a] >= 2 and last >= first:
                out.append((a, 2, first, last))
            continue
        shard, words = SuffixAutomaton(), []
        for i in range(a, b):
            p = parts[i]
            words.append([p[j : j + WORD_BYTES] for j in range(0, len(p), WORD_BYTES)])
            # marked, so that a place within reach of the anchor twice isn't counted twice
            words[-1][int(lead[i])] += b"^"
            shard.add(words[-1], int(n[i]))
        shard.finish()
        for i, sequence in zip(range(a, b), words):
            first, last = max(0, int(lead[i]) - scheme.reach), min(int(lead[i]), len(sequence) - scheme.length)
            if last < first:
                continue
            counts = shard.window_counts(sequence, scheme.length)
            start = None
            for s in range(first, last + 2):
                again = s <= last and counts[s] >= 2
                if again and start is None:
                    start = s
                elif not again and start is not None:
                    out.append((i, 2, start, s - 1))
                    start = None
    table = np.array(out, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text, all, spans) for every document: spans of words that occur anywhere else too; may overlap, null if none.

    all: another row has the whole text, so all of it repeats if it is long enough.
    """
    return with_spans(docs, repeated_spans(docs, Scheme(length, min(GRAM, max(1, length // 2)), True), automaton_kernel, False), False)


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept, spans]) for every document; kept words are joined by single spaces."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<struct<s: long, e: long>>" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, whole in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("all").to_pylist()):
                words = (text or b"").split()
                if whole and len(words) >= length:
                    spans = [{"s": 0, "e": len(words)}]
                s, e = merge_spans(np.array([x["s"] for x in spans or ()], np.int64), np.array([x["e"] for x in spans or ()], np.int64))
                for a, b in zip(s[::-1].tolist(), e[::-1].tolist()):
                    del words[a:b]
                removed = int((e - s).sum())
                kept = b" ".join(words)
                row = (len(words) + removed, removed, hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode(), [{"s": int(a), "e": int(b)} for a, b in zip(s, e)]) if texts else row)
            names = ["n_words", "n_removed", "kept_sha256", "kept", "spans"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64())}
            columns |= {c: pa.array(v, t) for c, t, v in zip(names, kinds, zip(*rows) if rows else [()] * (5 if texts else 3))}
            yield pa.RecordBatch.from_pydict(columns)

    return find_repeats(docs, length).mapInArrow(run, schema)
