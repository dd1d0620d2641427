"""Periodic runs of words, found by a suffix automaton whose suffix links are accessed word by word.

Of each text only the stretches that repeat some GRAM words are looked at: every run of at least LEAST words and three periods lies in
one (two places a period apart share at least 16 words all along it). For each stretch the automaton is built; then its words are
appended once more in order, and each appended word accesses the path from its prefix to the root of the link tree. The path is cut
into segments whose strings last ended at the same place; an access recolours them all to the new end, as in a link-cut tree (the tree is
known by then, so its paths are kept as stacks of segments on heavy paths). If a segment's last end and the new one are q words apart
and its strings have 2 q words or more, then a cube of period q ends here; it is extended to its run on both sides.

Defined cases: a null text has no words, an empty one neither; a null id is an id that plants nothing; repeated rows and ids are rows
of their own; texts of any length are taken whole (a stretch needs some 0.3 kB of memory a word); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_texts, gram_hashes, merge_spans

#: Words in the shortest run, and periods.
LEAST, PERIODS = 24, 3
#: A run of LEAST words and PERIODS periods shares as many words with itself a period on: the least of max(LEAST - q, 2 q).
GRAM = 16

SCHEMA = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


# ---------------------------------------------------------------- the automaton


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest lengths and suffix links of all states (0 is the root), and the state of each prefix.

    Nearly all states have one transition, which two lists hold; further ones are in a dictionary by state.
    """
    length, link, char, to = [0], [-1], [-1], [0]
    more: dict[int, dict[int, int]] = {}
    last, prefixes = 0, []
    for c in symbols:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        char.append(-1)
        to.append(0)
        p = last
        while p >= 0:
            if char[p] == c:
                q = to[p]
                break
            if char[p] < 0:
                char[p], to[p] = c, cur
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: cur}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = cur
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                char.append(char[q])
                to.append(to[q])
                if q in more:
                    more[clone] = dict(more[q])
                link[q] = link[cur] = clone
                while p >= 0:
                    if char[p] == c:
                        if to[p] != q:
                            break
                        to[p] = clone
                    else:
                        others = more.get(p)
                        if others is None or others.get(c) != q:
                            break
                        others[c] = clone
                    p = link[p]
        prefixes.append(cur)
        last = cur
    return length, link, prefixes


def heavy_tops(length: list[int], link: list[int]) -> list[int]:
    """The top of each state's heavy path in the link tree."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size, heavy, best = [1] * len(length), [-1] * len(length), [0] * len(length)
    for v in reversed(order[1:]):
        u, s = link[v], size[v]
        size[u] += s
        if s > best[u]:
            best[u], heavy[u] = s, v
    top = list(range(len(length)))
    for v in order[1:]:
        if heavy[link[v]] == v:
            top[v] = top[link[v]]
    return top


def cubes(symbols: list[int]) -> Iterator[tuple[int, int]]:
    """(last word, period) of places where three equal stretches end one after the other, again at each further word of their run."""
    length, link, prefixes = automaton(symbols)
    top = heavy_tops(length, link)
    stacks: dict[int, list[tuple[int, int]]] = {}  # by top: (greatest length, last end) of the segments, the shortest strings last
    for i, v in enumerate(prefixes):
        while v > 0:
            t, reach = top[v], length[v]
            stack = stacks.get(t)
            if stack is None:
                stacks[t] = [(reach, i)]
            else:
                while stack and stack[-1][0] <= reach:
                    depth, j = stack.pop()
                    if depth >= 2 * (i - j):
                        yield i, i - j
                if stack and reach >= 2 * (i - stack[-1][1]):
                    yield i, i - stack[-1][1]
                stack.append((reach, i))
            v = link[t]


# ---------------------------------------------------------------- runs of a text


def _same(a: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words on from `at` (step 1) or back (-1) equal those q further."""
    n, size = 0, 64
    while True:
        if step > 0:
            x = a[at + n : at + n + size]
            y = a[at + n + q : at + n + q + size]
            x = x[: len(y)]
        else:
            hi = at - n + 1
            lo = max(0, hi - size)
            x, y = a[lo:hi][::-1], a[lo + q : hi + q][::-1]
        unequal = np.flatnonzero(x != y)
        if len(unequal):
            return n + int(unequal[0])
        n += len(x)
        if len(x) < size:
            return n
        size *= 2


def _smallest(a: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether a stretch of period q has no smaller one (which would divide q, at three periods and more)."""
    x, rest, p = a[start : start + length], q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if np.array_equal(x[q // p :], x[: len(x) - q // p]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def stretches(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal stretches covered by GRAM words that occur twice or more in a."""
    hashes = gram_hashes(a.astype(np.uint64), GRAM)
    order = np.argsort(hashes, kind="stable")
    twin = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(hashes), bool)
    again[order[1:][twin]] = again[order[:-1][twin]] = True
    at = np.flatnonzero(again)
    starts, ends = merge_spans(at, at + GRAM)
    enough = ends - starts >= LEAST
    return starts[enough], ends[enough]


def runs_of(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; a holds a number for each distinct word."""
    found = []
    if len(a) < LEAST:
        return found
    for lo, hi in zip(*stretches(a), strict=True):
        seen: dict[int, int] = {}  # by period, where the last stretch of that period ends
        for i, q in cubes(a[lo:hi].tolist()):
            i += int(lo)
            if i < seen.get(q, -1):
                continue
            start = i - 2 * q + 1
            start -= _same(a, start - 1, q, -1) if start > 0 else 0
            end = i + 1 + _same(a, i + 1 - q, q, 1)
            seen[q] = end
            if end - start >= max(LEAST, PERIODS * q) and _smallest(a, start, end - start, q):
                found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which words of n a document whose hash asks for it has after a period is planted; None if it is left as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _row(doc_id: int | None, text: bytes, planted: bool) -> tuple:
    words = text.split()  # at the six ASCII blanks
    order = planted_order(doc_id, len(words)) if planted else None
    if order is not None:
        words = [words[i] for i in order.tolist()]
    found = []
    if len(words) >= LEAST:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        if len(number) + GRAM <= len(words):  # else no GRAM words repeat
            found = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    kept = words
    if found:
        keep = np.ones(len(words), bool)
        for start, length, period in found:
            keep[start + period : start + length] = False
        kept = [words[i] for i in np.flatnonzero(keep).tolist()]
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    exponent = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, exponent, sha256(listed).hexdigest(), sha256(b" ".join(kept)).hexdigest()


def collapse(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per document its runs and what is left if of each run only the first period stays; planted first plants periods by the ids' hashes."""
    schema = SCHEMA.format(dict(docs.dtypes)["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [_row(i, t, planted) for i, t in zip(batch.column("doc_id").to_pylist(), batch_texts(batch.column("text")), strict=True)]
                columns = list(zip(*rows, strict=True))
                types = [batch.schema.field("doc_id").type, *[pa.int64()] * 5, pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, schema)
