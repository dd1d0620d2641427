"""Substring removal by suffix order and longest previous factors, keeping the first copy.

The contexts of an anchor (see windows) are cut into their suffixes at every place where a window can start. The suffixes are sorted; in
suffix order those with a common prefix of `length` bytes stand in one run, and within a run the previous and next smaller document of
every suffix give its longest previous factor: it reaches `length` if and only if the run holds a smaller document. Later copies go.

Matches never cross documents, overlaps count, and strings are judged on the input, not on what is left.

Defined cases: null or empty texts have no bytes and keep none; a null doc_id is later than all others; rows of one doc_id never remove
each other; texts shorter than a window stay; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import merge_spans
from .windows import Scheme, repeated_spans, with_spans

LENGTH, GRAM = 50, 26
#: Suffixes sorted at once, by whole anchors.
_CHUNK = 1 << 18


def _window_ranges(scheme: Scheme, lead: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of each context around its anchor; last < first if there is none."""
    return np.maximum(0, lead - scheme.reach), np.minimum(lead, size - scheme.length)


def previous_factors(keys: np.ndarray, group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each suffix the smallest owner whose suffix shares its whole window, itself included.

    keys holds the windows as rows of big-endian words. In suffix order the lcp of neighbours reaches a window within runs of equal
    rows only, so the previous and next smaller owners of a suffix that are near enough lie in its run, and its head is the least.
    """
    order = np.lexsort((owner, *keys.T[::-1], group))
    head = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        head[1:] = (group[a] != group[b]) | (keys[a] != keys[b]).any(axis=1)
    out = np.empty(len(order), np.int64)
    out[order] = owner[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return out


def lpf_kernel(scheme: Scheme, anchor: np.ndarray, lead: np.ndarray, parts: list[bytes], least: np.ndarray, n: np.ndarray):
    """The smallest document of every window of every context, as runs of window starts."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    first, last = _window_ranges(scheme, lead, size)
    count = np.maximum(0, last - first + 1)
    edge = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.empty(0, bool)
    group = np.cumsum(edge) - 1
    alone = np.bincount(group, minlength=1)[group] == 1 if len(group) else edge
    easy = np.flatnonzero(alone & (count > 0))
    out = [(easy, least[easy], first[easy], last[easy])]
    hard = np.flatnonzero(~alone & (count > 0))
    total = np.cumsum(count[hard])
    words = -(-scheme.length // 8)
    a = 0
    while a < len(hard):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + _CHUNK, "right"))
        b = max(b, a + 1)
        while b < len(hard) and group[hard[b]] == group[hard[b - 1]]:  # whole anchors only
            b += 1
        rows = hard[a:b]
        data = np.frombuffer(b"".join(parts[i] for i in rows), np.uint8)
        begin = np.cumsum(size[rows]) - size[rows]
        k = count[rows]
        which = np.repeat(np.arange(len(rows)), k)
        start = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + first[rows][which]
        window = np.zeros((len(which), 8 * words), np.uint8)
        window[:, : scheme.length] = np.lib.stride_tricks.sliding_window_view(data, scheme.length)[begin[which] + start]
        value = previous_factors(window.view(">u8").astype(np.uint64), group[rows][which], least[rows][which])
        cut = np.ones(len(which), bool)
        cut[1:] = (which[1:] != which[:-1]) | (value[1:] != value[:-1])
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], len(which)) - 1
        out.append((rows[which[heads]], value[heads], start[heads], start[tails]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out))


def find_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text, all, spans) for every document: spans of bytes that an earlier document holds too; may overlap, null if none.

    all: an earlier document has the whole text, so all of it repeats if it is long enough.
    """
    return with_spans(docs, repeated_spans(docs, Scheme(length, min(GRAM, max(1, length // 2)), False), lpf_kernel, True), True)


def remove_copies(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) for every document; kept is binary, as spans may split characters."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<s: long, e: long>>" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, whole in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("all").to_pylist()):
                data = text or b""
                if whole and len(data) >= length:
                    spans = [{"s": 0, "e": len(data)}]
                s, e = merge_spans(np.array([x["s"] for x in spans or ()], np.int64), np.array([x["e"] for x in spans or ()], np.int64))
                kept = b"".join(data[a:b] for a, b in zip([0, *e], [*s, len(data)])) if len(s) else data
                row = (len(data), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept, [{"s": int(a), "e": int(b)} for a, b in zip(s, e)]) if texts else row)
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64())}
            columns |= {c: pa.array(v, t) for c, t, v in zip(names, kinds, zip(*rows) if rows else [()] * (6 if texts else 4))}
            yield pa.RecordBatch.from_pydict(columns)

    return find_copies(docs, length).mapInArrow(run, schema)
