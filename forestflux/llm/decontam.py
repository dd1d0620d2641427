"""Benchmark decontamination by suffix arrays of the training documents.

Documents are read in shards of a few MB. Each shard builds the suffix array of its word sequence, in which every suffix of every
benchmark item is looked up by binary search; the interval found holds all places where the test suffix begins, and each is then
extended to its longest verbatim match. A match counts if it is at least as long as a window: `window` words, or the whole item if
that has fewer. Only suffixes that start a long enough run of benchmark words enter the array; no other can match.

The benchmark is sent to every task. Its size is checked: beyond MAX_BROADCAST_BYTES it is cut into parts by hash, the documents are
read once per part, and the parts' matches are put together.

Words are the runs of ASCII letters (lower-cased), digits and characters beyond ASCII. Words are told apart by 64-bit hashes.

Defined cases: null or empty texts and items have no words and match nothing; a null item id matches but is left out of the list of
items; repeated rows of either table are each judged; other columns are not read; empty tables give empty matches. Texts of any length are taken
whole; repetitive ones take memory in proportion to their maximal matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, batch_texts, joined, merge_spans, range_hashes, slices, table, text_bytes, word_spans

WINDOW = 10
SHARD_BYTES = 2 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    separator = np.zeros(256, bool)
    separator[0x00:0x30] = separator[0x3A:0x61] = separator[0x7B:0x80] = True
    return lower, separator


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of the first word of each text (with the number of all words last)."""
    lower, separator = _tables()
    data, at = joined(texts)
    data = lower[data] if len(data) else data
    starts, ends = word_spans(data, separator)
    return range_hashes(data, starts, ends), np.searchsorted(starts, at)


class TestSuffixes:
    """All suffixes of the benchmark items that can begin a match, as sorted-vocabulary ids."""

    __test__ = False

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int):
        self.window, self.ids = window, ids
        words, first = words_of(texts)
        self.vocabulary = np.unique(words)
        # 0 stands for the end of an item; the ids of words begin with 1
        lengths = np.diff(first)
        gaps = np.arange(len(texts))
        self.tokens = np.zeros(len(words) + len(texts) + window, np.int64)
        place = np.arange(len(words)) + np.repeat(gaps, lengths)
        self.tokens[place] = np.searchsorted(self.vocabulary, words) + 1
        self.item = np.full(len(self.tokens), -1, np.int64)
        self.item[place] = np.repeat(gaps, lengths)
        self.start = first[:-1] + gaps
        need = np.minimum(lengths, window)
        left = np.zeros(len(self.tokens), np.int64)  # words to the end of the item
        left[place] = np.repeat(first[1:], lengths) - np.arange(len(words))
        self.need = np.repeat(need, lengths)
        ok = left[place] >= self.need
        self.suffixes, self.need = place[ok], self.need[ok]
        self.least = int(need[need > 0].min()) if (need > 0).any() else 0
        self.bits = 16 if len(self.vocabulary) < (1 << 16) - 1 else 32

    def keys(self, tokens: np.ndarray, at: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """The next `window` tokens of each place, packed big-endian into unsigned words, so that rows compare like suffixes."""
        per = 64 // self.bits
        columns = -(-self.window // per)
        out = np.zeros((len(at), columns), np.uint64)
        for j in range(self.window):
            t = tokens[at + j].astype(np.uint64)
            if lengths is not None:
                t[j >= lengths] = 0
            out[:, j // per] |= t << np.uint64(self.bits * (per - 1 - j % per))
        return out


def _below(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
    """Row-wise a < b, or a <= b, in lexicographic order."""
    out = np.full(len(a), or_equal)
    for j in range(a.shape[1] - 1, -1, -1):
        out = np.where(a[:, j] == b[:, j], out, a[:, j] < b[:, j])
    return out


def _search(array: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all wanted rows at once in sorted rows."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(array), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        go = open_ & _below(array[np.minimum(middle, len(array) - 1)], wanted, after)
        low, high = np.where(go, middle + 1, low), np.where(open_ & ~go, middle, high)
    return low


def shard_matches(test: TestSuffixes, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word counts of the texts; for each maximal match text, first word in it, item, first word in that, length."""
    words, first = words_of(texts)
    counts = np.diff(first)
    none = [np.empty(0, np.int64)] * 5
    if not len(test.suffixes) or not len(words):
        return counts, none
    place = np.searchsorted(test.vocabulary, words)
    place[place == len(test.vocabulary)] = 0
    known = test.vocabulary[place] == words
    # texts are laid out with a 0 after each, as no match crosses them
    gap = np.repeat(np.arange(len(texts)), counts)
    tokens = np.zeros(len(words) + len(texts) + test.window, np.int64)
    tokens[np.arange(len(words)) + gap] = np.where(known, place + 1, 0)
    zeros = np.flatnonzero(tokens == 0)
    run = zeros[np.searchsorted(zeros, np.arange(len(tokens)))] - np.arange(len(tokens))
    at = np.flatnonzero(run >= test.least)
    if not len(at):
        return counts, none
    # the word before a suffix orders those that begin alike
    keys = np.column_stack([test.keys(tokens, at), tokens[at - 1].astype(np.uint64)])
    order = np.lexsort(keys.T[::-1])
    suffix_array, keys = at[order], keys[order]
    wanted = test.keys(test.tokens, test.suffixes, test.need)
    low = _search(keys[:, :-1], wanted, False)
    top = wanted.copy()  # the largest key that begins with the wanted words
    per = 64 // test.bits
    for j in range(test.window):
        top[test.need <= j, j // per] |= np.uint64(((1 << test.bits) - 1) << (test.bits * (per - 1 - j % per)))
    high = _search(keys[:, :-1], top, True)
    # a match that can be extended to the left is part of a longer one: places after the word that the test suffix follows are passed over,
    # so that repetitive texts cost no more than their maximal matches (a suffix that begins its item has no word before it)
    before = test.tokens[test.suffixes - 1]
    some = np.flatnonzero((high > low) & (before != 0))
    skip_from, skip_to = high.copy(), high.copy()
    longer = np.column_stack([wanted[some], before[some].astype(np.uint64)])
    skip_from[some], skip_to[some] = _search(keys, longer, False), _search(keys, longer, True)
    there, here, length = [], [], []
    for first_, last in ((low, skip_from), (skip_to, high)):
        n = last - first_
        which = np.repeat(np.arange(len(n)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        there.append(suffix_array[first_[which] + offset])
        here.append(test.suffixes[which])
        length.append(test.need[which])
    there, here, length = np.concatenate(there), np.concatenate(here), np.concatenate(length)
    grow = np.arange(len(there))
    while len(grow):
        a, b = tokens[there[grow] + length[grow]], test.tokens[here[grow] + length[grow]]
        grow = grow[(a == b) & (a != 0)]
        length[grow] += 1
    text_start = first[:-1] + np.arange(len(texts))
    text = np.searchsorted(text_start, there, "right") - 1
    item = test.item[here]
    return counts, [text, there - text_start[text], item, here - test.start[item], length]


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[bytes]]]:
    rows, size = text_bytes(benchmark, text_col)
    size += 32 * rows
    n = max(1, -(-6 * size // MAX_BROADCAST_BYTES))  # the suffix tables take about six times the text
    small = benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for k in range(n):
        part = small if n == 1 else small.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = part.orderBy("i", "t").collect()
        yield [r["i"] for r in rows], [r["t"].encode() for r in rows]


_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())])
_MATCH_SQL = "array<struct<item_id string, item_word long, doc_word long, length long>>"


def _hits(matches: list[list[dict]]) -> np.ndarray:
    """Words covered by the matches of each document."""
    out = np.zeros(len(matches), np.int64)
    for i, found in enumerate(matches):
        if found:
            start = np.array([m["doc_word"] for m in found])
            s, e = merge_spans(start, start + np.array([m["length"] for m in found]))
            out[i] = (e - s).sum()
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """(id, *keep, n_words, n_hit, matches[, text]) for every document; matches lists the maximal verbatim matches with their places."""
    spark = docs.sparkSession
    rows = docs.select(id_col, *keep, F.col("text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    n_kept, carried = len(kept), False
    parts = list(_parts(benchmark, "item_id", "text"))
    for number, (ids, texts) in enumerate(parts):
        shared, more = spark.sparkContext.broadcast(TestSuffixes(ids, texts, window)), number + 1 < len(parts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, more=more, carried=carried) -> Iterator[pa.RecordBatch]:
            test = shared.value
            for batch in batches:
                all_texts = batch_texts(batch.column("text"))
                for a, b in slices(np.array([len(t) for t in all_texts]), SHARD_BYTES):
                    part = batch.slice(a, b - a)
                    counts, (text, start, item, item_start, length) = shard_matches(test, all_texts[a:b])
                    order = np.lexsort((item_start, item, start, text))
                    text, start, item, item_start, length = (x[order] for x in (text, start, item, item_start, length))
                    offsets = np.searchsorted(text, np.arange(b - a + 1))
                    matches = pa.StructArray.from_arrays([pa.array([test.ids[i] for i in item], pa.string()), pa.array(item_start), pa.array(start), pa.array(length)], fields=list(_MATCH))
                    found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), matches).to_pylist()
                    if carried:
                        found = [x + y for x, y in zip(part.column("matches").to_pylist(), found)]
                    out = [*part.columns[:n_kept], pa.array(counts), pa.array(_hits(found)), pa.array(found, pa.list_(_MATCH))]
                    names = [*part.schema.names[:n_kept], "n_words", "n_hit", "matches"]
                    if more or keep_text:
                        out, names = [*out, part.column("text")], [*names, "text"]
                    yield pa.RecordBatch.from_arrays(out, names=names)

        schema = ", ".join([*kept, "n_words long", "n_hit long", f"matches {_MATCH_SQL}", *["text string"] * (more or keep_text)])
        rows = rows.mapInArrow(run, schema)
        if more:
            rows, carried = table(rows, "decontam-part"), True
    return rows


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    found = longest_matches(docs, benchmark, window)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a match, all columns as they are."""
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", F.struct(F.lit(1).alias("__one"), *[F.col(f"`{c}`") for c in others]).alias("__all"), "text")
    found = longest_matches(packed, benchmark, window, keep=("__all",), keep_text=True)
    return found.where("n_hit = 0").select(*[F.col(c) if c in ("doc_id", "text") else F.col("__all")[c].alias(c) for c in columns])
