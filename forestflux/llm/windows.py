"""Where do windows of L symbols (bytes or words) occur again? The distributed part shared by both exact substring removals.

A window's anchor is the k-gram in it with the least hash (its minimiser), so equal windows have equal anchors at equal places.

0. Equal texts are one text, of the first document that has it; what else has it is known to repeat from end to end.
1. Every text yields its anchors. Those that occur twice in a task's slice are known to repeat; of each only one stands in for the
   slice, so that a passage found in a third of all documents costs the next step one row a slice. The rest are shuffled by hash in
   packed arrays, and those seen in other slices come back.
2. Texts with repeated anchors yield, per such anchor, its context: all symbols that a window around it can reach, known by its hash.
   Equal contexts are merged with map-side combining. Where an anchor has one context only, all its windows occur as often as that.
   The symbols of the others meet in one task per anchor, where a kernel (suffix order or suffix automaton) decides window by window.
3. What was found about a context is joined to the places where it occurs, which gives spans per text.

Nothing is cut off or capped: a window is decided by its contents. Anchor hashes only choose candidates; the kernels compare symbols
(bytes as they are; words by 40 bits of their hashes).

Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_texts, blank_table, drop_table, gram_hashes, joined, mix64, range_hashes, release, slices, table, text_bytes, word_spans

SLICE_BYTES = 1_000_000
#: Anchors that meet in one group of the first shuffle, and contexts in one of the second.
BUCKET_ANCHORS, BUCKET_CONTEXTS = 1 << 20, 1 << 16
WORD_BYTES = 5
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Scheme:
    """Windows of `length` symbols, anchored at k-grams; symbols are bytes, or words if `words`."""

    length: int
    k: int
    words: bool

    @property
    def reach(self) -> int:
        return self.length - self.k


#: kernel(contexts as arrays of symbols grouped by anchor) -> rows (context number, value, first window start, last window start)
Kernel = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def symbols_of(texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, where each text begins and ends in them, and the texts' bytes."""
    data, at = joined(texts)
    if not words:
        return data, at[:-1], at[1:] - 1, data
    starts, ends = word_spans(data, blank_table())
    edges = np.searchsorted(starts, at)
    return range_hashes(data, starts, ends), edges[:-1], edges[1:], data


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best over x[i:i+w] for each i with a whole window."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows inside the texts."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(symbols, scheme.k)
    w = scheme.reach + 1
    if len(hashes) < w:
        return none
    least = _sliding(hashes, w, np.minimum)
    # a window that reaches over the end of its text has no anchor
    inside = np.zeros(len(least) + 1, np.int32)
    last = ends - scheme.length + 1
    ok = last > begins
    np.add.at(inside, begins[ok], 1)
    np.add.at(inside, last[ok], -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    reached = _sliding(padded, w, np.maximum)  # the greatest minimum of the windows that hold a gram
    places = np.flatnonzero((reached == hashes) & (hashes != 0))
    return places, hashes[places]


def _key_columns(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), text.alias("text"))


def repeated_anchors(docs: DataFrame, scheme: Scheme, total_symbols: int) -> DataFrame:
    """(key, places) of the anchors that occur twice or more; places is an array of int."""
    buckets = max(1, int(total_symbols * 2 / (scheme.reach + 2)) // BUCKET_ANCHORS + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), np.int64)
            texts = batch_texts(batch.column("text"))
            for a, b in slices(np.array([len(t) for t in texts]), SLICE_BYTES):
                once = np.sort(np.unique(keys[a:b], return_index=True)[1]) + a  # equal texts count once
                symbols, begins, ends, _ = symbols_of([texts[i] for i in once], scheme.words)
                places, found = anchors(symbols, begins, ends, scheme)
                if not len(places):
                    continue
                # of texts without symbols that start at the same place the last is the one with the anchor
                doc = np.searchsorted(begins, places, "right") - 1
                key, place = keys[once][doc], (places - begins[doc]).astype(np.uint32)
                order = np.argsort(found, kind="stable")
                ranked = found[order]
                twin = np.zeros(len(ranked), bool)
                twin[1:] = ranked[1:] == ranked[:-1]
                again = twin.copy()
                again[:-1] |= twin[1:]
                known = np.zeros(len(found), bool)
                known[order] = again
                stands = np.ones(len(found), bool)  # of each known hash, its first place stands for the slice
                stands[order[twin]] = False
                bucket = np.where(stands, (found % np.uint64(buckets)).astype(np.int64), 0)
                pick = np.flatnonzero(stands)
                pick = pick[np.argsort(bucket[pick], kind="stable")]
                edges = np.flatnonzero(np.diff(bucket[pick])) + 1
                rows: dict[str, list] = {"bucket": [], "found": [], "key": [], "place": [], "known": []}
                for part in np.split(pick, edges):
                    rows["bucket"].append(int(bucket[part[0]]))
                    rows["found"].append(found[part].tobytes())
                    rows["key"].append(key[part].tobytes())
                    rows["place"].append(place[part].tobytes())
                    rows["known"].append(known[part].tobytes())
                if known.any():  # these pass through whichever bucket
                    rows["bucket"].append(int(abs(int(keys[a])) % buckets))
                    rows["found"].append(b"")
                    rows["key"].append(key[known].tobytes())
                    rows["place"].append(place[known].tobytes())
                    rows["known"].append(b"")
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()})

    def meet(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_pylist() for c in ("found", "key", "place", "known")}
        shuffled = [i for i, f in enumerate(cols["found"]) if f]
        direct = [i for i, f in enumerate(cols["found"]) if not f]
        whole = lambda c, kind, rows: np.frombuffer(b"".join(cols[c][i] for i in rows), kind)
        found, known = whole("found", np.uint64, shuffled), whole("known", bool, shuffled)
        keys, places = whole("key", np.int64, shuffled), whole("place", np.uint32, shuffled)
        order = np.lexsort((known, places, keys, found))
        same = np.zeros(len(order), bool)  # one place of one text, from several slices
        a, b = order[1:], order[:-1]
        same[1:] = (found[a] == found[b]) & (keys[a] == keys[b]) & (places[a] == places[b])
        order = order[~same]
        ranked = found[order]
        twin = np.zeros(len(ranked), bool)
        twin[1:] = ranked[1:] == ranked[:-1]
        twin[:-1] |= twin[1:]
        pick = order[twin]
        pick = pick[~known[pick]]
        key = np.concatenate([keys[pick], whole("key", np.int64, direct)])
        place = np.concatenate([places[pick], whole("place", np.uint32, direct)]).astype(np.int32)
        return pa.table({"key": pa.array(key), "place": pa.array(place)})

    packed = docs.select("key", "text").mapInArrow(emit, "bucket int, found binary, key binary, place binary, known binary")
    parts = packed.groupBy("bucket").applyInArrow(meet, "key long, place int")
    return parts.groupBy("key").agg(F.collect_set("place").alias("places"))


_CONTEXT = "context long, anchor long, lead short, size short, key long, ord long, place int"


def contexts(docs: DataFrame, places: DataFrame, scheme: Scheme) -> DataFrame:
    """A row per repeated anchor of each text; context is the hash of anchor, lead, size and symbols. places: key, first, places."""
    rows = docs.join(places, (docs["key"] == places["key"]) & (docs["ord"] == places["first"])).select(docs["key"], "ord", "text", "places")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), np.int64)
            ords = np.array(batch.column("ord").to_pylist(), np.int64)
            texts = batch_texts(batch.column("text"))
            lists = batch.column("places")
            for a, b in slices(np.array([len(t) for t in texts]), SLICE_BYTES // 4):
                symbols, begins, ends, _ = symbols_of(texts[a:b], scheme.words)
                part = lists.slice(a, b - a)
                doc = np.repeat(np.arange(b - a), np.asarray(part.value_lengths()))
                at = np.asarray(part.flatten()).astype(np.int64) + begins[doc]
                left, right = np.maximum(begins[doc], at - scheme.reach), np.minimum(ends[doc], at + scheme.length)
                anchor = range_hashes(symbols, at, at + scheme.k)
                lead, size = at - left, right - left
                context = mix64(range_hashes(symbols, left, right) + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_pydict(
                    {
                        "context": pa.array(context.view(np.int64)), "anchor": pa.array(anchor.view(np.int64)), "lead": pa.array(lead.astype(np.int16)), "size": pa.array(size.astype(np.int16)),
                        "key": pa.array(keys[a:b][doc]), "ord": pa.array(ords[a:b][doc]), "place": pa.array((at - begins[doc]).astype(np.int32)),
                    }
                )

    return rows.mapInArrow(emit, _CONTEXT)


_ITEMS = "context long, anchor long, lead short, size short, least long, most long, n long"


def context_symbols(docs: DataFrame, owners: DataFrame, items: DataFrame, scheme: Scheme) -> DataFrame:
    """(context, anchor, lead, size, least, most, n, symbols) of the contexts in items, each cut from the text of its place.

    items: key, items, the latter an array of structs of a context's columns and its place in that text.
    """
    rows = items.join(owners.select("key", "first"), "key")
    rows = docs.join(rows, (docs["key"] == rows["key"]) & (docs["ord"] == rows["first"])).select("text", "items")
    names = [c.split()[0] for c in _ITEMS.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch_texts(batch.column("text")), batch.column("items")
            for a, b in slices(np.array([len(t) for t in texts]), SLICE_BYTES // 4):
                symbols, begins, _, _ = symbols_of(texts[a:b], scheme.words)
                part = lists.slice(a, b - a)
                doc = np.repeat(np.arange(b - a), np.asarray(part.value_lengths()))
                flat = part.flatten()
                place, lead, size = (np.asarray(flat.field(c)).astype(np.int64) for c in ("place", "lead", "size"))
                left = begins[doc] + place - lead
                offsets = np.concatenate([[0], np.cumsum(size)])
                index = np.arange(offsets[-1]) + np.repeat(left - offsets[:-1], size)
                if scheme.words:
                    body = np.ascontiguousarray(symbols.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES][index].ravel()
                    offsets = offsets * WORD_BYTES
                else:
                    body = symbols[index]
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])
                yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in names], binary], names=[*names, "symbols"])

    return rows.mapInArrow(emit, _ITEMS + ", symbols binary")


def repeated_spans(docs: DataFrame, scheme: Scheme, kernel: Kernel, earlier: bool) -> DataFrame:
    """(key, first, n, spans) of the texts that more than one row has, or in which windows occur again.

    key is the text's hash, first the least id that has it, n the number of rows; spans are struct<s, e> in symbols, in no order.
    earlier: only windows that also occur in a text whose first id is smaller; else any other occurrence does.
    """
    spark = docs.sparkSession
    keyed = _key_columns(docs)
    _, total = text_bytes(keyed)
    owners = table(keyed.groupBy("key").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")), "owners")
    places = table(repeated_anchors(keyed, scheme, total // 6 if scheme.words else total).join(owners.drop("n"), "key"), "places", "zstd")
    release(spark)
    found = table(contexts(keyed, places, scheme), "contexts", "zstd")
    drop_table(places)
    release(spark)
    merged = found.groupBy("context", "anchor", "lead", "size").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("at"))
    merged = table(merged, "merged", "zstd")
    release(spark)
    mixed = table(merged.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor"), "mixed")
    low, high = F.greatest(F.lit(0), F.col("lead") - scheme.reach), F.least(F.col("lead"), F.col("size") - scheme.length)
    plain = merged.join(mixed, "anchor", "left_anti").where(low <= high)
    plain = plain.where("least < most") if earlier else plain.where("n >= 2")
    plain = plain.select("context", F.col("least").alias("value"), (low - F.col("lead")).cast("int").alias("s"), (high - F.col("lead") + scheme.length).cast("int").alias("e"))
    whole = [F.col(c.split()[0]) for c in _ITEMS.split(", ")]
    items = merged.join(mixed, "anchor", "left_semi").groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct(*whole, F.col("at.place").alias("place"))).alias("items"))
    hard = table(context_symbols(keyed, owners, items, scheme), "symbols", "zstd")
    buckets = max(1, merged.count() // BUCKET_CONTEXTS + 1)

    def decide(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group.column("anchor").combine_chunks()), kind="stable")
        group = group.combine_chunks().take(pa.array(order))
        anchor, lead, least, most, n, context = (np.asarray(group.column(c).combine_chunks()).astype(np.int64) for c in ("anchor", "lead", "least", "most", "n", "context"))
        parts = group.column("symbols").to_pylist()
        which, value, first, last = kernel(scheme, anchor, lead, parts, least, n)
        use = (value < most[which]) if earlier else value >= 2
        which, value, first, last = which[use], value[use], first[use], last[use]
        return pa.table({"context": pa.array(context[which]), "value": pa.array(value), "s": pa.array((first - lead[which]).astype(np.int32)), "e": pa.array((last - lead[which] + scheme.length).astype(np.int32))})

    decided = hard.withColumn("bucket", F.pmod(F.col("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(decide, "context long, value long, s int, e int")
    runs = table(plain.unionByName(decided), "runs", "zstd")
    drop_table(merged)
    drop_table(hard)
    release(spark)
    # two plain exchanges: a context that very many texts share is split at run time
    hits = found.select("context", "key", "ord", "place").join(runs, "context")
    if earlier:
        hits = hits.where("value < ord")
    spans = hits.select("key", F.struct((F.col("place") + F.col("s")).alias("s"), (F.col("place") + F.col("e")).alias("e")).alias("span"))
    spans = spans.groupBy("key").agg(F.collect_set("span").alias("spans"))
    out = table(owners.join(spans, "key", "left").where("n > 1 or spans is not null"), "spans", "zstd")
    drop_table(found)
    drop_table(runs)
    release(spark)
    return out


def with_spans(docs: DataFrame, spans: DataFrame, earlier: bool) -> DataFrame:
    """(doc_id, text, all, spans) for every row of docs; all: the whole text occurs elsewhere (earlier: in a smaller id)."""
    rows = docs.select("doc_id", F.col("text"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    whole = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) > F.col("first") if earlier else F.col("n") > 1
    return rows.join(spans, "key", "left").select("doc_id", "text", F.coalesce(whole, F.lit(False)).alias("all"), "spans")
