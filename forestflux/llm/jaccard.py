"""N-gram Jaccard join with vertical partitioning, and the components of its links.

The global order of n-grams puts rarer ones first (document frequencies are counted over all documents; the common ones are
ranked by them, the rest by hash). It is cut into fragments, intervals of that order of about equal weight. A document's
n-grams in a fragment are a row of their own; partial overlaps are counted fragment by fragment and summed per pair.

Pairs with similarity t share an n-gram among the first n - ceil(t n) + 1 of each, so pairs are looked for among the documents that share
a prefix n-gram, with length and position bounds. Equal sets are one node from the start. Only what could join two components is looked
for, so no link is lost that would change one:

1. Of the documents that share a prefix n-gram each is compared with one head. A group of near copies takes as many pairs as members.
2. In groups that are still not connected, members of different components are compared pair by pair where few of them (SMALL) can be
   the smaller side of a pair that links, or few are outside the group's largest component, as one end of every such pair is.
3. The members of the others are described by what sets them apart from their head, their deviations. |x ^ y| <= h for sets that link, so
   |dx & dy| >= (|dx| + |dy| - h) / 2: members that link share most of their deviations, and a prefix of those, rarest first, brings them
   together. What all members have in common has no weight any more, so the new groups are small, and step 1 starts again with them.
   Where |dx| + |dy| <= h the sets link whatever they share; one of the two then links with the head, and one such pair is enough.

The joins of large tables are hinted to be sorted merges, as they have to be at scale: the plan is then the same at every size.

Words are lower-cased (A-Z) runs of characters other than the six ASCII blanks; n-grams are told apart by 64-bit hashes, sets by 64-bit
sums of them.

Defined cases: null, empty and blank texts have empty sets and are linked with nothing; texts with fewer words than n have one n-gram,
all of them; very long texts are shingled whole, by one task each; a null doc_id counts as larger than all others; repeated rows have
one set and so one component; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, batch_texts, blank_table, drop_table, gram_hashes, joined, mix64, range_hashes, release, slices, table, text_bytes, word_spans
from .components import components
from .windows import NO_ID

N, PER_CENT = 5, 80
FRAGMENTS = 4
#: An n-gram is ranked by its frequency if so many documents have it.
COMMON_LEAST = 32
SLICE_BYTES, BUCKET_ROWS = 1_000_000, 1 << 20
#: Codes that a counting task holds before it sends their counts, and n-grams in an Arrow batch of segments.
FLUSH_CODES, BATCH_GRAMS = 2_000_000, 1 << 20
_SEEN = 1 << 22
#: Bits of a row of a bitmap (those of Spark's bitmap_construct_agg), and bits for each key in it.
ROW_BITS, KEY_BITS = 32768, 8
#: Groups with so many possible sides are compared pair by pair, and larger ones while they take so many pairs for each first entry.
SMALL, PAIRS_PER_ENTRY = 32, 1


def _text_slices(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows a to b of a batch with their texts, at most `most` bytes of them at once."""
    column = batch.column("text")
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), most):
        yield a, b, batch_texts(column.slice(a, b - a))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-grams of all texts, in ascending order of both."""
    data, at = joined([t.lower() for t in texts])  # of bytes: A-Z only
    starts, ends = word_spans(data, blank_table())
    edges = np.searchsorted(starts, at)
    words = range_hashes(data, starts, ends)
    count = np.diff(edges)
    grams = gram_hashes(words, n)
    size = np.where(count < n, count > 0, count - n + 1)
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(texts)), size)
    value = np.empty(len(owner), np.uint64)
    full = (count >= n)[owner]
    value[full] = grams[(np.arange(len(owner)) + (edges[:-1] - at[:-1])[owner])[full]]
    short = np.flatnonzero((count > 0) & (count < n))
    value[at[short]] = range_hashes(words, edges[short], edges[short + 1])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):  # text by text is faster than one sort by both
        value[a:b].sort()
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _nodes(owner: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and 64-bit identity of each text's set."""
    edges = np.searchsorted(owner, np.arange(texts + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value + np.uint64(0x632BE59BD9B4E019)))])
    node = total[edges[1:]] - total[edges[:-1]]
    size = np.diff(edges)
    return size, mix64(node ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _prefix(size: np.ndarray, per_cent: int) -> np.ndarray:
    return size - (size * per_cent + 99) // 100 + 1


def document_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, ord, key, n_shingles, node) for every row."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.xxhash64("doc_id", "text").alias("key"), "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _text_slices(batch, SLICE_BYTES):
                size, node = _nodes(*shingle_sets(texts, n), b - a)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(size.astype(np.int64)), pa.array(node)], names=["doc_id", "ord", "key", "n_shingles", "node"])

    return rows.mapInArrow(run, f"doc_id {kind}, ord long, key long, n_shingles long, node long")


@dataclass(frozen=True)
class Order:
    """The global order: 32-bit codes of the common n-grams (ascending) and their frequencies, and how it is cut.

    The first `rare` fragments are equal ranges of the hashes of all other n-grams, the rest intervals of frequencies that end at `cuts`.
    """

    codes: np.ndarray
    documents: np.ndarray
    rare: int
    cuts: np.ndarray

    @property
    def fragments(self) -> int:
        return self.rare + len(self.cuts) + (len(self.codes) > 0)

    def rank(self, value: np.ndarray) -> np.ndarray:
        """0 for rare n-grams, else the frequency."""
        if not len(self.codes):
            return np.zeros(len(value), np.int64)
        code = value.astype(np.uint32)
        out = np.zeros(len(value), np.int64)
        maybe = np.flatnonzero(self._seen[code & np.uint32(_SEEN - 1)])
        code = code[maybe]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        out[maybe] = np.where(self.codes[at] == code, self.documents[at], 0)
        return out

    @cached_property
    def _seen(self) -> np.ndarray:
        """Whether any common code ends in these bits; most n-grams are rare and need no search."""
        out = np.zeros(_SEEN, bool)
        out[self.codes & np.uint32(_SEEN - 1)] = True
        return out

    def fragment(self, value: np.ndarray) -> np.ndarray:
        rank = self.rank(value)
        low = ((value >> np.uint64(32)) * np.uint64(self.rare) >> np.uint64(32)).astype(np.int64)
        return np.where(rank > 0, self.rare + np.searchsorted(self.cuts, rank, "right"), low)


def packed_counts(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, codes, counts) of the n-grams' codes, counted FLUSH_CODES at a time; buckets are equal ranges of codes."""
    bounds = np.array([-(-(k << 32) // buckets) for k in range(buckets)], np.uint32)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(held)
        held.clear()
        codes.sort()
        heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.diff(np.append(heads, len(codes))).astype(np.uint32)
        codes = codes[heads]
        edges = np.append(np.searchsorted(codes, bounds), len(codes))
        parts = [(k, edges[k], edges[k + 1]) for k in np.flatnonzero(np.diff(edges)).tolist()]
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([k for k, _, _ in parts], pa.int32()),
                "codes": pa.array([codes[a:b].tobytes() for _, a, b in parts], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for _, a, b in parts], pa.binary()),
            }
        )

    held, size = [], 0
    for batch in batches:
        for _, _, texts in _text_slices(batch, SLICE_BYTES):
            held.append(shingle_sets(texts, n)[1].astype(np.uint32))
            size += len(held[-1])
            if size > FLUSH_CODES:
                yield send(held)
                size = 0
    if size:
        yield send(held)


def global_order(docs: DataFrame, n: int, total_bytes: int, shingles: int, fragments: int) -> Order:
    """Counts all n-grams and cuts their order; codes that collide count together.

    The frequency that counts as common is raised until all fit MAX_BROADCAST_BYTES; it orders n-grams only, so any gives the same links.
    """
    buckets = max(1, total_bytes // 6 // (2 * BUCKET_ROWS) + 1)

    def add(group: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32).astype(np.int64)
        codes, counts = _add_up(codes, counts)
        keep = counts >= least
        return pa.table({"code": pa.array(codes[keep].astype(np.int64)), "documents": pa.array(counts[keep])})

    least = COMMON_LEAST
    packed = docs.select("text").mapInArrow(lambda batches: packed_counts(batches, n, buckets), "bucket int, codes binary, counts binary")
    found = table(packed.groupBy("bucket").applyInArrow(add, "code long, documents long"), "common")
    while 12 * found.where(F.col("documents") >= least).count() > MAX_BROADCAST_BYTES:
        least *= 2
    common = found.where(F.col("documents") >= least).orderBy("code").toPandas()
    drop_table(found)
    documents = common["documents"].to_numpy(np.int64)
    last = min(fragments - 1, max(1, round(fragments * documents.sum() / max(1, shingles)))) if len(documents) else 0
    ascending = np.sort(documents)
    weight = np.cumsum(ascending)
    cuts = np.unique([ascending[np.searchsorted(weight, weight[-1] * k / last)] for k in range(1, last)]) if last > 1 else np.empty(0, np.int64)
    return Order(common["code"].to_numpy(np.uint32), documents, fragments - last, cuts)


def _add_up(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _rare_first(owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by owner, rank and place; owner ascends."""
    late = np.flatnonzero(rank)
    order = np.concatenate([np.flatnonzero(rank == 0), late[np.lexsort((rank[late], owner[late]))]])
    return order[np.argsort(owner[order], kind="stable")]


def prefixes(docs: DataFrame, n: int, per_cent: int, order: Order) -> DataFrame:
    """(gram, node, size, place) of the prefix n-grams of all sets; sets that are equal may come more than once."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, texts in _text_slices(batch, SLICE_BYTES):
                owner, value = shingle_sets(texts, n)
                if not len(owner):
                    continue
                size, node = _nodes(owner, value, b - a)
                once = np.zeros(b - a, bool)
                for x, i in zip(*(y.tolist() for y in np.unique(node, return_index=True))):  # equal sets once a task
                    once[i] = x not in seen
                    seen.add(x)
                use = once[owner]
                owner, value = owner[use], value[use]
                by = _rare_first(owner, shared.value.rank(value))
                owner, value = owner[by], value[by]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                use = place < _prefix(size, per_cent)[owner]
                owner, value, place = owner[use], value[use], place[use]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(node[owner]), pa.array(size[owner].astype(np.int32)), pa.array(place.astype(np.int32))], names=["gram", "node", "size", "place"])

    return docs.select("text").mapInArrow(emit, "gram long, node long, size int, place int")


def maybe_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose `key` (a long) is among keys, and a few others: a bitmap of the keys' hashes, of MAX_BROADCAST_BYTES at most, goes to all tasks."""
    bits = min(8 * MAX_BROADCAST_BYTES, max(1, -(-KEY_BITS * keys.count() // ROW_BITS)) * ROW_BITS)
    hashed = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(bits))
    row, place = F.floor(hashed / ROW_BITS), (hashed % ROW_BITS)
    bitmap = keys.groupBy(row.alias("__row")).agg(F.bitmap_construct_agg(place).alias("__bits"))
    byte = F.conv(F.hex(F.substr("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__row", row).join(F.broadcast(bitmap), "__row")
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def node_texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes, each from the document with the least id that has its set; few other texts move."""
    owners = sets.where("n_shingles > 0").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("ord", "key")).alias("m")).select("node", F.col("m.key").alias("key"))
    owners = table(owners, "owners")
    rows = maybe_in(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text"), owners).join(owners.hint("merge"), "key")
    return rows.groupBy("node").agg(F.first("text").alias("text"))  # repeated rows


def _either(pairs: DataFrame) -> DataFrame:
    """(node): the nodes of pairs (a, b); only their texts move."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def segments(texts: DataFrame, peers: DataFrame, n: int, order: Order, low: int = 0, high: int | None = None) -> DataFrame:
    """(peer, fragment, node, size, grams): the n-grams of every node of peers (node, peers), once for each of its peers and fragments [low, high)."""
    shared = texts.sparkSession.sparkContext.broadcast(order)
    rows = texts.join(peers.hint("merge"), "node").select("node", "text", "peers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        f = cut.fragments
        wanted = np.arange(low, f if high is None else high)
        for batch in batches:
            nodes, lists = np.asarray(batch.column("node")), batch.column("peers")
            copies = np.asarray(lists.value_lengths()).astype(np.int64)
            for a, b, texts in _text_slices(batch, SLICE_BYTES // 2):
                owner, value = shingle_sets(texts, n)
                cell = owner * f + cut.fragment(value)
                by = np.argsort(cell, kind="stable")
                cell, value = cell[by], value[by].view(np.int64)
                edges = np.searchsorted(cell, np.arange((b - a) * f + 1))
                size = np.diff(edges[::f])
                doc = np.repeat(np.arange(b - a), copies[a:b])
                peer = np.asarray(lists.slice(a, b - a).flatten())
                for i, j in slices(size[doc], BATCH_GRAMS):
                    row = np.repeat(doc[i:j], len(wanted)) * f + np.tile(wanted, j - i)
                    length = edges[row + 1] - edges[row]
                    ends = np.cumsum(length)
                    at = np.repeat(edges[row] - ends + length, length) + np.arange(ends[-1])
                    grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(value[at]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(peer[i:j], len(wanted))), pa.array((row % f).astype(np.int32)), pa.array(nodes[a:b][row // f]), pa.array(size[row // f].astype(np.int32)), grams],
                        names=["peer", "fragment", "node", "size", "grams"],
                    )

    return rows.mapInArrow(run, "peer long, fragment int, node long, size int, grams array<long>")


def _side_by_side(pairs: DataFrame, texts: DataFrame, n: int, order: Order, low: int = 0, high: int | None = None) -> DataFrame:
    """(a, b, fragment, size_a, size_b, ga, gb) of the pairs (a, b); the sets of b move to those of a, which may be hot and are split then."""
    b = segments(texts, pairs.groupBy(F.col("b").alias("node")).agg(F.collect_set("a").alias("peers")), n, order, low, high)
    a = segments(texts, pairs.select(F.col("a").alias("node")).distinct().withColumn("peers", F.array("node")), n, order, low, high)
    b = b.select(F.col("peer").alias("a"), "fragment", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("grams").alias("gb"))
    return b.join(a.select(F.col("node").alias("a"), "fragment", F.col("size").alias("size_a"), F.col("grams").alias("ga")), ["a", "fragment"])


def verify(pairs: DataFrame, texts: DataFrame, n: int, per_cent: int, order: Order) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted per fragment and summed.

    The first fragment goes first, as a pair whose count there cannot be made up for by all the others needs none of them.
    """
    enough = lambda count: (100 + per_cent) * count >= per_cent * (F.col("size_a") + F.col("size_b"))
    overlap = F.size(F.array_intersect("ga", "gb"))
    rest = F.least(F.col("size_a") - F.size("ga"), F.col("size_b") - F.size("gb"))
    first = _side_by_side(pairs, texts, n, order, 0, 1).select("a", "b", "size_a", "size_b", overlap.alias("first"), rest.alias("rest"))
    open_ = table(first.where(enough(F.col("first") + F.col("rest"))).select("a", "b", "first"), "open")
    counts = _side_by_side(open_, texts, n, order, 1).select("a", "b", "size_a", "size_b", overlap.alias("overlap"))
    total = counts.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), *[F.min(c).alias(c) for c in ("size_a", "size_b")]).join(open_, ["a", "b"])
    return total.where(enough(F.col("first") + F.col("overlap"))).select("a", "b")


def _most_apart(per_cent: int, sizes: Column) -> Column:
    """|x ^ y| of sets that link, at most; sizes: |x| + |y|."""
    return F.floor((100 - per_cent) * sizes / F.lit(100 + per_cent))


def _may_link(x: str, y: str, per_cent: int) -> Column:
    """Whether two members of a group can link that share its gram, and none before it, by size and place."""
    c = lambda side, name: F.col(f"{side}.{name}")
    left = lambda side: c(side, "dev") - c(side, "place")
    close = 100 * F.least(c(x, "size"), c(y, "size")) >= per_cent * F.greatest(c(x, "size"), c(y, "size"))
    return close & (2 * F.least(left(x), left(y)) >= c(x, "dev") + c(y, "dev") - _most_apart(per_cent, c(x, "size") + c(y, "size")))


def _heads() -> Column:
    """The member of a gram's group that all others are compared with: that with the fewest rarer n-grams, so the least of its own."""
    return F.min(F.struct("place", F.xxhash64("node").alias("h"), "node", "size", "dev", "part")).alias("head")


def _smaller_side(per_cent: int) -> Column:
    """Whether an entry can be that of the member with fewer deviations in a pair that links."""
    return 2 * F.col("place") <= _most_apart(per_cent, F.col("size") + F.floor(100 * F.col("size") / F.lit(per_cent)))


def _of_use(entries: DataFrame, per_cent: int) -> DataFrame:
    """The entries that can bring up a pair of different parts, with their group's head; every such pair has a `side` among `few` of the group.

    The sides are the possible smaller ones or, if those are fewer, the entries outside the group's largest part.
    """
    most = _most_apart(per_cent, F.col("size") + F.floor(100 * F.col("size") / F.lit(per_cent)))
    sides = entries.withColumn("smaller", _smaller_side(per_cent))
    least = sides.where("smaller").groupBy("gram").agg(F.min("dev").alias("least"))
    sides = sides.join(least.hint("merge"), "gram").where(F.col("smaller") | (F.col("dev") - 2 * F.col("place") + most >= F.col("least"))).drop("least")
    by_part = sides.groupBy("gram", "part").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("smaller").cast("int")).alias("s"), _heads())
    groups = by_part.groupBy("gram").agg(F.max(F.struct("c", "part")).alias("main"), F.sum("c").alias("all"), F.sum("s").alias("s"), F.min("head").alias("head")).where("all > main.c")
    groups = groups.withColumn("outside", F.col("all") - F.col("main.c")).select("gram", "head", F.col("main.part").alias("main"), F.least("s", "outside").alias("few"), (F.col("outside") < F.col("s")).alias("by_part"))
    side = F.when(F.col("by_part"), F.col("part") != F.col("main")).otherwise(F.col("smaller"))
    return sides.join(groups.hint("merge"), "gram").withColumn("side", side).drop("smaller", "main", "by_part")


def _pairwise(entries: DataFrame, most: int) -> int:
    """Up to which number of sides groups are compared pair by pair: SMALL, or the power of two that takes `most` pairs in all."""
    power = F.ceil(F.log2(F.col("few"))).cast("int").alias("power")
    by_size = entries.where(F.col("few") > SMALL).groupBy(power).agg(F.sum("few").alias("pairs")).orderBy("power").collect()
    limit, total = SMALL, 0
    for row in by_size:  # a row per power of two
        total += row["pairs"]
        if total > most:
            break
        limit = 1 << row["power"]
    return limit


def deviations(members: DataFrame, texts: DataFrame, n: int, per_cent: int, order: Order) -> tuple[DataFrame, DataFrame]:
    """For members b of heads a, rows (a, b, part): new groups (gram, node, size, dev, place, part) by deviations, and pairs that link by |dx| + |dy|."""
    apart = _side_by_side(members, texts, n, order).select("a", "b", "size_a", "size_b", F.explode(F.concat(F.array_except("ga", "gb"), F.array_except("gb", "ga"))).alias("g"))
    apart = table(apart, "apart")
    often = apart.groupBy("a", "g").agg(F.count(F.lit(1)).alias("c"))
    each = apart.join(often, ["a", "g"]).groupBy("a", "b", "size_a", "size_b").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("devs")).join(members, ["a", "b"])
    each = table(each.withColumn("dev", F.size("devs")).withColumn("v", (100 + per_cent) * F.col("dev") - (100 - per_cent) * F.col("size_b")), "deviations")
    drop_table(apart)
    size = F.col("size_b")
    most = _most_apart(per_cent, size + F.floor(100 * size / F.lit(per_cent))).cast("int")
    groups = each.select("a", F.col("b").alias("node"), F.col("size_b").alias("size"), "dev", "part", F.posexplode(F.slice("devs", F.lit(1), most + 1)).alias("place", "d"))
    groups = groups.where("d.c > 1").select(F.xxhash64("a", "d.g").alias("gram"), "node", "size", "dev", "place", "part")
    with_head = F.col("v") <= (100 - per_cent) * F.col("size_a")
    best = each.where(with_head).groupBy("a").agg(F.min(F.struct("v", "b", "part")).alias("best"))
    sure = each.where(~with_head).join(best, "a").where((F.col("v") + F.col("best.v") <= 0) & (F.col("part") != F.col("best.part")))
    return groups, sure.select(F.col("best.b").alias("a"), "b", F.col("best.part").alias("pa"), F.col("part").alias("pb"))


def _joined_parts(label: DataFrame | None, step: DataFrame) -> DataFrame:
    """(node, root) after the parts themselves were joined by step (node, root)."""
    if label is None:
        return step
    onto = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = label.join(onto, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return table(moved.unionByName(step.join(label, "node", "left_anti")), "labels")


def join_documents(docs: DataFrame, n: int = N, per_cent: int = PER_CENT, fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame]:
    """The sets (doc_id, ord, key, n_shingles, node) of all documents, and (node, root) of all nodes that are linked with others."""
    if fragments < 2:
        raise ValueError("two fragments at least")
    spark = docs.sparkSession
    _, total = text_bytes(docs)
    sets = table(document_sets(docs, n), "sets")
    shingles = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    order = global_order(docs, n, total, shingles, fragments)
    first = table(prefixes(docs, n, per_cent, order), "prefixes")
    # counts take half the room of nodes; what only equal sets of several tasks share comes along and brings up no pair
    several = first.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    entries = first.join(several.hint("merge"), "gram").groupBy("gram", "node").agg(F.first("size").alias("size"), F.first("size").alias("dev"), F.first("place").alias("place"), F.first("node").alias("part"))
    entries = table(entries, "entries")
    size = entries.count()
    drop_table(first)
    label, more = None, spark.createDataFrame([], "a long, b long, pa long, pb long")
    member = F.struct("node", "size", "dev", "place", "part")
    while True:
        if entries is not None:
            heads = entries.groupBy("gram").agg(_heads())
            near = entries.select("gram", member.alias("x")).join(heads.hint("merge"), "gram").where((F.col("x.part") != F.col("head.part")) & _may_link("x", "head", per_cent))
            near = near.select(F.col("head.node").alias("a"), F.col("x.node").alias("b"), F.col("head.part").alias("pa"), F.col("x.part").alias("pb"))
            more = near.unionByName(more)
        pairs = table(more.distinct(), "pairs")
        texts = table(node_texts(docs, sets, _either(pairs)), "texts")
        links = table(verify(pairs, texts, n, per_cent, order).join(pairs, ["a", "b"]).select(F.col("pa").alias("a"), F.col("pb").alias("b")), "links")
        drop_table(pairs)
        drop_table(texts)
        release(spark)
        if not links.isEmpty():
            step = components(links)
            label = _joined_parts(label, step)
            if entries is not None:
                entries_ = entries.join(step.select(F.col("node").alias("part"), "root"), "part", "left").withColumn("part", F.coalesce("root", "part")).drop("root")
                entries, old = table(entries_, "entries"), entries
                drop_table(old)
        drop_table(links)
        if entries is None:  # the pairs were the last ones
            return sets, label if label is not None else spark.createDataFrame([], "node long, root long")
        # where all members are connected nothing is left to find
        open_ = table(_of_use(entries, per_cent), "open")
        drop_table(entries)
        small = F.col("few") <= _pairwise(open_, PAIRS_PER_ENTRY * size)
        few = open_.where(small).select("gram", "side", member.alias("x"))
        before = F.struct("x.dev", "x.node") < F.struct("y.dev", "y.node")
        each = few.where("side").join(few.select("gram", F.col("side").alias("too"), F.col("x").alias("y")), "gram")
        each = each.where((before | ~F.col("too")) & (F.col("x.part") != F.col("y.part")) & _may_link("x", "y", per_cent))
        more = each.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.part").alias("pa"), F.col("y.part").alias("pb"))
        large = open_.where(~small & (F.col("node") != F.col("head.node"))).select(F.col("head.node").alias("a"), F.col("node").alias("b"), "part")
        large = table(large.distinct(), "members")
        if large.isEmpty():
            entries = None
        else:
            texts = table(node_texts(docs, sets, _either(large)), "texts")
            entries, sure = deviations(large, texts, n, per_cent, order)
            drop_table(texts)
            entries, more = table(entries, "entries"), more.unionByName(sure)
        more = table(more.distinct(), "more")
        drop_table(open_)
        drop_table(large)
        release(spark)
        if (entries is None or entries.isEmpty()) and more.isEmpty():
            return sets, label if label is not None else spark.createDataFrame([], "node long, root long")


def near_components(docs: DataFrame, n: int = N, per_cent: int = PER_CENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the least doc_id reachable by links."""
    sets, label = join_documents(docs, n, per_cent, fragments)
    full = sets.where("n_shingles > 0").select("doc_id", "n_shingles", "node").join(label, "node", "left").withColumn("part", F.coalesce("root", "node")).select("doc_id", "n_shingles", "part")
    full = table(full, "parts")
    least = table(full.groupBy("part").agg(F.min("doc_id").alias("component_id")), "least")
    linked = full.join(least, "part").select("doc_id", "n_shingles", "component_id")
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each component the row with the least doc_id (null last; of several the one with the least hash of id and text), as it is.

    Rows are told apart by id and text, so rows that share an id are judged one by one. Of rows that agree in both one stays. Rows with an
    empty set are in no component and stay.
    """
    sets, label = join_documents(docs, **options)
    part = sets.where("n_shingles > 0").join(label, "node", "left").select(F.coalesce("root", "node").alias("part"), "ord", "key")
    kept = part.groupBy("part").agg(F.min(F.struct("ord", "key")).alias("m")).select(F.col("m.key").alias("__key"))
    kept = table(kept, "kept")
    empty = sets.where("n_shingles = 0").select(F.col("key").alias("__key")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("__key"), F.struct(*columns).alias("__row"))
    first = F.first if any("map<" in t for _, t in docs.dtypes) else F.min
    one = keyed.join(kept.hint("merge"), "__key", "left_semi").groupBy("__key").agg(first("__row").alias("__row"))
    rest = keyed.join(empty, "__key", "left_semi")
    return one.unionByName(rest).select("__row.*")
