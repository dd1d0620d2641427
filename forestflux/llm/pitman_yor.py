"""A hierarchical Pitman-Yor language model of word pairs, seated by Gibbs sampling, and the log probabilities of texts under it.

Every word is a restaurant (the context of what follows it) whose dishes are the next words. All these restaurants share one parent,
whose customers are their tables, and the parent's base is uniform over the known tokens and one unknown. Seatings are sampled from the
training tokens in sweeps; probabilities are averaged over the sweeps that are kept.

How a sweep is spread: given a gamma variable for each restaurant (which stands for its number of tables) and the parent's probabilities,
the dishes of all restaurants are independent, so pairs of words are dealt by their hash, and no restaurant is ever gathered in one task.
Per dish the tables of its c customers are drawn at once from their exact conditional distribution (c up to EXACT; above, from its normal
limit at the saddle point). Sums of tables go to the words' buckets, by word; these draw the parent's tables, and send each pair bucket the
variables and probabilities of the words that it asks for. The parent's probabilities are those of the last sweep, as in other
distributed samplers. Concentrations are drawn from a grid, discounts are taken from how many pairs occur once and twice.

What moves: texts are cut into slices that hold each distinct word and pair once, so a word or pair that fills a third of the corpus is
a number in each slice. Words have numbers (bucket and place); 64-bit hashes tell them apart. All messages are packed arrays, and every
step is a written table, so lost executors repeat a step from tables. Draws depend on the bucket and sweep only: reruns agree.

Defined cases: null texts are empty and consist of their end; null ids are scored, too, and are a matter of held_out; repeated rows and
ids are documents of their own; texts of any length are taken whole; without training documents every token has the base probability of
one unknown token; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import pickle
import random
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_texts, blank_table, drop_table, joined, mix64, range_hashes, release, slices, table, text_bytes, word_spans

#: Sweeps before the first that is kept, and sweeps that are kept.
BURN_IN, KEPT = 2, 2
#: Customers of a dish up to which their tables are drawn from the exact distribution.
EXACT = 512
#: Bytes of text hashed at once, tokens in a slice, and tokens of the corpus for a bucket of pairs and one of words.
CHUNK_BYTES, SLICE_TOKENS, PAIR_TOKENS, WORD_TOKENS = 1_000_000, 500_000, 1_500_000, 4_000_000
#: Rows of a batch that are taken out of it at once.
ROWS = 256
#: Concentrations to choose from.
GRID = np.geomspace(0.01, 1e6, 40)
#: What stands for the end of a text, and for what is before its first word.
END, BEGIN = np.uint64(0x9D4C0A55E0F1B3A7), np.uint64(0x51ED270B9C6F2E15)
PLACE_BITS = 26
MESSAGE = "b int, src long, kind string, data binary"


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: whole numbers in as few bytes as they need, and bytes of equal weight together, which makes them small."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a) and a.max() < 1 << 32:
            a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if int(a.max()) < 1 << 8 * t().itemsize))
        size = a.dtype.itemsize
        planes = a.view(np.uint8).reshape(len(a), size).T if a.dtype.kind == "u" and 1 < size < 8 else a
        out.append((a.dtype.str, planes.tobytes()))
    return zstandard.compress(pickle.dumps(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    """What pack() was given; whole numbers under 2**32 as int64."""
    out = []
    for kind, raw in pickle.loads(zstandard.decompress(data)):
        size = np.dtype(kind).itemsize
        if kind[1] == "u" and size < 8:
            planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
            a = planes[0].astype(np.int64)
            for i in range(1, size):
                a |= planes[i].astype(np.int64) << (8 * i)
            out.append(a)
        else:
            out.append(np.frombuffer(raw, kind))
    return out


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(keys, return_inverse=True) for keys of so many bits: one sort of keys that hold their places, if there is room for these."""
    room = max(1, len(keys) - 1).bit_length()
    low = bits + room - 63
    if low > 0 and bits < 64 or low > 24:
        return np.unique(keys, return_inverse=True)
    # of keys that fill all bits the last are left out of the sort, and what then looks equal is compared
    cut = np.uint64(max(0, low))
    packed = ((keys.astype(np.uint64) >> cut) << np.uint64(room)) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    at = (packed & np.uint64((1 << room) - 1)).astype(np.int64)
    packed >>= np.uint64(room)
    new = np.ones(len(keys), bool)
    new[1:] = packed[1:] != packed[:-1]
    values = keys[at[new]]
    inverse = np.empty(len(keys), np.int64)
    inverse[at] = np.cumsum(new) - 1
    if low > 0 and not np.array_equal(values[inverse], keys):
        return np.unique(keys, return_inverse=True)
    return values, inverse


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def _bits(tokens: float, each: int) -> int:
    return max(0, math.ceil(math.log2(max(1.0, tokens / each))))


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _pair_bucket(u: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    return _top(mix64(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(w.astype(np.uint64) + np.uint64(1))), bits)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal buckets in a sorted array."""
    if len(bucket):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(bucket[a]), slice(int(a), int(b))


def _messages(rows: Iterable[tuple[int, int, str, bytes]], limit: int = 64) -> Iterator[pa.RecordBatch]:
    """(b, src, kind, data) rows as batches."""
    held: list = []
    types = (pa.int32(), pa.int64(), pa.string(), pa.binary())

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["b", "src", "kind", "data"])

    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield batch()
            held = []
    if held:
        yield batch()


def _gathered(found: DataFrame, by: str, step) -> DataFrame:
    """step(bucket, rows) -> rows for all rows of a bucket; both are (b, src, kind, data)."""

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part["src"].to_pylist(), part["kind"].to_pylist(), part["b"].to_pylist(), part["data"].to_pylist(), strict=True), key=lambda r: (r[1], r[0], r[2]))
        key = part[by][0].as_py()
        out = list(_messages(step(key, [(b, src, kind, data) for src, kind, b, data in rows]), 1 << 30))
        del rows
        trim()
        return pa.Table.from_batches(out) if out else pa.table({"b": pa.array([], pa.int32()), "src": pa.array([], pa.int64()), "kind": pa.array([], pa.string()), "data": pa.array([], pa.binary())})

    return found.groupBy(by).applyInArrow(run, MESSAGE)


def _mapped(found: DataFrame, step) -> DataFrame:
    """step(b, src, kind, data) -> rows, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _messages(out for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) for out in step(*row))

    return found.select("b", "src", "kind", "data").mapInArrow(run, MESSAGE)


# ---------------------------------------------------------------- numbers of tables


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


@lru_cache(maxsize=4)
def log_seatings(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the weights of all seatings of c customers at t tables, [c, t]; a table of n has (1-d)(2-d)..(n-1-d)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + out[c]
            out[c + 1] = np.logaddexp(np.concatenate([[-np.inf], out[c, :-1]]), stay)
    return out


def draw_tables(c: np.ndarray, lam: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with c customers, each seating weighing lam to the number of tables (and see log_seatings)."""
    out = np.ones(len(c), np.int64)
    out[c == 0] = 0
    two = np.flatnonzero(c == 2)
    out[two] += rng.random(len(two)) * (lam[two] + (1 - d)) < lam[two]
    some = np.flatnonzero((c > 2) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    weights = log_seatings(d) if len(some) else None
    for n, part in _cuts(c[some]):
        t = np.arange(1, n + 1)[:, None]
        for at in range(part.start, part.stop, max(1, 1_000_000 // n)):
            rows = some[at : min(part.stop, at + max(1, 1_000_000 // n))]
            w = weights[n, 1 : n + 1, None] + np.log(lam[rows]) * t
            w -= w.max(0)
            w = np.cumsum(np.exp(w, out=w), axis=0, out=w)
            out[rows] = 1 + (w < rng.random(len(rows)) * w[-1]).sum(0)
    rows = np.flatnonzero(c > EXACT)
    if len(rows):
        n, mu = c[rows].astype(float), lam[rows] / d
        # x with mu x G'(x) = n for G(x) = 1 - (1 - x)^d; y = 1 - x by bisection of its logarithm
        low, high = np.full(len(n), -700.0), np.zeros(len(n))
        for _ in range(80):
            y = (low + high) / 2
            more = np.log(mu * d) + np.log(-np.expm1(y)) + (d - 1) * y > np.log(n)
            low, high = np.where(more, y, low), np.where(more, high, y)
        y = np.exp((low + high) / 2)
        mean = mu * -np.expm1(d * np.log(y))
        spread = n + mu * (1 - y) ** 2 * d * (1 - d) * y ** (d - 2)
        sd = np.sqrt(np.maximum(mean - n * n / spread, 0))
        out[rows] = np.clip(np.rint(mean + sd * rng.standard_normal(len(n))), 1, n).astype(np.int64)
    return out


def grid_weights(t: np.ndarray, c: np.ndarray, d: float) -> np.ndarray:
    """For each concentration of GRID the log probability of restaurants with t tables and c customers, as far as it depends on it."""
    some = t > 0
    both, number = np.unique(t[some] + c[some] * (1 << 31), return_counts=True)  # no restaurant has so many tables in one bucket's memory
    t, c = (both % (1 << 31)).astype(float), (both >> 31).astype(float)
    return np.array([(number * (lgamma(g / d + t) - math.lgamma(g / d) - lgamma(g + c) + math.lgamma(g))).sum() for g in GRID])


def draw_concentration(weights: np.ndarray, rng: random.Random) -> float:
    """A concentration by its grid weights and a prior of one over it, 1e6 at most."""
    w = np.exp(weights - weights.max())
    return float(GRID[min(len(GRID) - 1, int(np.searchsorted(np.cumsum(w), rng.random() * w.sum())))])


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))


# ---------------------------------------------------------------- slices of the corpus


def _slices(docs: DataFrame, held_out: Column, word_bits: int) -> DataFrame:
    """Slices: documents and the stream of their tokens, as places in the slice's distinct words (by hash), with training counts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lens, hashes, size, number = [], [], [], [], 0, 0

        def emit() -> pa.RecordBatch:
            tokens, lengths = np.concatenate(hashes), np.array(lens, np.int64)
            words, stream = distinct(np.append(tokens, BEGIN), 64)
            trains = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(stream[:-1][trains], minlength=len(words))
            counts[stream[-1]] = len(held) - sum(held)  # documents begun
            data = pack(words, counts.astype(np.int64), stream[:-1].astype(np.uint32))
            key = TaskContext.get().partitionId() << 32 | number
            return pa.record_batch([pa.array([key], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([lens], pa.list_(pa.int32())), pa.array([data], pa.binary())], names=["src", "ids", "held", "lens", "data"])

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            id_type = batch.schema.field("doc_id").type
            texts = batch_texts(batch.column("text"))
            all_ids, all_held = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            for a, b in slices(np.array([len(t) for t in texts]), CHUNK_BYTES):
                data, at = joined(texts[a:b])
                low = data.copy()
                low[(data >= 65) & (data <= 90)] += 32
                starts, ends = word_spans(low, blank_table())
                per = np.diff(np.searchsorted(starts, at))
                out = np.full(len(starts) + b - a, END)
                own = np.ones(len(out), bool)
                own[np.cumsum(per + 1) - 1] = False
                out[own] = range_hashes(low, starts, ends)
                hashes.append(out)
                ids += all_ids[a:b]
                held += all_held[a:b]
                lens += (per + 1).tolist()
                size += len(out)
                if size >= SLICE_TOKENS:
                    yield emit()
                    ids, held, lens, hashes, size, number = [], [], [], [], 0, number + 1
                    trim()
        if ids:
            yield emit()

    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    return rows.mapInArrow(run, f"src long, ids array<{kind}>, held array<boolean>, lens array<int>, data binary")


def _word_step(bits: int):
    """Distinct words of a bucket with their training counts, and each slice's places and counts in return."""

    def step(b: int, rows: list) -> Iterator[tuple]:
        parts = [unpack(data) for *_, data in rows]
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        tokens = counts[words != BEGIN]
        yield b, 0, "words", pack(words, counts, np.array([tokens.sum(), (tokens > 0).sum()], np.int64))
        done = 0
        for (_, src, _, _), (own, _) in zip(rows, parts, strict=True):
            here = at[done : done + len(own)]
            done += len(own)
            yield b, src, "places", pack((b << PLACE_BITS) + here, counts[here])

    return step


class _Slice:
    """A slice whose words have numbers: its stream, contexts and distinct pairs in order of their bucket."""

    def __init__(self, data: bytes, lens: list[int], held: list[bool], bits: int):
        self.numbers, self.counts, stream, begin = unpack(data)
        self.stream, n = stream.astype(np.int64), len(self.numbers)
        self.lens = np.array(lens, np.int64)
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[np.cumsum(self.lens) - self.lens] = begin[0]
        pairs, self.pair = distinct(before * n + self.stream, 2 * n.bit_length())
        u, w = pairs // n, pairs % n
        bucket = _pair_bucket(self.numbers[u], self.numbers[w], bits)
        order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pair, self.u, self.w, self.bucket = place[self.pair], u[order], w[order], bucket[order]
        self.trains = np.repeat(~np.array(held, bool), self.lens)


# ---------------------------------------------------------------- sweeps


def _pairs_step(word_bits: int, ask: bool):
    """The distinct training pairs of a bucket: those seen once as sums by word, others as state; and what each word's bucket gets."""

    def step(b: int, rows: list) -> Iterator[tuple]:
        parts = [unpack(data) for *_, data in rows]
        u, w, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts, rows
        words, at = distinct(np.concatenate([u, w]), PLACE_BITS + word_bits)
        keys, at = distinct(at[: len(u)] * len(words) + at[len(u) :], 2 * len(words).bit_length())
        c = np.bincount(at, c, len(keys)).astype(np.int64)
        iu, iw = keys // len(words), keys % len(words)
        u, w, once = words[iu], words[iw], c == 1
        tables1, dishes1 = np.bincount(iu[once], minlength=len(words)), np.bincount(iw[once], minlength=len(words))
        tables2, dishes2 = np.bincount(iu[~once], minlength=len(words)), np.bincount(iw[~once], minlength=len(words))
        asks = tables2 + dishes2 > 0
        rank = np.cumsum(asks) - 1
        yield b, 0, "pairs", pack(u, w, c, rank[iu[~once]], rank[iw[~once]], np.array([once.sum(), (c == 2).sum()], np.int64))
        bucket = words >> PLACE_BITS
        for to, part in _cuts(bucket):
            mine = asks[part]
            place = words[part] & ((1 << PLACE_BITS) - 1)
            yield to, b, "once", pack(place, tables1[part], dishes1[part], place[mine], tables2[part][mine], dishes2[part][mine])

    return step


def _static_step(b: int, rows: list) -> Iterator[tuple]:
    """A word bucket: counts, what pairs seen once add, and the places that each pair bucket asks for (with the tables of the start)."""
    n = next(len(unpack(data)[0]) for _, _, kind, data in rows if kind == "words")
    counts = next(unpack(data)[1] for _, _, kind, data in rows if kind == "words")
    tables, dishes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for _, src, kind, data in rows:
        if kind == "once":
            place, t1, d1, asked, t2, d2 = unpack(data)
            tables[place] += t1
            dishes[place] += d1
            yield b, src, "asked", pack(asked)
            yield b, src, "sums", pack(t2, d2)
    yield b, 0, "static", pack(counts, tables, dishes)


def _parent_step(sweep: int, lam0: float, d: float, d0: float, keep: bool):
    """Tables of each restaurant, customers and tables of the parent's dishes, and sums for the driver."""

    def step(b: int, rows: list) -> Iterator[tuple]:
        by: dict[tuple[str, int], bytes] = {(kind, src): data for _, src, kind, data in rows}
        counts, tables, dishes = unpack(by["static", 0])
        for (kind, src), data in by.items():
            if kind == "sums":
                (asked,), (t, k) = unpack(by["asked", src]), unpack(data)
                tables[asked] += t
                dishes[asked] += k
        # single tables and dishes that are left out of the sums are in the static part
        drawn = draw_tables(dishes, np.full(len(dishes), lam0), d0, np.random.default_rng([sweep, b, 1]))
        sums = np.array([drawn.sum(), dishes.sum(), (dishes == 1).sum(), (dishes == 2).sum()], np.int64)
        yield b, sweep, "parent", pack(tables, dishes, drawn, sums, grid_weights(tables, counts, d))

    return step


def _reply_step(sweep: int, theta: float, d: float, parent: tuple):
    """To each pair bucket the product of discount, gamma variable and so on of what it asks for."""

    def step(b: int, rows: list) -> Iterator[tuple]:
        by = {(kind, src): data for _, src, kind, data in rows}
        tables, dishes, drawn, *_ = unpack(by["parent", sweep])
        gamma = np.where(tables > 0, np.random.default_rng([sweep, b, 2]).standard_gamma(theta / d + np.maximum(tables, 1e-9)), 0.0)
        p = parent_probability(dishes, drawn, parent)
        for (kind, src), data in by.items():
            if kind == "asked":
                (asked,) = unpack(data)
                yield src, b, "reply", pack(d * gamma[asked], p[asked])

    return step


def _seat_step(sweep: int, d: float, word_bits: int):
    """New tables of all pairs of a bucket seen twice or more, and their sums by word."""

    def step(b: int, rows: list) -> Iterator[tuple]:
        replies = [unpack(data) for _, _, kind, data in rows if kind == "reply"]  # in order of the word bucket, so of the words' numbers
        asked_by = [src for _, src, kind, _ in rows if kind == "reply"]
        u, w, c, iu, iw, _ = unpack(next(data for _, _, kind, data in rows if kind == "pairs"))
        if not replies:
            yield b, sweep, "tables", pack(np.empty(0, np.uint32))
            return
        gamma, p = (np.concatenate([r[i] for r in replies]) for i in (0, 1))
        t = draw_tables(c[c > 1], np.maximum(gamma[iu] * p[iw], 1e-300), d, np.random.default_rng([sweep, b, 3]))
        yield b, sweep, "tables", pack(t.astype(np.uint32))
        tables, dishes = np.bincount(iu, t, len(p)).astype(np.int64), np.bincount(iw, t, len(p)).astype(np.int64)
        done = 0
        for to, reply in zip(asked_by, replies, strict=True):
            part = slice(done, done + len(reply[0]))
            done = part.stop
            yield to, b, "sums", pack(tables[part], dishes[part])

    return step


def parent_probability(dishes: np.ndarray, drawn: np.ndarray, parent: tuple) -> np.ndarray:
    """Of words with so many customers and tables in the parent, whose (concentration, discount, tables, customers, known words) are given."""
    theta, d, tables, customers, known = parent
    return (dishes - d * drawn + (theta + d * tables) / (known + 1)) / (theta + customers)


# ---------------------------------------------------------------- scores


def score(docs: DataFrame, held_out: Column, seed: int = 0) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; what is held out is not learned from."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    _, size = text_bytes(docs)
    word_bits, pair_bits = _bits(size / 6, WORD_TOKENS), _bits(size / 6, PAIR_TOKENS)
    raw = table(_slices(docs, held_out, word_bits), "slices")

    def ask_words(b: int, src: int, kind: str, data: bytes) -> Iterator[tuple]:
        words, counts, _ = unpack(data)
        for to, part in _cuts(_top(words, word_bits)):
            yield to, src, "ask", pack(words[part], counts[part])

    as_rows = raw.select(F.lit(0).alias("b"), "src", F.lit("slice").alias("kind"), "data")
    words = table(_gathered(_mapped(as_rows, ask_words), "b", _word_step(word_bits)), "words")
    release(spark)
    total, known = _total(words, "words", -1, 2)

    def numbered(src: int, rows: list) -> Iterator[tuple]:
        hashes, _, stream = unpack(next(data for _, _, kind, data in rows if kind == "slice"))
        places = [unpack(data) for _, _, kind, data in rows if kind == "places"]
        yield 0, src, "slice", pack(np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places]), stream, np.searchsorted(hashes, np.array([BEGIN])))

    found = _gathered(as_rows.unionByName(words.where("kind = 'places'")), "src", numbered).select("src", "data")
    sliced = table(raw.drop("data").join(found, "src"), "numbered")
    words = _replaced(words, words.where("kind = 'words'"), "words")
    drop_table(raw)
    release(spark)

    # training pairs
    def train_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for src, lens, held, s in _each_slice(batches, pair_bits):
                counts = np.bincount(s.pair[s.trains], minlength=len(s.u))
                seen = np.flatnonzero(counts)
                for to, part in _cuts(s.bucket[seen]):
                    at = seen[part]
                    yield to, src, "pairs", pack(s.numbers[s.u[at]], s.numbers[s.w[at]], counts[at].astype(np.uint32))

        yield from _messages(rows(), 16)

    counted = table(_gathered(sliced.select("src", "lens", "held", "data").mapInArrow(train_pairs, MESSAGE), "b", _pairs_step(word_bits, True)), "counted")
    release(spark)
    ones, twos = _total(counted.where("kind = 'pairs'"), "pairs", -1, 2)
    d = discount(ones, twos)
    static = table(_gathered(words.unionByName(counted.where("kind = 'once'")), "b", _static_step), "static")
    pairs = counted.where("kind = 'pairs'")
    release(spark)

    # sweeps
    rng = random.Random(seed)
    fixed, sums = static.where("kind <> 'sums'"), static.where("kind = 'sums'")
    d0, theta, theta0, tables0 = 0.5, 1.0, 1.0, max(1, known)
    kept_parents, kept_tables, scalars, old = [], [], [], None
    for sweep in range(BURN_IN + KEPT + 1):
        lam0 = d0 * rng.gammavariate(theta0 / d0 + tables0, 1.0) / (known + 1)
        parents = table(_gathered(fixed.unionByName(sums), "b", _parent_step(sweep, lam0, d, d0, True)), "parents")
        tables0, customers, k1, k2 = _total(parents, "parent", 3, 4)
        weights = np.array(_total(parents, "parent", 4, len(GRID), "double"))
        theta = draw_concentration(weights, rng)
        own = np.array([math.lgamma(g / d0 + tables0) - math.lgamma(g / d0) - math.lgamma(g + customers) + math.lgamma(g) for g in GRID]) if tables0 else np.zeros(len(GRID))
        theta0 = draw_concentration(own, rng)
        parent = (theta0, d0, tables0, customers, known)
        if sweep > BURN_IN:  # this parent belongs to the tables that were kept with the last sweep
            kept_parents.append(parents)
            scalars.append((theta, d, parent))
        if old is not None:
            drop_table(old)
            old = None
        if sweep == BURN_IN + KEPT:
            break
        replies = _gathered(fixed.where("kind = 'asked'").unionByName(parents), "b", _reply_step(sweep, theta, d, parent))
        seated = table(_gathered(pairs.unionByName(replies), "b", _seat_step(sweep, d, word_bits)), "seated")
        sums = seated.where("kind = 'sums'")
        if sweep >= BURN_IN:
            kept_tables.append(seated)
        else:
            old = seated
        if sweep <= BURN_IN:
            drop_table(parents)
        d0 = discount(k1, k2)
        release(spark)

    # what each slice asks for, answered by word and by pair
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for src, lens, held, s in _each_slice(batches, pair_bits):
                for to, part in _cuts(s.numbers >> PLACE_BITS):
                    yield to, src, "word", pack(s.numbers[part] & ((1 << PLACE_BITS) - 1))
                for to, part in _cuts(s.bucket):
                    yield to, src, "pair", pack(s.numbers[s.u[part]], s.numbers[s.w[part]])

        yield from _messages(rows(), 16)

    def answer_words(b: int, rows: list) -> Iterator[tuple]:
        state = [unpack(data) for _, _, kind, data in rows if kind == "parent"]
        p = [parent_probability(s[1], s[2], x[2]) for s, x in zip(state, scalars, strict=True)]
        for _, src, kind, data in rows:
            if kind == "word":
                (at,) = unpack(data)
                yield b, src, "word", pack(*[s[0][at] for s in state], *[x[at] for x in p])

    def answer_pairs(b: int, rows: list) -> Iterator[tuple]:
        state = next((unpack(data) for _, _, kind, data in rows if kind == "pairs"), None)
        drawn = [unpack(data)[0] for _, _, kind, data in rows if kind == "tables"]
        if state is not None:
            u, w, c = state[:3]
            tables = [np.ones(len(c), np.int64) for _ in drawn]
            for t, x in zip(tables, drawn, strict=True):
                t[c > 1] = x
            words = np.unique(u)
            first = np.searchsorted(u, words)
            key = np.searchsorted(words, u) * np.int64(1 << 31) + _dense(w)[0]
            spread = _dense(w)[1]
        while rows:
            _, src, kind, data = rows.pop()
            if kind == "pair":
                own_u, own_w = unpack(data)
                n = np.zeros(len(own_u), np.int64)
                t = [np.zeros(len(own_u), np.int64) for _ in range(KEPT)]
                if state is not None and len(u):
                    iu = np.minimum(np.searchsorted(words, own_u), len(words) - 1)
                    iw = np.minimum(np.searchsorted(spread, own_w), len(spread) - 1)
                    hit = (words[iu] == own_u) & (spread[iw] == own_w)
                    at = np.minimum(np.searchsorted(key, iu * np.int64(1 << 31) + iw), len(key) - 1)
                    hit &= (u[at] == own_u) & (w[at] == own_w)
                    n[hit] = c[at[hit]]
                    for mine, x in zip(t, tables, strict=True):
                        mine[hit] = x[at[hit]]
                yield b, src, "pair", pack(n, *t)

    asks = sliced.select("src", "lens", "held", "data").mapInArrow(ask, MESSAGE)
    parents = kept_parents[0]
    for x in kept_parents[1:]:
        parents = parents.unionByName(x)
    tables = kept_tables[0]
    for x in kept_tables[1:]:
        tables = tables.unionByName(x)
    of_words = table(_gathered(parents.unionByName(asks.where("kind = 'word'")), "b", answer_words), "of_words")
    release(spark)
    of_pairs = table(_gathered(pairs.unionByName(tables.where("kind = 'tables'")).unionByName(asks.where("kind = 'pair'")), "b", answer_pairs), "of_pairs")
    for x in [*kept_parents, *kept_tables, static, counted, words]:
        drop_table(x)
    release(spark)

    def scored(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        own = next(r for r in rows if r["kind"] == "slice")
        s = _Slice(own["data"], own["lens"], own["held"], pair_bits)
        answers = {kind: [unpack(r["data"]) for r in sorted(rows, key=lambda r: r["b"]) if r["kind"] == kind] for kind in ("word", "pair")}
        del rows
        by_word, by_pair = ([np.concatenate(x) for x in zip(*answers[kind], strict=True)] for kind in ("word", "pair"))
        context, c = s.counts[s.u], by_pair[0]
        p = np.zeros(len(c))
        for i, (theta, d, _) in enumerate(scalars):
            tables, parent, own_tables = by_word[i][s.u], by_word[KEPT + i][s.w], by_pair[1 + i]
            p += np.where(context > 0, (c - d * own_tables + (theta + d * tables) * parent) / (theta + np.maximum(context, 1)), parent)
        logs = np.log10(p / len(scalars))[s.pair]
        base = np.log10((s.counts + 1) / (total + known + 1))[s.stream]
        at = np.cumsum(s.lens) - s.lens
        ids = own["ids"]
        return pa.table(
            {
                "doc_id": pa.array(ids, part.schema.field("ids").type.value_type),
                "held_out": pa.array(own["held"], pa.bool_()),
                "n_tokens": s.lens,
                "n_known": np.add.reduceat((s.counts > 0)[s.stream].astype(np.int64), at),
                "train_tokens": np.full(len(ids), total),
                "base_score": np.add.reduceat(base, at),
                "score": np.add.reduceat(logs, at),
            }
        )

    plain = sliced.select(F.lit(0).alias("b"), "src", F.lit("slice").alias("kind"), "data", "ids", "held", "lens")
    answers = of_words.unionByName(of_pairs)
    return plain.unionByName(answers, allowMissingColumns=True).groupBy("src").applyInArrow(scored, schema)


def _dense(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of w among its distinct values, and these."""
    values, at = np.unique(w, return_inverse=True)
    return at, values


def _each_slice(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    for batch in batches:
        for src, lens, held, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            yield src, lens, held, _Slice(data, lens, held, bits)


def _sums_of(kind: str, which: int, of: str = "long"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpack(data)[which].tolist() for data in batch.column(3).to_pylist()]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int64() if of == "long" else pa.float64()))], names=["v"])

    return run


def _total(found: DataFrame, kind: str, which: int, n: int, of: str = "long") -> list:
    """The sums of an array of n numbers that every bucket's row holds."""
    rows = found.where(F.col("kind") == kind).select("b", "src", "kind", "data").mapInArrow(_sums_of(kind, which, of), f"v array<{of}>")
    row = rows.agg(*[F.coalesce(F.sum(F.col("v")[i]), F.lit(0)).alias(f"s{i}") for i in range(n)]).first()
    return list(row)


def _replaced(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    out = table(new, name)
    drop_table(old)
    return out
