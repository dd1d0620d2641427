"""Token-id files by an adaptive context-mixing range coder.

The ids of all documents, in ascending doc_id order, are cut into blocks of BLOCK ids. Every block starts from an empty model and has a
checksum of its own, so each can be decoded, and damage found, without any other. Within a block, the ids that followed the last one
and the last two ids before are predictions of order 1 and 2; the chance that the better one is right is mixed, in the logistic domain
and with weights that follow the errors, from what their confidences and the order-0 record of recent hits say. A range coder codes the
hit with that chance; after a miss it codes the id itself, nibble by nibble, by adaptive order-0 frequencies. All arithmetic is on whole
numbers. One block after another would be slow in Python; here all blocks of a file advance in step, as lanes of numpy arrays.

A file holds whole documents of one range of ids: a header with the ids and lengths of its documents and the sizes and checksums of
its blocks, then the coded words. Names follow from the task's number, so a repeated task replaces its own files.

Defined cases: a null or empty text has the end id alone; a null doc_id comes last; rows with one doc_id are separate documents, in the
order of their texts; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, batch_texts, partitions_for, shared_dir, slices, text_bytes, write_file

#: Ids in a block, ids in a file (rounded up to whole documents), UTF-8 bytes for one writing task.
BLOCK, FILE_TOKENS, TASK_BYTES = 4096, 8 << 20, 20 << 20
_MAGIC = b"FFTOKEN1"
_HEAD = struct.Struct("<8sQQIII")

# ---------------------------------------------------------------- text to ids

#: Blanks beyond ASCII (and the separators 1C-1F) by which the tokenizer's pattern may also cut.
_OTHER_BLANKS = "[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"
_CACHE_PIECES, _LEARN = 400_000, 20_000


def _table(*kinds: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for k, which in enumerate(kinds, 1):
        out[list(which)] = k
    return out


_LETTERS, _DIGITS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Lead bytes C3 to C8 and what follows them are Latin letters (but for the signs C3 97 and C3 B7).
_LATIN = bytes([*range(0x80, 0xC0), *range(0xC3, 0xC9)])
_HELD = bytes([39, *(set(range(128, 256)) - {*_LATIN})])
_SIGNS = bytes(set(range(128)) - {*_LETTERS, *_DIGITS, *_HELD, *BLANKS})
#: Kinds of bytes: 0 blanks, 1 letters, 2 digits, 3 other ASCII, 4 what keeps its word in one piece.
_KIND = _table(_LETTERS + _LATIN, _DIGITS, _SIGNS, _HELD)
#: Bytes with which any of _OTHER_BLANKS begins in UTF-8.
_MAY_BE_BLANK = _table(bytes({c.encode()[0] for c in _OTHER_BLANKS[1:-1]})) > 0

#: Letters, digits or signs after at most one space: what the tokenizer's pattern never cuts.
_SIMPLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8][\x80-\xBF])+|[0-9]+|[!-&(-/:-@[-`{-~]+)").fullmatch
#: The character by which a byte-level tokenizer writes a byte that is not printable.
_BYTE_CHARS = dict(zip([*range(33), *range(127, 161), 173], range(256, 324)))


def cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that start at `starts`: at blanks after a word, and where letters, digits and signs meet in it.

    A piece takes along the blanks before it. Words with an apostrophe or a character beyond ASCII but Latin letters are one piece.
    """
    kind = _KIND.take(data)
    begins = np.zeros(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
    begins[1:-1] &= kind[:-1] != 0
    begins[starts] = True
    begins[-1] = False
    signs = np.flatnonzero(data == 0xC3)
    follows = data.take(np.minimum(signs + 1, len(data) - 1))
    kind[signs[(follows == 0x97) | (follows == 0xB7)]] = 4
    held = np.flatnonzero(kind == 4)
    at = np.flatnonzero(begins)
    if len(held):
        fixed = kind.take(at) == 0
        fixed[np.searchsorted(at, starts[starts < len(data)])] = True
        word = np.cumsum(fixed) - 1
        whole = np.zeros(len(at), bool)
        whole[word[np.searchsorted(at, held, "right") - 1]] = True
        at = at[fixed | ~whole[word]]
    return at


class Encoder:
    """Encodes whole texts with a tokenizer file of the tokenizers library.

    A byte-level tokenizer that cuts texts by its usual pattern never joins what stands before a run of ASCII blanks with what follows,
    nor letters with digits or other signs but apostrophes, so each distinct piece (see cut) is encoded once and remembered: pieces that
    its pattern leaves whole by the tokenizer's model alone. Texts with other blanks or special tokens, and all texts under any other
    kind of tokenizer, are encoded in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.piecewise = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer")
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.whole = re.compile("|".join([_OTHER_BLANKS, *map(re.escape, self.special)]))
        self.largest = self.tokenizer.get_vocab_size() - 1
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at, self.length = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = 0

    def _keep(self, pieces: list[bytes]) -> None:
        """Forgets all known pieces but these."""
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        flat, at, sizes = self.flat, self.at[which], self.length[which]
        self._forget()
        self._add(pieces, flat[np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes)

    def _add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(self.known) + len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while m > len(self.at):
            self.at, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n:m] = self.used + np.cumsum(sizes) - sizes
        self.length[n:m] = sizes
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, m)))

    def _learn(self, pieces: list[bytes]) -> None:
        simple, others = [], []
        for p in pieces:
            (simple if _SIMPLE(p) else others).append(p)
        tokenize = self.model.tokenize
        for part in (simple, others):
            for a in range(0, len(part), _LEARN):
                some = part[a : a + _LEARN]
                if part is simple:
                    found = [[t.id for t in tokenize(p.decode("latin-1").translate(_BYTE_CHARS))] for p in some]
                else:
                    found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
                self._add(some, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=starts[1:])
        data = b"".join(texts)
        if not data:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        at = cut(np.frombuffer(data, np.uint8), starts)
        column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        distinct, index = column.dictionary.to_pylist(), np.asarray(column.indices)
        missing = [p for p in distinct if p not in self.known]
        if missing and len(self.known) + len(missing) > _CACHE_PIECES and self.known:
            self._keep([p for p in distinct if p in self.known])
        if missing:
            self._learn(missing)
        which = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        sizes = self.length[which].take(index)
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        from_here = np.repeat(self.at[which].take(index) - ends[:-1], sizes)
        from_here += np.arange(len(from_here))
        return self.flat.take(from_here), np.diff(ends[np.searchsorted(at, starts)])

    def _in_pieces(self, text: bytes) -> bool:
        if not self.piecewise:
            return False
        if any(t.encode() in text for t in self.special):
            return False
        return not (_MAY_BE_BLANK.take(np.frombuffer(text, np.uint8)).any() and self.whole.search(text.decode()))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id after each text, and the number of ids of each text."""
        plain = [self._in_pieces(t) for t in texts]
        ids, sizes = self._pieces([t for t, p in zip(texts, plain) if p])
        others = iter([e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t, p in zip(texts, plain) if not p], add_special_tokens=False)])
        lengths = np.empty(len(texts), np.int64)
        lengths[np.array(plain, bool)] = sizes
        odd = {i: np.array(next(others), np.uint32) for i, p in enumerate(plain) if not p}
        for i, x in odd.items():
            lengths[i] = len(x)
        if odd:
            parts, at, k = [], np.concatenate([[0], np.cumsum(sizes)]), 0
            for i, p in enumerate(plain):
                parts.append(ids[at[k] : at[k + 1]] if p else odd[i])
                k += p
            ids = np.concatenate(parts).astype(np.uint32)
        out = np.full(len(ids) + len(texts), end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), lengths)] = ids
        return out, lengths + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


# ---------------------------------------------------------------- the coder

_U = np.uint64
_TOP, _LOW32 = _U(1 << 48), _U((1 << 32) - 1)
_TOTAL_BITS = 15
_TOTAL = 1 << _TOTAL_BITS
_SLOTS1, _SLOTS2 = 10, 11
_RATE = 4
#: A row of 16 bounds as one item.
_ROW = np.dtype("V32")


def _logistic_tables() -> tuple[np.ndarray, np.ndarray]:
    stretch = [round(256 * math.log((2 * p + 1) / (8191 - 2 * p))) for p in range(4096)]
    squash = [min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)]
    return np.array(stretch, np.int32), np.array(squash, np.int32)


_STRETCH, _SQUASH = _logistic_tables()
#: A guess's confidence after a miss and after a hit; below 2 the guess itself gives way to the id that came.
_GROWN = np.array([x for k in range(8) for x in (max(k >> 1, k < 2), min(k + 1, 7))], np.int32)
#: For each nibble the lower bounds that its frequencies move towards; none ever gets empty.
_TARGET = (np.arange(16) + (np.arange(16) > np.arange(16)[:, None]) * (_TOTAL - 16)).astype(np.int16)


class _Lanes:
    """Models and range coders of `n` blocks that advance in step."""

    def __init__(self, n: int, nibbles: int):
        self.n, self.nibbles = n, nibbles
        self.low, self.range = np.zeros(n, _U), np.full(n, 0xFFFFFFFFFFFFFFFF, _U)
        # the id that followed a context last, times 8, plus its confidence: one word, so one memory access
        self.t1, self.t2 = np.zeros(n << _SLOTS1, np.int32), np.zeros(n << _SLOTS2, np.int32)
        lane = np.arange(n, dtype=np.int64)
        self.base1, self.base2 = lane << _SLOTS1, lane << _SLOTS2
        # contexts of the three chances: confidence 2 with how the guesses relate, confidence 1, recent hits; 64 in all
        start = np.concatenate([np.minimum(60000, 2000 + 700 * (8 * (np.arange(24) // 3) + np.arange(24) % 3)), 2000 + 4000 * (np.arange(16) // 2), np.full(24, 12000)])
        self.chance = np.tile(start.astype(np.int32), n)
        self.width = lane * 64 + np.array([[0], [24], [40]])
        self.weight = np.full((3, n), 26000, np.int32)
        self.history = np.zeros(n, np.int32)
        self.last, self.before = np.zeros(n, np.int32), np.zeros(n, np.int32)
        contexts = 1 + 16 + 256 + 16 * (nibbles - 3)
        self.bounds = np.tile((np.arange(16) * (_TOTAL // 16)).astype(np.int16), (n * contexts, 1))
        self.whole_rows = self.bounds.view(_ROW).ravel()
        self.base0 = lane * contexts
        self.first = np.arange(n * nibbles) * 16

    def shrink(self, n: int) -> None:
        """Goes on with the first n lanes only."""
        self.n = n
        for name in ("low", "range", "base0", "base1", "base2", "history", "last", "before"):
            setattr(self, name, getattr(self, name)[:n])
        self.width, self.weight = self.width[:, :n], self.weight[:, :n]

    def predict(self) -> None:
        a = self.last * np.int32(0x1E3779B1)
        self.s1 = self.base1 + ((a >> 13) & ((1 << _SLOTS1) - 1))
        self.s2 = self.base2 + (((a + self.before * np.int32(0x05EBCA6B)) >> 14) & ((1 << _SLOTS2) - 1))
        v1, v2 = self.t1.take(self.s1), self.t2.take(self.s2)
        self.v1, self.v2, self.q1, self.k1, self.q2, self.k2 = v1, v2, v1 >> 3, v1 & 7, v2 >> 3, v2 & 7
        sure = self.k2 > 0
        self.guess = self.q1.copy()
        np.putmask(self.guess, sure, self.q2)
        relation = (self.q1 == self.q2).view(np.int8) + np.int8(1)
        relation *= self.k1 > 0
        self.at = np.empty((3, self.n), np.int64)
        np.add(self.k2 * np.int32(3), relation, out=self.at[0])
        np.add(self.k1 * np.int32(2), sure, out=self.at[1])
        self.at[2] = self.history
        self.at += self.width
        self.drawn = self.chance.take(self.at)
        self.stretched = _STRETCH.take(self.drawn >> 4)
        weighed = self.weight * self.stretched
        mixed = weighed[0] + weighed[1]
        mixed += weighed[2]
        mixed >>= 16
        np.maximum(mixed, -2047, out=mixed)
        np.minimum(mixed, 2047, out=mixed)
        mixed += 2048
        self.p = _SQUASH.take(mixed)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        hit = hit.astype(np.int32)
        error = hit << 12
        error -= self.p
        error *= 6
        moved = hit * np.int32(65535) - self.drawn
        moved >>= _RATE
        moved += self.drawn
        self.chance[self.at] = moved
        step = self.stretched * error
        step += 0x2000
        step >>= 14
        self.weight += step
        np.minimum(self.weight, 1 << 18, out=self.weight)
        np.maximum(self.weight, -(1 << 18), out=self.weight)
        self.history = ((self.history << 1) | hit) & 15
        coming = ids.astype(np.int32) << 3
        for t, s, v, q, k in ((self.t1, self.s1, self.v1, self.q1, self.k1), (self.t2, self.s2, self.v2, self.q2, self.k2)):
            v -= k
            np.putmask(v, k < 2, coming)
            k <<= 1
            k |= q == ids
            v += _GROWN.take(k)
            t[s] = v
        self.before, self.last = self.last, ids

    def context(self, level: int, ids: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The order-0 context of a nibble: the nibbles above it, of which from the fourth on only the last."""
        if level == 0:
            return base
        above = ids >> (4 * (self.nibbles - level))
        if level == 1:
            return base + 1 + (above & 15)
        if level == 2:
            return base + 17 + (above & 255)
        return base + 273 + 16 * (level - 3) + (above & 15)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The frequencies at `at`, 16 bounds each."""
        return self.bounds.take(at, axis=0)

    def part(self, rows: np.ndarray, nib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each row's nibble's part."""
        at = self.first[: len(nib)] + nib
        flat = rows.ravel()
        start = flat.take(at)
        at += 1
        size = flat.take(at, mode="wrap")  # every row begins with 0, which stands for _TOTAL after the last nibble
        size -= start
        size &= _TOTAL - 1
        return start.astype(_U), size.astype(_U)

    def count(self, at: np.ndarray, rows: np.ndarray, nib: np.ndarray) -> None:
        moved = _TARGET.take(nib, axis=0)
        moved -= rows
        moved >>= _RATE
        moved += rows
        self.whole_rows[at] = moved.view(_ROW).ravel()  # as one item a row: far fewer steps than 16


def _narrow(low: np.ndarray, rng: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int, shift) -> None:
    """Takes, in place, the part [start, start + size) of 2**bits of the ranges; shift(places, low) moves settled words out or in."""
    rng >>= _U(bits)
    start *= rng
    low += start
    rng *= size
    apart = low + rng
    apart ^= low
    settled = apart < _TOP
    settled |= rng <= _LOW32
    todo = settled.nonzero()[0]
    while len(todo):
        lo, r = low.take(todo), rng.take(todo)
        settled = apart.take(todo) < _TOP
        if not settled.all():
            r = np.where(settled, r, (_U(0) - lo) & _LOW32)
        shift(todo, lo)
        lo <<= _U(16)
        r <<= _U(16)
        low[todo], rng[todo] = lo, r
        again = lo + r
        again ^= lo
        more = again < _TOP
        more |= r <= _LOW32
        if not more.any():
            break
        apart[todo] = again
        todo = todo[more]


def _hit_part(p: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size, of 65536, of a hit's or a miss's part at a chance of p / 4096."""
    chance = p.astype(_U)
    chance <<= _U(4)
    size = _U(65536) - chance
    np.putmask(size, hit, chance)
    np.putmask(chance, hit, _U(0))
    return chance, size


def encode_blocks(ids: np.ndarray, nibbles: int, block: int = BLOCK) -> list[np.ndarray]:
    """The coded 16-bit words of each block."""
    n = -(-len(ids) // block)
    if not n:
        return []
    grid = np.zeros((n, block), np.int32)
    grid.ravel()[: len(ids)] = ids
    steps = np.ascontiguousarray(grid.T)
    del grid
    tail = len(ids) - (n - 1) * block
    lanes = _Lanes(n, nibbles)
    # words and their lanes as they come; dealt to the lanes at the end
    words, owners = [np.empty(0, np.uint16)], [np.empty(0, np.int32)]
    gathered: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(which: np.ndarray, low: np.ndarray) -> None:
        gathered.append((which, low >> _U(48)))

    def settle() -> None:
        if gathered:
            owners.append(np.concatenate([x for x, _ in gathered]).astype(np.int32))
            words.append(np.concatenate([x for _, x in gathered]).astype(np.uint16))
            gathered.clear()

    finals = {}
    for t in range(block):
        if t == tail:
            finals[n - 1] = int(lanes.low[n - 1])
            lanes.shrink(n - 1)
            if n == 1:
                break
        ids_now = steps[t, : lanes.n]
        lanes.predict()
        hit = lanes.guess == ids_now
        _narrow(lanes.low, lanes.range, *_hit_part(lanes.p, hit), 16, emit)
        missed = (~hit).nonzero()[0]
        if m := len(missed):
            wanted, base = ids_now.take(missed), lanes.base0.take(missed)
            low, rng = lanes.low.take(missed), lanes.range.take(missed)
            # the levels have no row in common, so they are read and counted together
            at, nib = np.empty((nibbles, m), np.int64), np.empty((nibbles, m), np.int32)
            for level in range(nibbles):
                at[level] = lanes.context(level, wanted, base)
                np.right_shift(wanted, 4 * (nibbles - 1 - level), out=nib[level])
            nib &= 15
            at, nib = at.ravel(), nib.ravel()
            rows = lanes.rows(at)
            start, size = lanes.part(rows, nib)
            for k in range(0, nibbles * m, m):
                _narrow(low, rng, start[k : k + m], size[k : k + m], _TOTAL_BITS, lambda which, x: emit(missed.take(which), x))  # noqa: B023
            lanes.count(at, rows, nib)
            lanes.low[missed], lanes.range[missed] = low, rng
        lanes.learn(ids_now, hit)
        if t % 64 == 63:
            settle()
    settle()
    finals |= {i: int(x) for i, x in enumerate(lanes.low)}
    owner = np.concatenate(owners)
    order = np.argsort(owner.astype(np.uint16) if n <= 1 << 16 else owner, kind="stable")
    coded = np.concatenate(words).take(order)
    edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    ends = [np.array([(finals[i] >> s) & 0xFFFF for s in (48, 32, 16, 0)], np.uint16) for i in range(n)]
    return [np.concatenate([coded[edges[i] : edges[i + 1]], ends[i]]) for i in range(n)]


def decode_blocks(words: list[np.ndarray], total: int, nibbles: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks in order."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint32)
    tail = total - (n - 1) * block
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    stream = np.concatenate([*words, np.zeros(8, np.uint16)])
    lanes, at = _Lanes(n, nibbles), first + 4
    code = np.zeros(n, _U)
    for k in range(4):
        code = (code << _U(16)) | stream[first + k]

    def take(which: np.ndarray, code: np.ndarray, held: np.ndarray) -> None:
        """Moves a word of each lane `which` into its code, held at the places `held`."""
        here = at.take(which)
        own = code.take(held)
        own <<= _U(16)
        own |= stream.take(here, mode="clip")
        code[held] = own
        here += 1
        at[which] = here

    steps = np.zeros((block, n), np.uint32)
    for t in range(block):
        if t == tail:
            lanes.shrink(n - 1)
            if n == 1:
                break
        m = lanes.n
        lanes.predict()
        chance = lanes.p.astype(_U)
        chance <<= _U(4)
        chance *= lanes.range >> _U(16)
        hit = (code[:m] - lanes.low) < chance
        _narrow(lanes.low, lanes.range, *_hit_part(lanes.p, hit), 16, lambda which, _: take(which, code, which))
        ids = lanes.guess.copy()
        missed = (~hit).nonzero()[0]
        if len(missed):
            found, base = np.zeros(len(missed), np.int32), lanes.base0.take(missed)
            low, rng, own = lanes.low.take(missed), lanes.range.take(missed), code.take(missed)
            met = []
            for level in range(nibbles):
                # the nibbles found so far stand where those of a whole id would
                at_ctx = lanes.context(level, found << (4 * (nibbles - level)), base)
                rows = lanes.rows(at_ctx)
                value = own - low
                value //= rng >> _U(_TOTAL_BITS)
                np.minimum(value, _U(_TOTAL - 1), out=value)
                # how many bounds are not above the value, eight truth values a word
                below = np.bitwise_count((rows <= value.astype(np.int16)[:, None]).view(_U))
                nib = (below[:, 0] + below[:, 1]).astype(np.int32)
                nib -= 1
                _narrow(low, rng, *lanes.part(rows, nib), _TOTAL_BITS, lambda which, _: take(missed.take(which), own, which))  # noqa: B023
                met.append((at_ctx, rows, nib))
                found = (found << 4) | nib
            lanes.count(*map(np.concatenate, zip(*met)))
            lanes.low[missed], lanes.range[missed], code[missed] = low, rng, own
            ids[missed] = found
        lanes.learn(ids, hit)
        steps[t, :m] = ids
    return np.ascontiguousarray(steps.T).ravel()[:total]


# ---------------------------------------------------------------- files


def block_for(total: int) -> int:
    """Ids in a block of a file: BLOCK, or less where a short file would have too few lanes to fill numpy's arrays."""
    return min(BLOCK, max(256, 1 << max(0, total // 1024 - 1).bit_length()))


def pack(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nibbles: int) -> bytes:
    """One file: header, documents, blocks, and a checksum of all that."""
    block = block_for(len(ids))
    words = encode_blocks(ids, nibbles, block)
    little = ids.astype("<u4", copy=False)
    sums = np.array([zlib.crc32(little[k * block : (k + 1) * block].tobytes()) for k in range(len(words))], "<u4")
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), block, nibbles, len(words))
    head += doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u8").tobytes()
    head += np.array([len(w) for w in words], "<u4").tobytes() + sums.tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(w.astype("<u2").tobytes() for w in words)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, nulls, lengths and ids of a file; raises ValueError if any part is damaged."""
    magic, docs, total, block, nibbles, n = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("no token file")
    at = _HEAD.size
    fields = []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", n), ("<u4", n)):
        fields.append(np.frombuffer(data, kind, count, at))
        at += fields[-1].nbytes
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the header is damaged")
    doc_ids, nulls, lengths, sizes, sums = fields
    stream = np.frombuffer(data, "<u2", int(sizes.sum()), at + 4)
    edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ids = decode_blocks([stream[a:b] for a, b in zip(edges[:-1], edges[1:])], total, nibbles, block)
    little = ids.astype("<u4")
    for k in range(n):
        if zlib.crc32(little[k * block : (k + 1) * block].tobytes()) != sums[k]:
            raise ValueError(f"block {k} is damaged")
    return doc_ids, nulls.astype(bool), lengths.astype(np.int64), ids


def _numbers(name: str) -> list[int]:
    """Task and file number of a name; as numbers they sort rightly however many there are."""
    return [int(x) for x in re.findall(r"\d+", name)]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end: int) -> DataFrame:
    """Writes token files of all documents under folder, in ascending doc_id order; returns (file, base) of each file.

    base is the number of ids in all files before. The driver gets one row per file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    _, total = text_bytes(rows)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    parts = rows.repartitionByRange(partitions_for(rows, total, TASK_BYTES), order[0]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, number = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        nibbles = 4 if max(code.largest, end) < 1 << 16 else 6
        held: list[tuple] = []
        done: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal number
            doc_ids, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            name = f"part-{part:06d}-{number:04d}.tok"
            write_file(f"{folder}/{name}", pack(doc_ids, nulls, lengths, ids, nibbles))
            done.append((name, len(ids), len(doc_ids)))
            number += 1

        for batch in batches:
            texts = batch_texts(batch.column("text"))
            doc_ids = np.array([0 if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            nulls = np.asarray(batch.column("doc_id").is_null())
            for a, b in slices(np.array([len(t) for t in texts]), 4 << 20):
                ids, lengths = code.encode(texts[a:b], end)
                held.append((doc_ids[a:b], nulls[a:b], lengths, ids))
                if sum(len(x[3]) for x in held) >= FILE_TOKENS:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in done], pa.string()), "tokens": pa.array([x[1] for x in done], pa.int64()), "docs": pa.array([x[2] for x in done], pa.int64())})

    files = sorted(parts.mapInArrow(write, "file string, tokens long, docs long").collect(), key=lambda f: _numbers(f["file"]))
    base, out = 0, []
    for f in files:
        out.append((f["file"], base))
        base += f["tokens"]
    return spark.createDataFrame(out, "file string, base long")


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, file, offset, n_tokens, ids_crc32[, ids]) of every document; offset counts the ids before it in its file."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.tok").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = "doc_id long, file string, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                doc_ids, nulls, lengths, found = unpack(data.as_py())
                edges = np.concatenate([[0], np.cumsum(lengths)])
                little = memoryview(found.astype("<u4").tobytes())
                sums = np.array([zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:])], np.int64)
                columns = {"doc_id": pa.array(doc_ids, mask=nulls), "file": pa.array([name] * len(doc_ids)), "offset": pa.array(edges[:-1]), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(sums)}
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return files.mapInArrow(read, schema)


def encode_and_read(docs: DataFrame, tokenizer_path: str, end: int = 2, ids: bool = False) -> DataFrame:
    """Writes the token files to the shared folder and returns (doc_id, start, n_tokens, ids_crc32[, ids]) from them."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    bases = write_tokens(docs, folder, tokenizer_path, end)
    if bases.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    found = read_tokens(spark, folder, ids).join(bases, "file")
    return found.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
