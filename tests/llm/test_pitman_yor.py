"""The seating sampler against enumeration, the model against customer-by-customer sampling, and the query's base columns."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from forestflux.llm import pitman_yor as P

def held():
    return F.expr("crc32(coalesce(cast(doc_id as string), '')) % 7 = 2")


def partitions(n):
    """Sizes of the blocks of every set partition of n things."""
    def grow(blocks, left):
        if not left:
            yield tuple(blocks)
            return
        for i in range(len(blocks)):
            blocks[i] += 1
            yield from grow(blocks, left - 1)
            blocks[i] -= 1
        yield from grow([*blocks, 1], left - 1)

    yield from grow([], n)


@pytest.mark.parametrize("c", [1, 2, 3, 5, 7])
def test_seating_weights(c):
    want = Counter()
    for blocks in partitions(c):
        want[len(blocks)] += math.prod(math.prod(i - 0.3 for i in range(1, n)) for n in blocks)
    assert np.exp(P.log_seatings(0.3)[c, 1 : c + 1]) == pytest.approx([want[t] for t in range(1, c + 1)], rel=1e-9)


def test_drawn_tables_have_the_right_distribution():
    rng = np.random.default_rng(1)
    for c, lam in ((2, 0.4), (6, 2.5), (30, 8.0)):
        w = np.exp(P.log_seatings(0.6)[c, 1 : c + 1] - P.log_seatings(0.6)[c, 1:c+1].max()) * lam ** np.arange(1, c + 1)
        drawn = P.draw_tables(np.full(40_000, c), np.full(40_000, lam), 0.6, rng)
        assert np.bincount(drawn, minlength=c + 1)[1:] / 40_000 == pytest.approx(w / w.sum(), abs=0.012)


def test_many_customers_by_the_normal_limit(monkeypatch):
    """Just over the bound, the draw's mean and spread are those of the exact distribution."""
    c, lam = P.EXACT, 60.0
    exact = P.draw_tables(np.full(4000, c), np.full(4000, lam), 0.7, np.random.default_rng(2))
    monkeypatch.setattr(P, "EXACT", c - 1)
    near = P.draw_tables(np.full(4000, c), np.full(4000, lam), 0.7, np.random.default_rng(3))
    assert near.mean() == pytest.approx(exact.mean(), rel=0.02) and near.std() == pytest.approx(exact.std(), rel=0.1)
    huge = P.draw_tables(np.array([10**6, 10**9]), np.array([0.01, 5e4]), 0.7, np.random.default_rng(4))
    assert 1 <= huge[0] <= 3 and 5e4 < huge[1] < 10**9


def test_distinct_and_packing():
    r = np.random.default_rng(3)
    for bits in (12, 40, 64):
        keys = r.integers(0, 1 << min(63, bits), 500, np.uint64)[r.integers(0, 500, 5000)]
        got, want = P.distinct(keys, bits), np.unique(keys, return_inverse=True)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    arrays = [np.array([], np.int64), np.arange(300), np.array([1 << 40, 5]), r.random(7), r.integers(0, 1 << 63, 9, np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, P.unpack(P.pack(*arrays)), strict=True))
    assert P.lgamma(np.array([0.01, 0.5, 3.0, 1e6])) == pytest.approx([math.lgamma(x) for x in (0.01, 0.5, 3.0, 1e6)], rel=1e-8)


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return low.encode().split() + [None]


def base_of(rows):
    train = Counter(t for i, text in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for t in tokens_of(text))
    n, v = sum(train.values()), len(train)
    out = []
    for i, text in rows:
        own = tokens_of(text)
        out.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(own), sum(train[t] > 0 for t in own), n, round(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own), 8)))
    return sorted(out, key=repr)


def columns(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in df.collect()), key=repr)


def test_base_columns_of_odd_documents(docs):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    df, rows = docs
    found = P.score(df, held()).cache()
    assert columns(found) == base_of(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found.collect())


def test_no_documents_and_no_training(spark):
    assert P.score(documents(spark, []), held()).count() == 0
    rows = [(i, "a b", "en", "a") for i in (1, 2)]
    found = P.score(documents(spark, rows), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(0, 0, 0.0, 0.0)] * 2


def test_partitions_buckets_and_reruns_agree(spark, monkeypatch):
    """Which task holds what changes nothing but the draws, which depend on the number of buckets."""
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary[: r.choice([5, 60])]) for _ in range(r.randint(0, 40))), "en", "a") for i in range(120)]
    df = documents(spark, rows)
    scores = lambda d: {q.doc_id: q.score for q in P.score(d, held()).collect()}
    monkeypatch.setattr(P, "SLICE_TOKENS", 300)
    one = scores(df.repartition(1))
    assert scores(df.repartition(5)) == pytest.approx(one, rel=1e-12)
    monkeypatch.setattr(P, "PAIR_TOKENS", 300)
    monkeypatch.setattr(P, "WORD_TOKENS", 500)
    many = scores(df)
    assert sum(many.values()) == pytest.approx(sum(one.values()), rel=0.02)


def customers_by_customers(train, d, theta, d0, theta0, sweeps, seed):
    """Seatings of every customer, moved one at a time; probabilities averaged over the later sweeps."""
    r = random.Random(seed)
    vocabulary = {w for text in train for w in text}
    v = len(vocabulary)
    tables = {}  # (context, word) -> sizes; the parent's context is ()
    rest = {}

    def count(u):
        return rest.setdefault(u, [0, 0])  # customers and tables

    def p(u, w):
        c, t = rest.get(u, (0, 0))
        own = tables.get((u, w), [])
        dd, th = (d0, theta0) if u == () else (d, theta)
        up = 1 / (v + 1) if u == () else p((), w)
        return up if not c else (sum(own) - dd * len(own) + (th + dd * t) * up) / (th + c)

    def sit(u, w):
        dd, th = (d0, theta0) if u == () else (d, theta)
        own, (c, t) = tables.setdefault((u, w), []), count(u)
        up = 1 / (v + 1) if u == () else p((), w)
        weights = [n - dd for n in own] + [(th + dd * t) * up]
        k = r.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            rest[u][1] += 1
            if u != ():
                sit((), w)
        else:
            own[k] += 1
        rest[u][0] += 1

    def leave(u, w):
        own = tables[u, w]
        k = r.choices(range(len(own)), own)[0]
        own[k] -= 1
        rest[u][0] -= 1
        if not own[k]:
            own.pop(k)
            rest[u][1] -= 1
            if u != ():
                leave((), w)

    pairs = [pair for text in train for pair in itertools.pairwise(["<", *text])]
    for u, w in pairs:
        sit((u,), w)
    found = []
    for sweep in range(sweeps):
        for u, w in pairs:
            leave((u,), w)
            sit((u,), w)
        if sweep >= sweeps // 3:
            found.append({(u, w): p((u,), w) for u in {*vocabulary, "<", "?"} for w in {*vocabulary, "?"}})
    return {k: sum(f[k] for f in found) / len(found) for k in found[0]}


def test_against_customers_moved_one_by_one(spark, monkeypatch):
    """A small corpus with fixed concentrations and discounts: mean log probabilities of all documents agree."""
    monkeypatch.setattr(P, "GRID", np.array([1.5]))
    monkeypatch.setattr(P, "discount", lambda ones, twos: 0.5)
    monkeypatch.setattr(P, "KEPT", 6)
    r = random.Random(6)
    words = "abcdefgh"
    rows = [(i, " ".join(r.choices(words, [9, 5, 3, 2, 1, 1, 1, 1], k=r.randint(3, 14))), "en", "a") for i in range(60)]
    df = documents(spark, rows)
    got = {q.doc_id: q.score for q in P.score(df, held()).collect()}
    texts = {i: [*text.split(), "$"] for i, text, *_ in rows}
    p = customers_by_customers([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], 0.5, 1.5, 0.5, 1.5, 90, 1)
    want = {i: sum(math.log10(p[u, w]) for u, w in itertools.pairwise(["<", *t])) for i, t in texts.items()}
    assert all(got[i] == pytest.approx(want[i], rel=0.03) for i in want)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.005)


def test_better_than_counting(spark):
    """Held-out texts in which words follow each other by habit."""
    r = random.Random(9)
    habit = {i: r.sample(range(50), 3) for i in range(50)}

    def text():
        at, out = r.randrange(50), []
        for _ in range(30):
            at = r.choice(habit[at]) if r.random() < 0.9 else r.randrange(50)
            out.append(f"w{at}")
        return " ".join(out)

    found = P.score(documents(spark, [(i, text(), "en", "a") for i in range(200)]), held()).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert 10 ** (-found[0] / found[2]) < 0.35 * 10 ** (-found[1] / found[2])
