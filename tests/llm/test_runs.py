"""Periodic runs against brute force, and the query's digests."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from conftest_llm import documents

from forestflux.llm import runs


def brute(a):
    """Every run: for each period, the stretches that agree with themselves a period on."""
    n, out = len(a), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if a[i] != a[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and a[i] == a[i + q]:
                i += 1
            length = i + q - s
            x = a[s : s + length]
            if length >= max(24, 3 * q) and not any(x[r:] == x[: length - r] for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def noisy(r, n, k):
    a = []
    while len(a) < n:
        if r.random() < 0.5:
            a += [r.randrange(k) for _ in range(r.randint(1, 9))]
        else:
            a += [r.randrange(k) for _ in range(r.randint(1, 12))] * r.randint(2, 12)
    return a[:n]


def test_runs_of():
    r, found = random.Random(1), 0
    for _ in range(400):
        a = noisy(r, r.randint(0, 160), r.choice([1, 2, 2, 3, 5]))
        want = brute(a)
        assert runs.runs_of(np.array(a, np.int64)) == want
        found += len(want)
    assert found > 200


@pytest.mark.parametrize("a", [[1] * 30_000, [i % 7 for i in range(30_000)], list(range(3000)) * 10, list(range(15_000)) * 2], ids=["equal", "short", "long", "twice"])
def test_long_texts(a):
    want = {1: [(0, 30_000, 1)], 7: [(0, 30_000, 7)], 3000: [(0, 30_000, 3000)], 15_000: []}[len(set(a))]
    assert runs.runs_of(np.array(a, np.int64)) == want


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *top, sha256(listed.encode()).hexdigest(), sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_collapse(spark):
    """Nulls, empty and blank texts, repeated rows, clashing columns and planted periods."""
    r = random.Random(3)
    texts = [None, "", " \t\n ", "one", "é " * 40, "a b\fc\x0bd " * 9, *[" ".join(f"w{x}" for x in noisy(r, r.randint(20, 200), 6)) for _ in range(40)]]
    texts += [" ".join(f"x{r.randrange(1000)}" for _ in range(90)) for _ in range(40)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, "z " * 30, "en", "a"), (5, "z " * 30, None, None), (5, "z " * 30, None, None)]
    got = [tuple(x) for x in runs.collapse(documents(spark, rows), planted=True).collect()]
    want = [expected(i, t) for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in want[46:86]) >= 2  # planted ones


def test_no_rows(spark):
    assert runs.collapse(documents(spark, [])).count() == 0
