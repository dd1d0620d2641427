"""Maximal matches of repetitive texts: against brute force, and in memory that follows their number."""

import random
import tracemalloc

import numpy as np

from forestflux.llm import decontam


def brute(texts, items, window):
    out = set()
    for t, text in enumerate(texts):
        a = text.split()
        for i, item in enumerate(items):
            b = item.split()
            need = min(window, len(b))
            for p in range(len(a)):
                for q in range(len(b)):
                    if p and q and a[p - 1] == b[q - 1]:
                        continue
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if b and n >= need:
                        out.add((t, p, i, q, n))
    return out


def test_repetitive_texts():
    r = random.Random(4)
    words = ["la", "li", "lo"]
    for _ in range(60):
        make = lambda n: " ".join(r.choice(words[: r.randint(1, 3)]) for _ in range(r.randint(0, n)))
        texts, items = [make(60) for _ in range(4)], [make(25) for _ in range(5)]
        test = decontam.TestSuffixes([str(i) for i in range(5)], [x.encode() for x in items], 5)
        counts, found = decontam.shard_matches(test, [x.encode() for x in texts])
        got = list(zip(*(c.tolist() for c in found), strict=True))
        assert len(got) == len(set(got)) and set(got) == brute(texts, items, 5)
        assert counts.tolist() == [len(x.split()) for x in texts]


def test_memory_of_equal_words():
    """20,000 equal words against an item of 2,000: the matches are those that touch an end, not every pair."""
    test = decontam.TestSuffixes(["i"], [b"la " * 2000], 10)
    sizes = []
    for n in (5_000, 10_000, 20_000):
        tracemalloc.start()
        _, found = decontam.shard_matches(test, [b"la " * n])
        sizes.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found[0]) == (2000 - 9) + (n - 9) - 1 and int(np.max(found[4])) == 2000
    assert sizes[-1] < 200e6 and sizes[2] < 2.6 * sizes[1]
