"""Substring removal against brute force over sets of windows."""

import collections
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from forestflux.llm import automata, suffixes
from forestflux.llm.automata import SuffixAutomaton

FAR = 1 << 62


def bytes_removed(rows, length=50):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            first[w] = min(first.get(w, FAR), FAR if i is None else i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < (FAR if i is None else i):
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def words_removed(rows, length=35):
    count = collections.Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        count.update(tuple(w[k : k + length]) for k in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_order(docs):
    df, rows = docs
    assert sorted(map(tuple, suffixes.remove_copies(df).collect()), key=repr) == bytes_removed(rows)


def test_automata(docs):
    df, rows = docs
    assert sorted(map(tuple, automata.remove_repeats(df).collect()), key=repr) == words_removed(rows)


def test_texts_and_spans(docs):
    df, rows = docs
    for r in automata.remove_repeats(df, texts=True).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert sum(s.e - s.s for s in r.spans) == r.n_removed


def test_empty_table(docs):
    df, _ = docs
    assert suffixes.remove_copies(df.limit(0)).count() == 0
    assert automata.remove_repeats(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=12), st.integers(1, 3)), min_size=1, max_size=4), st.integers(1, 5))
def test_automaton_counts(parts, window):
    a = SuffixAutomaton()
    for t, weight in parts:
        a.add(list(t), weight)
    a.finish()
    for t, _ in parts:
        want = [sum(weight * sum(x[j : j + window] == t[k : k + window] for j in range(len(x) - window + 1)) for x, weight in parts) for k in range(len(t) - window + 1)]
        assert a.window_counts(list(t), window) == want
