"""The Jaccard join and its components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from conftest_llm import documents

from forestflux.llm import jaccard
from forestflux.llm.components import components

FAR = 1 << 62


def brute(rows, n=4, t=85):
    sets = []
    for _, x in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), FAR), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def ours(df, n=4, t=85):
    return sorted(map(tuple, jaccard.near_components(df, n=n, per_cent=t).collect()), key=repr)


def test_odd_documents(docs):
    df, rows = docs
    assert ours(df) == brute(rows)


def test_chains_of_near_copies(spark, monkeypatch):
    """Families in which each member differs from the last by a few words, around the threshold; groups of three count as large."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    r = random.Random(3)
    rows = []
    for family in range(6):
        text = [f"w{r.randrange(10**6)}" for _ in range(r.randint(30, 90))]
        for _ in range(12):
            rows.append((len(rows) * 3 % 101 + 1000 * family, " ".join(text)))
            for _ in range(r.randint(0, 3)):
                text[r.randrange(len(text))] = f"w{r.randrange(10**6)}"
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    assert ours(df) == brute(rows)


def test_only_texts_of_pairs_move(spark, monkeypatch):
    """Short texts share prefix n-grams with long ones, but cannot link with them by size: their texts stay where they are."""
    r = random.Random(7)
    long = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    near = [*long[0][:-1], "changed"]
    rows = list(enumerate(" ".join(x) for x in [*long, near, *[x[k : k + 4] for x in long for k in range(57)]]))
    nodes = {"texts": set(), "pairs": set(), "members": set(), "entries": set()}
    table = jaccard.table

    def seen(df, name, *args, **options):
        out = table(df, name, *args, **options)
        for c in {"texts": ("node",), "entries": ("node",), "pairs": ("a", "b"), "members": ("a", "b")}.get(name, ()):
            nodes[name] |= {row[0] for row in out.select(c).collect()}
        return out

    monkeypatch.setattr(jaccard, "table", seen)
    assert ours(documents(spark, [(i, t, "en", "a") for i, t in rows])) == brute(rows)
    assert len(nodes["entries"]) > 4
    assert nodes["texts"] == nodes["pairs"] | nodes["members"] and len(nodes["texts"]) == 2


def test_sets_are_sorted_and_distinct():
    texts = [b"", b"A b", b" \n", b"a B c d e a b C d", b"a", b"x y z w v"]
    owner, value = jaccard.shingle_sets(texts, 4)
    assert np.bincount(owner, minlength=6).tolist() == [0, 1, 0, 5, 1, 2]
    assert all((np.diff(value[owner == k].astype(object)) > 0).all() for k in range(6))
    assert set(jaccard.shingle_sets([b"a b c d"], 4)[1]) < set(value[owner == 3])
    order = jaccard.Order(np.sort(value[:4].astype(np.uint32)), np.array([40, 50, 60, 70]), 3, np.empty(0, np.int64))
    rank = order.rank(value)
    assert sorted(rank[rank > 0].tolist()) == [40, 50, 60, 70, *rank[4:][rank[4:] > 0].tolist()]
    assert (jaccard._rare_first(owner, rank) == np.lexsort((value, rank, owner))).all()


@pytest.mark.parametrize("n, t, words", [(4, 85, 10**6), (5, 80, 10**6), (4, 85, 12)])
def test_large_group_of_near_copies(spark, monkeypatch, n, t, words):
    """Copies of one text with none to eight edits, most linked with few others or none; with few words, edits recur."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    r = random.Random(n * t)
    base = [f"w{r.randrange(10**6)}" for _ in range(140)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(r.randint(0, 8)):
            kind, at = r.random(), r.randrange(len(text))
            text[at : at + (kind < 0.8)] = [] if kind < 0.2 else [f"w{r.randrange(words)}"]
        rows.append((i, " ".join(text)))
    assert ours(documents(spark, [(i, x, "en", "a") for i, x in rows]), n, t) == brute(rows, n, t)


def test_few_outside_the_largest_part(spark):
    """In a group of 60 connected members and two others, each pair of different parts has one of those two: they are the sides, not all 62."""
    entries = spark.createDataFrame([(7, i, 100, 100, 0, i if i in (20, 40) else -1) for i in range(62)], "gram long, node long, size int, dev int, place int, part long")
    rows = jaccard._of_use(entries, 80).collect()
    assert len(rows) == 62 and {r["few"] for r in rows} == {2}
    assert {r["node"] for r in rows if r["side"]} == {20, 40}


def test_near_group_ends_in_few_rounds(spark, monkeypatch):
    """Most copies of a text are linked and some are far from all: these are compared at once, not described by deviations again and again."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(80):
        text = list(base)
        for at in r.sample(range(120), 7 if i % 20 == 0 else r.randint(0, 2)):
            text[at] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    names, table = [], jaccard.table
    monkeypatch.setattr(jaccard, "table", lambda df, name, *a, **b: names.append(name) or table(df, name, *a, **b))
    assert ours(documents(spark, [(i, x, "en", "a") for i, x in rows]), 4, 85) == brute(rows, 4, 85)
    assert names.count("pairs") <= 2 and "deviations" not in names


def test_fragments_are_intervals_of_the_order():
    """Every n-gram is in one fragment, and fragments ascend with (rank, hash)."""
    r = np.random.default_rng(4)
    value = r.integers(0, (1 << 64) - 1, 5000, np.uint64)
    codes = np.unique(value[:700].astype(np.uint32))
    order = jaccard.Order(codes, r.integers(40, 900, len(codes)), 3, np.array([200, 400]))
    rank = order.rank(value)
    assert order.fragments == 6 and (rank[:700] > 0).all()
    by = np.lexsort((value, rank))
    assert (np.diff(order.fragment(value)[by]) >= 0).all() and set(order.fragment(value)) == set(range(6))


def test_one_stays(docs):
    """By rows: of each group of linked rows one, that with the least id."""
    df, rows = docs
    kept = jaccard.keep_one(df, n=4, per_cent=85)
    assert kept.columns == df.columns
    least = {i for i, _, c in brute(rows) if i is not None and i == c}
    want = {(i, text) for i, text in rows if i in least}  # two different texts have id 14, and one of them is there twice
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == sorted(want, key=lambda r: (r[0], r[1] or ""))
    assert kept.where("doc_id is null").count() == 1  # the null text; the other null id is a copy of document 6


def test_one_stays_with_odd_ids(spark):
    """Null and repeated ids: rows are judged by id and text, not by id alone."""
    a, x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "axy")
    df = documents(spark, [(None, a, "en", "a"), (None, a + " more", "en", "a"), (7, x, "en", "a"), (7, y, "en", "a"), (8, y, "en", "a"), (9, "", "en", "a"), (9, "", "en", "a")]).withColumnRenamed("g", "a.b")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    found = sorted(((r.doc_id or 0, r.text) for r in kept.collect()))
    assert len(found) == 5 and found[0][1] in (a, a + " more") and found[1:] == [(7, x), (7, y), (9, ""), (9, "")]


def test_pipeline_stage(spark):
    """The stage links from 0.8 of five-word n-grams on: scattered edits and replaced ends around 0.8 and 0.85, against brute force."""
    import corpus_pipeline as pipeline

    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for _ in range(20):
        text = [word() for _ in range(r.randint(60, 200))]
        scattered = list(text)
        for _ in range(max(1, len(text) // 50)):
            scattered[r.randrange(len(text))] = word()
        cut = round(len(text) * r.uniform(0.06, 0.13))
        for x in (text, scattered, text[:-cut] + [word() for _ in range(cut)], text + [word() for _ in range(2 * cut)]):
            rows.append((len(rows), " ".join(x)))
    wide, narrow = ({i for i, _, c in brute(rows, n, t) if i == c} for n, t in ((5, 80), (4, 85)))
    assert len(narrow - wide) > 5
    stage = dict(pipeline.STAGES)["n-gram Jaccard join"]
    kept = stage(spark, documents(spark, [(i, t, "en", "a") for i, t in rows]), "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted(wide)


def test_empty_table(docs):
    assert jaccard.near_components(docs[0].limit(0)).count() == 0
    assert jaccard.keep_one(docs[0].limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    groups = {}
    for r in components(links).collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 201]


def test_few_other_texts_move(spark):
    """Of 20,000 rows those of 30 keys, and hardly more; the keys need not be among the rows."""
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.lit("text").alias("text"))
    keys = spark.range(0, 21_000, 700).select(F.xxhash64("id").alias("key"))
    found = jaccard.maybe_in(rows, keys)
    assert found.columns == rows.columns
    assert found.join(keys, "key", "left_semi").count() == 29 and found.count() < 200
    assert jaccard.maybe_in(rows, keys.limit(0)).count() == 0


def test_counting_takes_little_memory():
    """Counts are those of all n-grams, and a task holds few bytes for each that it has not sent."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    r = np.random.default_rng(1)
    batch = pa.RecordBatch.from_pydict({"text": [None, "a b", *(" ".join(map(str, r.integers(0, 10**6, 2000))) for _ in range(400))]})
    for got in jaccard.packed_counts(iter([batch]), 4, 5):  # what is loaded once
        pass
    tracemalloc.start()
    got = [x for b in jaccard.packed_counts(iter([batch] * 5), 4, 5) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 170_000_000
    counts = Counter()
    for x in got:
        codes = np.frombuffer(x["codes"], np.uint32)
        assert (codes.astype(np.uint64) * np.uint64(5) >> np.uint64(32) == x["bucket"]).all()
        counts.update(dict(zip(codes.tolist(), np.frombuffer(x["counts"], np.uint32).tolist())))
    want = Counter(np.repeat(jaccard.shingle_sets([b"" if t is None else t.encode() for t in batch.column("text").to_pylist()], 4)[1].astype(np.uint32), 5).tolist())
    assert counts == want
