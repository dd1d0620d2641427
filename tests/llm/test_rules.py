"""Quality rules, decontamination, WARC, urls, HTML, mixing and the pipeline."""

import collections
import hashlib
import re

import numpy as np
import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from forestflux.llm import decontam, html, mixing, quality, urls, warc
from forestflux.llm.queries import URL_RULES

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---------------------------------------------------------------- quality


def base(t):
    w = WORD.findall(t or "")
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    hit = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_base_statistics(docs):
    df, rows = docs
    odd = documents(df.sparkSession, [(1, "a b c d e f g h " * 3 + "\nx\n\nx\n x", "en", "a"), (2, "### $ a|b " * 9, "en", "a")])
    for d, rs in ((df, rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        got = quality.judge(d).collect()
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(((i, *base(t)) for i, t in rs), key=repr)
        assert all(not r.kept for r in got if r.base_failed)


def test_estimates_match_numpy_and_reject_outliers(spark):
    """A clean group with planted outliers: the location is that of the clean part, and just the outliers are far."""
    r = np.random.default_rng(1)
    clean = r.normal([1600, 0, 0, 0, 5500], [50, 1, 1, 1, 800], (2000, 5)).round().astype(int)
    bad = r.normal([2100, 4000, 0, 0, 5500], [50, 200, 1, 1, 800], (300, 5)).round().astype(int)
    rows = [("g", 2300, *map(int, x)) for x in [*clean, *bad]]
    df = spark.createDataFrame(rows, "g string, n_group long, q0 long, q1 long, q2 long, q3 long, q4 long")
    found = quality.estimates(df).first()
    assert abs(found.m0 - 1600) < 15 and abs(found.m1) < 15
    far = df.join(F.broadcast(quality.estimates(df)), "g").withColumn("d", quality._distance()).where(F.col("d") > quality.CUTOFF)
    assert far.count() == 300 and far.where("q1 > 1000").count() == 300


def test_repetition_in_a_clean_group(spark):
    """Many repeated lines or words are far from a group that has none, one repeated line or symbol is not, however short the text."""
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(int(np.exp(r.normal(5.5, 0.5)))) for _ in range(300)]
    lines = lambda n: "\n".join(f"{text(4)}\nok" for _ in range(n // 5))
    passage = text(40)
    far = [lines(100), lines(400), f"{text(110)} {passage} {text(100)} {passage}"]
    near = [f"{text(60)}\nok\n{text(60)}\nok", f"{text(11)}\nok\n{text(11)}\nok", text(24) + " #", text(20)]
    texts = [*clean, *far, *near]
    got = {x.doc_id: x for x in quality.judge(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    kept = [got[i].kept for i in range(len(texts))]
    assert not any(x.base_failed for x in got.values())
    assert kept[300:] == [False] * len(far) + [True] * len(near) and sum(kept[:300]) >= 298


def test_small_groups_fall_back(spark):
    """Small groups are judged by their language, rare languages by all: a text full of repeated lines is rejected in both."""
    r = np.random.default_rng(6)
    text = lambda n: " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(n))
    far = "\n".join(f"{text(4)}\nok" for _ in range(60))
    rows = [(i, text(int(r.integers(100, 300))), "de", f"s{i % 4}") for i in range(60)]
    rows += [(100, far, "de", "s1"), (101, text(150), "fr", "s1"), (102, far, "fr", None), (103, text(150), None, None)]
    got = {x.doc_id: x for x in quality.judge(documents(spark, rows)).collect()}
    assert len(got) == len(rows) and all(x.distance is not None for x in got.values())
    assert {i for i, x in got.items() if not x.kept} == {100, 102}


def test_empty_quality(docs):
    assert quality.judge(docs[0].limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                if i is not None:
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def items(spark, docs):
    passage = next(t for i, t in docs[1] if i == 11)
    rows = [(1, passage), (20, "x " + passage.upper()), (3, "na na"), (4, None), (5, ""), (None, "one, two"), (6, passage), (7, "zz unknown")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


@pytest.mark.parametrize("limit", [decontam.MAX_BROADCAST_BYTES, 2000])
def test_decontamination(spark, docs, monkeypatch, limit):
    """Also with a benchmark that takes several parts."""
    monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", limit)
    df, rows = docs
    bench, raw = items(spark, docs)
    got = sorted(map(tuple, decontam.judge(df, bench).collect()), key=repr)
    assert got == sorted(((i, *hits(t, raw)) for i, t in rows), key=repr)


def test_removal_keeps_columns(spark, docs):
    df, rows = docs
    bench, raw = items(spark, docs)
    kept = decontam.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, t in rows if not hits(t, raw)[4]), key=repr)
    assert decontam.judge(df, bench.limit(0)).where("contaminated").count() == 0


# ---------------------------------------------------------------- WARC


def test_archives(spark):
    long, other = "é" * 600, "b" * 999
    rows = [(1, "http://a", long), (5, None, long), (3, "http://c\nx", long), (7, "u", other), (8, "u", other), (9, "u", None), (None, "u", long), (5, None, long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()), key=repr)
    want = []
    for i, _, p in rows:
        data = (p or "").encode()
        again = p == long and i is not None and i < 5
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archive_headers(spark, tmp_path):
    """A plain reader resolves revisits by standard headers; ids are unique, also of repeated rows; two writes differ in dates alone."""
    import gzip

    long = "payload " * 200
    pages = spark.createDataFrame([(1, "http://a", long), (2, "http://b", long), (2, "http://b", long), (3, "http://c", "short")], "page_id long, url string, html string")
    texts = []
    for run in ("x", "y"):
        folder = f"file://{tmp_path}/{run}"
        assert warc.write_archives(pages, folder, date=f"2024-01-01T00:00:0{len(texts)}Z").agg(F.sum("records")).first()[0] == 4
        texts.append("".join(gzip.decompress(f.read_bytes()).decode() for f in sorted((tmp_path / run).glob("*.warc.gz"))))
    assert texts[0].replace("00:00:00Z", "00:00:01Z") == texts[1]
    records = [dict(x.split(": ", 1) for x in r.split("\r\n\r\n")[0].split("\r\n") if ": " in x) for r in texts[0].split("WARC/1.1\r\n")[1:]]
    ids = [r["WARC-Record-ID"] for r in records]
    assert len(ids) == len(set(ids)) and sum(r["WARC-Type"] == "warcinfo" for r in records) == len(list((tmp_path / "x").glob("*.warc.gz")))
    (revisit,) = [r for r in records if r["WARC-Type"] == "revisit"]
    (to,) = [r for r in records if r["WARC-Record-ID"] == revisit["WARC-Refers-To"]]
    assert to["WARC-Target-URI"] == revisit["WARC-Refers-To-Target-URI"] == "http://b" and to["WARC-Date"] == revisit["WARC-Refers-To-Date"]


# ---------------------------------------------------------------- urls


def plain_verdict(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(v, h, p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: (x[1].count("."), len(x[2])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_urls(spark):
    found = [None, "", "no scheme", "http://EXAMPLE.com/en/75?x", "http://a.b.example.com/en/6", "http://com/en/", "http://xcom/en/", "https://example.net/de/9", "https://m.example.net/de/88#f", "ftp://x.org/es/", "http://x.org?/es/", "http://x.com/en", "http://a://com/en/1", "http://.com/en/", "http://exampleXcom/en/7"]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, URL_RULES).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(found)}


def test_rules_and_sql_are_those_of_the_contract(spark, tmp_path):
    import duckdb

    from forestflux.llm.queries import ORACLE, op7_url_filter

    assert sorted(URL_RULES) == sorted([("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")])
    wanted = {"http://a.com/en/": "block", "http://example.com/en/75": "allow", "http://a.net/de/1": "allow", "http://example.net/de/9": "allow", "http://m.example.net/de/88": "block", "http://x.org/es/": "block", "http://x.org/de/": "allow"}
    spark.createDataFrame(list(enumerate(wanted)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.verdict for r in op7_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()] == list(wanted.values())
    with duckdb.connect() as con:
        con.execute(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
        assert [v for _, v in sorted(con.execute(f"select page_id, verdict from ({ORACLE['op7_url_filter']})").fetchall())] == list(wanted.values())


def test_precedence_of_allow_and_block():
    t = urls.UrlTrie([("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "com", "/x/y/z"), ("allow", "", "/x/")])
    assert t.match("a.com", "/x/1")[0] == "block" and t.match("b.com", "/x/y/zz") == ("block", "com/x/y/z") and t.match("q.org", "/x/") == ("allow", "/x/")


# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("a<b", "a"),
        ("<p>One<p>Two <b>bold</b>\n  x", "One\n\nTwo bold x"),
        ("<head><title>t</title><style>s</style></head>body<script>var a='</p>'</script> on", "body on"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>N<tr><td>apple pie<td>3<tr><td rowspan=2>z<td>4<tr><td>5</table>", "Name      | N\napple pie | 3\nz         | 4\n          | 5"),
        ("<div hidden>no</div><div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div><!-- c", "yes"),
        ("<pre>\n a\n   b</pre>x<br>y &amp;&nbsp;z", " a\n   b\n\nx\ny &\xa0z"),
        ("<details><summary>S</summary>no</details><dialog>no</dialog><td>stray</p>k", "S\nstray\n\nk"),
    ],
)
def test_rendering(page, text):
    assert html.extract(page).strip("\n") == text.strip("\n")


@pytest.mark.parametrize("page", ["a<!-->b<p>c", "a<!--->b<p>c", "a<!-->b<p>c<!-- no -->", "a<!--->b<p>c<!-- no --->"])
def test_abrupt_comments(page):
    assert html.extract(page).strip("\n") == "ab\n\nc"


def test_depth_and_rows(spark):
    assert html.extract("<div><b>" * 50_000 + "x") == "x"
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None)], "page_id long, html string")
    assert sorted(map(tuple, html.extract_text(pages).collect())) == [(1, "a"), (1, "a"), (2, "")]


# ---------------------------------------------------------------- mixing


def test_targets_are_capped_and_reshared():
    t = mixing.targets_of([("a", 100), ("b", 10), (None, 50)])
    assert sum(t.values()) == pytest.approx(1.5 * 160) and t["b"] <= 20 and t["a"] <= 200 and t[None] == pytest.approx(88)
    assert mixing.targets_of([]) == {} and mixing.targets_of([("a", 0)]) == {"a": 0.0}


def test_pivot_keeps_mass():
    r = np.random.default_rng(0)
    p = np.full(1000, 0.3)
    out = mixing.pivot(p, r.random(1000), False)
    assert out.sum() == pytest.approx(300) and ((out > 0) & (out < 1)).sum() <= 1


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 50), "en", None if i % 3 == 0 else "big" if i % 3 == 1 else f"s{i % 6}") for i in range(900)] + [(5, "a b c", "en", "big")] * 3 + [(7, None, "en", None)]
    df = documents(spark, rows)
    got = mixing.mix(df, leaf_rows=50, fan_in=3).collect()
    again = mixing.mix(df.repartition(5), leaf_rows=50, fan_in=3).collect()
    key = lambda r: (r.doc_id, r.size, r.nth, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    per = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        per[r.source][0] += r.taken
        per[r.source][1] = r.target
    assert all(abs(taken - target) <= 60 for taken, target in per.values())
    repeated = mixing.repeat(df, leaf_rows=50, fan_in=3)
    assert repeated.columns == df.columns and repeated.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    """Each stage keeps a subset by its own rule, and the last one tells of what the mix took."""
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for _, stage in pipeline.STAGES[:4]:
        after = stage(spark, docs, d)
        assert after.columns == names
        docs = pipeline.table(after, "test")
    final = pipeline.STAGES[4][1](spark, docs, d)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_run(spark, docs, tmp_path):
    """run() over odd documents (nulls, repeated rows and ids, empty and long texts, clashing columns) and over an empty table."""
    import os

    import corpus_pipeline as pipeline

    df, rows = docs
    for name, table in (("odd", df), ("none", df.limit(0))):
        d = str(tmp_path / name)
        table.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([("b1", " ".join(rows[9][1].split()[:12]))], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
        before = set(os.listdir(pipeline.shared_dir(spark, "x").removeprefix("file:").rpartition("/")[0]))
        found = pipeline.run(spark, d).collect()
        left = set(os.listdir(pipeline.shared_dir(spark, "x").removeprefix("file:").rpartition("/")[0])) - before
        assert {x.rpartition("-")[0] for x in left} <= {"stage4", "tokens"}
        if name == "none":
            assert not found
            continue
        assert found[0].start == 0 or min(r.start for r in found) == 0
        ids = {r.doc_id for r in found}
        assert {1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16} & ids == set()  # fail the base rules, are copies, or hold the benchmark
        ends = sorted((r.start, r.n_tokens) for r in found)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_good_rows_stay(spark):
    """Rows that share an id are judged one by one."""
    good = " ".join(f"word{i}" for i in range(60))
    df = documents(spark, [(1, good, "en", "a"), (1, "short", "en", "a"), (None, good, "en", "a"), (None, None, "en", "a")])
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, good), (1, good)]


def test_many_rules_under_one_host():
    """A last segment is looked up by its beginnings, not by a scan of all rules that end there."""
    trie = urls.UrlTrie([("block", "a.com", f"/x{i}") for i in range(20_000)])
    assert trie.match("a.com", "/x12345678") == ("block", "a.com/x12345") and trie.match("a.com", "/y") is None
