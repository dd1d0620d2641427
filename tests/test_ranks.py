"""Order statistics, percentiles and global ranks against sorting."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from forestflux.ml import models
from forestflux.operators import ranks


def test_bits_keep_order_and_come_back(spark):
    r = random.Random(1)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1.0, 2.0, 0.5, 1 - 2**-53, 1 + 2**-52]
    odd += [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, d) for k in range(-1022, 1024, 31) for d in (0.0, math.inf)]
    odd += [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(3000)]
    odd = [v for v in odd if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in odd], "v double").withColumn("b", ranks.ordered_bits(F.col("v")))
    rows = df.withColumn("back", ranks.from_bits(F.col("b"))).collect()
    assert all(q.back == q.v for q in rows)
    by = sorted(rows, key=lambda q: q.b)
    assert all(a.v <= b.v and (a.v < b.v or a.b == b.b) for a, b in zip(by, by[1:], strict=False))
    assert spark.createDataFrame([(None,), (math.nan,)], "v double").select(ranks.ordered_bits(F.col("v")).alias("b")).where("b is not null").count() == 0


def test_percentiles(spark):
    r = random.Random(2)
    rows = [(k, v) for k, n in (("a", 1000), ("b", 1), ("c", 2), (None, 300)) for v in [r.choice([r.gauss(0, 1e6), float(r.randint(-2, 2)), 1e-310, None]) for _ in range(n)]] + [("d", None), ("c", 5.0), ("b", 1.0)]
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.995, "p100": 1.0}
    got = {q.k: [q[n] for n in shares] for q in ranks.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        values = [v for q, v in rows if q == k and v is not None]
        if values:
            want[k] = np.quantile(values, list(shares.values()))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k].tolist(), rel=1e-12) for k in got)
    whole = ranks.percentiles(spark.createDataFrame(rows, "k string, v double"), [], "v", shares).first()
    assert list(whole) == pytest.approx(np.quantile([v for _, v in rows if v is not None], list(shares.values())).tolist(), rel=1e-12)


def test_no_group_is_held(spark):
    """The plan has no list of values, and counts before it shuffles."""
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    plan = ranks.percentiles(df, ["k"], "v", {"p": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "partial_count" in plan


@pytest.mark.parametrize("kind", ["numbers", "words", "one key"])
def test_global_rank(spark, monkeypatch, kind):
    """Keys with many equal ones; ranks are those of a sort, and come from many ranges."""
    monkeypatch.setattr(ranks, "SAMPLE", 400)
    monkeypatch.setattr(ranks, "RANGES", 20)
    r = random.Random(3)
    key = {"numbers": lambda: r.choice([7, 7, 7, r.randint(-50, 1000), None]), "words": lambda: r.choice(["m", "m", r.choice("abcxyz") * r.randint(1, 9)]), "one key": lambda: 1}[kind]
    rows = [(key(), i) for i in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, f"k {'string' if kind == 'words' else 'int'}, i int")
    got = sorted(ranks.global_rank(df, "k", ["i"]).collect(), key=lambda q: q.rank)
    assert [q.rank for q in got] == list(range(3000))
    keys = [q.k for q in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k if k is not None else 0))
    singles = [(q.k, q.i) for q in got if keys.count(q.k) < 100]
    assert singles == sorted(singles, key=lambda q: (q[0] is not None, q[0] if q[0] is not None else 0, q[1]))
    again = {(q.k, q.i): q.rank for q in ranks.global_rank(df.repartition(5), "k", ["i"]).collect()}
    assert again == {(q.k, q.i): q.rank for q in got}
    plan = ranks.global_rank(df, "k", ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the ranges' sizes


def test_split_stratified(spark):
    """Each cluster of the label gives its share, without windows over clusters."""
    df = spark.range(1000).select("id", (F.col("id") % 5 * 100 + F.rand(3)).alias("biomass"))
    train, test = models.split_stratified(df, "id", strata=5, share=0.8)
    assert train.columns == df.columns and train.count() == 800 and test.count() == 200
    per = {q.s: q.n for q in train.groupBy((F.col("id") % 5).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert set(per.values()) == {160}
    assert train.join(test, "id").count() == 0
