"""Pulse fits and smoothing in batches against known shapes and row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forestflux.functions import pulses
from forestflux.operators import allometry, lidar
from forestflux.plans import pipelines


def pulse(sigma, mean=23.4, height=0.8, n=48):
    return 0.1 + height * np.exp(-((np.arange(n) - mean) ** 2) / (2 * sigma**2))


def one_by_one(wf, sigma):
    radius = int(4 * sigma + 0.5)
    k = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    return np.convolve(np.pad(wf, radius, mode="symmetric"), w / w.sum(), "valid")


@pytest.mark.parametrize("sigma", [1.5, 3.0, 5.2])
def test_fit_recovers_the_width(sigma):
    assert pulses.fit_sigma(pulse(sigma)) == pytest.approx(sigma, rel=1e-4)


def test_batch_of_unlike_pulses():
    """Lanes converge, fail and fall back without a word to each other."""
    r = np.random.default_rng(1)
    sigmas = r.uniform(2, 6, 400)
    waves = np.stack([pulse(s, m, h) for s, m, h in zip(sigmas, r.uniform(20, 30, 400), r.uniform(0.2, 2, 400), strict=True)])
    assert pulses.fit_sigmas(waves) == pytest.approx(sigmas, rel=2e-3)  # what is cut off at the ends lifts the minimum
    mixed = np.vstack([waves[:3], np.ones((1, 48)), np.full((1, 48), np.nan), r.random((20, 48)), waves[3:6]])
    found = pulses.fit_sigmas(mixed)
    assert found[:3] == pytest.approx(sigmas[:3], rel=2e-3) and found[-3:] == pytest.approx(sigmas[3:6], rel=2e-3) and found[3] == found[4] == 3.0
    assert np.isfinite(found).all() and (found > 0).all() and (found <= 48).all()
    assert found == pytest.approx([pulses.fit_sigma(w) for w in mixed], rel=1e-6)


def test_fit_is_a_minimum():
    """No width near the fitted one, with the best height and mean for it, fits better."""
    r = np.random.default_rng(4)
    wave = pulse(3.7) + r.normal(0, 0.02, 48)
    y, x = wave - wave.min(), np.arange(48)

    def cost(sigma):
        return min(((y - y @ e / (e @ e) * e) ** 2).sum() for m in np.linspace(22, 25, 301) for e in [np.exp(-((x - m) ** 2) / (2 * sigma**2))])

    best = pulses.fit_sigma(wave)
    assert cost(best) <= min(cost(best * 0.98), cost(best * 1.02))


def test_fallbacks():
    assert pulses.fit_sigma(np.ones(48)) == 3.0 and pulses.fit_sigma(np.array([1.0, np.nan])) == 3.0 and pulses.fit_sigma(np.array([])) == 3.0


def test_smoothing():
    r = np.random.default_rng(2)
    waves, sigmas = r.random((50, 120)), np.concatenate([r.uniform(0.1, 9, 48), [0.0, np.nan]])
    got = pulses.smooth_all(waves, sigmas)
    assert all(got[i] == pytest.approx(one_by_one(waves[i], sigmas[i])) for i in range(48))
    assert (got[48:] == waves[48:]).all()
    assert pulses.smooth(np.full(30, 2.0), 3.0) == pytest.approx(np.full(30, 2.0))
    bad = np.array([1.0, np.nan, 2.0])
    assert pulses.smooth(bad, 2.0)[0] == 1.0 and len(pulses.smooth(np.array([]), 2.0)) == 0


def test_columns(spark):
    """NULL arrays, missing entries and arrays of unlike lengths."""
    rows = [(1, [0.0, 1.0, 0.0, 0.0], 1.0), (2, [0.0, None, 1.0], 1.0), (3, None, 1.0), (4, [1.0, 2.0, 3.0, 9.0, 1.0], None), (5, [], 2.0)]
    df = spark.createDataFrame(rows, "i int, wf array<double>, s double").repartition(2)
    got = {q.i: q.o for q in df.select("i", pulses.smoothed(F.col("wf"), F.col("s")).alias("o")).collect()}
    assert got[1] == pytest.approx(one_by_one(np.array(rows[0][1]), 1.0).tolist()) and got[2] == [0.0, None, 1.0] and got[3] is None and got[5] == []
    assert got[4] == pytest.approx(one_by_one(np.array(rows[3][1]), 3.0).tolist())
    widths = spark.createDataFrame([(1, pulse(2.5).tolist()), (2, None), (3, [1.0, 1.0])], "i int, w array<double>").select("i", pulses.pulse_sigma(F.col("w")).alias("s"))
    assert {q.i: q.s for q in widths.collect()} == {1: pytest.approx(2.5, rel=1e-6), 2: None, 3: 3.0}


BINS = 544
#: Metres of a nanosecond on its way there and back.
HALF = 299792458.0e-9 / 2


def raw(spark):
    """Two products of twelve shots with two peaks; some fail one of the quality rules each."""
    r = np.random.default_rng(3)
    first, second, waves = [], [], {}
    for k in range(12):
        loc = np.arange(BINS, dtype=float)[::-1]  # the ground comes first
        x = loc * HALF
        begin, end, top, ground = 20.0, 70.0, 40.0 + k % 3, 63.0
        wf = 0.05 + 0.6 * np.exp(-((x - top) ** 2) / 8) + 0.5 * np.exp(-((x - ground) ** 2) / 2) + r.normal(0, 0.004, BINS)
        waves[k] = (x, wf, 2.0 + k / 4, begin, end)
        peaks = 1 if k == 7 else 2
        far = float(x.max())
        first.append((k, 1, loc.tolist(), 0.0, 0.0, wf.tolist(), pulse(2.0 + k / 4).tolist(), 0.05, 0.004))
        second.append((k, 1, None if k == 8 else 10.5, 200.0, 4.0e7 + 5.0e6, 100.0 if k != 9 else 500.0, 0.5, 0.1, 0.2, begin - far if k != 10 else -90.0, end - far, 40.0 - far, peaks, [ground - far, top - far] + [1e38] * 4, [0.5, 0.6] + [1e38] * 4, [1 / HALF, 2 / HALF] + [1e38] * 4))
    w = spark.createDataFrame(first, "record_index long, shot_number int, rec_wf_sample_loc array<double>, rec_wf_response_end_time double, tx_wf_peak_time double, rec_wf array<double>, tx_wf array<double>, noise_mean double, noise_sd double")
    e = spark.createDataFrame(second, "record_index long, shot_number int, lat double, lon double, time double, elevation double, elevation_correction double, delta_ellipse double, geoid double, sig_begin_offset double, sig_end_offset double, centroid_offset double, num_gaussian_peaks int, gaussian_mu array<double>, gaussian_amp array<double>, gaussian_sigma array<double>")
    return w, e, waves


def test_raw_shots_to_biomass(spark):
    w, e, waves = raw(spark)
    srtm = spark.createDataFrame([(0, 0, 100.0)], "iy int, ix int, srtm double")
    shots = pipelines.raw_shots(w, e, srtm, (10.0, 1.0, 1, -160.0, 1.0, 1))
    assert shots.count() == 12 and {round(q.lon, 6) for q in shots.select("lon").collect()} == {-160.0}
    done = pipelines.preprocess(shots).collect()
    assert sorted(q.record_index for q in done) == [0, 1, 2, 3, 4, 5, 6, 11]
    for q in done:
        x, wf, sigma, begin, end = waves[q.record_index]
        assert q.dist == pytest.approx(x.tolist(), abs=1e-9)
        smooth = one_by_one(wf, sigma) - 0.05
        want = np.where((x > begin) & (x < end), np.maximum(smooth, 0), 0)
        assert q.wf == pytest.approx(want.tolist(), abs=1e-5)
        assert q.time == 4.5e7 + 946728000 and q.acquired.year == 2001
    unknown = pipelines.preprocess(pipelines.raw_shots(w, e))
    assert unknown.count() == 9  # the surface model is not there to judge by
    ancillary = shots.select("record_index", "shot_number", F.lit(450).alias("ecoregion"), F.lit(2).alias("igbp"), F.lit(None).cast("int").alias("nlcd"), F.lit(None).cast("int").alias("eosd"), F.lit(80.0).alias("treecover2000_mean"), F.lit(False).alias("burned"))
    ancillary = ancillary.withColumn("senergy", F.lit(0.0))  # asks for voltages of the converter
    metrics = [m for m in lidar.HEIGHTS if m != "senergy"]
    found = pipelines.lidar_biomass(shots, ancillary, metrics).collect()
    assert len(found) == 8 and all(q.biomass is not None and math.isfinite(q.biomass) and q.biomass > 0 for q in found)
    assert {q.allometric_eq for q in found} <= set(allometry.EQUATIONS)
    heights = {q.record_index: q.VH for q in found}
    assert all(h == pytest.approx(63.0 - 20.0, abs=1e-6) for h in heights.values())
