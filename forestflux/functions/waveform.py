"""Lidar waveforms as array expressions. `dist` holds the distance of each bin (descending elevation ascends in distance)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EPOCH_2000_NOON, NS_TO_S, SPEED_OF_LIGHT
from .nulls import safe_div

_HALF_LIGHT = NS_TO_S * SPEED_OF_LIGHT / 2


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def bin_distances(loc: Column, end_time: Column, peak_time: Column) -> Column:
    """Distance in metres of every sample location (ns)."""
    return F.transform(loc, lambda x: (x + end_time - peak_time) * F.lit(_HALF_LIGHT))


def gaussian(x: Column, amp: Column, mu: Column, sigma: Column) -> Column:
    return amp * F.exp(-F.pow(x - mu, F.lit(2.0)) / (2.0 * sigma * sigma))


def modelled(dist: Column, mu: Column, amp: Column, sigma_ns: Column, noise: Column) -> Column:
    """Sum of the fitted peaks at every bin, less the noise; peaks with a NULL part don't count."""
    peaks = F.arrays_zip(mu.alias("m"), amp.alias("a"), sigma_ns.alias("s"))
    one = lambda x, p: F.coalesce(gaussian(x, p["a"], p["m"], p["s"] * F.lit(_HALF_LIGHT)), F.lit(0.0))
    return F.transform(dist, lambda x: F.aggregate(peaks, F.lit(0.0), lambda s, p: s + one(x, p)) - noise)


def valid_area(dist: Column, wf: Column, begin: Column, end: Column) -> Column:
    """The waveform where begin < bin < end, negative values as 0, and 0 elsewhere."""
    return F.zip_with(dist, wf, lambda b, w: F.when((b > begin) & (b < end), F.greatest(w, F.lit(0.0))).otherwise(F.lit(0.0)))


def running_sum(wf: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("a"))
    step = lambda acc, w: F.struct((acc["s"] + F.coalesce(w, F.lit(0.0))).alias("s"), F.array_append(acc["a"], acc["s"] + F.coalesce(w, F.lit(0.0))).alias("a"))
    return F.aggregate(wf, start, step)["a"]


def percentile_distance(dist: Column, cumulative: Column, p: float) -> Column:
    """Greatest distance at which the running sum exceeds p per cent of the whole; NULL if none does."""
    limit = F.element_at(cumulative, -1) * F.lit(p / 100.0)
    over = F.zip_with(dist, cumulative, lambda d, c: F.when(c > limit, d))
    return F.array_max(over)


def mean_distance(dist: Column, wf: Column) -> Column:
    return safe_div(total(F.zip_with(dist, wf, lambda d, w: d * w)), total(wf))


def quadratic_mean_distance(dist: Column, wf: Column) -> Column:
    return F.sqrt(safe_div(total(F.zip_with(dist, wf, lambda d, w: d * d * w)), total(wf)))


def variance_distance(dist: Column, wf: Column, mean: Column) -> Column:
    return safe_div(total(F.zip_with(dist, wf, lambda d, w: (d - mean) * (d - mean) * w)), total(wf))


def at_maximum(dist: Column, wf: Column) -> Column:
    """Distance of the first bin with the greatest value."""
    return F.get(dist, F.array_position(wf, F.array_max(wf)).cast("int") - 1)


def half_power(dist: Column, wf: Column, noise: Column) -> tuple[Column, Column]:
    """Least and greatest distance of the raw waveform at or above half of its maximum over the noise."""
    level = (F.array_max(wf) - noise) / 2.0
    there = F.zip_with(dist, wf, lambda d, w: F.when(w >= level, d))
    return F.array_min(there), F.array_max(there)


def ground_of_peaks(mu: Column, amp: Column) -> Column:
    """Of the first two fitted peaks the one with the larger amplitude, the first on ties; NULL counts as 0."""
    a, b = F.coalesce(F.get(amp, F.lit(0)), F.lit(0.0)), F.coalesce(F.get(amp, F.lit(1)), F.lit(0.0))
    return F.when(a >= b, F.get(mu, F.lit(0))).otherwise(F.get(mu, F.lit(1)))


def ground_of_waveform(dist: Column, wf: Column) -> Column:
    """Of the first two strict local maxima (in bin order) the higher one, the first on ties; a missing one is bin 0."""
    n = F.size(wf)
    peak = lambda i: (F.get(wf, i) > F.get(wf, i - 1)) & (F.get(wf, i) > F.get(wf, i + 1))
    peaks = F.filter(F.sequence(F.lit(1), n - 2), peak)
    one, two = F.coalesce(F.get(peaks, F.lit(0)), F.lit(0)), F.coalesce(F.get(peaks, F.lit(1)), F.lit(0))
    return F.get(dist, F.when(F.get(wf, one) >= F.get(wf, two), one).otherwise(two))


def front_slope(d: Column, amp: Column, begin: Column, noise: Column, sd: Column, time: Column) -> Column:
    """Slope of the front edge by the campaign's noise threshold, at least 0, as degrees, capped at 15."""
    n = F.when(time < F.lit(float(EPOCH_2000_NOON + 289742400)), F.lit(3.5)).otherwise(F.lit(7.5))
    raw = safe_div(amp - (noise + n * sd), d - begin)
    return F.when(raw.isNotNull(), F.least(F.lit(0.5744) + F.lit(19.7762) * F.greatest(raw, F.lit(0.0)), F.lit(15.0)))


def energy_share(dist: Column, wf: Column, inner: tuple[Column, Column], outer: tuple[Column, Column]) -> Column:
    return safe_div(total(valid_area(dist, wf, *inner)), total(valid_area(dist, wf, *outer)))


def campaign_dummy(time: Column, first: float, last: float, inside: int = 0) -> Column:
    """0 inside the window and 1 outside, unless `inside` is 1."""
    return F.when(time.between(first, last), inside).otherwise(1 - inside)


def volt_step(i: int) -> float:
    """Voltage of digital count i; the converter has two ranges with a joint between."""
    # 127 steps of 0.006675 from -0.195279, one of 0.006478, then steps of 0.006198.
    return round(-0.195279 + 0.006675 * min(i, 127) + (0.006478 if i > 127 else 0.0) + 0.006198 * max(0, i - 128), 6)


def digital_counts(wf: Column) -> Column:
    """Digital count of every voltage; NULL voltages are the lowest, unknown ones an error."""
    pairs = [F.lit(x) for i in range(256) for x in (int(round(volt_step(i) * 1e6)), i)]
    table = F.create_map(*pairs)
    key = lambda v: F.round(F.coalesce(v, F.lit(volt_step(0))) * 1e6).cast("int")
    return F.transform(wf, lambda v: F.coalesce(F.try_element_at(table, key(v)), F.raise_error(F.lit("unknown voltage")).cast("int")))


def start_energy(dist: Column, counts: Column, ground: Column, end: Column) -> Column:
    inside = F.zip_with(dist, counts, lambda d, c: F.when((d > ground) & (d < end), c.cast("double")))
    return F.lit(-4.397006) + F.lit(0.006208) * total(inside) * 2.0
