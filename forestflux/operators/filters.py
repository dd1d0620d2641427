"""Boxes, masks and membership filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import true


def half_open_box(df: DataFrame, lat0: float, lat1: float, lon0: float, lon1: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """min < v <= max on both axes."""
    a, b = F.col(lat), F.col(lon)
    return df.where((a > lat0) & (a <= lat1) & (b > lon0) & (b <= lon1))


def closed_box(df: DataFrame, lat0: float, lat1: float, lon0: float, lon1: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """min <= v <= max on both axes; a point on a border is in both boxes that share it."""
    return df.where(F.col(lat).between(lat0, lat1) & F.col(lon).between(lon0, lon1))


def keep_where(df: DataFrame, condition: Column, columns: list[str], other: Column | None = None) -> DataFrame:
    """Columns stay where the condition is true, else become NULL or `other`; rows all stay."""
    return df.withColumns({c: F.when(true(condition), F.col(c)).otherwise(other) for c in columns})


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is NULL, NaN or infinite."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c)
        ok = ok & x.isNotNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            ok = ok & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(ok)


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for those arguments that are not None; a tuple is an inclusive range."""
    for c, v in wanted.items():
        if isinstance(v, tuple):
            df = df.where(F.col(c).between(*v))
        elif v is not None:
            df = df.where(F.col(c) == v)
    return df


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows that depend on their keys alone."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def sample_per_class(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """At most n rows of every class, chosen by their keys alone."""
    from pyspark.sql import Window

    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def evaluated(df: DataFrame) -> DataFrame:
    """df as it is, computed before what comes after: later filters and columns refer to its columns and don't repeat their expressions.

    Without it Spark moves a filter on a height below all layers of waveform expressions, each written out where it is used.
    """
    return df.withColumn("__row", F.monotonically_increasing_id()).where(F.col("__row") >= 0).drop("__row")


def waveform_quality(df: DataFrame) -> DataFrame:
    """Usable lidar shots: located, two peaks or more, a clear signal, near the surface model, sane signal bounds."""
    surface = F.abs(F.coalesce(F.col("srtm_elev"), F.col("glas_elev")) - F.col("glas_elev"))
    return df.where(
        F.col("lat").isNotNull() & (F.col("num_gaussian_peaks") >= 2) & (F.array_max("rec_wf") >= 2 * F.col("noise_mean")) & (surface <= 30)
        & (F.abs("sig_begin_offset") <= 70) & F.abs("sig_end_offset").between(1, 20)
    )


def edge_extents(df: DataFrame, lead: float = 0.5, trail: float = 0.35) -> DataFrame:
    """Shots whose leading and trailing edges are small against the waveform's extent."""
    return df.where((F.col("leading_edge_extent") <= lead * F.col("wf_extent")) & (F.col("trailing_edge_extent") <= trail * F.col("wf_extent")))


#: Equations built for leaf-off data, whose seasons are turned round.
LEAF_OFF = ("conus_conifer_popescu_2011", "palearctic_shang_and_chazette_2014")


def leaf_on(df: DataFrame, time: str = "time", lat: str = "lat", equation: str = "allometric_eq") -> DataFrame:
    """Shots of the growing season, two late campaigns counted as southern summer; the tropics all year.

    Shots from 2009-03-01 on and those of 2003-03-20 to 29 are dropped for good.
    """
    t, y = F.col(time), F.col(lat)
    day = lambda s: F.to_timestamp(F.lit(s))
    late = ((t >= day("2006-10-25")) & (t < day("2006-11-29"))) | ((t >= day("2008-11-25")) & (t < day("2008-12-19")))
    special = F.col(equation).isin(*LEAF_OFF)
    north_on = (F.month(t) >= 5) & ~late
    south_on = (F.month(t) < 5) | late
    out = ((y > 23.5) & F.when(special, ~south_on).otherwise(~north_on)) | ((y < -23.5) & F.when(special, ~north_on).otherwise(~south_on))
    usable = (t < day("2009-03-01")) & ~((t >= day("2003-03-20")) & (t < day("2003-03-30")))
    return df.where(true(usable) & ~true(out))
