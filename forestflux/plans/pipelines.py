"""The three end-to-end jobs: country emissions, lidar biomass, and scenes to carbon pools. Each is one lazy plan over all tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EPOCH_2000_NOON
from ..functions import pulses
from ..functions.grid import cell_area_ha
from ..functions.waveform import bin_distances, valid_area
from ..operators import aggregate, allometry, emissions, filters, joins, landsat, lidar, timeseries
from ..operators.training import acquisition_time
from ..sources import catalog


def country_emissions(static: DataFrame, fire: DataFrame, countries: DataFrame, first: int, last: int, step: float) -> DataFrame:
    """Loss-year emissions, split by fire, area-weighted, summed per country and year.

    static: iy, ix, lat, lon, agb, lossyear; fire: iy, ix, year, burned; countries: id, code, ring.
    """
    split = emissions.split_by_fire(emissions.lost_cells(static, fire, first, last))
    values = ["emissions", "emissions_fire", "emissions_clearing"]
    area = cell_area_ha(F.col("lat"), step, step)
    masked = joins.polygon_mask(split, countries).withColumns({v: F.col(v) * area for v in values})
    return aggregate.regional_totals_of_years(masked, countries.select(F.col("id").alias("region"), "code"), values, first, last)


def raw_shots(waveforms: DataFrame, elevations: DataFrame, srtm: DataFrame | None = None, grid: tuple | None = None) -> DataFrame:
    """Shots of the two lidar products by record and shot number, with distances of the bins, elevations and the surface model's.

    waveforms: rec_wf, tx_wf, rec_wf_sample_loc, rec_wf_response_end_time, tx_wf_peak_time, noise_mean, noise_sd; elevations: lat, lon,
    time, elevation, elevation_correction, delta_ellipse, geoid, offsets and Gaussian peaks. srtm (iy, ix, srtm) is read at the nearest
    cell of the grid that nearest_lookup takes; without it the surface model is unknown.
    """
    both = waveforms.join(catalog.glah14(elevations), ["record_index", "shot_number"])
    if srtm is not None:
        both = joins.nearest_lookup(both, srtm, "srtm", *grid).drop("iy", "ix")
    else:
        both = both.withColumn("srtm", F.lit(None).cast("double"))
    return filters.evaluated(both.withColumns(
        {
            "dist": bin_distances(F.col("rec_wf_sample_loc"), F.col("rec_wf_response_end_time"), F.col("tx_wf_peak_time")),
            "glas_elev": F.col("elevation") + F.col("elevation_correction"),
            "srtm_elev": F.col("srtm") + F.col("delta_ellipse") + F.col("geoid"),
        }
    ))


def preprocess(shots: DataFrame) -> DataFrame:
    """Usable shots with smoothed waveforms less noise (wf), edge extents within bounds, and times as epoch seconds and timestamps.

    Pulses are fitted for shots that pass the cheap filter only; where there is no transmitted pulse, the fallback's width smooths.
    """
    good = filters.waveform_quality(shots)
    smooth = pulses.smoothed(F.col("rec_wf"), pulses.pulse_sigma(F.col("tx_wf")))
    offset = lambda c: F.col(c) + F.array_max("dist")
    wf = valid_area(F.col("dist"), F.transform("__smooth", lambda w: w - F.col("noise_mean")), offset("sig_begin_offset"), offset("sig_end_offset"))
    good = filters.evaluated(filters.evaluated(good.withColumn("__smooth", smooth)).withColumn("wf", wf).drop("__smooth"))
    kept = filters.edge_extents(filters.evaluated(lidar.add_metrics(good, ["wf_extent", "leading_edge_extent", "trailing_edge_extent"])))
    return kept.withColumns({"acquired": acquisition_time(F.col("time")), "time": F.col("time") + EPOCH_2000_NOON})


def lidar_biomass(shots: DataFrame, ancillary: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("record_index", "shot_number")) -> DataFrame:
    """Height metrics, equations and biomass of every usable shot; raw shots (with tx_wf) are pre-processed first.

    Cheap predicates come before the metrics, which no shot needs that fails them.
    """
    if "tx_wf" in shots.columns:
        usable = preprocess(shots)
    else:
        usable = filters.edge_extents(filters.evaluated(lidar.add_metrics(filters.waveform_quality(shots), ["wf_extent", "leading_edge_extent", "trailing_edge_extent"])))
    measured = filters.evaluated(lidar.add_metrics(usable, metrics))
    return allometry.apply_allometry(measured.join(ancillary, list(keys)))


def pools_from_series(stack: DataFrame, ancillary: DataFrame, landcover: DataFrame | None = None) -> DataFrame:
    """Gap filling, change detection and carbon pools of a seven-year biomass stack (iy, ix, year, agb).

    ancillary: iy, ix, is_tropics, elevation, precipitation; with landcover the pools are kept in forest only.
    """
    filled = timeseries.fill_gaps(stack, "agb")
    first = stack.agg(F.min("year").alias("first"))
    found = timeseries.change_points(filled)
    rows = found.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6)))).join(F.broadcast(first))
    smooth = rows.select("iy", "ix", (F.col("first") + F.col("i")).alias("year"), F.get("prediction", F.col("i")).alias("agb"), "breakpoint", "pvalue")
    pools = emissions.carbon_pools(smooth.join(ancillary, ["iy", "ix"], "left"))
    return emissions.forest_mask(pools, landcover, list(emissions.POOLS)) if landcover is not None else pools


def scene_features(pixels: DataFrame, climate: DataFrame, terrain: DataFrame) -> DataFrame:
    """Season composite of scene pixels with the nearest climate and terrain cells, complete rows only."""
    scenes = landsat.common_projection(pixels, ("scene_row",)) if "scene_row" in pixels.columns else pixels
    rows = landsat.seasonal_average(scenes).withColumn("NIR_V", F.col("SR_B4") * F.col("NDVI"))
    out = rows.join(climate, ["iy", "ix"], "left").join(terrain, ["iy", "ix"], "left")
    return filters.complete_rows(out, [c for c in out.columns if c not in ("iy", "ix")])
