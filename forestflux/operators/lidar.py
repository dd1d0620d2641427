"""Height metrics of lidar shots as a lazily built graph of named columns.

A metric is a function from a resolver to a Column; asking for some metrics adds just the arrays and distances they need, layer by
layer, so that Spark computes each intermediate once. Names are those of the published metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waveform as W
from ..functions.nulls import clip, safe_div

C = F.col

#: Arrays and distances: name -> (names that must exist first, expression). A distance grows towards the ground.
DISTANCES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {}
#: Heights: name -> (needs, expression).
HEIGHTS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {}


def _d(name: str, *needs: str):
    return lambda f: DISTANCES.setdefault(name, (needs, f)) and f


def _offset(c: str) -> Callable[[], Column]:
    return lambda: C(c) + F.array_max("dist")


DISTANCES["sig_begin"] = ((), _offset("sig_begin_offset"))
DISTANCES["sig_end"] = ((), _offset("sig_end_offset"))
DISTANCES["centroid"] = ((), _offset("centroid_offset"))
DISTANCES["gaussian_fit"] = ((), lambda: F.slice(F.transform("gaussian_mu", lambda m: m + F.array_max("dist")), F.lit(1), C("num_gaussian_peaks")))
DISTANCES["wf"] = (("sig_begin", "sig_end"), lambda: W.valid_area(C("dist"), F.transform("rec_wf", lambda w: w - C("noise_mean")), C("sig_begin"), C("sig_end")))
DISTANCES["wf_modeled"] = (("sig_begin", "sig_end", "gaussian_fit"), lambda: W.valid_area(C("dist"), W.modelled(C("dist"), C("gaussian_fit"), F.slice("gaussian_amp", F.lit(1), C("num_gaussian_peaks")), F.slice("gaussian_sigma", F.lit(1), C("num_gaussian_peaks")), C("noise_mean")), C("sig_begin"), C("sig_end")))
DISTANCES["ground_peak"] = (("gaussian_fit",), lambda: F.array_max("gaussian_fit"))
DISTANCES["first_peak"] = (("gaussian_fit",), lambda: F.array_min("gaussian_fit"))
DISTANCES["start_of_ground_peak"] = (("ground_peak", "sig_end"), lambda: C("ground_peak") - (C("sig_end") - C("ground_peak")))
DISTANCES["adj_ground_peak"] = (("gaussian_fit",), lambda: W.ground_of_peaks(C("gaussian_fit"), C("gaussian_amp")))
DISTANCES["adj_ground_peak_actual_wf"] = (("wf",), lambda: W.ground_of_waveform(C("dist"), C("wf")))
DISTANCES["bottom_of_canopy"] = (("adj_ground_peak_actual_wf",), lambda: C("adj_ground_peak_actual_wf") - 0.5)
DISTANCES["wf_above_ground"] = (("wf", "sig_begin", "adj_ground_peak_actual_wf"), lambda: W.valid_area(C("dist"), C("wf"), C("sig_begin"), C("adj_ground_peak_actual_wf")))
DISTANCES["wf_canopy"] = (("wf", "sig_begin", "bottom_of_canopy"), lambda: W.valid_area(C("dist"), C("wf"), C("sig_begin"), C("bottom_of_canopy")))
DISTANCES["quadratic_mean"] = (("wf_above_ground",), lambda: W.quadratic_mean_distance(C("dist"), C("wf_above_ground")))
DISTANCES["mean"] = (("wf_above_ground",), lambda: W.mean_distance(C("dist"), C("wf_above_ground")))
DISTANCES["wf_max_e"] = (("wf",), lambda: W.at_maximum(C("dist"), C("wf")))
DISTANCES["leading_edge"] = ((), lambda: W.half_power(C("dist"), C("rec_wf"), C("noise_mean"))[0])
DISTANCES["trailing_edge"] = ((), lambda: W.half_power(C("dist"), C("rec_wf"), C("noise_mean"))[1])
for _array, _suffix, _percents in (
    ("wf", "", (5, 10, 20, 25, 30, 40, 50, 75, 80, 90)),
    ("wf_modeled", "_modeled_wf", (90, 75, 50, 40, 10)),
    ("wf_above_ground", "_of_sig_beg_and_adj_ground_actual_wf", (10, 80, 90)),
    ("wf_canopy", "_canopy", (5, 10, 20, 30, 50, 75, 80)),
):
    DISTANCES[f"sum_{_array}"] = ((_array,), lambda a=_array: W.running_sum(C(a)))
    for _p in _percents:
        DISTANCES[f"pct_{_p:02d}{_suffix}"] = ((f"sum_{_array}",), lambda a=_array, p=_p: W.percentile_distance(C("dist"), C(f"sum_{a}"), p))


def _height(name: str, top: str, bottom: str) -> None:
    HEIGHTS[name] = ((top, bottom), lambda: C(bottom) - C(top))


_GROUND, _END = "adj_ground_peak_actual_wf", "sig_end"
_height("VH", "sig_begin", "ground_peak")
for _name, _p in (("H10_Baccini", 90), ("H25_Baccini", 75), ("H60_Baccini", 40), ("HOME_Baccini", 50)):
    _height(_name, f"pct_{_p}_modeled_wf", _END)
_height("CANOPY_DEP", "sig_begin", "start_of_ground_peak")
_height("ht_adjusted", "sig_begin", "adj_ground_peak")
_height("QMCH", "quadratic_mean", _GROUND)
_height("MeanH", "mean", _GROUND)
_height("HOME_Yavasli", "centroid", "adj_ground_peak")
for _p in (25, 50, 75, 90):
    _height(f"h{_p}_Neigh", f"pct_{_p}", _GROUND)
for _p in (5, 10, 20, 25, 30, 50, 75, 80, 90):
    _height(f"h{_p:02d}_Nelson", f"pct_{_p:02d}", _END)
for _p in (10, 80, 90):
    _height(f"h{_p}_p12", f"pct_{_p}_of_sig_beg_and_adj_ground_actual_wf", _GROUND)
for _p in (5, 10, 20, 30, 50, 75, 80):
    _height(f"h{_p:02d}_canopy", f"pct_{_p:02d}_canopy", "bottom_of_canopy")
_height("trail_Nelson", "adj_ground_peak", _END)
_height("lead_Nelson", "adj_ground_peak", _END)
_height("leading_edge_extent", "sig_begin", "pct_90_modeled_wf")
_height("trailing_edge_extent", "pct_10_modeled_wf", _END)
_height("sig_beg_to_highest_energy", "sig_begin", "wf_max_e")
HEIGHTS["wf_extent"] = (("sig_begin", _END), lambda: clip(C(_END) - C("sig_begin"), low=0.0))
HEIGHTS["pct_HOME_Yavasli"] = (("HOME_Yavasli", "ht_adjusted"), lambda: safe_div(C("HOME_Yavasli"), C("ht_adjusted")))
HEIGHTS["CANOPY_ENE"] = (("wf_modeled", "sig_begin", "sig_end", "start_of_ground_peak"), lambda: W.energy_share(C("dist"), C("wf_modeled"), (C("sig_begin"), C("start_of_ground_peak")), (C("sig_begin"), C("sig_end"))))
HEIGHTS["Height_35_to_40"] = (("wf", "sig_begin", _GROUND), lambda: W.energy_share(C("dist"), C("wf"), (C(_GROUND) - 40.0, C(_GROUND) - 35.0), (C("sig_begin"), C(_GROUND))))
HEIGHTS["f_slope"] = (("wf", "wf_max_e", "sig_begin"), lambda: W.front_slope(C("wf_max_e"), F.array_max("wf"), C("sig_begin"), C("noise_mean"), C("noise_sd"), C("time")))
HEIGHTS["senergy"] = ((_GROUND, "sig_end"), lambda: W.start_energy(C("dist"), W.digital_counts(C("rec_wf")), C(_GROUND), C("sig_end")))
HEIGHTS["wf_variance"] = (("wf_above_ground", "mean"), lambda: W.variance_distance(C("dist"), C("wf_above_ground"), C("mean")))
HEIGHTS["wf_energy"] = (("wf",), lambda: W.total(C("wf")))
#: Campaign windows in epoch seconds (2006-05-24 to 2006-06-27 twice, 2005-10-21 to 2005-11-24). Dummies are 0 inside.
CAMPAIGNS = {"acq3_Neigh": (1148428800.0, 1151366400.0), "acq2_Nelson": (1148428800.0, 1151366400.0), "acq3_Nelson": (1129852800.0, 1132790400.0)}
for _name, _window in CAMPAIGNS.items():
    HEIGHTS[_name] = ((), lambda w=_window: W.campaign_dummy(C("time"), *w))


def _order(names: list[str], df_columns: set[str]) -> list[str]:
    """What is needed for the names, each after all that it needs."""
    out: list[str] = []
    state: dict[str, int] = {}
    todo = [(n, False) for n in reversed(names)]
    while todo:
        name, ready = todo.pop()
        if ready:
            out.append(name)
            continue
        if name in state or (name in df_columns and name not in names):
            continue
        state[name] = 1
        if name not in DISTANCES and name not in HEIGHTS:
            raise NotImplementedError(f"no metric named {name}")
        needs = (DISTANCES.get(name) or HEIGHTS[name])[0]
        todo.append((name, True))
        todo += [(n, False) for n in needs if n not in state]
    return out


def add_metrics(df: DataFrame, names: list[str], recalculate: bool = False) -> DataFrame:
    """Adds the named metrics; columns that are there already stay unless recalculate."""
    have = set(df.columns)
    wanted = [n for n in names if recalculate or n not in have]
    level: dict[str, int] = {}
    layers: dict[int, dict[str, Column]] = {}
    for name in _order(wanted, have):
        needs, make = DISTANCES.get(name) or HEIGHTS[name]
        level[name] = 1 + max((level[n] for n in needs if n in level), default=0)
        layers.setdefault(level[name], {})[name] = make()
    for k in sorted(layers):
        df = df.withColumns(layers[k])
    extra = [n for n in level if n not in names and n not in have]
    return df.drop(*extra)
