"""Queries over lidar shots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import waveform as W
from ..operators import allometry, filters, lidar
from ..sources import adapters as A
from .registry import query

_V = f"""select *, case when d > 600000.0::double - 7.5625 and d < 600000.0::double - 1.0625 then greatest(w - 0.05::double, 0) else 0 end v from ({A.SQL_BINS})"""
_CUM = f"select *, sum(v) over (partition by vec_id order by i rows unbounded preceding) c, sum(v) over (partition by vec_id) t from ({_V})"
_PCT = (5, 10, 20, 25, 30, 40, 50, 75, 80, 90)


def _metrics(spark, d, names):
    df = lidar.add_metrics(A.shots(spark, d), names)
    return df.select("vec_id", *[F.round(n, 5).alias(n) for n in names])


@query("h9_percentile_distances", f"select vec_id, {', '.join(f'round(max(case when c > t * {p} / 100.0::double then d end), 5) pct_{p:02d}' for p in _PCT)} from ({_CUM}) group by vec_id")
def h9(spark, d):
    return _metrics(spark, d, [f"pct_{p:02d}" for p in _PCT])


@query("h25_nelson_heights", f"select vec_id, {', '.join(f'round(600000.0::double - 1.0625 - max(case when c > t * {p} / 100.0::double then d end), 5) h{p:02d}_Nelson' for p in _PCT if p != 40)} from ({_CUM}) group by vec_id")
def h25(spark, d):
    return _metrics(spark, d, [f"h{p:02d}_Nelson" for p in _PCT if p != 40])


_PEAKS = f"select a.vec_id, a.i, row_number() over (partition by a.vec_id order by a.i) k, a.v, a.d from ({_V}) a join ({_V}) p on p.vec_id = a.vec_id and p.i = a.i - 1 join ({_V}) n on n.vec_id = a.vec_id and n.i = a.i + 1 where a.v > p.v and a.v > n.v"
_GROUND = f"""select s.vec_id, case when coalesce(p1.v, s.v) >= coalesce(p2.v, s.v) then coalesce(p1.d, s.d) else coalesce(p2.d, s.d) end g from (select * from ({_V}) where i = 0) s
 left join (select * from ({_PEAKS}) where k = 1) p1 using (vec_id) left join (select * from ({_PEAKS}) where k = 2) p2 using (vec_id)"""


@query("h15_ground_of_waveform", f"select vec_id, round(g, 5) adj_ground_peak_actual_wf, round(g - 0.5, 5) bottom_of_canopy from ({_GROUND})")
def h15(spark, d):
    return _metrics(spark, d, ["adj_ground_peak_actual_wf", "bottom_of_canopy"])


_ABOVE = f"select b.*, g, case when d > 600000.0::double - 7.5625 and d < g then v else 0 end u from ({_V}) b join ({_GROUND}) using (vec_id)"


@query("h17_mean_heights", f"select vec_id, round(max(g) - sum(u * d) / nullif(sum(u), 0), 5) MeanH, round(max(g) - sqrt(sum(u * d * d) / nullif(sum(u), 0)), 5) QMCH from ({_ABOVE}) group by vec_id")
def h17(spark, d):
    return _metrics(spark, d, ["MeanH", "QMCH"])


@query(
    "h12_gaussian_heights",
    """select vec_id, 600000.0::double - (600000.0::double - 7.5625) VH, 600000.0::double ground_peak, 600000.0::double - 1.25 * (vec_id % 6) first_peak,
 case when vec_id % 6 = 0 then 600000.0::double when embedding[1] + 0.6::double >= embedding[2] + 0.6::double then 600000.0::double else 600000.0::double - 1.25 end adj_ground_peak from embeddings""",
)
def h12(spark, d):
    df = lidar.add_metrics(A.shots(spark, d).withColumn("gaussian_amp", F.slice("gaussian_amp", F.lit(1), F.col("num_gaussian_peaks"))), ["VH", "ground_peak", "first_peak", "adj_ground_peak"])
    return df.select("vec_id", "VH", "ground_peak", "first_peak", "adj_ground_peak")


@query("h18_energy", f"select vec_id, round(sum(v), 5) wf_energy, round(arg_max(d, v - i * 1e-12), 5) wf_max_e from ({_V}) group by vec_id")
def h18(spark, d):
    return _metrics(spark, d, ["wf_energy", "wf_max_e"])


@query("h19_half_power_edges", f"select vec_id, round(min(case when w >= (m - 0.05::double) / 2 then d end), 5) leading_edge, round(max(case when w >= (m - 0.05::double) / 2 then d end), 5) trailing_edge from (select *, max(w) over (partition by vec_id) m from ({A.SQL_BINS})) group by vec_id")
def h19(spark, d):
    return _metrics(spark, d, ["leading_edge", "trailing_edge"])


_MODEL = f"""select vec_id, i, d, case when d > 600000.0::double - 7.5625 and d < 600000.0::double - 1.0625 then greatest(sum(a * exp(-pow(d - mu, 2) / (2 * s * s))) - 0.05::double, 0) else 0 end v from
 (select vec_id, i, 600000.0::double - 0.125 * i d, k, 600000.0::double - 1.25 * k mu, cast(embedding[k + 1] as double) + 0.6::double a, (4.0::double + vec_id % 5) * 1e-9::double * 299792458.0::double / 2 s
  from embeddings, range(64) t(i), range(6) u(k) where k <= vec_id % 6) group by vec_id, i, d"""


@query("h22_canopy_energy", f"select vec_id, round(sum(case when d < 600000.0::double + 1.0625 then v else 0 end) / nullif(sum(v), 0), 5) CANOPY_ENE from ({_MODEL}) group by vec_id")
def h22(spark, d):
    return _metrics(spark, d, ["CANOPY_ENE"])


@query("h10_baccini_heights", f"with c as (select *, sum(v) over (partition by vec_id order by i rows unbounded preceding) c, sum(v) over (partition by vec_id) t from ({_MODEL})) select vec_id, {', '.join(f'round(600000.0::double - 1.0625 - max(case when c > t * {p} / 100.0::double then d end), 5) {n}' for n, p in (('H10_Baccini', 90), ('H25_Baccini', 75), ('H60_Baccini', 40), ('HOME_Baccini', 50)))} from c group by vec_id")
def h10(spark, d):
    return _metrics(spark, d, ["H10_Baccini", "H25_Baccini", "H60_Baccini", "HOME_Baccini"])


@query("h20_front_slope", f"select vec_id, round(least(0.5744::double + 19.7762::double * greatest((max(v) - (0.05::double + (case when vec_id * 100000 + 1128000000 < 1236470400 then 3.5 else 7.5 end) * 0.01::double)) / nullif(arg_max(d, v - i * 1e-12) - (600000.0::double - 7.5625), 0), 0), 15), 4) f_slope from ({_V}) group by vec_id")
def h20(spark, d):
    return lidar.add_metrics(A.shots(spark, d), ["f_slope"]).select("vec_id", F.round("f_slope", 4).alias("f_slope"))


@query("h24_campaign_dummies", "select vec_id, cast(not (vec_id * 100000 + 1128000000 between 1148428800 and 1151366400) as int) acq3_Neigh, cast(not (vec_id * 100000 + 1128000000 between 1129852800 and 1132790400) as int) acq3_Nelson from embeddings")
def h24(spark, d):
    return lidar.add_metrics(A.shots(spark, d), ["acq3_Neigh", "acq3_Nelson"]).select("vec_id", "acq3_Neigh", "acq3_Nelson")


@query("h23_start_energy", "select vec_id, round(-4.397006::double + 0.006208::double * 2 * sum(case when 600000 - 0.125 * i > 599995.0 and 600000 - 0.125 * i < 599998.9375 then cast(floor((embedding[i + 1] + 0.6::double) * 200) as int) end), 5) senergy from embeddings, range(64) t(i) group by vec_id")
def h23(spark, d):
    """Waveforms of voltages that the digitiser can produce, looked up in its table."""
    volts = F.array(*[F.lit(W.volt_step(i)) for i in range(256)])
    df = A.shots(spark, d).withColumn("rec_wf", F.transform("rec_wf", lambda w: F.get(volts, F.floor(w * 200).cast("int"))))
    return df.select("vec_id", F.round(W.start_energy(F.col("dist"), W.digital_counts(F.col("rec_wf")), F.lit(599995.0), F.lit(599998.9375)), 5).alias("senergy"))


@query("h13_all_heights")
def h13(spark, d):
    """Every registered height at once, but the voltage lookup, which needs digitiser voltages."""
    names = [n for n in lidar.HEIGHTS if n != "senergy"]
    return lidar.add_metrics(A.shots(spark, d), names).select("vec_id", *names)


_QUALITY = "select vec_id from (select vec_id, list_max(embedding) + 0.6::double m from embeddings) where vec_id % 97 <> 0 and vec_id % 6 >= 1 and m >= 0.9::double"


@query("b6_waveform_quality", _QUALITY)
def b6(spark, d):
    df = A.shots(spark, d).withColumns({"srtm_elev": F.when(F.col("vec_id") % 2 == 0, F.lit(100.0)), "glas_elev": F.lit(90.0), "noise_mean": F.lit(0.45)})
    return filters.waveform_quality(df).select("vec_id")


# Shots that reach every equation: eight variants of each vector, in the shared dialect of both engines.
_SHOT_COLUMNS = """vec_id
case when vec_id % 13 = 0 then 370 when vec_id % 17 = 1 then 347 else vec_id % 847 end ecoregion
case vec_id % 7 when 0 then 90 when 1 then 41 when 2 then 42 when 3 then 43 when 4 then 11 end nlcd
case vec_id % 5 when 0 then 81 when 1 then 211 when 2 then 10 end eosd
cast(vec_id % 17 as int) igbp
vec_id % 11 = 0 burned
(vec_id * 7 % 101) * 1.0e0 treecover2000_mean
(vec_id % 50) / 10e0 f_slope
(vec_id % 60) * 1.0e0 senergy
2 + (vec_id % 37) / 2e0 VH
3 + (vec_id % 23) / 3e0 QMCH
1 + (vec_id % 29) / 4e0 MeanH
(vec_id % 7) / 100e0 Height_35_to_40
(vec_id % 3) / 3e0 CANOPY_ENE
4 + (vec_id % 9) * 1.0e0 CANOPY_DEP
5 + (vec_id % 13) * 1.0e0 HOME_Baccini
8 + (vec_id % 12) * 1.0e0 H10_Baccini
6 + (vec_id % 11) * 1.0e0 H25_Baccini
4 + (vec_id % 10) * 1.0e0 H60_Baccini
3 + (vec_id % 5) * 1.0e0 HOME_Yavasli
(vec_id % 6) / 5e0 pct_HOME_Yavasli
6 + (vec_id % 8) * 1.0e0 ht_adjusted
cast(vec_id % 2 as int) acq3_Neigh
cast(vec_id % 3 = 0 as int) acq3_Nelson
1.5e0 + vec_id % 4 lead_Nelson
2.5e0 + vec_id % 5 trail_Nelson
11.0e0 + vec_id % 3 h10_p12
10.0e0 + vec_id % 20 h80_p12
14.0e0 + vec_id % 6 h90_p12
1.0e0 + vec_id % 3 h05_canopy
2.0e0 + vec_id % 5 h10_canopy
3.0e0 + vec_id % 7 h20_canopy
4.0e0 + vec_id % 9 h30_canopy
5.0e0 + vec_id % 11 h50_canopy
6.0e0 + vec_id % 13 h75_canopy
7.0e0 + vec_id % 15 h80_canopy
2.0e0 + vec_id % 6 h10_Nelson
4.0e0 + vec_id % 4 h25_Nelson
6.0e0 + vec_id % 5 h50_Nelson
8.0e0 + vec_id % 7 h75_Nelson
10.0e0 + vec_id % 9 h90_Nelson
3.0e0 + vec_id % 8 h25_Neigh
5.0e0 + vec_id % 10 h50_Neigh
7.0e0 + vec_id % 14 h75_Neigh
9.0e0 + vec_id % 16 h90_Neigh
(vec_id % 120) - 60.0e0 lat""".splitlines()
_SHOTS = f"select {', '.join(_SHOT_COLUMNS)} from (select vec_id * 8 + k vec_id from embeddings, range(8) t(k))"


def _shot_meta(spark, d):
    return A.read(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select((F.col("vec_id") * 8 + F.col("k")).alias("vec_id")).selectExpr(*_SHOT_COLUMNS)


#: The published equations once more, as plain SQL for DuckDB; the operator has them as coefficients.
_EQUATION_SQL = {
    "afrotropic": "-31.631 + 15.952 * HOME_Baccini + 7.832 * H10_Baccini - 18.805 * H60_Baccini - 38.428 * CANOPY_ENE + 8.285 * H25_Baccini",
    "tropical_asia": "-31.631 + 15.952 * HOME_Baccini + 7.832 * H10_Baccini - 18.805 * H60_Baccini - 38.428 * CANOPY_ENE + 8.285 * H25_Baccini",
    "tropical_neotropic": "-31.631 + 15.952 * HOME_Baccini + 7.832 * H10_Baccini - 18.805 * H60_Baccini - 38.428 * CANOPY_ENE + 8.285 * H25_Baccini",
    "australia_baccini_2012": "-31.631 + 15.952 * HOME_Baccini + 7.832 * H10_Baccini - 18.805 * H60_Baccini - 38.428 * CANOPY_ENE + 8.285 * H25_Baccini",
    "extratropical_neotropic": "2 * (0.41 + 0.53 * treecover2000_mean)",
    "ak_wetland_steep": "11.66 + 4.48 * VH - 6.27 * h50_Neigh - 2.10 * f_slope + 6.31 * acq3_Neigh",
    "ak_wetland_flat": "4.82 + 5.52 * VH - 5.17 * h50_Neigh - 2.22 * acq3_Neigh",
    "ak_hardwood": "37.16 + 5.28 * h90_Neigh - 4.34 * h25_Neigh + 15.95 * acq3_Neigh",
    "ak_conifer": "36.98 + 7.39 * h90_Neigh - 8.75 * h50_Neigh - 1.35 * acq3_Neigh",
    "ak_mixedwood": "5.76 + 4.54 * QMCH + 2.45 * VH + 18.96 * acq3_Neigh",
    "ak_burned": "5.05 + 5.46 * QMCH + 4.07 * ht_adjusted + 22.77 * acq3_Neigh",
    "w_canada_wetland": "4.82 + 5.52 * VH - 5.17 * h50_Neigh - 2.22 * acq3_Neigh",
    "w_canada_hardwood": "37.16 + 5.28 * h90_Neigh - 4.34 * h25_Neigh + 15.95 * acq3_Neigh",
    "w_canada_conifer": "4.03 + 5.31 * VH - 4.19 * h25_Neigh",
    "w_canada_mixedwood": "20.61 + 4.11 * QMCH + 2.26 * VH - 2.50 * h25_Neigh",
    "w_canada_burned": "5.05 + 5.46 * QMCH + 4.07 * ht_adjusted + 22.77 * acq3_Neigh",
    "e_canada_wetland_steep": "-1.20 + 6.08 * VH - 1.29 * f_slope",
    "e_canada_wetland_flat": "4.82 + 5.52 * VH - 5.17 * h50_Neigh - 2.22 * acq3_Neigh",
    "e_canada_hardwood": "9.32 + 3.92 * QMCH + 6.09 * h90_Neigh - 5.44 * h25_Neigh",
    "e_canada_conifer": "2.40 + 2.27 * VH + 5.54 * h90_Neigh - 9.13 * h25_Neigh",
    "e_canada_mixedwood_high": "14.63 + 5.74 * VH - 0.92 * senergy - 5.01 * h25_Neigh",
    "e_canada_mixedwood_low": "20.61 + 4.11 * QMCH + 2.26 * VH - 2.50 * h25_Neigh",
    "e_canada_burned": "5.05 + 5.46 * QMCH + 4.07 * ht_adjusted + 22.76 * acq3_Neigh",
    "conus_wetland": "3.623 * h50_Nelson + 4.980 * h90_Nelson",
    "conus_hardwood": "6.660 * h75_Nelson - 7.036 * h10_Nelson + 3.132 * trail_Nelson",
    "conus_mixedwood": "6.147 * h75_Nelson - 6.292 * h10_Nelson + 0.667 * lead_Nelson + 3.128 * trail_Nelson",
    "conus_burned": "4.331 * h90_Nelson - 4.222 * h75_Nelson",
    "zero_biomass": "0",
    "mexico_north": "-3.364 * h25_Nelson + 3.210 * h90_Nelson + 21.612 * acq3_Nelson",
    "mexico_north_conifer": "18.778 - 3.364 * h25_Nelson + 3.210 * h90_Nelson + 21.612 * acq3_Nelson",
    "mexico_south": "6.845 * h75_Nelson - 6.144 * h10_Nelson - 2.565 * trail_Nelson",
    "conus_conifer_nelson_2017": "6.147 * h75_Nelson - 6.292 * h10_Nelson + 0.667 * lead_Nelson + 3.128 * trail_Nelson",
    "conus_conifer_tsui_2012": "-7.144 - 12.925 * MeanH + 2.239 * h10_p12 + 14.019 * h90_p12",
    "conus_conifer_neigh_2013": "4.03 + 5.31 * VH - 4.19 * h25_Neigh",
    "conus_conifer_lu_2012": "case when Height_35_to_40 <= 0 or QMCH <= 0 then 0 else exp(2.10 + 1.56 * ln(QMCH) + 0.05 * ln(Height_35_to_40)) end",
    "conus_conifer_hudak_2012": "-16.54 + 21.18 * MeanH",
    "conus_conifer_hyde_2007": "7.042 + 16.141 * MeanH",
    "conus_conifer_popescu_2011": "-29.308 + 7.5429 * VH",
    "conus_conifer_skowronski_2007": "6.04 * MeanH",
    "conus_conifer_sun_2011": "-1.717 + 6.208 * h50_Neigh + 8.625 * h75_Neigh",
    "conus_conifer_anderson_2006": "29.954 + 14.297 * h50_Neigh",
    "wbe_confier": "4.72 + 5.95 * h90_Neigh - 5 * h25_Neigh",
    "wbe_mixed_hard_wood": "-7.03 + 8.84 * h75_Neigh - 5.09 * h25_Neigh",
    "eastern_boreal_eurasia": "-3.49 + 13.60 * h75_Neigh - 14.30 * h25_Neigh",
    "palearctic_wang_2013": "case when VH <= 0 then 0 else exp(1.48 + 1.09 * ln(VH)) end",
    "palearctic_takagi_2015": "2 * (24.5 + 6.70 * MeanH)",
    "palearctic_yavasli_2016": "24.11 - 3.84 * HOME_Yavasli + 2.44 * pct_HOME_Yavasli",
    "palearctic_brovkina_2015": "-99.9 + 12.8 * MeanH",
    "palearctic_alberti_2013": "2 * 3.33 * pow(MeanH, 1.27)",
    "palearctic_whrc": "13.7949 + 0.8912 * HOME_Baccini + 25.4467 * CANOPY_DEP - 18.1995 * VH",
    "palearctic_shang_and_chazette_2014": "2 * (42.36 + 0.24 * QMCH * QMCH)",
    "palearctic_simonson_2016": "case when MeanH <= 0 then 0 else exp(3.02 + 0.89 * ln(MeanH)) end",
    "palearctic_patenaude_2004": "2 * (1.36 * 0.68 * 0.49) * 19.186 * exp(0.1256 * h80_p12)",
    "palearctic_suganuma_2006": "119.9699 * pow(treecover2000_mean / 100, 1.1781)",
    "australia_suganuma_2006": "119.9699 * pow(treecover2000_mean / 100, 1.1781)",
    "australia_beets_2011": "2 * (-45.8 + 7.52 * h30_canopy + 0.67 * treecover2000_mean)",
    "australia_lucas_2008": "-20.68 - 44.4 * h05_canopy + 57.98 * h10_canopy - 18.8 * h20_canopy + 8.3 * h50_canopy - 34.98 * h75_canopy + 32.2 * h80_canopy + 0.86 * treecover2000_mean",
}


def _listed(ranges: dict[str, str]) -> str:
    """Rows (nth, name, low, high) of fixed id ranges."""
    rows = [(i, name, *(part.split("-") * 2)[:2]) for i, (name, text) in enumerate(ranges.items()) for part in text.split()]
    return "(values " + ", ".join(f"({i}, '{name}', {low}, {high})" for i, name, low, high in rows) + ") g(nth, name, low, high)"


def _grouped(c: str, source: str, ranges: dict[str, str], out: str) -> str:
    """source with the last group whose ranges hold column c, by a range join."""
    return f"select s.*, m.name {out} from ({source}) s left join (select c, arg_max(name, nth) name from (select distinct {c} c from ({source})), {_listed(ranges)} where c between low and high group by c) m on m.c = s.{c}"


_COVERED = f"""select *, nlcd = 90 or eosd = 81 or (none and igbp = 11) wet, nlcd = 41 or eosd in (220, 221, 222, 223) or (none and igbp = 4) hard, nlcd = 42 or eosd in (210, 211, 212, 213) or (none and igbp in (1, 3)) con,
 nlcd = 43 or eosd in (51, 230, 231, 232, 233) or (none and igbp in (5, 8, 9)) mix, nlcd in (11, 12, 21, 22, 23, 24, 31, 52, 71, 72, 73, 74, 81, 82, 95) or eosd in (0, 10, 11, 12, 20, 30, 31, 32, 33, 34, 35, 36, 37, 40, 51, 52, 82, 83, 100)
 or (none and igbp in (0, 6, 7, 10, 12, 13, 15, 16)) nil from (select *, nlcd is null and eosd is null none from ({_grouped('ecoregion', _grouped('ecoregion', _SHOTS, allometry.ECOREGION_GROUPS, 'eco'), allometry.CONIFER_GROUPS, 'own_conifer')}))"""
_ASSIGNED = f"""select *, case when own_conifer is not null and con then own_conifer
 when eco in ('alaska', 'western_canada', 'eastern_canada', 'conus') and nil then 'zero_biomass'
 when eco = 'alaska' and burned then 'ak_burned' when eco = 'western_canada' and burned then 'w_canada_burned' when eco = 'eastern_canada' and burned then 'e_canada_burned' when eco = 'conus' and burned then 'conus_burned'
 when eco = 'alaska' and mix then 'ak_mixedwood' when eco = 'western_canada' and mix then 'w_canada_mixedwood' when eco = 'conus' and mix then 'conus_mixedwood'
 when eco = 'eastern_canada' and mix and senergy >= 26.643 then 'e_canada_mixedwood_high' when eco = 'eastern_canada' and mix then 'e_canada_mixedwood_low'
 when eco = 'alaska' and con then 'ak_conifer' when eco = 'western_canada' and con then 'w_canada_conifer' when eco = 'eastern_canada' and con then 'e_canada_conifer'
 when eco = 'alaska' and hard then 'ak_hardwood' when eco = 'western_canada' and hard then 'w_canada_hardwood' when eco = 'eastern_canada' and hard then 'e_canada_hardwood' when eco = 'conus' and hard then 'conus_hardwood'
 when eco = 'alaska' and wet and f_slope >= 2.552 then 'ak_wetland_steep' when eco = 'alaska' and wet then 'ak_wetland_flat' when eco = 'eastern_canada' and wet and f_slope >= 2.552 then 'e_canada_wetland_steep'
 when eco = 'eastern_canada' and wet then 'e_canada_wetland_flat' when eco = 'western_canada' and wet then 'w_canada_wetland' when eco = 'conus' and wet then 'conus_wetland'
 when eco = 'western_boreal_eurasia' and igbp in (1, 3, 8, 9, 11) then 'wbe_confier' when eco = 'western_boreal_eurasia' then 'wbe_mixed_hard_wood'
 when eco = 'mexico_north' and con then 'mexico_north_conifer' else coalesce(eco, '') end allometric_eq from ({_COVERED})"""
_BIOMASS = f"select *, case allometric_eq {' '.join(f"when '{k}' then {e}" for k, e in _EQUATION_SQL.items())} end::double biomass from ({_ASSIGNED}) where allometric_eq in {tuple(_EQUATION_SQL)}"


@query("e5_assign_equations", f"select vec_id, allometric_eq from ({_ASSIGNED})")
def e5(spark, d):
    return allometry.assign_equations(_shot_meta(spark, d)).select("vec_id", "allometric_eq")


@query("e6_biomass", f"select vec_id, allometric_eq, round(biomass, 5) biomass from ({_BIOMASS})")
def e6(spark, d):
    df = allometry.calculate_biomass(allometry.assign_equations(_shot_meta(spark, d)))
    return df.select("vec_id", "allometric_eq", F.round("biomass", 5).alias("biomass"))


@query("e7_clean_biomass", f"select allometric_eq, count(*) n, round(sum(case when VH < 2 or biomass < 1 or treecover2000_mean < 10 then 0 else biomass end), 5) biomass from ({_BIOMASS}) where VH >= 0 and (allometric_eq <> 'palearctic_patenaude_2004' or h80_p12 between 13 and 25) group by 1")
def e7(spark, d):
    df = allometry.apply_allometry(_shot_meta(spark, d), seasons=False)
    return df.groupBy("allometric_eq").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("biomass"), 5).alias("biomass"))


_REALM_OF = """case when eco is null then 'nan' when eco = 'afrotropic' then 'afrotropic' when eco = 'tropical_asia' then 'tropical_asia' when eco like 'australia%' then 'australia' when eco like '%neotropic' then 'neotropic'
 when eco in ('alaska', 'western_canada', 'eastern_canada', 'conus', 'mexico_north', 'mexico_south') then 'nearctic' else 'palearctic' end"""


@query("e9_realms", f"select realm, count(*) n, sum(ecoregion) ecoregions from (select ecoregion, case when ecoregion in (0, 129, 133) then 'ice' when ecoregion = 622 then 'tropical_asia' else {_REALM_OF} end realm from ({_grouped('ecoregion', 'select vec_id % 850 ecoregion from (select vec_id * 8 + k vec_id from embeddings, range(8) t(k))', allometry.ECOREGION_GROUPS, 'eco')})) group by 1")
def e9(spark, d):
    df = _shot_meta(spark, d).select((F.col("vec_id") % 850).alias("ecoregion")).withColumn("realm", allometry.realm())
    return df.groupBy("realm").agg(F.count(F.lit(1)).alias("n"), F.sum("ecoregion").alias("ecoregions"))


@query("e4_burned_after", "select vec_id, 2005 < floor((2000 + vec_id % 12) * 1000 / 1000) burned from embeddings where vec_id % 5 > 0 union all select vec_id, false from embeddings where vec_id % 5 = 0")
def e4(spark, d):
    df = A.read(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 > 0, (2000 + F.col("vec_id") % 12) * 1000 + 17).alias("date"))
    return df.select("vec_id", allometry.burned_after(F.lit(2005), F.col("date")).alias("burned"))


_LEAF = """select * from (select event_id, timestamp '2003-01-01' + interval (event_id % 2400) day as t, cast(event_id * 7 % 120 - 60 as double) lat, case event_id % 3 when 0 then 'conus_conifer_popescu_2011' else 'alaska' end allometric_eq from events)"""
_LATE = "((t >= timestamp '2006-10-25' and t < timestamp '2006-11-29') or (t >= timestamp '2008-11-25' and t < timestamp '2008-12-19'))"


@query(
    "b8_leaf_on",
    f"""select event_id from (select *, month(t) >= 5 and not {_LATE} north, allometric_eq = 'conus_conifer_popescu_2011' special from ({_LEAF}))
 where t < timestamp '2009-03-01' and not (t >= timestamp '2003-03-20' and t < timestamp '2003-03-30') and (abs(lat) <= 23.5 or (lat > 23.5 and north <> special) or (lat < -23.5 and north = special))""",
)
def b8(spark, d):
    e = A.read(spark, d, "events")
    t = F.to_timestamp(F.lit("2003-01-01")) + F.make_dt_interval((F.col("event_id") % 2400).cast("int"))
    df = e.select("event_id", t.alias("time"), (F.col("event_id") * 7 % 120 - 60).cast("double").alias("lat"), F.when(F.col("event_id") % 3 == 0, "conus_conifer_popescu_2011").otherwise("alaska").alias("allometric_eq"))
    return filters.leaf_on(df).select("event_id")
