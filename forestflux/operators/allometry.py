"""Which biomass equation fits a lidar shot, and its value.

Most equations are a row of coefficients, the others SQL text in the names of the height metrics, where exponent literals keep all
arithmetic in doubles. Assignment is one CASE in order of priority, so the whole step is a projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import member, true
from .filters import leaf_on

# Ecoregion ids of every group as inclusive ranges; where an id is in two groups the later one has it.
ECOREGION_GROUPS = {
    "afrotropic": "1-116",
    "tropical_asia": "135-141 143-146 148-149 151-166 188 195 217-323 618 621-622 626-627 634-635 637-638",
    "tropical_neotropic": "439-560 562 564-574 579-584 587-617 619-620 622-625 628-633 636 639-641",
    "extratropical_neotropic": "561 563 575-578 585-586",
    "alaska": "369 371-372 375 404-411 416 420",
    "western_canada": "376-381 383 412-415 417-419",
    "eastern_canada": "370 373-374 382 421",
    "conus": "325 328-368 384-403 422-425 429-430 433-434 438",
    "mexico_north": "324 326-327 426 428 431-432 435-437",
    "mexico_south": "427",
    "western_boreal_eurasia": "691 708 711 717 729 774 776 778 780",
    "eastern_boreal_eurasia": "710 712-716 718-720 771-773 775 777 779 781-784",
    "palearctic_wang_2013": "642-643 653 655-657 659 667 669 673 677 680-681 684-685 687 690 693-694 696-697 700 702 704-707 709 721-724 726-728 730-743 746-757 759-770",
    "palearctic_takagi_2015": "666 670-671 682-683 698-699",
    "palearctic_yavasli_2016": "649 652 662 688 725 785-786 789-791 804",
    "palearctic_brovkina_2015": "692",
    "palearctic_alberti_2013": "689",
    "palearctic_whrc": "644 646 650 658 660 665 674-675 678 695 703 788 794-795 799 801-802 806",
    "palearctic_shang_and_chazette_2014": "645 647-648 654 661 664 668 676 679 686",
    "palearctic_simonson_2016": "701 758 787 792-793 796-798 800 803 805",
    "palearctic_patenaude_2004": "651 663 672",
    "palearctic_suganuma_2006": "744-745 807-846",
    "australia_beets_2011": "142 147 169-175 180 190 194 196",
    "australia_suganuma_2006": "197-216",
    "australia_lucas_2008": "167-168 176-179 181-187 189 191-193",
    "australia_baccini_2012": "150",
}
# Conifer ids of the contiguous United States by equation.
CONIFER_GROUPS = {
    "conus_conifer_nelson_2017": "325 356 385 387-392 394-398 400-402 422-425 429-430 433-434 438",
    "conus_conifer_tsui_2012": "349 351 360 364-365 403",
    "conus_conifer_neigh_2013": "345 350 355 361-362 386",
    "conus_conifer_lu_2012": "352 354 357-359 366",
    "conus_conifer_hudak_2012": "348 353 367-368",
    "conus_conifer_hyde_2007": "346",
    "conus_conifer_popescu_2011": "329-332 336-337 340-341 363 384 393 399",
    "conus_conifer_skowronski_2007": "347",
    "conus_conifer_sun_2011": "333-335 338",
    "conus_conifer_anderson_2006": "328 339 342-344",
}
# Land-cover codes of each mask in the three maps (first the national map, then the northern one, then the global one).
COVER_CODES = {
    "wetland": ("90", "81", "11"),
    "hardwood": ("41", "220-223", "4"),
    "conifer": ("42", "210-213", "1 3"),
    "mixedwood": ("43", "51 230-233", "5 8-9"),
    "zero": ("11-12 21-24 31 52 71-74 81-82 95", "0 10-12 20 30-37 40 51-52 82-83 100", "0 6-7 10 12-13 15-16"),
}
# Ecoregions of ice.
ICE = (0, 129, 133)
REALM_PREFIXES = {"afrotropic": ("afrotropic",), "australia": ("australia_",), "nearctic": ("alaska", "western_canada", "eastern_canada", "conus", "mexico_"), "neotropic": ("tropical_neotropic", "extratropical_neotropic"), "palearctic": ("western_boreal", "eastern_boreal", "palearctic_"), "tropical_asia": ("tropical_asia",)}

# The linear equations, as factor, constant and the coefficients of metrics.
LINEAR: dict[str, tuple[float, float, dict[str, float]]] = {
    "afrotropic": (1, -31.631, {"HOME_Baccini": 15.952, "H10_Baccini": 7.832, "H60_Baccini": -18.805, "CANOPY_ENE": -38.428, "H25_Baccini": 8.285}),
    "tropical_asia": (1, -31.631, {"HOME_Baccini": 15.952, "H10_Baccini": 7.832, "H60_Baccini": -18.805, "CANOPY_ENE": -38.428, "H25_Baccini": 8.285}),
    "tropical_neotropic": (1, -31.631, {"HOME_Baccini": 15.952, "H10_Baccini": 7.832, "H60_Baccini": -18.805, "CANOPY_ENE": -38.428, "H25_Baccini": 8.285}),
    "australia_baccini_2012": (1, -31.631, {"HOME_Baccini": 15.952, "H10_Baccini": 7.832, "H60_Baccini": -18.805, "CANOPY_ENE": -38.428, "H25_Baccini": 8.285}),
    "extratropical_neotropic": (2, 0.41, {"treecover2000_mean": 0.53}),
    "ak_wetland_steep": (1, 11.66, {"VH": 4.48, "h50_Neigh": -6.27, "f_slope": -2.1, "acq3_Neigh": 6.31}),
    "ak_wetland_flat": (1, 4.82, {"VH": 5.52, "h50_Neigh": -5.17, "acq3_Neigh": -2.22}),
    "ak_hardwood": (1, 37.16, {"h90_Neigh": 5.28, "h25_Neigh": -4.34, "acq3_Neigh": 15.95}),
    "ak_conifer": (1, 36.98, {"h90_Neigh": 7.39, "h50_Neigh": -8.75, "acq3_Neigh": -1.35}),
    "ak_mixedwood": (1, 5.76, {"QMCH": 4.54, "VH": 2.45, "acq3_Neigh": 18.96}),
    "ak_burned": (1, 5.05, {"QMCH": 5.46, "ht_adjusted": 4.07, "acq3_Neigh": 22.77}),
    "w_canada_wetland": (1, 4.82, {"VH": 5.52, "h50_Neigh": -5.17, "acq3_Neigh": -2.22}),
    "w_canada_hardwood": (1, 37.16, {"h90_Neigh": 5.28, "h25_Neigh": -4.34, "acq3_Neigh": 15.95}),
    "w_canada_conifer": (1, 4.03, {"VH": 5.31, "h25_Neigh": -4.19}),
    "w_canada_mixedwood": (1, 20.61, {"QMCH": 4.11, "VH": 2.26, "h25_Neigh": -2.5}),
    "w_canada_burned": (1, 5.05, {"QMCH": 5.46, "ht_adjusted": 4.07, "acq3_Neigh": 22.77}),
    "e_canada_wetland_steep": (1, -1.2, {"VH": 6.08, "f_slope": -1.29}),
    "e_canada_wetland_flat": (1, 4.82, {"VH": 5.52, "h50_Neigh": -5.17, "acq3_Neigh": -2.22}),
    "e_canada_hardwood": (1, 9.32, {"QMCH": 3.92, "h90_Neigh": 6.09, "h25_Neigh": -5.44}),
    "e_canada_conifer": (1, 2.4, {"VH": 2.27, "h90_Neigh": 5.54, "h25_Neigh": -9.13}),
    "e_canada_mixedwood_high": (1, 14.63, {"VH": 5.74, "senergy": -0.92, "h25_Neigh": -5.01}),
    "e_canada_mixedwood_low": (1, 20.61, {"QMCH": 4.11, "VH": 2.26, "h25_Neigh": -2.5}),
    "e_canada_burned": (1, 5.05, {"QMCH": 5.46, "ht_adjusted": 4.07, "acq3_Neigh": 22.76}),
    "conus_wetland": (1, 0, {"h50_Nelson": 3.623, "h90_Nelson": 4.98}),
    "conus_hardwood": (1, 0, {"h75_Nelson": 6.66, "h10_Nelson": -7.036, "trail_Nelson": 3.132}),
    "conus_mixedwood": (1, 0, {"h75_Nelson": 6.147, "h10_Nelson": -6.292, "lead_Nelson": 0.667, "trail_Nelson": 3.128}),
    "conus_burned": (1, 0, {"h90_Nelson": 4.331, "h75_Nelson": -4.222}),
    "zero_biomass": (1, 0, {}),
    "mexico_north": (1, 0, {"h25_Nelson": -3.364, "h90_Nelson": 3.21, "acq3_Nelson": 21.612}),
    "mexico_north_conifer": (1, 18.778, {"h25_Nelson": -3.364, "h90_Nelson": 3.21, "acq3_Nelson": 21.612}),
    "mexico_south": (1, 0, {"h75_Nelson": 6.845, "h10_Nelson": -6.144, "trail_Nelson": -2.565}),
    "conus_conifer_nelson_2017": (1, 0, {"h75_Nelson": 6.147, "h10_Nelson": -6.292, "lead_Nelson": 0.667, "trail_Nelson": 3.128}),
    "conus_conifer_tsui_2012": (1, -7.144, {"MeanH": -12.925, "h10_p12": 2.239, "h90_p12": 14.019}),
    "conus_conifer_neigh_2013": (1, 4.03, {"VH": 5.31, "h25_Neigh": -4.19}),
    "conus_conifer_hudak_2012": (1, -16.54, {"MeanH": 21.18}),
    "conus_conifer_hyde_2007": (1, 7.042, {"MeanH": 16.141}),
    "conus_conifer_popescu_2011": (1, -29.308, {"VH": 7.5429}),
    "conus_conifer_skowronski_2007": (1, 0, {"MeanH": 6.04}),
    "conus_conifer_sun_2011": (1, -1.717, {"h50_Neigh": 6.208, "h75_Neigh": 8.625}),
    "conus_conifer_anderson_2006": (1, 29.954, {"h50_Neigh": 14.297}),
    "wbe_confier": (1, 4.72, {"h90_Neigh": 5.95, "h25_Neigh": -5.0}),
    "wbe_mixed_hard_wood": (1, -7.03, {"h75_Neigh": 8.84, "h25_Neigh": -5.09}),
    "eastern_boreal_eurasia": (1, -3.49, {"h75_Neigh": 13.6, "h25_Neigh": -14.3}),
    "palearctic_takagi_2015": (2, 24.5, {"MeanH": 6.7}),
    "palearctic_yavasli_2016": (1, 24.11, {"HOME_Yavasli": -3.84, "pct_HOME_Yavasli": 2.44}),
    "palearctic_brovkina_2015": (1, -99.9, {"MeanH": 12.8}),
    "palearctic_whrc": (1, 13.7949, {"HOME_Baccini": 0.8912, "CANOPY_DEP": 25.4467, "VH": -18.1995}),
    "australia_beets_2011": (2, -45.8, {"h30_canopy": 7.52, "treecover2000_mean": 0.67}),
    "australia_lucas_2008": (1, -20.68, {"h05_canopy": -44.4, "h10_canopy": 57.98, "h20_canopy": -18.8, "h50_canopy": 8.3, "h75_canopy": -34.98, "h80_canopy": 32.2, "treecover2000_mean": 0.86}),
}
# The others, in SQL.
CURVED = {
    "conus_conifer_lu_2012": "case when Height_35_to_40 <= 0 or QMCH <= 0 then 0e0 else exp(2.10e0 + 1.56e0 * ln(QMCH) + 0.05e0 * ln(Height_35_to_40)) end",
    "palearctic_wang_2013": "case when VH <= 0 then 0e0 else exp(1.48e0 + 1.09e0 * ln(VH)) end",
    "palearctic_alberti_2013": "2e0 * 3.33e0 * pow(MeanH, 1.27e0)",
    "palearctic_shang_and_chazette_2014": "2e0 * (42.36e0 + 0.24e0 * QMCH * QMCH)",
    "palearctic_simonson_2016": "case when MeanH <= 0 then 0e0 else exp(3.02e0 + 0.89e0 * ln(MeanH)) end",
    "palearctic_patenaude_2004": "2e0 * (1.36e0 * 0.68e0 * 0.49e0) * 19.186e0 * exp(0.1256e0 * h80_p12)",
    "palearctic_suganuma_2006": "119.9699e0 * pow(treecover2000_mean / 100e0, 1.1781e0)",
    "australia_suganuma_2006": "119.9699e0 * pow(treecover2000_mean / 100e0, 1.1781e0)",
}
EQUATIONS = [*LINEAR, *CURVED]
METRICS = sorted({m for _, _, terms in LINEAR.values() for m in terms})


def ids(ranges: str) -> list[int]:
    """The numbers of a text of inclusive ranges."""
    out: list[int] = []
    for part in ranges.split():
        a, _, b = part.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def within(c: str, ranges: str) -> str:
    """SQL for membership in a text of ranges, false for NULL."""
    tests = []
    for part in ranges.split():
        a, _, b = part.partition("-")
        tests.append(f"{c} between {a} and {b}" if b else f"{c} = {a}")
    return f"coalesce({' or '.join(tests)}, false)"


def group_sql(c: str = "ecoregion") -> str:
    """The group of an ecoregion, the empty text for none; later groups win."""
    return "case " + " ".join(f"when {within(c, r)} then '{g}'" for g, r in reversed(ECOREGION_GROUPS.items())) + " else '' end"


def realm_sql(c: str = "ecoregion") -> str:
    """The realm of an ecoregion; the later of two realms wins, ids of ice are ice, and none is 'nan'."""
    tests = []
    for realm, starts in reversed(REALM_PREFIXES.items()):
        ranges = " ".join(r for g, r in ECOREGION_GROUPS.items() if g.startswith(starts) and not (realm == "afrotropic" and g != "afrotropic"))
        tests.append(f"when {within(c, ranges)} then '{realm}'")
    return f"case when {c} in {ICE} then 'ice' {' '.join(tests)} else 'nan' end"


def cover_sql(kind: str) -> str:
    """Whether a shot has this cover: by the first two maps, or by the global one where neither knows."""
    a, b, c = COVER_CODES[kind]
    return f"({within('nlcd', a)} or {within('eosd', b)} or (nlcd is null and eosd is null and {within('igbp', c)}))"


def assignment_sql() -> str:
    """The equation of a shot, from eco_group, ecoregion, nlcd, eosd, igbp, burned, f_slope and senergy, first match first."""
    out = []
    for name, ranges in reversed(CONIFER_GROUPS.items()):
        out.append(f"when {within('ecoregion', ranges)} and {cover_sql('conifer')} then '{name}'")
    for group, short in (("alaska", "ak"), ("western_canada", "w_canada"), ("eastern_canada", "e_canada"), ("conus", "conus")):
        mine = f"eco_group = '{group}' and "
        out.append(f"when {mine}{cover_sql('zero')} then 'zero_biomass'")
        out.append(f"when {mine}coalesce(burned, false) then '{short}_burned'")
        if group == "eastern_canada":
            out.append(f"when {mine}{cover_sql('mixedwood')} and senergy >= 26.643e0 then 'e_canada_mixedwood_high'")
            out.append(f"when {mine}{cover_sql('mixedwood')} and senergy < 26.643e0 then 'e_canada_mixedwood_low'")
        else:
            out.append(f"when {mine}{cover_sql('mixedwood')} then '{short}_mixedwood'")
        if group != "conus":
            out.append(f"when {mine}{cover_sql('conifer')} then '{short}_conifer'")
        out.append(f"when {mine}{cover_sql('hardwood')} then '{short}_hardwood'")
        if group in ("alaska", "eastern_canada"):
            out.append(f"when {mine}{cover_sql('wetland')} and f_slope >= 2.552e0 then '{short}_wetland_steep'")
            out.append(f"when {mine}{cover_sql('wetland')} and f_slope < 2.552e0 then '{short}_wetland_flat'")
        else:
            out.append(f"when {mine}{cover_sql('wetland')} then '{short}_wetland'")
    out.append(f"when eco_group = 'western_boreal_eurasia' and {within('igbp', '0 2 4-7 10 12-16')} then 'wbe_mixed_hard_wood'")
    out.append(f"when eco_group = 'western_boreal_eurasia' and {within('igbp', '1 3 8-9 11')} then 'wbe_confier'")
    out.append(f"when eco_group = 'mexico_north' and {cover_sql('conifer')} then 'mexico_north_conifer'")
    return "case " + " ".join(out) + " else eco_group end"


def realm(c: Column | str = "ecoregion") -> Column:
    return F.expr(realm_sql(c if isinstance(c, str) else "ecoregion"))


def burned_after(acquired_year: Column, burn_date: Column, before: bool = False) -> Column:
    """Whether a cell burned (YYYYDDD) after the acquisition's year, or before it if asked; false without a date."""
    year = F.floor(burn_date / 1000)
    return true(year < acquired_year if before else acquired_year < year)


def assign_equations(df: DataFrame) -> DataFrame:
    # a lambda over one value, so that the group is found once and not in every branch
    return df.withColumn("allometric_eq", F.expr(f"element_at(transform(array({group_sql()}), eco_group -> {assignment_sql()}), 1)"))


def coefficients(spark: SparkSession) -> DataFrame:
    """(allometric_eq, factor, constant, terms): terms are the places of metrics in METRICS and their coefficients."""
    rows = [(name, float(factor), float(constant), [(METRICS.index(m), c) for m, c in terms.items()]) for name, (factor, constant, terms) in LINEAR.items()]
    return spark.createDataFrame(rows, "allometric_eq string, factor double, constant double, terms array<struct<at: int, c: double>>")


def calculate_biomass(df: DataFrame) -> DataFrame:
    """Adds biomass; shots whose equation is none of the table are dropped.

    Linear equations are one sum over their terms, so the code does not grow with their number; the table of them is of fixed size.
    """
    # a lambda over one value, so that the optimizer never repeats the assignment in each branch
    branches = " ".join(f"when '{name}' then {text}" for name, text in CURVED.items())
    curve = F.expr(f"element_at(transform(array(allometric_eq), eq -> case eq {branches} end), 1)")
    rows = df.where(member(F.col("allometric_eq"), EQUATIONS)).join(F.broadcast(coefficients(df.sparkSession)), "allometric_eq", "left")
    rows = rows.withColumn("__metrics", F.array(*[F.col(m).cast("double") for m in METRICS]))
    line = F.aggregate("terms", F.col("constant"), lambda total, t: total + t["c"] * F.get("__metrics", t["at"]), lambda total: total * F.col("factor"))
    return rows.withColumn("biomass", F.when(F.col("terms").isNull(), curve).otherwise(line)).drop("factor", "constant", "terms", "__metrics")


def clean_biomass(df: DataFrame) -> DataFrame:
    """Drops shots outside an equation's bounds, and sets small or treeless biomass to 0."""
    ok = true((F.col("VH") >= 0) & (F.col("treecover2000_mean") >= 0))
    bounded = (F.col("allometric_eq") != "palearctic_patenaude_2004") | true(F.col("h80_p12").between(13, 25))
    low = (F.col("VH") < 2) | (F.col("treecover2000_mean") < 10)
    return df.where(ok & bounded).withColumn("biomass", F.element_at(F.transform(F.array("biomass"), lambda b: F.when(true(low | (b < 1)), 0.0).otherwise(b)), 1))


def apply_allometry(df: DataFrame, seasons: bool = True) -> DataFrame:
    """Assignment, season filter (by the timestamp in `acquired`, or in `time` without it), value and clean-up of shots with all metrics."""
    out = assign_equations(df)
    if seasons:
        out = leaf_on(out, time="acquired" if "acquired" in out.columns else "time")
    return clean_biomass(calculate_biomass(out))
