"""Emission algebra: loss years, fire attribution, carbon pools and their conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIRE_FACTORS, FOREST_CLASSES, POOL_CARBON, SAVANNA_CLASSES, TC_PER_TBM, TCO2_PER_TC
from ..functions.nulls import clip, member, true

POOLS = ("agb", "bgb", "dead_wood", "litter")


def emissions_by_loss_year(static: DataFrame, first: int, last: int, amount: str = "agb", tree_cover: str | None = None) -> DataFrame:
    """A row per cell and year of [first, last]: the biomass (or tree cover times biomass) lost in that year as CO2, else 0."""
    rows = static.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    here = F.when(F.col("lossyear") == F.col("year"), F.col(tree_cover) if tree_cover else F.lit(1.0)).otherwise(0.0)
    return rows.withColumn("emissions", F.col(amount) * here * TC_PER_TBM * TCO2_PER_TC)


def lost_cells(static: DataFrame, fire: DataFrame, first: int, last: int, amount: str = "agb") -> DataFrame:
    """A row per cell: the year in [first, last] it was lost in (NULL if in none), its emissions, and is_fire: burned in that year or the one before.

    What emissions_by_loss_year and fire attribution give over all years is 0 but in the year of loss, so totals need no row per cell and
    year, and the look back is a join with burns of two years rather than a sort of every series. fire: iy, ix, year, burned.
    """
    year = F.when(F.col("lossyear").between(first, last), F.col("lossyear"))
    burns = fire.where(F.col("burned").cast("int") > 0).where(F.col("year").between(first, last))
    burns = burns.select("iy", "ix", F.explode(F.array(F.col("year"), F.col("year") + 1)).alias("year")).distinct().withColumn("is_fire", F.lit(True))
    cells = static.withColumn("year", year).withColumn("emissions", F.when(F.col("year").isNotNull(), F.col(amount) * TC_PER_TBM * TCO2_PER_TC))
    return cells.join(burns, ["iy", "ix", "year"], "left").withColumn("is_fire", F.coalesce("is_fire", F.lit(False)))


def split_by_fire(df: DataFrame, total: str = "emissions", flag: str = "is_fire") -> DataFrame:
    """Adds emissions_fire (attributed to fire, else 0) and emissions_clearing (the rest)."""
    fire = F.when(true(F.col(flag)), F.col(total)).otherwise(0.0)
    return df.withColumn("emissions_fire", fire).withColumn("emissions_clearing", F.col(total) - F.col("emissions_fire"))


def sources(flux: Column) -> Column:
    return clip(flux, low=0.0)


def sinks(flux: Column) -> Column:
    return clip(flux, high=0.0)


def belowground(agb: Column) -> Column:
    return F.lit(0.489) * F.pow(agb, F.lit(0.890))


def dead_wood_and_litter(agb: Column, is_tropics: Column, elevation: Column, precipitation: Column) -> tuple[Column, Column]:
    """By tropical elevation and rain class, or outside the tropics; 0 where the class isn't known."""
    tropics, outside = true(is_tropics), is_tropics.isNotNull() & ~true(is_tropics)
    low, high = elevation < 2000, elevation >= 2000
    classes = [
        (tropics & low & (precipitation < 1000), 0.02, 0.04),
        (tropics & low & (precipitation >= 1000) & (precipitation < 1600), 0.01, 0.01),
        (tropics & low & (precipitation >= 1600), 0.06, 0.01),
        (tropics & high, 0.07, 0.01),
        (outside, 0.08, 0.04),
    ]
    dead = litter = None
    for condition, d, l in classes:
        dead = F.when(true(condition), d) if dead is None else dead.when(true(condition), d)
        litter = F.when(true(condition), l) if litter is None else litter.when(true(condition), l)
    return agb * dead.otherwise(0.0), agb * litter.otherwise(0.0)


def carbon_pools(df: DataFrame) -> DataFrame:
    """Adds bgb, dead_wood and litter to agb, is_tropics, elevation and precipitation."""
    dead, litter = dead_wood_and_litter(F.col("agb"), F.col("is_tropics"), F.col("elevation"), F.col("precipitation"))
    return df.withColumns({"bgb": belowground(F.col("agb")), "dead_wood": dead, "litter": litter})


def forest_mask(df: DataFrame, landcover: DataFrame, values: list[str]) -> DataFrame:
    """Values only in cells that are forest in any year."""
    forest = landcover.groupBy("iy", "ix").agg(F.bool_or(member(F.col("igbp"), FOREST_CLASSES)).alias("__f"))
    out = df.join(forest, ["iy", "ix"], "left")
    return out.withColumns({v: F.when(true(F.col("__f")), F.col(v)) for v in values}).drop("__f")


def result_mask(df: DataFrame, landcover: DataFrame, valid: DataFrame, values: list[str]) -> DataFrame:
    """Values only in cells that are land in any year and inside the valid area."""
    land = landcover.groupBy("iy", "ix").agg(F.bool_or(true(F.col("igbp") > 0)).alias("__l"))
    ok = valid.select("iy", "ix").distinct().withColumn("__v", F.lit(True))
    out = df.join(land, ["iy", "ix"], "left").join(ok, ["iy", "ix"], "left")
    return out.withColumns({v: F.when(true(F.col("__l")) & true(F.col("__v")), F.col(v)) for v in values}).drop("__l", "__v")


def split_pools_by_fire(df: DataFrame, flag: str = "is_fire") -> DataFrame:
    """fire_biomass: losses of agb and bgb where attributed to fire; clearing_{pool}: losses of every pool elsewhere."""
    fire = true(F.col(flag))
    out = df.withColumn("fire_biomass", F.when(fire, sources(F.col("d_agb")) + sources(F.col("d_bgb"))).otherwise(0.0))
    return out.withColumns({f"clearing_{p}": F.when(~fire, sources(F.col(f"d_{p}"))).otherwise(0.0) for p in POOLS} | {f"sink_{p}": sinks(F.col(f"d_{p}")) for p in POOLS})


def fire_to_emissions(biomass: Column, igbp: Column, is_tropics: Column) -> Column:
    """Burnt biomass by the factor of savanna, tropics or elsewhere; NULL becomes 0."""
    factor = F.when(member(igbp, SAVANNA_CLASSES), FIRE_FACTORS["savanna"]).when(true(is_tropics), FIRE_FACTORS["tropics"]).otherwise(FIRE_FACTORS["extratropics"])
    return F.coalesce(biomass * factor, F.lit(0.0))


def pools_to_emissions(prefix: str) -> Column:
    """CO2 of the pools {prefix}_{pool} by their carbon shares."""
    out = None
    for p in POOLS:
        term = F.col(f"{prefix}_{p}") * F.lit(POOL_CARBON[p]) * F.lit(TCO2_PER_TC)
        out = term if out is None else out + term
    return out


def flux_emissions(df: DataFrame) -> DataFrame:
    """Adds emissions_from_fire, emissions_from_clearing, sinks and net to the output of split_pools_by_fire."""
    out = df.withColumns({"emissions_from_fire": fire_to_emissions(F.col("fire_biomass"), F.col("igbp"), F.col("is_tropics")), "emissions_from_clearing": pools_to_emissions("clearing"), "sinks": pools_to_emissions("sink")})
    return out.withColumn("net", F.col("emissions_from_fire") + F.col("emissions_from_clearing") + F.col("sinks"))
