"""The end-to-end jobs on adapters of the smallest tables."""

from pyspark.sql import functions as F

from forestflux.functions.grid import cell_area_ha
from forestflux.operators import aggregate, emissions, joins, timeseries
from forestflux.plans import pipelines
from forestflux.sources import adapters as A

D = "/root/testdata/sf0.001"


def test_country_emissions(spark):
    """One row per lost cell gives the totals that a row per cell and year gives."""
    static = A.with_position(A.static_raster(spark, D))
    fire = A.burned(spark, D).withColumn("burned", F.lit(1))
    out = pipelines.country_emissions(static, fire, A.regions(spark, D), 2001, 2007, 0.25)
    dense = emissions.split_by_fire(timeseries.attribute_to_fire(emissions.emissions_by_loss_year(static, 2001, 2007).join(fire, ["iy", "ix", "year"], "left")))
    values = ["emissions", "emissions_fire", "emissions_clearing"]
    masked = joins.polygon_mask(dense, A.regions(spark, D)).withColumns({v: F.col(v) * cell_area_ha(F.col("lat"), 0.25, 0.25) for v in values})
    want = aggregate.regional_totals(masked, A.regions(spark, D).select(F.col("id").alias("region"), "code"), values)
    rows = lambda df: sorted((r.code, r.begin_date, r.end_date, *(round(r[v], 3) for v in values)) for r in df.collect())
    assert rows(out) == rows(want) and out.count() > 0


def test_pools_from_series(spark):
    cells = spark.range(6).select(F.floor(F.col("id") / 3).cast("int").alias("iy"), (F.col("id") % 3).cast("int").alias("ix"))
    stack = cells.withColumn("year", F.explode(F.sequence(F.lit(2014), F.lit(2020)))).withColumn("agb", F.when((F.col("ix") + F.col("year")) % 4 > 0, 50.0 + F.col("ix") * (F.col("year") - 2014)))
    ancillary = cells.withColumns({"is_tropics": F.lit(True), "elevation": F.lit(100.0), "precipitation": F.lit(2000.0)})
    out = pipelines.pools_from_series(stack, ancillary).collect()
    assert len(out) == 42 and {r.year for r in out} == set(range(2014, 2021))
    assert all(abs(r.agb - (50 + r.ix * (r.year - 2014))) < 1e-6 and abs(r.dead_wood - 0.06 * r.agb) < 1e-9 for r in out)
