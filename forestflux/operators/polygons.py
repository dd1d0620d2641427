"""Polygons of any size as rows of edges: a quad-tree cover for points, runs of cells for rasters, and exact shares of clipped cells.

A layer has an id and `rings`, an array of rings (arrays of struct<x, y>, closed or not): the first is the shell, the others are holes;
further parts are further rows of the same id. Rings are taken apart where they are read: no later row holds more than the edges of one
cell. A point is inside by the even-odd rule; points on a lower or left edge are inside, on an upper or right one outside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of quad-tree cells in units of the coordinates: LEVELS of them, from TOP down, each a FACTOR-th of the last.
TOP, FACTOR, LEVELS = 16.0, 4, 6
#: Edges of mean length that a polygon's smallest cells are meant to be wide.
EDGES_PER_CELL = 16
#: Part of a cell by which edges count as touching its neighbours, for rounding.
MARGIN = 1e-9


def edges(polygons: DataFrame) -> DataFrame:
    """(id, sign, x0, y0, x1, y1) of every edge; sign 1 if the polygon lies to the left of it, -1 if to the right."""
    rings = polygons.select("id", F.posexplode("rings").alias("hole", "ring")).where(F.size("ring") > 2)
    n = F.size("ring")
    shifted = F.concat(F.slice("ring", F.lit(2), n - 1), F.slice("ring", 1, 1))
    pairs = rings.select("id", "hole", F.arrays_zip(F.col("ring").alias("a"), shifted.alias("b")).alias("pairs"))
    # the origin of the area is the first vertex, so that rings far from (0, 0) lose no digits
    first = F.col("pairs")[0]["a"]
    cross = lambda s, e: s + (e["a"]["x"] - first["x"]) * (e["b"]["y"] - first["y"]) - (e["b"]["x"] - first["x"]) * (e["a"]["y"] - first["y"])
    area = F.aggregate("pairs", F.lit(0.0), cross)
    sign = F.signum(area) * F.when(F.col("hole") == 0, 1).otherwise(-1)
    flat = pairs.withColumn("sign", sign.cast("int")).select("id", "sign", F.explode("pairs").alias("e"))
    at = lambda p, c: F.col(f"e.{p}.{c}").cast("double")
    out = flat.select("id", "sign", at("a", "x").alias("x0"), at("a", "y").alias("y0"), at("b", "x").alias("x1"), at("b", "y").alias("y1"))
    return out.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


def _between(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int"))


def _straddles(y: Column) -> Column:
    return (F.col("y0") <= y) != (F.col("y1") <= y)


def _x_at(y: Column) -> Column:
    return F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))


# ---------------------------------------------------------------- the cover


def cover(polygons: DataFrame) -> DataFrame:
    """(level, cx, cy, id, odd, edges): cells wholly inside (edges NULL), and smallest border cells with the edges that touch them.

    Each polygon goes down to the level whose cells are some EDGES_PER_CELL edges wide. On each level up to it, the cells that edges
    touch are border cells; of their children those that no edge touches are decided as a whole, by how often the row's middle line
    crosses edges left of them. odd says the same for a border cell's left end of that line, just inside the cell.
    """
    every = edges(polygons)
    size = F.lit(TOP) / F.pow(F.lit(float(FACTOR)), F.col("level"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    depth = every.groupBy("id").agg(F.avg(length).alias("mean"))
    wanted = F.floor(F.log(F.lit(TOP) / (F.col("mean") * EDGES_PER_CELL)) / F.log(F.lit(float(FACTOR)))).cast("int")
    depth = depth.select("id", F.least(F.greatest(wanted, F.lit(0)), F.lit(LEVELS - 1)).alias("depth"))
    rows = every.join(depth, "id").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("s", size)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = rows.withColumn("cy", F.explode(_between(low / F.col("s") - MARGIN, high / F.col("s") + MARGIN)))
    middle = (F.col("cy") + 0.5) * F.col("s")
    # where the row's middle line crosses an edge: in the cell with its left end before and its right end not before the crossing
    crossing = (F.ceil(_x_at(middle) / F.col("s")) - 1).cast("int")
    crossed = rows.where(_straddles(middle)).select("id", "depth", "level", "cy", crossing.alias("cx"), F.lit(1).alias("n"), F.lit(0).alias("touched"), F.lit(None).alias("edge"))
    clip = lambda y: F.greatest(F.least(y, F.greatest("x0", "x1")), F.least("x0", "x1"))
    a, b = F.greatest(low, F.col("cy") * F.col("s")), F.least(high, (F.col("cy") + 1) * F.col("s"))
    level_edge = F.col("y0") == F.col("y1")
    xa, xb = F.when(level_edge, F.col("x0")).otherwise(clip(_x_at(a))), F.when(level_edge, F.col("x1")).otherwise(clip(_x_at(b)))
    touching = rows.withColumn("cx", F.explode(_between(F.least(xa, xb) / F.col("s") - MARGIN, F.greatest(xa, xb) / F.col("s") + MARGIN)))
    edge = F.when(F.col("level") == F.col("depth"), F.struct("x0", "y0", "x1", "y1"))
    touched = touching.select("id", "depth", "level", "cy", "cx", F.lit(0).alias("n"), F.lit(1).alias("touched"), edge.alias("edge"))
    keys = ["id", "depth", "level", "cy", "cx"]
    border = crossed.withColumn("edge", F.col("edge").cast(dict(touched.dtypes)["edge"])).unionByName(touched)
    border = border.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("touched").alias("touched"), F.collect_list("edge").alias("edges"))
    # each border cell and its children in one pass; a child that is a border cell itself becomes one group with it
    own = F.struct("level", "cy", "cx", "n", "touched", F.lit(0).alias("child"), "edges")
    steps = [F.lit(i) for i in range(FACTOR)]
    nothing = F.lit(None).cast(dict(border.dtypes)["edges"]).alias("edges")
    child = lambda i, j: F.struct((F.col("level") + 1).alias("level"), (F.col("cy") * FACTOR + i).alias("cy"), (F.col("cx") * FACTOR + j).alias("cx"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("touched"), F.lit(1).alias("child"), nothing)
    family = F.when((F.col("touched") == 1) & (F.col("level") < F.col("depth")), F.array(own, *[child(i, j) for i in steps for j in steps])).otherwise(F.array(own))
    both = border.select("id", "depth", F.explode(family).alias("c")).select("id", "depth", "c.*")
    both = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("touched").alias("touched"), F.max("child").alias("child"), F.first("edges", True).alias("edges"))
    line = Window.partitionBy("id", "level", "cy").orderBy("cx")
    both = both.withColumn("through", F.sum("n").over(line)).withColumn("next", F.lead("cx").over(line))
    odd = (F.col("through") - F.col("n")) % 2 == 1
    # smallest border cells; children that are inside as a whole; on the first level, what lies between two cells of a row
    smallest = (F.col("touched") == 1) & (F.col("level") == F.col("depth"))
    inner = (F.col("touched") == 0) & (F.col("child") == 1) & odd
    gap = (F.col("level") == 0) & (F.col("through") % 2 == 1) & (F.col("next") > F.col("cx") + 1)
    cell = lambda cx, is_odd, held: F.struct(cx.alias("cx"), is_odd.alias("odd"), held.alias("edges"))
    this = F.when(smallest | inner, F.array(cell(F.col("cx"), odd, F.when(smallest, F.col("edges")))))
    wide = F.when(gap, F.transform(F.sequence(F.col("cx") + 1, F.col("next") - 1), lambda cx: cell(cx, F.lit(True), nothing)))
    empty = F.array().cast(f"array<struct<cx:int,odd:boolean,edges:{dict(border.dtypes)['edges']}>>")
    found = F.concat(F.coalesce(this, empty), F.coalesce(wide, empty))
    return both.select("level", "cy", "id", F.explode(found).alias("c")).select("level", "c.cx", "cy", "id", "c.odd", "c.edges")


def _holds(x: Column, y: Column) -> Column:
    """Whether a border cell's polygon holds a point of it: from the cell's left end up or down to y, then right to x, by edges crossed.

    The upright part lies just right of the cell's left side, so vertices on that side count as left of it.
    """
    s = F.lit(TOP) / F.pow(F.lit(float(FACTOR)), F.col("level"))
    left, middle = F.col("cx") * s, (F.col("cy") + 0.5) * s

    def flips(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        over = (e["x0"] <= left) != (e["x1"] <= left)
        at_y = e["y0"] + (left - e["x0"]) * dy / F.nullif(dx, F.lit(0.0))
        below = lambda v: (at_y < v) | ((at_y == v) & (dy * dx <= 0))
        at_x = e["x0"] + (y - e["y0"]) * dx / F.nullif(dy, F.lit(0.0))
        right = ((e["y0"] <= y) != (e["y1"] <= y)) & (at_x > left) & (at_x <= x)
        return F.when(over & (below(y) != below(middle)), 1).otherwise(0) + F.when(right, 1).otherwise(0)

    crossed = F.aggregate("edges", F.lit(0), lambda total, e: total + flips(e))
    return (F.col("odd").cast("int") + crossed) % 2 == 1


def points_in(points: DataFrame, polygons: DataFrame, x: str, y: str) -> DataFrame:
    """Every pair of a point and a polygon that holds it: the point's columns and `id`. Points without coordinates have none.

    One equi-join on the cells that hold the point, one for each level; the polygons' other columns are for a join by id afterwards.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    sizes = [TOP / FACTOR**level for level in range(LEVELS)]
    cell = [F.struct(F.lit(i).alias("level"), F.floor(px / s).cast("int").alias("cx"), F.floor(py / s).cast("int").alias("cy")) for i, s in enumerate(sizes)]
    rows = points.select(F.struct(*points.columns).alias("__point"), px.alias("__x"), py.alias("__y"), F.explode(F.array(*cell)).alias("__cell"))
    rows = rows.select("__point", "__x", "__y", "__cell.*")
    found = rows.join(cover(polygons), ["level", "cx", "cy"]).where(F.col("edges").isNull() | _holds(F.col("__x"), F.col("__y")))
    return found.select("__point.*", "id")


# ---------------------------------------------------------------- rasters


@dataclass(frozen=True)
class Grid:
    """A raster: west and north edges, the width of a cell, and its numbers of rows and columns; row 0 is the northernmost."""

    west: float
    north: float
    step: float
    nlat: int
    nlon: int

    def centre_x(self, ix: Column) -> Column:
        return F.lit(self.west) + (ix + 0.5) * self.step

    def centre_y(self, iy: Column) -> Column:
        return F.lit(self.north) - (iy + 0.5) * self.step


def inside_runs(polygons: DataFrame, grid: Grid) -> DataFrame:
    """(id, iy, ix0, ix1): runs of cells whose centres are inside, row by row between each odd crossing of the row's middle and the next."""
    every = edges(polygons)
    row = lambda y: (F.lit(grid.north) - y) / grid.step - 0.5
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(F.floor(row(high)), F.lit(0)).cast("int"), F.least(F.floor(row(low)) + 1, F.lit(grid.nlat - 1)).cast("int")
    rows = every.where(first <= last).withColumn("iy", F.explode(F.sequence(first, last)))
    y = grid.centre_y(F.col("iy"))
    crossed = rows.where(_straddles(y)).select("id", "iy", _x_at(y).alias("at"))
    line = Window.partitionBy("id", "iy").orderBy("at")
    pairs = crossed.select("id", "iy", "at", F.lead("at").over(line).alias("to"), F.row_number().over(line).alias("k")).where(F.col("k") % 2 == 1)

    def first_from(v: Column) -> Column:
        """The first column whose centre is not left of v, decided by the centres themselves."""
        k = F.ceil((v - grid.west) / grid.step - 0.5)
        k = F.when(grid.centre_x(k - 1) >= v, k - 1).otherwise(k)
        return F.when(grid.centre_x(k) < v, k + 1).otherwise(k)

    runs = pairs.select("id", "iy", F.greatest(first_from(F.col("at")), F.lit(0)).cast("int").alias("ix0"), F.least(first_from(F.col("to")) - 1, F.lit(grid.nlon - 1)).cast("int").alias("ix1"))
    return runs.where("ix0 <= ix1")


def share_runs(polygons: DataFrame, grid: Grid) -> DataFrame:
    """(id, iy, ix0, ix1, share): which part of each cell (in the plane of the coordinates) is inside, in runs of equal cells.

    Edges are clipped to cells. A clipped edge covers what is right of it in its cell, and its height in all cells further right; the
    sums of these along a row are the shares, and between two cells with edges the share stays what it is.
    """
    e = edges(polygons)
    gx = lambda c: (F.col(c) - grid.west) / grid.step
    gy = lambda c: (F.lit(grid.north) - F.col(c)) / grid.step
    # downward edges have the inside on the right if the inside is on the left of the edge seen against the rows' order
    e = e.select("id", (F.col("sign") * F.signum(gy("y1") - gy("y0"))).alias("sign"), gx("x0").alias("xa"), gy("y0").alias("ya"), gx("x1").alias("xb"), gy("y1").alias("yb")).where("ya <> yb")
    top, bottom = F.least("ya", "yb"), F.greatest("ya", "yb")
    first, last = F.greatest(F.floor(top), F.lit(0)).cast("int"), F.least(F.floor(bottom), F.lit(grid.nlat - 1)).cast("int")
    rows = e.where(first <= last).withColumn("iy", F.explode(F.sequence(first, last)))
    x_at = lambda y: F.col("xa") + (y - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    rows = rows.withColumns({"t": F.greatest(top, F.col("iy").cast("double")), "b": F.least(bottom, F.col("iy") + 1.0)}).where("t < b")
    rows = rows.select("id", "iy", (F.col("sign") * (F.col("b") - F.col("t"))).alias("dy"), F.least(x_at(F.col("t")), x_at(F.col("b"))).alias("l"), F.greatest(x_at(F.col("t")), x_at(F.col("b"))).alias("r"))
    first, last = F.greatest(F.floor("l"), F.lit(-1)).cast("int"), F.greatest(F.least(F.floor("r"), F.lit(grid.nlon - 1)), F.lit(-1)).cast("int")
    parts = rows.where(first <= last).withColumn("ix", F.explode(F.sequence(first, last)))
    left = F.when(F.col("ix") < 0, F.col("l")).otherwise(F.greatest(F.col("l"), F.col("ix").cast("double")))  # column -1 is all that is west
    right = F.least(F.col("r"), F.col("ix") + 1.0)
    part = F.when(F.col("r") > F.col("l"), (right - left) / (F.col("r") - F.col("l"))).otherwise(1.0)
    sums = parts.groupBy("id", "iy", "ix").agg(F.sum(F.col("dy") * part).alias("dy"), F.sum(F.col("dy") * part * (F.col("ix") + 1.0 - (left + right) / 2)).alias("own"))
    line = Window.partitionBy("id", "iy").orderBy("ix")
    sums = sums.select("id", "iy", "ix", "own", F.sum("dy").over(line).alias("through"), "dy", F.lead("ix", 1, grid.nlon).over(line).alias("next"))
    one = F.struct(F.col("ix").alias("ix0"), F.col("ix").alias("ix1"), (F.col("through") - F.col("dy") + F.col("own")).alias("share"))
    gap = F.struct((F.col("ix") + 1).alias("ix0"), (F.col("next") - 1).alias("ix1"), F.col("through").alias("share"))
    runs = sums.select("id", "iy", F.explode(F.array(one, gap)).alias("run")).select("id", "iy", "run.*")
    return runs.where((F.col("ix0") >= 0) & (F.col("ix0") <= F.col("ix1")) & (F.abs("share") > MARGIN))


def cells_in_runs(cells: DataFrame, runs: DataFrame, block: int = 512) -> DataFrame:
    """cells (iy, ix, ...) with id (and share) of every run that holds them: an equi-join on row and block of columns."""
    cut = runs.withColumn("__b", F.explode(F.sequence(F.floor(F.col("ix0") / block).cast("int"), F.floor(F.col("ix1") / block).cast("int"))))
    keyed = cells.withColumn("__b", F.floor(F.col("ix") / block).cast("int"))
    return keyed.join(cut, ["iy", "__b"]).where(F.col("ix").between(F.col("ix0"), F.col("ix1"))).drop("__b", "ix0", "ix1")


def mask(cells: DataFrame, polygons: DataFrame, grid: Grid, name: str = "region") -> DataFrame:
    """cells with the least id of the polygons that hold their centre, NULL outside all; only cells and runs meet, never cells and edges."""
    held = cells_in_runs(cells.select("iy", "ix").distinct(), inside_runs(polygons, grid)).groupBy("iy", "ix").agg(F.min("id").alias(name))
    return cells.join(held, ["iy", "ix"], "left")


def clipped_sums(cells: DataFrame, polygons: DataFrame, grid: Grid, values: list[str], area: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum per polygon of value * area * share of the cell that is inside; without area of value * share."""
    weight = F.col("share") * (F.col(area) if area else F.lit(1.0))
    found = cells_in_runs(cells, share_runs(polygons, grid))
    return found.groupBy("id", *keys).agg(*[F.sum(F.col(v) * weight).alias(v) for v in values], F.sum(weight).alias("inside"))
