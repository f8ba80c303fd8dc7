"""Nearest-neighbour resampling to a metric grid, and projecting geometry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterdrill.functions.projection import Albers
from rasterdrill.grid import Grid
from rasterdrill.operators.geometry import extent_tiles

# The metric target grid, 30 m pixels, rows running south. Eastings are
# negative west of the central meridian, so tile columns run both ways.
METRIC_GRID = Grid(origin_x=0.0, origin_y=0.0, res_x=30.0, res_y=-30.0)


def project_points(
    df: DataFrame, lon: str = "lon", lat: str = "lat", albers: Albers = Albers()
) -> DataFrame:
    """Add ``east`` and ``north`` in metres; works on points and on vertex rows."""
    east, north = albers.forward(F.col(lon), F.col(lat))
    return df.withColumns({"east": east, "north": north})


def reproject_nearest(
    pixels: DataFrame, source: Grid, target: Grid = METRIC_GRID, albers: Albers = Albers()
) -> DataFrame:
    """Pixels of a longitude/latitude grid moved to the target grid.

    A target pixel takes the source pixel under its centre. Each source pixel
    lists the few target pixels near its own corners and keeps those whose
    centre falls back into it. A centre lies in one source pixel only, so every
    target pixel is written once, with neither join nor shuffle. Adds ``tx``,
    ``ty`` and ``target_tile``, the target's tile number; other columns are kept.
    """
    x, y = F.col("x"), F.col("y")
    cols, rows = [], []
    for dx in (0, 1):
        for dy in (0, 1):
            lon = F.lit(source.origin_x) + (x + F.lit(dx)) * F.lit(source.res_x)
            lat = F.lit(source.origin_y) + (y + F.lit(dy)) * F.lit(source.res_y)
            east, north = albers.forward(lon, lat)
            cols.append(target.col(east))
            rows.append(target.row(north))
    corners = pixels.withColumns(
        {f"_c{i}": c for i, c in enumerate(cols)} | {f"_r{i}": r for i, r in enumerate(rows)}
    )

    def cells(prefix: str, slack: float):
        names = [f"{prefix}{i}" for i in range(4)]
        low = F.ceil(F.least(*names) - F.lit(0.5 + slack)).cast("bigint")
        high = F.floor(F.greatest(*names) - F.lit(0.5 - slack)).cast("bigint")
        return F.explode(F.when(high >= low, F.sequence(low, high)))

    # A projected pixel edge bulges by less than its length squared over the
    # Earth's radius; a centre that near the corners' box is a candidate too.
    edge = 111_700.0 * math.hypot(source.res_x, source.res_y)
    bulge = edge * edge / 6.3e6

    near = (
        corners.withColumn("tx", cells("_c", bulge / abs(target.res_x) + 1e-3))
        .withColumn("ty", cells("_r", bulge / abs(target.res_y) + 1e-3))
        .drop(*[f"_c{i}" for i in range(4)], *[f"_r{i}" for i in range(4)])
    )
    lon, lat = albers.inverse(target.x_centre(F.col("tx")), target.y_centre(F.col("ty")))
    own = near.filter((F.floor(source.col(lon)) == x) & (F.floor(source.row(lat)) == y))
    return own.withColumn("target_tile", target.tile_id(F.col("tx"), F.col("ty")))


def source_tiles(
    targets: DataFrame, target: Grid, source: Grid, albers: Albers = Albers()
) -> DataFrame:
    """``tile_id`` of the source tiles that may lie under target tiles ``(_tx, _ty)``.

    The corners of a target tile go back to longitude and latitude. Its edges are curves
    there, which leave the corners' box by less than the square of their length over the
    Earth's radius (at these latitudes); the box is widened by that and a source pixel.
    """
    size = float(target.tile)
    cols, rows = [], []
    for dx in (0, 1):
        for dy in (0, 1):
            east = F.lit(target.origin_x) + (F.col("_tx") + F.lit(dx)) * F.lit(size * target.res_x)
            north = F.lit(target.origin_y) + (F.col("_ty") + F.lit(dy)) * F.lit(size * target.res_y)
            lon, lat = albers.inverse(east, north)
            cols.append(source.col(lon))
            rows.append(source.row(lat))
    edge = size * math.hypot(target.res_x, target.res_y)
    bulge = edge * edge / 6.3e6 / 80_000.0  # degrees: one of longitude has 80 km or more up to 44 degrees
    wide, high = 1 + bulge / abs(source.res_x), 1 + bulge / abs(source.res_y)

    def ends(values: list, slack: float):
        return F.least(*values) - F.lit(slack), F.greatest(*values) + F.lit(slack)

    (x0, x1), (y0, y1) = ends(cols, wide), ends(rows, high)
    boxes = targets.select(x0.alias("bx0"), y0.alias("by0"), x1.alias("bx1"), y1.alias("by1"))
    return extent_tiles(boxes, source).select("tile_id").distinct()
