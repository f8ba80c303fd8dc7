"""Masks in two levels and drills from tile summaries: answers, sizes and what is read."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_plans import read_of_the_store, stored, wide  # noqa: F401

from rasterdrill import tuning
from rasterdrill.grid import Grid
from rasterdrill.operators import geometry as G
from rasterdrill.plans import cube
from rasterdrill.plans import drills as D

SF = "/root/testdata/sf0.001"
TILE = Grid(tile=8, tiles_across=64)
VERTICES = "poly_id int, ring int, seq int, vx double, vy double"


def rings(spark, seed=5):
    """Stars with holes, thin slivers, and squares that run along tile borders or just beside them."""
    rnd, rows = random.Random(seed), []

    def ring(poly, number, points):
        rows.extend((poly, number, i, float(x), float(y)) for i, (x, y) in enumerate([*points, points[0]]))

    def star(cx, cy, low, high, n):
        turn = [2 * math.pi * i / n for i in range(n)]
        return [(cx + (r := rnd.uniform(low, high)) * math.cos(a), cy + r * math.sin(a)) for a in turn]

    for k in range(6):
        cx, cy = rnd.uniform(-40, 40), rnd.uniform(-40, 40)
        ring(k, 0, star(cx, cy, 25, 45, rnd.randint(3, 30)))
        ring(k, 1, star(cx, cy, 3, 12, 7))
    for k, beside in enumerate((0.0, 1e-9, -1e-9, 0.49, 1e-5), start=10):
        a, b = 8 + beside, 40 - beside
        ring(k, 0, [(a, a), (b, a), (b, b), (a, b)])
    ring(20, 0, [(-30.2, -30.1), (60.3, 44.4), (60.4, 44.9)])
    ring(21, 0, [(-400, -3), (400, -3), (400, 30), (-400, 30)])  # beyond the grid's columns
    return spark.createDataFrame(rows, VERTICES)


@pytest.mark.parametrize(
    "grid,all_touched", [(TILE, False), (replace(TILE, curve=True), True), (Grid(tile=5, tiles_across=100), True)]
)
def test_both_levels_are_the_mask(spark, grid, all_touched):
    po = rings(spark)
    two, one = G.two_level_mask(po, grid, all_touched), G.polygon_mask(po, grid, all_touched)
    pixel = ("poly_id", "tile_id", "y", F.explode(F.sequence("x_from", "x_to")).alias("x"))
    each, border = one.each.select(*pixel), two.border.select(*pixel)
    whole = each.groupBy("poly_id", "tile_id").count().filter(F.col("count") == grid.tile**2)
    full = two.full
    assert full.count() == full.distinct().count() > 20
    assert full.exceptAll(whole.drop("count")).count() == 0
    inside = each.join(full, ["poly_id", "tile_id"], "left_anti")
    assert inside.exceptAll(border).count() == 0 and border.exceptAll(inside).count() == 0
    assert two.border.select("poly_id", "tile_id").distinct().exceptAll(two.border_tiles).count() == 0
    area = lambda df: {tuple(r) for r in df.collect()}
    assert area(two.area(grid)) == area(one.area())
    assert max(df.count() for df in two[:3]) <= two.bound


def test_rows_grow_with_the_outline(spark):
    """A square of 100 by 100 tiles: one row per tile inside, spans along the outline only."""
    grid = Grid(tile=16, tiles_across=256)
    a, b = 0.3, 1600.2
    po = spark.createDataFrame([(1, 0, i, x, y) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b), (a, a)])], VERTICES)
    two = G.two_level_mask(po, grid)
    assert two.full.count() == 98 * 98 + 2 * 98 + 1  # the edge at 1600.2 lies in the next tile
    assert two.border_tiles.count() == 4 * 100
    assert two.border.count() <= 2 * 1600 + 2 * 16 * 100
    assert G.polygon_mask(po, grid).each.count() == 1600 * 100


def test_no_polygon(spark):
    two = G.two_level_mask(rings(spark).limit(0), TILE)
    assert [df.count() for df in two[:3]] == [0, 0, 0]


@pytest.fixture(scope="module")
def summaries(spark, stored, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("summaries") / "canopy")
    made = D.canopy_summaries(wide(spark, stored))
    made.write.partitionBy("tile_id").parquet(path)
    return spark.read.schema(made.schema).parquet(path).select(made.columns)


@pytest.mark.parametrize("limit", [None, -1])
def test_summaries_answer_like_pixels(spark, stored, summaries, monkeypatch, rows, limit):  # noqa: F811
    if limit is not None:
        monkeypatch.setattr(tuning, "BROADCAST_ROWS", limit)
    px, sc, po = wide(spark, stored), cube.scenes(spark, SF), cube.polygons(spark, SF)
    ranges = spark.createDataFrame([(0, "2000", "2003"), (3, "2001-02", "2004-07-09")], "poly_id bigint, start string, end string")
    for options in ({}, {"ranges": ranges, "time": ("2000", "2006")}) if limit is None else ({"ranges": ranges},):
        want = rows(D.mangrove_drill(px, sc, po, cube.GRID, **options))
        assert rows(D.mangrove_drill_summaries(px, summaries, sc, po, cube.GRID, **options)) == want


def test_overlapping_scenes(spark, stored, rows):  # noqa: F811
    px, sc, po = wide(spark, stored), cube.scenes(spark, SF), cube.polygons(spark, SF)
    merged = D.canopy_summaries(px, sc)
    want = rows(D.mangrove_drill(px, sc, po, cube.GRID, overlapping=True))
    assert rows(D.mangrove_drill_summaries(px, merged, sc, po, cube.GRID, overlapping=True)) == want


def test_pixels_are_read_from_border_tiles_only(spark, stored, summaries, rows):  # noqa: F811
    """A polygon over one whole tile and a strip of the next reads the files of the next alone."""
    px, sc, grid = wide(spark, stored), cube.scenes(spark, SF), cube.GRID
    x0, y0, size = grid.first_col, grid.first_tile_y * grid.tile, grid.tile
    a, b, c, d = x0 - 0.5, y0 - 0.5, x0 + size + 2.5, y0 + size + 0.5
    ring = [(a, b), (c, b), (c, d), (a, d), (a, b)]
    po = spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate(ring)], VERTICES.replace("int", "bigint", 1))
    drill = D.mangrove_drill_summaries(px, summaries, sc, po, grid)
    files, read = read_of_the_store(drill)
    all_files, all_read = read_of_the_store(D.mangrove_drill(px, sc, po, grid))
    assert G.two_level_mask(po, grid).full.count() == 1
    assert 0 < files < all_files and 0 < read < all_read
    assert rows(drill) == rows(D.mangrove_drill(px, sc, po, grid))
