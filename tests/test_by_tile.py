"""Beyond the broadcast limit pixels are dealt by tile once, and nothing after that moves them."""

from __future__ import annotations

import pytest
from test_plans import DRILLS, exchanges, stored, wide  # noqa: F401

from pyspark.sql import functions as F

from rasterdrill import tuning
from rasterdrill.operators import geometry as G
from rasterdrill.operators import temporal as T
from rasterdrill.plans import cube
from rasterdrill.plans import drills as D
from rasterdrill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
WINDOWS = {
    "windows": lambda px, sc, po: D.wetland_areas(px, sc, po, cube.GRID, aggregate=1),
    "composite": lambda px, sc, po: D.wetland_areas(px, sc, po, cube.GRID, aggregate=365),
}


@pytest.mark.parametrize("name", [*DRILLS, *WINDOWS])
def test_pixels_move_once(spark, stored, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    drill = (DRILLS | WINDOWS)[name]
    found = exchanges(drill(wide(spark, stored), cube.scenes(spark, SF), cube.polygons(spark, SF)))
    sums = ["set_a", "set_b"]  # sums per set of polygons and time
    moved = [keys for keys, below, pixels in found if pixels and below != "HashAggregate" and keys != sums]
    assert moved == [["tile_id"]]


@pytest.mark.parametrize("name", WINDOWS)
def test_windows_are_not_built_to_count_them(spark, stored, monkeypatch, name):  # noqa: F811
    """Spines and windows were taken twice, once to choose how they join."""
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    walk = T.anchored_windows
    unwanted = F.raise_error(F.lit("windows were built")).isNull()
    monkeypatch.setattr(T, "anchored_windows", lambda *a, **k: walk(*a, **k).filter(unwanted))
    WINDOWS[name](wide(spark, stored), cube.scenes(spark, SF), cube.polygons(spark, SF))


def test_bounds_of_windows(spark):
    """Extents of two tiles, one and none; three scenes of two times lie on tiles 0 and 1."""
    extents = spark.createDataFrame(
        [(1, 0.0, 0.0, 16.0, 8.0), (2, 0.0, 0.0, 8.0, 8.0), (3, 16.0, 0.0, 24.0, 8.0)],
        "poly_id long, bx0 double, by0 double, bx1 double, by1 double",
    )
    shots = [("2000-01-01", 0), ("2000-01-02", 0), ("2000-01-01", 8)]
    scenes = spark.createDataFrame(
        [(t, x + 0.0, 0.0, x + 8.0, 8.0) for t, x in shots], "t string, sx0 double, sy0 double, sx1 double, sy1 double"
    ).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert G.spine_bound(extents, scenes, cube.GRID) == 5
    assert G.window_bounds(extents, scenes, cube.GRID) == (2 + 2 + 0, 2 * 2 + 2 + 0)


PIXELS_ONLY = ["collate", "fuse_first_valid", "fuse_water", "juxtapose", "mask_polygon", "prune_bbox"]


@pytest.mark.parametrize("name", PIXELS_ONLY)
def test_an_archive_dealt_by_tile_is_not_moved(spark, monkeypatch, name):
    """Joins and merges of pixels are satisfied by the tile."""
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    pixel_keys = [line for line in lines if "scene_id" in line or ("tile_id" in line and " x#" in line)]
    assert lines and not pixel_keys


@pytest.mark.parametrize("hashed", [tuning.HASHED_ROWS, -1])
@pytest.mark.parametrize("name", ["fc_drill", "wofs_pixel_drill", "wit_drill_reprojected", "average_over_day"])
def test_answers_do_not_hang_on_the_join(spark, monkeypatch, rows, name, hashed):
    want = rows(QUERIES[name](spark, SF))
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(tuning, "HASHED_ROWS", hashed)
    assert len(want) > 10 and rows(QUERIES[name](spark, SF)) == want


def test_half_a_million_rows_are_not_sent_through_the_driver(spark):
    """Near the old limit a drill held several such tables in the driver at once."""
    side = spark.range(8).selectExpr("id AS tile_id", "id AS v")
    for hinted in (tuning.sized(side, 500_000), tuning.beside(side, 500_000)):
        assert "strategy=broadcast" not in hinted._jdf.queryExecution().optimizedPlan().toString().lower()
        joined = tuning.dealt(side.drop("v"), 500_000).join(hinted, "tile_id")
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["wofs_pixel_drill_ranges", "wit_drill_requests"])
def test_tables_of_a_row_per_request_are_not_sent_through_the_driver(spark, monkeypatch, name):
    """The planner's own estimate of ranges and parameters is below its limit for a million requests too."""
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "Inner" not in line]
    assert not [line for line in joins if "point_id" in line or "poly_id" in line]


@pytest.mark.parametrize("limit", [tuning.BROADCAST_ROWS, -1])
def test_ranges_are_read_once_per_request(spark, monkeypatch, limit):
    """The texts of a range were read again for each pixel and each scene they met."""
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", limit)
    plan = QUERIES["wofs_pixel_drill_ranges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if "Join Inner" in line and "start#" in line]
    assert len(met) == 2 and not [line for line in met if "RLIKE" in line]


def test_tiles_of_points_are_listed_once(spark, monkeypatch):
    """A drill with ranges listed them twice, once for pixels that it did not read."""
    calls, listed = [], G.tile_filter
    monkeypatch.setattr(G, "tile_filter", lambda tiles: calls.append(1) or listed(tiles))
    QUERIES["wofs_pixel_drill_ranges"](spark, SF)
    assert len(calls) == 1


# --- windows per request -----------------------------------------------------

def lengths(polygons, days=(0, 0, 1, 16, 400)):
    """A length of window per request; every seventh request has none."""
    ids = polygons.select("poly_id").distinct().filter("poly_id % 7 != 6")
    return ids.withColumn("aggregate", F.element_at(F.array(*map(F.lit, days)), (F.col("poly_id") % len(days) + 1).cast("int")))


@pytest.mark.parametrize("limit", [tuning.BROADCAST_ROWS, -1])
def test_requests_without_windows_share_their_pixels(spark, stored, monkeypatch, rows, limit):  # noqa: F811
    """Each pixel of a time was merged once for every polygon that holds it."""
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", limit)
    seen, either = [], T.composite_either
    monkeypatch.setattr(T, "composite_either", lambda px, *a, **k: seen.append(px) or either(px, *a, **k))
    data = wide(spark, stored), cube.scenes(spark, SF), cube.polygons(spark, SF), cube.GRID
    got = rows(D.wetland_areas(*data, aggregate=lengths(data[2], (0,))))
    place = seen[0].select("ts", "tile_id", "y", "x")
    assert place.count() == place.distinct().count() > 10_000
    assert got == rows(D.wetland_areas(*data))


@pytest.mark.parametrize("limit", [tuning.BROADCAST_ROWS, -1])
def test_windows_per_request_as_merged_per_polygon(spark, stored, monkeypatch, rows, limit):  # noqa: F811
    """Lengths of all kinds, also where pixels and lengths come twice."""
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", limit)
    px = wide(spark, stored)
    po = cube.polygons(spark, SF)
    days = lengths(po)
    twice = px.unionByName(px.filter("(scene_id + x + y) % 5 = 0"))
    data = twice, cube.scenes(spark, SF), po, cube.GRID
    mask = G.polygon_mask(po, cube.GRID, all_touched=True)
    merged = D.wetland_composite(*data, aggregate=days, mask=mask)
    want = rows(D.wetland_area(merged, ["poly_id", F.col("anchor").alias("time")]))
    got = rows(D.wetland_areas(*data, aggregate=days.unionByName(days.filter("poly_id % 2 = 0")), mask=mask))
    assert got == want and len({r[0] for r in got}) >= 7


def test_pixels_of_windows_per_request_move_once(spark, stored, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    po = cube.polygons(spark, SF)
    found = exchanges(D.wetland_areas(wide(spark, stored), cube.scenes(spark, SF), po, cube.GRID, aggregate=lengths(po)))
    moved = [keys for keys, below, pixels in found if pixels and below != "HashAggregate" and keys != ["set_a", "set_b"]]
    assert moved == [["tile_id"]]
