"""Hand-worked drills, and different routes to one answer."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rasterdrill import schema as S
from rasterdrill import tuning
from rasterdrill.grid import Grid
from rasterdrill.operators import admission as A
from rasterdrill.operators import combine as C
from rasterdrill.operators import geometry as G
from rasterdrill.plans import cube
from rasterdrill.plans import drills as D
from rasterdrill.sources import scenes as SC

SF = "/root/testdata/sf0.001"
GRID = Grid(tile=8, tiles_across=8, first_tile_x=0)
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2", "fmask", "nbart_contiguity")
WET_BANDS = (100, 100, 100, 100, 100, 100, 1, 1)  # wetness about -59
DRY_BANDS = (100, 100, 100, 100, 900, 900, 1, 1)  # wetness below -350


def scene_frame(spark, *scenes):
    """Scenes over the first tile: (scene_id, time)."""
    rows = [(i, datetime.fromisoformat(t), "ls8", 150.0, 0.5, 0.0, 0.0, 8.0, 8.0) for i, t in scenes]
    return spark.createDataFrame(
        rows,
        "scene_id bigint, ts timestamp_ntz, product string, lon double, gqa_iterative_mean_xy double,"
        " sx0 double, sy0 double, sx1 double, sy1 double",
    )


def pixel_frame(spark, scenes, rows):
    """Pixels: (scene_id, x, y, bs, pv, npv, water, surface bands, canopy class)."""
    times = {r["scene_id"]: r["ts"] for r in scenes.collect()}
    data = [
        (i, times[i], 0, y, x, bs, pv, npv, water, *surface, canopy)
        for i, x, y, bs, pv, npv, water, surface, canopy in rows
    ]
    names = ", ".join(f"{b} int" for b in ("bs", "pv", "npv", "water", *BANDS, "canopy_cover_class"))
    return spark.createDataFrame(
        data, f"scene_id bigint, ts timestamp_ntz, tile_id bigint, y int, x int, {names}"
    )


def square(spark, size=2):
    pts = [(0.1, 0.1), (size - 0.1, 0.1), (size - 0.1, size - 0.1), (0.1, size - 0.1), (0.1, 0.1)]
    return spark.createDataFrame(
        [(7, 0, i, x, y) for i, (x, y) in enumerate(pts)],
        "poly_id bigint, ring int, seq int, vx double, vy double",
    )


def test_cover_by_hand(spark, rows):
    sc = scene_frame(spark, (1, "2014-05-01 00:00:10"), (2, "2014-06-01 00:00:10"))
    px = pixel_frame(spark, sc, [
        (1, 0, 0, 60, 30, 10, 0, WET_BANDS, 1),
        (1, 1, 0, 10, 80, 10, 0, WET_BANDS, 2),
        (1, 0, 1, 5, 5, 90, 64, WET_BANDS, 2),
        (1, 1, 1, -1, -1, -1, 1, WET_BANDS, 255),
        (1, 5, 5, 99, 0, 1, 0, WET_BANDS, 3),  # outside the polygon
        (2, 0, 0, -1, -1, -1, 0, WET_BANDS, 1),  # dry, but without cover
    ])
    got = rows(D.cover_drill(px, sc, square(spark), GRID))
    third = 1 / 3 * 100
    assert got[0] == (7, datetime(2014, 5, 1, 0, 0, 10), third, third, 0.0, third)
    # No valid pixel at all: every share is missing, the time is not.
    assert got[1] == (7, datetime(2014, 6, 1, 0, 0, 10), None, None, None, None)

    counts = D.cover_counts(px, sc, square(spark), GRID).orderBy("time").collect()[1]
    assert (counts["valid_bs"], counts["seen"], counts["n_bs"]) == (0, 1, 1)
    strict = D.cover_counts(px, sc, square(spark), GRID, strict_nodata=True).orderBy("time").collect()[1]
    assert (strict["seen"], strict["n_bs"]) == (0, 0)


def test_overlapping_scenes_of_a_solar_day(spark, rows):
    """Cover takes the first valid source, water the last; the label is the first time."""
    sc = scene_frame(spark, (5, "2014-04-30 23:59:50"), (3, "2014-05-01 00:00:15"), (4, "2014-05-01 00:00:15"))
    px = pixel_frame(spark, sc, [
        (5, 0, 0, -1, 90, 10, 64, WET_BANDS, 1),
        (3, 0, 0, 70, 20, 10, 1, WET_BANDS, 1),
        (4, 0, 0, 50, 20, 30, 0, WET_BANDS, 1),
        (5, 1, 0, 40, 30, 30, 128, WET_BANDS, 1),
        (3, 1, 0, 20, 10, 70, 1, WET_BANDS, 1),
    ])
    grouped = SC.group_scenes(sc).select("scene_id", "grp", "ord")
    ready = C.with_scene(px, grouped, "grp", "ord")
    fused = C.fuse(ready, {b: -1 for b in S.COVER_BANDS}, water="water")
    assert rows(fused, "x", "bs", "pv", "npv", "water") == [(0, 70, 90, 10, 0), (1, 40, 30, 30, 128)]
    spine = D.cover_drill(px, sc, square(spark), GRID).collect()
    assert [r["time"] for r in spine] == [datetime(2014, 4, 30, 23, 59, 50)]


def test_mangrove_by_hand(spark, rows):
    sc = scene_frame(spark, (1, "2014-05-01 00:00:10"), (2, "2015-05-01 00:00:10"))
    px = pixel_frame(spark, sc, [
        (1, x, y, 0, 0, 0, 0, WET_BANDS, c) for x, y, c in [(0, 0, 1), (1, 0, 3), (0, 1, 3), (1, 1, 255), (4, 4, 2)]
    ])
    got = rows(D.mangrove_drill(px, sc, square(spark), GRID))
    assert got == [(7, datetime(2014, 5, 1, 0, 0, 10), 1, 0, 2), (7, datetime(2015, 5, 1, 0, 0, 10), 0, 0, 0)]


def test_overlap_at_one_exact_time(spark, rows):
    """Said to overlap, scenes of one time merge instead of counting twice."""
    sc = scene_frame(spark, (1, "2014-05-01 00:00:10"), (2, "2014-05-01 00:00:10"))
    px = pixel_frame(spark, sc, [
        (1, 0, 0, 10, 20, 70, 0, DRY_BANDS, 255), (2, 0, 0, 10, 20, 70, 0, DRY_BANDS, 2),
        (1, 1, 0, 10, 20, 70, 128, DRY_BANDS, 1), (2, 1, 0, 10, 20, 70, 128, DRY_BANDS, 2),
        (1, 0, 1, 10, 20, 70, 0, WET_BANDS, 1), (1, 1, 1, 10, 20, 70, 0, WET_BANDS, 1),
    ])
    got = rows(D.mangrove_drill(px, sc, square(spark), GRID, overlapping=True))
    assert got == [(7, datetime(2014, 5, 1, 0, 0, 10), 3, 1, 0)]
    areas = D.wetland_areas(px, sc, square(spark), GRID, overlapping=True).first()
    assert (areas["valid"], areas["water"], areas["wet"]) == (4, 1, 2)


def test_wetland_by_hand(spark, rows):
    sc = scene_frame(spark, (1, "2014-05-01 00:00:10"), (2, "2014-05-01 00:00:35"))
    full = [
        (1, 0, 0, 20, 30, 50, 0, DRY_BANDS, 1),
        (1, 1, 0, 40, 40, 20, 0, DRY_BANDS, 1),
        (1, 0, 1, 10, 10, 80, 0, WET_BANDS, 1),
        (1, 1, 1, 10, 10, 80, 128, WET_BANDS, 1),
    ]
    partial = [(2, x, y, 20, 30, 50, 0 if x else 64, DRY_BANDS, 1) for x in (0, 1) for y in (0, 1)]
    px = pixel_frame(spark, sc, full + partial)
    got = D.wetland_drill(px, sc, square(spark), GRID).collect()
    assert len(got) == 1  # half of the second time is cloud
    r = got[0]
    assert r["time"] == datetime(2014, 5, 1, 0, 0, 10)
    assert [round(r[c], 6) for c in ("water", "wet", "bs", "pv", "npv")] == [0.25, 0.25, 0.15, 0.175, 0.175]
    assert r["geometry"] == "POLYGON ((0.1 0.1, 1.9 0.1, 1.9 1.9, 0.1 1.9, 0.1 0.1))"
    merged = D.wetland_areas(px, sc, square(spark), GRID, aggregate=7).collect()
    assert [(m["valid"], m["water"]) for m in merged] == [(4, 1)]


def test_share_must_exceed_nine_tenths(spark):
    """Nine valid pixels of ten are not enough."""
    sc = scene_frame(spark, (1, "2014-05-01 00:00:10"))
    pts = [(0.1, 0.1), (4.9, 0.1), (4.9, 1.9), (0.1, 1.9), (0.1, 0.1)]
    po = spark.createDataFrame([(7, 0, i, x, y) for i, (x, y) in enumerate(pts)],
                               "poly_id bigint, ring int, seq int, vx double, vy double")
    cells = [(x, y) for x in range(5) for y in range(2)]
    for n, kept in ((9, 0), (10, 1)):
        px = pixel_frame(spark, sc, [(1, x, y, 1, 1, 98, 0, DRY_BANDS, 1) for x, y in cells[:n]])
        assert D.wetland_drill(px, sc, po, GRID).count() == kept


def test_point_without_data_is_not_observable(spark, rows):
    sc = scene_frame(spark, (1, "2014-05-01 00:00:10"), (2, "2014-06-01 00:00:10"))
    px = pixel_frame(spark, sc, [(1, 3, 1, 0, 0, 0, 128, WET_BANDS, 1)])
    pts = spark.createDataFrame([(1, 3.4, 1.7)], "point_id int, lon double, lat double")
    got = rows(D.point_water_drill(px, sc, pts, GRID), "time", "longitude", "latitude", "observation")
    assert got == [
        (datetime(2014, 5, 1, 0, 0, 10), 3.4, 1.7, "wet"),
        (datetime(2014, 6, 1, 0, 0, 10), 3.4, 1.7, "not observable"),
    ]


@pytest.fixture(scope="module")
def archive(spark):
    px, po = cube.pixels(spark, SF).persist(), cube.polygons(spark, SF)
    po = spark.createDataFrame(po.collect(), po.schema)
    yield px, cube.scenes(spark, SF), po, cube.GRID
    px.unpersist()


def test_products_stored_apart_give_the_same(archive, rows):
    """Fuse each product on its own and align them: the same as fusing them together."""
    px, sc, _, _ = archive
    scenes = SC.group_scenes(sc).select("scene_id", "grp", "ord")
    ready = C.with_scene(px, scenes, "grp", "ord")
    nodata = {b: -1 for b in S.COVER_BANDS}
    apart = C.juxtapose(C.fuse_first_valid(ready, nodata), C.fuse_water(ready))
    together = C.fuse(ready, nodata, water="water")
    columns = [*C.PIXEL_KEY, *S.COVER_BANDS, "water"]
    assert apart.select(columns).exceptAll(together.select(columns)).count() == 0
    assert apart.count() == together.count()


DRILLS = {
    "cover": D.cover_counts,
    "mangrove": D.mangrove_drill,
    "wetland": D.wetland_areas,
    "composite": lambda *a, **k: D.wetland_areas(*a, aggregate=365, **k),
}


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("name", DRILLS)
def test_ranges_per_request_equal_one_range(spark, archive, name):
    """A range on every request is the same as that range for the whole job."""
    drill, po = DRILLS[name], archive[2]
    every = po.select("poly_id").distinct().select("poly_id", F.lit("2001").alias("start"), F.lit("2004-05").alias("end"))
    assert same(drill(*archive, ranges=every), drill(*archive, time=("2001", "2004-05")))
    none = every.withColumn("end", F.lit(None).cast("string"))
    assert same(drill(*archive, ranges=none), drill(*archive))


@pytest.mark.parametrize("name", ["mangrove", "wetland"])
def test_merging_is_harmless_without_overlap(archive, name):
    assert same(DRILLS[name](*archive, overlapping=True), DRILLS[name](*archive))


@pytest.mark.parametrize("name", DRILLS)
def test_same_answer_beyond_the_broadcast_limit(archive, monkeypatch, name):
    """With nothing allowed to broadcast, merge joins give the same rows."""
    want = DRILLS[name](*archive).collect()
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    got = DRILLS[name](*archive)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "strategy=broadcast" not in plan
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_admission_messages(spark, archive):
    sc = SC.group_scenes(scene_frame(spark, *[(i, f"2014-05-{i:02d} 00:00:10") for i in range(1, 6)]))
    po = square(spark)

    def status(refine, scenes=sc, polygons=po):
        r = A.guard_rail(polygons, scenes, GRID, S.COVER_PRODUCT, refine=refine).first()
        return r["times"], r["status"]

    assert status(1) == (5, "ok")
    # 5 times x (2 x 9000)^2 pixels x 6 bytes = 9.72 GB, 1.9 GB each
    assert status(9000) == (5, "ok")
    assert status(10000) == (5, "requested time slices each requires 2GB data to load - maximum is 2.0GB")
    assert status(13000) == (5, "requested area requires 20GB data to load - maximum is 20.0GB")
    assert status(1, sc.filter("false")) == (0, "no data returned for query")
