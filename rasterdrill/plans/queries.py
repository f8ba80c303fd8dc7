"""The registered queries: every operator run over the archive of ``cube.py``.

Pixel-level operators end in per-scene or per-tile sums that pin each value to
its place, so the whole table is checked without returning it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterdrill import schema as S
from rasterdrill.functions import pixel as P
from rasterdrill.grid import Grid
from rasterdrill.operators import admission as A
from rasterdrill.operators import combine as C
from rasterdrill.operators import geometry as G
from rasterdrill.operators import present as V
from rasterdrill.operators import reproject as R
from rasterdrill.operators import temporal as T
from rasterdrill.plans import cube
from rasterdrill.plans import drills as D
from rasterdrill.sources import pixels as PX
from rasterdrill.sources import requests as RQ
from rasterdrill.sources import scenes as SC
from rasterdrill.sources.times import inside_request
from rasterdrill.tuning import beside, counted, dealt, rows_of, shared_folder

GRID = cube.GRID
SURFACE_NODATA = S.nodata_of(S.SURFACE_PRODUCT)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _round6(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, halves upwards, in arithmetic that every engine does alike."""
    return df.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in columns})


def _sum(value: Column | str, name: str) -> Column:
    return F.sum(F.col(value) if isinstance(value, str) else value).cast("bigint").alias(name)


def _steps(value: Column, factor: int, name: str) -> Column:
    """A sum of rounded values: whole numbers, so the order of adding is no matter."""
    return F.sum(F.round(value.cast("double") * factor).cast("bigint")).alias(name)


def _place() -> Column:
    """A number for the pixel's place on the grid."""
    return F.col("x") + 64 * F.col("y") + 1


# --- scans, filters, requests ------------------------------------------------

@query
def scan_pixels(spark, sf):
    px = PX.scan_pixels(cube.pixels(spark, sf), S.COVER_BANDS)
    return px.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[_sum(b, f"sum_{b}") for b in S.COVER_BANDS],
        _sum(F.col("bs") * _place(), "placed_bs"),
    )


@query
def filter_time_range(spark, sf):
    ranges = cube.request_texts(spark, sf, cube.RANGE_TEXTS)
    asked = G.points_to_pixels(cube.points(spark, sf), GRID).join(ranges, "point_id")
    return (
        asked.join(cube.scenes(spark, sf).select("tile_id", "ts"), "tile_id")
        .filter(inside_request(F.col("ts"), F.col("start"), F.col("end")))
        .groupBy("point_id")
        .agg(
            F.count(F.lit(1)).alias("n_scenes"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


@query
def prune_bbox(spark, sf):
    px = cube.pixels(spark, sf).select("tile_id", "y", "x", "water")
    return (
        G.prune_bbox(px, cube.polygons(spark, sf), GRID)
        .groupBy("tile_id")
        .agg(F.count(F.lit(1)).alias("n_pixels"), _sum("water", "sum_water"))
    )


@query
def pixels_in_extents(spark, sf):
    px = cube.pixels(spark, sf).select("scene_id", "tile_id", "y", "x", "water")
    held = G.pixels_in_extents(px, cube.polygons(spark, sf), GRID)
    # Per scene first: a dominant polygon then has few rows left to count apart.
    per_scene = held.groupBy("poly_id", "scene_id").agg(F.count(F.lit(1)).alias("n"), _sum("water", "w"))
    return per_scene.groupBy("poly_id").agg(
        _sum("n", "n_pixels"), F.count(F.lit(1)).alias("n_scenes"), _sum("w", "sum_water")
    )


@query
def filter_scene_quality(spark, sf):
    return SC.filter_scene_quality(cube.scenes(spark, sf)).select("scene_id", "ts", "gqa_iterative_mean_xy")


@query
def filter_sensor_epoch(spark, sf):
    return SC.filter_sensor_epoch(cube.scenes(spark, sf)).select("scene_id", "product", "ts")


@query
def parse_feature_requests(spark, sf):
    return RQ.parse_feature_requests(cube.request_texts(spark, sf, cube.REQUEST_TEXTS), "request_id")


@query
def parse_time_requests(spark, sf):
    return RQ.parse_time_requests(cube.request_texts(spark, sf, cube.TIME_TEXTS))


@query
def parse_parameters(spark, sf):
    parsed = RQ.parse_parameters(cube.request_texts(spark, sf, cube.PARAMETER_TEXTS))
    return parsed.select("request_id", "status", "aggregate", F.size("parameters").alias("n_parameters"))


# --- combining products ------------------------------------------------------

def _by_scene(px: DataFrame, scenes: DataFrame, *columns: str) -> DataFrame:
    """Pixels of ``scenes``; a scene here covers one tile, which both name."""
    n = rows_of(scenes)
    return C.with_scene(dealt(px, n), beside(scenes, n), *columns, on=("scene_id", "tile_id"))


@query
def collate(spark, sf):
    good = D.wetland_scenes(cube.scenes(spark, sf))
    px = cube.pixels(spark, sf).select("scene_id", "tile_id", "blue", "swir2")
    sensors = {
        name: _by_scene(px, good.filter(F.col("product") == name))
        for name in S.SENSOR_EPOCHS
    }
    return (
        C.collate(sensors)
        .groupBy("product", "tile_id")
        .agg(F.count(F.lit(1)).alias("n"), _sum("blue", "sum_blue"), _sum("swir2", "sum_swir2"))
    )


@query
def juxtapose(spark, sf):
    px, sc = cube.pixels(spark, sf), cube.scenes(spark, sf)
    keys = ["ts", "tile_id", "y", "x"]
    cover = _by_scene(px.select("scene_id", *keys, *S.COVER_BANDS), SC.filter_scene_quality(sc))
    water = _by_scene(px.select("scene_id", *keys, "water"), SC.filter_sensor_epoch(sc))
    return (
        C.juxtapose(cover.drop("scene_id"), water.drop("scene_id"), keys)
        .groupBy("tile_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _sum(F.col("bs") * F.col("water"), "bs_water"),
            _sum(F.col("npv") * (F.col("x") + 1), "placed_npv"),
        )
    )


@query
def group_solar_day(spark, sf):
    return SC.group_solar_day(cube.scenes(spark, sf), "tile_id")


def _daily(spark, sf, *bands: str) -> DataFrame:
    sc = SC.group_scenes(cube.scenes(spark, sf)).select("scene_id", "tile_id", "grp", "ord")
    px = cube.pixels(spark, sf).select("scene_id", "tile_id", "y", "x", *bands)
    return _by_scene(px, sc, "grp", "ord")


@query
def fuse_water(spark, sf):
    return (
        C.fuse_water(_daily(spark, sf, "water"))
        .groupBy("tile_id", F.col("grp").alias("solar_day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("water") == 1).alias("n_nodata"),
            F.count_if(F.col("water") == 128).alias("n_water"),
            _sum(F.col("water") * _place(), "placed"),
        )
    )


@query
def fuse_first_valid(spark, sf):
    bands = {b: S.COVER_NODATA for b in S.COVER_BANDS}
    return (
        C.fuse_first_valid(_daily(spark, sf, *bands), bands)
        .groupBy("tile_id", F.col("grp").alias("solar_day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("bs") == -1).alias("n_nodata"),
            _sum(F.col("bs") * (F.col("x") + 1), "placed_bs"),
            _sum(F.col("pv") * (F.col("y") + 1), "placed_pv"),
            _sum("npv", "sum_npv"),
        )
    )


@query
def apply_mask(spark, sf):
    px = cube.pixels(spark, sf)
    quality = P.pixel_quality_mask(F.col("fmask"), F.col("nbart_contiguity"), F.col("water"))
    ready = px.select(
        "scene_id", *S.COVER_BANDS, P.tasselled_cap(nodata=SURFACE_NODATA).alias("TCW"),
        P.water_value(F.col("water")).alias("water"), quality.alias("pmask"), quality.alias("good"),
    )
    masked = C.apply_mask(ready, "pmask", D.WETLAND_NODATA)
    return masked.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("good")).alias("n_masked"),
        *[_sum(b, f"sum_{b}") for b in S.COVER_BANDS],
        _steps(F.col("TCW"), 100, "sum_wetness"),
        _sum("water", "sum_water"),
    )


@query
def reproject_nearest(spark, sf):
    px = cube.pixels(spark, sf).select("tile_id", "y", "x", "water", "bs")
    moved = R.reproject_nearest(px, cube.LONLAT_GRID)
    return moved.groupBy("ty", "tile_id").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_distinct("tx").alias("n_target"),
        _sum("tx", "sum_tx"),
        _sum("water", "sum_water"),
        _sum(F.col("bs") * (F.col("tx") % 97), "sum_bs"),
    )


@query
def project_points(spark, sf):
    key = F.col("c_custkey")
    places = cube.table(spark, sf, "customer").select(
        key.alias("point_id"),
        (112 + key * 37 % 4200 / F.lit(100.0)).alias("lon"),
        (-44 + key * 53 % 3400 / F.lit(100.0)).alias("lat"),
    )
    return R.project_points(places).select(
        "point_id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north")
    )


# --- geometry ----------------------------------------------------------------

@query
def rasterize_centre(spark, sf):
    return G.spans_to_pixels(G.spans_centre(cube.polygons(spark, sf), GRID))


@query
def rasterize_all_touched(spark, sf):
    return G.spans_to_pixels(G.spans_all_touched(cube.polygons(spark, sf), GRID))


@query
def mask_polygon(spark, sf):
    po = cube.polygons(spark, sf)
    px = cube.pixels(spark, sf).select("tile_id", "y", "x", "bs", "water", "fmask")
    mask = G.polygon_mask(po, GRID)
    px, each = dealt(px, mask.bound), mask.each
    nodata = {"bs": S.COVER_NODATA, "water": S.WATER_NODATA, "fmask": None}
    return (
        G.mask_polygon(G.pixels_in_extents(px, po, GRID), each, nodata)
        .groupBy("poly_id", "tile_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("inside").alias("n_inside"),
            _sum("bs", "sum_bs"),
            _sum("water", "sum_water"),
            F.count("fmask").alias("n_fmask"),
        )
    )


@query
def polygon_pixel_area(spark, sf):
    po = cube.polygons(spark, sf)
    centre = G.polygon_pixel_area(po, GRID).withColumnRenamed("total_area", "centre_area")
    touched = G.polygon_pixel_area(po, GRID, all_touched=True).withColumnRenamed("total_area", "touched_area")
    return touched.join(centre, "poly_id", "left").select(
        "poly_id", F.coalesce("centre_area", F.lit(0)).alias("centre_area"), "touched_area"
    )


@query
def polygon_area_two_level(spark, sf):
    po = cube.polygons(spark, sf)
    centre, touched = (G.two_level_mask(po, GRID, all_touched=t).area(GRID) for t in (False, True))
    both = touched.withColumnRenamed("total_area", "touched_area").join(
        centre.withColumnRenamed("total_area", "centre_area"), "poly_id", "left"
    )
    return both.select("poly_id", F.coalesce("centre_area", F.lit(0)).alias("centre_area"), "touched_area")


@query
def convex_hull_wkt(spark, sf):
    return G.convex_hull(cube.polygons(spark, sf))


@query
def pixel_at_point(spark, sf):
    px = cube.pixels(spark, sf).select("tile_id", "y", "x", "water")
    return (
        G.pixel_at_point(px, cube.points(spark, sf), GRID)
        .groupBy("point_id", "x", "y")
        .agg(F.count(F.lit(1)).alias("n_obs"), _sum("water", "sum_water"))
    )


@query
def time_spine(spark, sf):
    sc = SC.group_scenes(cube.scenes(spark, sf))
    spine = G.time_spine(G.polygon_extents(cube.polygons(spark, sf), GRID), sc, GRID)
    return spine.withColumnRenamed("grp", "solar_day")


# --- per-pixel expressions ---------------------------------------------------

@query
def decode_flags(spark, sf):
    names = F.array_join(P.decode_flags(F.col("water")), ",")
    return cube.pixels(spark, sf).groupBy("water", names.alias("flags")).agg(F.count(F.lit(1)).alias("n"))


def _per_scene(spark, sf, **aggs: Column) -> DataFrame:
    return cube.pixels(spark, sf).groupBy("scene_id").agg(*[c.alias(n) for n, c in aggs.items()])


@query
def flag_mask(spark, sf):
    return _per_scene(spark, sf, n_clear=F.count_if(P.flag_mask(F.col("water"), S.CLEAR_DRY_LAND)))


@query
def classify_water(spark, sf):
    seen = P.classify_water(F.col("water"))
    return _per_scene(
        spark, sf,
        n_wet=F.count_if(seen == "wet"),
        n_dry=F.count_if(seen == "dry"),
        n_hidden=F.count_if(seen == "not observable"),
    )


@query
def water_value(spark, sf):
    value = P.water_value(F.col("water"))
    return _per_scene(spark, sf, n_water=_sum(value, "n"), placed=_sum(value * _place(), "n"))


@query
def pixel_quality_mask(spark, sf):
    good = P.pixel_quality_mask(F.col("fmask"), F.col("nbart_contiguity"), F.col("water"))
    return _per_scene(spark, sf, n_good=F.count_if(good))


@query
def tasselled_cap(spark, sf):
    return _per_scene(
        spark, sf,
        **{c: _steps(P.tasselled_cap(c, nodata=SURFACE_NODATA), 100, c) for c in ("wetness", "brightness", "greenness")},
        n_missing=F.count_if(P.tasselled_cap(nodata=SURFACE_NODATA) == S.WETNESS_NODATA),
    )


@query
def nodata_null_roundtrip(spark, sf):
    held = P.nodata_to_null(F.col("blue"), -999)
    return _per_scene(
        spark, sf,
        n_null=F.count_if(held.isNull()),
        sum_valid=_sum(held, "n"),
        sum_restored=_sum(P.null_to_nodata(held, -999), "n"),
    )


@query
def dominant_cover(spark, sf):
    top = P.dominant_cover(*[P.nodata_to_null(F.col(b), S.COVER_NODATA) for b in S.COVER_BANDS])
    return _per_scene(
        spark, sf,
        n_bs=F.count_if(top == "BS"),
        n_pv=F.count_if(top == "PV"),
        n_npv=F.count_if(top == "NPV"),
        n_none=F.count_if(top.isNull()),
    )


@query
def wet_threshold(spark, sf):
    wetness = P.tasselled_cap(nodata=SURFACE_NODATA)
    return _per_scene(
        spark, sf,
        n_wet=F.count_if(P.is_wet(wetness)),
        n_ground=F.count_if(P.is_dry_ground(wetness)),
        n_neither=F.count_if(wetness == S.WET_THRESHOLD),
    )


# --- drills ------------------------------------------------------------------

def _archive(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, Grid]:
    return cube.pixels(spark, sf), cube.scenes(spark, sf), cube.polygons(spark, sf), GRID


@query
def wofs_pixel_drill(spark, sf):
    return D.point_water_drill(
        cube.pixels(spark, sf), cube.scenes(spark, sf), cube.points(spark, sf), GRID
    )


@query
def fc_total_valid(spark, sf):
    counts = D.cover_counts(*_archive(spark, sf))
    return counts.select(
        "poly_id", "time",
        *[F.coalesce(f"valid_{b}", F.lit(0)).alias(f"valid_{b}") for b in S.COVER_BANDS],
    )


@query
def fc_unobservable(spark, sf):
    counts = D.cover_counts(*_archive(spark, sf))
    hidden = F.coalesce("valid_bs", F.lit(0)) - F.coalesce("seen", F.lit(0))
    return counts.select("poly_id", "time", hidden.alias("unobservable"))


@query
def fc_drill(spark, sf):
    return _round6(D.cover_drill(*_archive(spark, sf)), *S.COVER_SERIES)


@query
def mangrove_drill(spark, sf):
    return D.mangrove_drill(*_archive(spark, sf))


@query
def mangrove_drill_years(spark, sf):
    return D.mangrove_drill(*_archive(spark, sf), time=("2000", "2005"))


@query
def mangrove_drill_summaries(spark, sf):
    px, sc, po, grid = _archive(spark, sf)
    return D.mangrove_drill_summaries(px, D.canopy_summaries(px), sc, po, grid)


@query
def wit_cal_area(spark, sf):
    return _round6(D.wetland_areas(*_archive(spark, sf)), *S.COVER_BANDS)


WETLAND_SHARES = ("water", "wet", *S.COVER_BANDS)


@query
def wit_drill(spark, sf):
    return _round6(D.wetland_drill(*_archive(spark, sf)), *WETLAND_SHARES)


@query
def wit_drill_aggregated(spark, sf):
    return _round6(D.wetland_drill(*_archive(spark, sf), aggregate=365), *WETLAND_SHARES)


@query
def wit_drill_daily(spark, sf):
    return _round6(D.wetland_drill(*_archive(spark, sf), aggregate=1), *WETLAND_SHARES)


# A metric grid under the same pixels: requests in longitude and latitude are projected to it.
EAST, NORTH = 1_500_000.0, -3_900_000.0
METRIC = Grid(EAST, NORTH, 30.0, -30.0, tile=8, tiles_across=8, first_tile_x=cube.WEST // 8, first_tile_y=cube.NORTH // 8)


@query
def fc_drill_lonlat(spark, sf):
    """Ground cover for polygons that arrive as texts in longitude and latitude."""
    features = RQ.read_features(cube.lonlat_requests(spark, sf, METRIC))
    polygons = RQ.polygon_vertices(RQ.usable(features), "request_id", metric=True)
    drill = D.cover_drill(cube.pixels(spark, sf), cube.scenes(spark, sf), polygons, METRIC)
    return _round6(drill, *S.COVER_SERIES)


@query
def wofs_pixel_drill_ranges(spark, sf):
    """Water at points, each in its own time range; requests in error are not drilled."""
    ranges = cube.request_texts(spark, sf, cube.RANGE_TEXTS)
    return D.point_water_drill(
        cube.pixels(spark, sf), cube.scenes(spark, sf), cube.points(spark, sf), GRID, ranges=ranges
    )


@query
def wit_drill_requests(spark, sf):
    """The wetland drill with a length of window per request: none, a day, more days, or in error."""
    parsed = RQ.parse_parameters(cube.request_texts(spark, sf, cube.PARAMETER_TEXTS))
    good = RQ.usable(parsed).select(F.col("request_id").alias("poly_id"), "aggregate")
    pixels, scenes, polygons, grid = _archive(spark, sf)
    asked = polygons.join(counted(good.select("poly_id")), "poly_id", "left_semi")
    return _round6(D.wetland_drill(pixels, scenes, asked, grid, aggregate=good), *WETLAND_SHARES)


@query
def fc_drill_products(spark, sf):
    """Ground cover where cover and water are stored apart, each with its own scenes."""
    cover, water = (cube.product(spark, sf, n) for n in ("cover", "water"))
    return _round6(D.cover_drill_products(cover, water, cube.polygons(spark, sf), GRID), *S.COVER_SERIES)


def _products(spark, sf) -> tuple[D.Product, dict[str, D.Product], D.Product]:
    cover, water, *sensors = (D.Product(*cube.product(spark, sf, n)) for n in ("cover", "water", *cube.SENSORS))
    return cover, dict(zip(cube.SENSORS, sensors)), water


@query
def wit_drill_products(spark, sf):
    """Wetlands where cover, each sensor and water are stored apart, each with its own scenes."""
    drill = D.wetland_drill_products(*_products(spark, sf), cube.polygons(spark, sf), GRID)
    return _round6(drill, *WETLAND_SHARES)


@query
def wit_drill_products_yearly(spark, sf):
    """The same with windows of a year, which follow the times that all products have."""
    drill = D.wetland_drill_products(*_products(spark, sf), cube.polygons(spark, sf), GRID, aggregate=365)
    return _round6(drill, *WETLAND_SHARES)


@query
def wit_drill_reprojected(spark, sf):
    """Wetlands in metres from an archive in longitude and latitude, resampled inside the drill."""
    drill = D.wetland_drill(
        cube.pixels(spark, sf), cube.scenes(spark, sf), cube.projected_polygons(spark, sf), cube.TARGET_GRID,
        outlines=cube.polygons(spark, sf), source=cube.LONLAT_GRID,
    )
    return _round6(drill, *WETLAND_SHARES)


# --- compositing -------------------------------------------------------------

def _wetland_times(spark, sf) -> DataFrame:
    sc = SC.group_scenes(D.wetland_scenes(cube.scenes(spark, sf)), "exact")
    spine = G.time_spine(G.polygon_extents(cube.polygons(spark, sf), GRID), sc, GRID)
    return spine.select("poly_id", F.col("time").alias("ts"))


def _windows(spark, sf, days: int) -> DataFrame:
    return (
        T.anchored_windows(_wetland_times(spark, sf), days)
        .groupBy("poly_id", "anchor")
        .agg(F.max("n_times").alias("n_times"), F.max("ts").alias("last_time"))
    )


@query
def anchored_windows(spark, sf):
    return _windows(spark, sf, 365)


@query
def anchored_windows_16(spark, sf):
    return _windows(spark, sf, 16)


@query
def anchored_windows_daily(spark, sf):
    return _windows(spark, sf, 1)


def _composited(spark, sf, days: int) -> DataFrame:
    merged = D.wetland_composite(*_archive(spark, sf), aggregate=days)
    return merged.groupBy("poly_id", "anchor").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        _sum("water", "sum_water"),
        F.count_if(P.is_valid(F.col("TCW"), S.WETNESS_NODATA)).alias("n_wetness"),
        _steps(F.col("TCW"), 100, "sum_wetness"),
        *[_steps(F.col(b), 1000, f"sum_{b}") for b in S.COVER_BANDS],
    )


@query
def average_over_day(spark, sf):
    return _composited(spark, sf, 1)


@query
def composite_first_valid(spark, sf):
    return _composited(spark, sf, 365)


# --- presentation, sinks, admission ------------------------------------------

@query
def melt_cover(spark, sf):
    long = V.melt_cover(D.cover_drill(*_archive(spark, sf)), list(S.COVER_SERIES))
    return _round6(long, "Area")


@query
def normalized_stack(spark, sf):
    stack = V.normalized_stack(D.mangrove_drill(*_archive(spark, sf)), list(S.MANGROVE_SERIES))
    return _round6(stack, "share")


@query
def style_join(spark, sf):
    melted = V.melt_cover(D.mangrove_drill(*_archive(spark, sf)), list(S.MANGROVE_SERIES))
    return V.style_join(melted, V.style_table(spark, "mangrove"))


@query
def wofs_tick_series(spark, sf):
    return V.wofs_tick_series(wofs_pixel_drill(spark, sf))


@query
def write_drill_parquet(spark, sf):
    base = f"{shared_folder(spark).rstrip('/')}/drills-{uuid.uuid4().hex}"
    V.write_drill_parquet(wit_drill(spark, sf), base, "wit", "run-1")
    return V.read_drill_parquet(spark, base)


@query
def drill_to_csv(spark, sf):
    return V.drill_to_csv(fc_drill(spark, sf), S.COVER_SERIES)


@query
def drill_catalog_json(spark, sf):
    csv = V.drill_to_csv(mangrove_drill(spark, sf), S.MANGROVE_SERIES)
    entry = V.drill_catalog_json(csv, "mangrove")
    parts = {
        "data": "$.data", "is_enabled": "$.isEnabled", "type": "$.type", "name": "$.name",
        "open_forest_color": "$.tableStyle.columns['Open Forest'].chartLineColor",
    }
    return entry.select("poly_id", *[F.get_json_object("json", p).alias(n) for n, p in parts.items()])


@query
def guard_rail(spark, sf):
    po = cube.polygons(spark, sf)
    turn = F.col("poly_id") % 3
    ranges = po.select("poly_id").distinct().select(
        "poly_id",
        F.when(turn == 1, "2000-01").when(turn == 2, "2010-02").alias("start"),
        F.when(turn == 1, "2000-03").when(turn == 2, "2010-02").alias("end"),
    )
    sc = SC.group_scenes(cube.scenes(spark, sf))
    return A.guard_rail(po, sc, GRID, S.COVER_PRODUCT, ranges=ranges, refine=1500)
