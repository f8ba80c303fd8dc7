"""The four drills, from pixels and requests to a table of one row per time.

Each drill prunes pixels to the polygons, works per pixel in generated code, and
ends in one aggregate with map-side partial sums, so neither a dominant polygon
nor a dominant day becomes a single task. Only the merge of overlapping scenes
(solar-day drills) and compositing shuffle pixels, and both do so on keys that
hold the pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterdrill import schema as S
from rasterdrill import tuning
from rasterdrill.functions import pixel as P
from rasterdrill.grid import Grid
from rasterdrill.operators import combine as C
from rasterdrill.operators import geometry as G
from rasterdrill.operators import reproject as R
from rasterdrill.operators import temporal as T
from rasterdrill.sources import scenes as SC
from rasterdrill.sources.times import inside_range, read_ranges
from rasterdrill.tuning import beside, counted, dealt, one_row, sized

_PLACE = ("tile_id", "y", "x")


_SET = ("set_a", "set_b")


def _near(pixels: DataFrame, tiles: Column, mask: G.Mask, sets: bool = False) -> DataFrame:
    """Pixels inside any polygon, each once: files first, then the mask. With their set, if asked for."""
    asked, segments = dealt(pixels.filter(tiles), 2 * mask.bound), mask.overlay().segments
    return G.in_segments(asked, segments) if sets else _inside(asked, segments)


def _of_scenes(pixels: DataFrame, tiles: DataFrame, bound: int, *columns: str) -> DataFrame:
    """Pixels of the scene tiles ``tiles``, at most ``bound``, with their columns."""
    return C.with_scene_tiles(dealt(pixels, bound), beside(tiles, bound), *columns)


def _inside(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    return G.inside_any(pixels, segments.select("tile_id", "y", "x_from", "x_to"))


def _fused(
    pixels: DataFrame, scenes: DataFrame, footprints: int, polygons: DataFrame, grid: Grid, mask: G.Mask, **rules
) -> DataFrame:
    """Solar-day pixels inside any polygon, by the set of polygons that hold them.

    Pixels outside all polygons go before the merge of overlapping scenes.
    """
    near = _near(pixels, G.polygon_tiles(polygons, grid), mask)
    kept = _of_scenes(near, scenes, footprints, "grp", "ord")
    return G.in_segments(C.fuse(kept, **rules), mask.overlay().segments)


def _fused_in_ranges(
    pixels: DataFrame, scenes: DataFrame, footprints: int, polygons: DataFrame, grid: Grid, mask: G.Mask, **rules
) -> DataFrame:
    """Solar-day pixels per polygon: a time range may split a day differently for each."""
    near = G.inside_each(dealt(pixels.filter(G.polygon_tiles(polygons, grid)), mask.bound), mask.each)
    kept = _of_scenes(near, scenes, footprints, "grp", "ord")
    return C.fuse(kept, keys=("poly_id", *C.PIXEL_KEY), **rules)


# --- ground cover ------------------------------------------------------------

def cover_statistics(
    pixels: DataFrame, keys: Sequence[str], nodata: int = S.COVER_NODATA, strict_nodata: bool = False
) -> DataFrame:
    """Counts behind the cover drill, from fused pixels with cover and water bands.

    ``valid_*`` counts pixels before the quality mask that are not nodata;
    ``seen`` counts pixels that pass it; ``n_*`` counts dominant covers. A seen
    pixel without cover data counts as bare soil unless ``strict_nodata``.
    """
    clear = P.flag_mask(F.col("water"), S.CLEAR_DRY_LAND)
    if strict_nodata:
        for b in S.COVER_BANDS:
            clear = clear & (F.col(b) != F.lit(nodata))
    top = P.dominant_cover(*[F.col(b) for b in S.COVER_BANDS])
    marked = pixels.withColumns({"_clear": clear, "_top": F.when(clear, top)})
    return marked.groupBy(*keys).agg(
        *[
            F.count_if(~F.col(b).eqNullSafe(F.lit(nodata))).alias(f"valid_{b}")
            for b in S.COVER_BANDS
        ],
        F.count_if("_clear").alias("seen"),
        *[F.count_if(F.col("_top") == b.upper()).alias(f"n_{b}") for b in S.COVER_BANDS],
    )


def cover_counts(
    pixels: DataFrame,
    scenes: DataFrame,
    polygons: DataFrame,
    grid: Grid,
    time=None,
    ranges: DataFrame | None = None,
    nodata: int = S.COVER_NODATA,
    strict_nodata: bool = False,
) -> DataFrame:
    """:func:`cover_statistics` per polygon and solar day; null where nothing was read."""
    taken = SC.filter_time_range(scenes, time)
    _, footprints = G.scene_sizes(taken, grid)
    sc = SC.group_scenes(taken, "solar_day")
    bands = SC.filter_time_range(pixels, time).select(
        "scene_id", "ts", *_PLACE, *S.COVER_BANDS, "water"
    )
    mask = G.polygon_mask(polygons, grid, ranges=ranges)
    extents = G.polygon_extents(polygons, grid)
    tiles = G.scene_tiles(sc, extents, grid, "grp", "ord")
    rules = {"first_valid": {b: nodata for b in S.COVER_BANDS}, "water": "water"}
    if ranges is None:
        held = _fused(bands, tiles, footprints, polygons, grid, mask, **rules)
        sums = cover_statistics(held, [*_SET, "grp"], nodata, strict_nodata)
        counts = G.spread(sums, mask.overlay().members, "grp")
    else:
        held = _fused_in_ranges(bands, tiles, footprints, polygons, grid, mask, **rules)
        counts = cover_statistics(held, ["poly_id", "grp"], nodata, strict_nodata)
    spine = G.time_spine(extents, sc, grid, ranges=ranges, footprints=footprints)
    return spine.join(counts, ["poly_id", "grp"], "left")


def cover_drill(
    pixels: DataFrame, scenes: DataFrame, polygons: DataFrame, grid: Grid, **options
) -> DataFrame:
    """``poly_id, time, BS, PV, NPV, Unobservable`` in percent of valid pixels.

    A share is missing where the polygon had no valid pixel at that time.
    """
    return _cover_shares(cover_counts(pixels, scenes, polygons, grid, **options))


def _cover_shares(counts: DataFrame) -> DataFrame:
    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.nullif(F.col(whole), F.lit(0)) * F.lit(100.0)

    hidden = counts.withColumn("_hidden", F.col("valid_bs") - F.col("seen"))
    return hidden.select(
        "poly_id",
        "time",
        share("n_bs", "valid_bs").alias("BS"),
        share("n_pv", "valid_pv").alias("PV"),
        share("n_npv", "valid_npv").alias("NPV"),
        share("_hidden", "valid_bs").alias("Unobservable"),
    )


def cover_drill_products(
    cover: tuple[DataFrame, DataFrame],
    water: tuple[DataFrame, DataFrame],
    polygons: DataFrame,
    grid: Grid,
    time=None,
    nodata: int = S.COVER_NODATA,
    strict_nodata: bool = False,
) -> DataFrame:
    """:func:`cover_drill` over two products, each ``(pixels, scenes)``.

    Each is grouped by solar day and merged by itself; then they are aligned on day and
    pixel. A day that only one of them has gives no row; the first scene of either
    names it. Both sides of the join are partitioned on its keys by their merges.
    """
    mask = G.polygon_mask(polygons, grid)
    extents = G.polygon_extents(polygons, grid)
    held, spines = [], []
    over = mask.overlay()
    near_tiles = G.polygon_tiles(polygons, grid)
    sizes = iter(G.footprints([SC.filter_time_range(sc, time) for _, sc in (cover, water)], grid))
    for (pixels, scenes), rules in (
        (cover, {"first_valid": {b: nodata for b in S.COVER_BANDS}}), (water, {"water": "water"}),
    ):
        taken, footprints = SC.filter_time_range(scenes, time), next(sizes)
        sc = SC.group_scenes(taken, "solar_day")
        bands = [*rules.get("first_valid", {}), *([rules["water"]] if "water" in rules else [])]
        px = SC.filter_time_range(pixels, time).select("scene_id", *_PLACE, *bands)
        tiles = G.scene_tiles(sc, extents, grid, "grp", "ord")
        held.append(C.fuse(_of_scenes(_near(px, near_tiles, mask), tiles, footprints, "grp", "ord"), **rules))
        spines.append(G.time_spine(extents, sc, grid, footprints=footprints).select("poly_id", "grp", "time"))
    aligned = G.in_segments(C.juxtapose(*held), over.segments)
    counts = G.spread(cover_statistics(aligned, [*_SET, "grp"], nodata, strict_nodata), over.members, "grp")
    both = spines[0].join(spines[1].withColumnRenamed("time", "_time"), ["poly_id", "grp"])
    spine = both.select("poly_id", "grp", F.least("time", "_time").alias("time"))
    return _cover_shares(spine.join(counts, ["poly_id", "grp"], "left"))


# --- mangroves ---------------------------------------------------------------

def _fuse_exact(pixels: DataFrame, scenes: DataFrame, bands: dict[str, float]) -> DataFrame:
    """Merge scenes of one exact time that overlap: first valid value per band."""
    sc = SC.group_scenes(scenes, "exact").select("scene_id", "ord")
    ordered = C.with_scene(pixels, counted(sc), "ord")
    return C.fuse(ordered, first_valid=bands, keys=("ts", *_PLACE))


def mangrove_drill(
    pixels: DataFrame,
    scenes: DataFrame,
    polygons: DataFrame,
    grid: Grid,
    time=None,
    ranges: DataFrame | None = None,
    overlapping: bool = False,
) -> DataFrame:
    """``poly_id, time`` and the pixel count of each canopy class.

    Every scene time under the polygon has a row. Scenes of one exact time are
    taken not to overlap; say ``overlapping`` if they do.
    """
    px = SC.filter_time_range(pixels, time).filter(G.polygon_tiles(polygons, grid))
    sc = SC.filter_time_range(scenes, time)
    mask = G.polygon_mask(polygons, grid, ranges=ranges)
    over = mask.overlay()
    if overlapping:
        px = _fuse_exact(_inside(px, over.segments), sc, {CANOPY: 255})
    return _canopy_at_times(_canopy_counts(px, over, mask.bound), sc, polygons, grid, ranges)


CANOPY = "canopy_cover_class"


def _canopy_classes() -> list[Column]:
    return [F.count_if(F.col(CANOPY) == k).alias(name) for k, name in S.CANOPY_CLASSES.items()]


def _canopy_counts(pixels: DataFrame, over: G.Overlay, bound: int) -> DataFrame:
    """``poly_id, grp`` and the count of each class, from pixels in the segments of ``over``, laid from ``bound`` spans."""
    held = G.in_segments(dealt(pixels.select("ts", *_PLACE, CANOPY), 2 * bound), over.segments)
    sums = held.groupBy(*_SET, F.col("ts").alias("grp")).agg(*_canopy_classes())
    return G.spread(sums, over.members, "grp")


def _canopy_at_times(
    counts: DataFrame, scenes: DataFrame, polygons: DataFrame, grid: Grid, ranges: DataFrame | None
) -> DataFrame:
    spine = G.time_spine(
        G.polygon_extents(polygons, grid), scenes.withColumn("grp", F.col("ts")), grid, ranges=ranges
    )
    return spine.join(counts, ["poly_id", "grp"], "left").select(
        "poly_id",
        "time",
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in S.CANOPY_CLASSES.values()],
    )


def canopy_summaries(pixels: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """``tile_id, ts`` and the pixel count of each canopy class: a table to store beside the pixels.

    One row stands for the pixels of a tile at a time. Give ``scenes`` if those of one exact
    time overlap: they are merged first, as ``overlapping`` does in a drill.
    """
    px = pixels if scenes is None else _fuse_exact(pixels, scenes, {CANOPY: 255})
    return px.groupBy("tile_id", "ts").agg(*_canopy_classes())


def mangrove_drill_summaries(
    pixels: DataFrame,
    summaries: DataFrame,
    scenes: DataFrame,
    polygons: DataFrame,
    grid: Grid,
    time=None,
    ranges: DataFrame | None = None,
    overlapping: bool = False,
) -> DataFrame:
    """:func:`mangrove_drill` that reads pixels of border tiles only.

    Tiles wholly inside a polygon are answered from ``summaries`` (see
    :func:`canopy_summaries`), so what is read grows with the outline of a polygon, not with
    its area. ``overlapping`` must be that of the summaries.
    """
    sc = SC.filter_time_range(scenes, time)
    mask = G.two_level_mask(polygons, grid)
    full, border = mask.full, mask.border
    if ranges is not None:
        own = counted(read_ranges(ranges, "poly_id"))
        full, border = full.join(own, "poly_id", "left"), border.join(own, "poly_id", "left")
    over = G.overlay(beside(border, mask.bound), mask.bound)
    px = SC.filter_time_range(pixels, time).filter(G.tile_filter(mask.border_tiles))
    if overlapping:
        px = _fuse_exact(_inside(px, over.segments), sc, {CANOPY: 255})
    kept = SC.filter_time_range(summaries, time).filter(G.tile_filter(mask.full))
    # A whole tile has a span in each of its rows, so the bound of spans holds for tiles too.
    whole = dealt(kept, mask.bound).join(beside(full, mask.bound), "tile_id")
    if ranges is not None:
        whole = whole.filter(inside_range(F.col("ts"), F.col("start"), F.col("end")))
    names = list(S.CANOPY_CLASSES.values())
    both = whole.select("poly_id", F.col("ts").alias("grp"), *names).unionByName(_canopy_counts(px, over, mask.bound))
    counts = both.groupBy("poly_id", "grp").agg(*[F.sum(n).alias(n) for n in names])
    return _canopy_at_times(counts, sc, polygons, grid, ranges)


# --- water at points ---------------------------------------------------------

def point_water(
    pixels: DataFrame, scenes: DataFrame, points: DataFrame, grid: Grid, time=None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """``point_id, time, longitude, latitude, water``: fused bit field per solar day.

    ``ranges (point_id, start, end)`` limits points in time; one without a row takes all.

    Coordinates are those of the request point. A time at which the pixel is
    absent has the nodata value.
    """
    taken = SC.filter_time_range(scenes, time)
    _, footprints = G.scene_sizes(taken, grid)
    sc = SC.group_scenes(taken, "solar_day")
    n_points = one_row(points.agg(F.count(F.lit(1))))[0]
    located = G.points_to_pixels(points.select("point_id", "lon", "lat"), grid)
    held = SC.filter_time_range(pixels, time).select("scene_id", "ts", *_PLACE, "water")
    near = dealt(G.at_tiles(held, located), n_points)
    squares = located.select(  # each in one tile, which its times are looked up by
        "point_id", "lon", "lat", "y", "x",
        F.col("x").cast("double").alias("bx0"), F.col("y").cast("double").alias("by0"),
        (F.col("x") + 1.0).alias("bx1"), (F.col("y") + 1.0).alias("by1"),
    )
    tiles = G.scene_tiles(sc, squares, grid, "grp", "ord")
    keys = ("point_id", "lon", "lat", *_PLACE)
    if ranges is None:
        cells = beside(located.select(*_PLACE).distinct(), n_points)
        own, on = near.drop("ts").join(cells, list(_PLACE), "left_semi"), list(C.PIXEL_KEY)
    else:
        # A range may split a day, so pixels are merged per point; a point has one pixel.
        asked = located.join(counted(read_ranges(ranges, "point_id")), "point_id", "left")
        asked = beside(asked.select("point_id", *_PLACE, "start", "end"), n_points)
        own = near.join(asked, list(_PLACE)).filter(inside_range(F.col("ts"), F.col("start"), F.col("end")))
        own, on = own.drop("ts", "start", "end"), ["point_id", *C.PIXEL_KEY]
    fused = C.fuse_water(_of_scenes(own, tiles, footprints, "grp", "ord"), on)
    spine = G.time_spine(squares, sc, grid, keys=keys, ranges=ranges, footprints=footprints)
    if footprints > tuning.BROADCAST_ROWS:
        fused = fused.hint("merge")  # a row per point and day, too many to hash
    return spine.join(fused, on, "left").select(
        "point_id",
        "time",
        F.col("lon").alias("longitude"),
        F.col("lat").alias("latitude"),
        F.coalesce(F.col("water"), F.lit(S.WATER_NODATA)).alias("water"),
    )


def point_water_drill(
    pixels: DataFrame,
    scenes: DataFrame,
    points: DataFrame,
    grid: Grid,
    time=None,
    flags: Sequence[S.Flag] = S.WATER_FLAGS,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """``point_id, time, longitude, latitude, observation``."""
    water = point_water(pixels, scenes, points, grid, time, ranges)
    return water.withColumn("observation", P.classify_water(F.col("water"), flags)).drop("water")


# --- wetlands ----------------------------------------------------------------

WETLAND_NODATA = {
    "bs": S.COVER_NODATA, "pv": S.COVER_NODATA, "npv": S.COVER_NODATA, "TCW": S.WETNESS_NODATA,
}


def wetland_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes good enough for the wetland drill: quality figure and sensor calendar."""
    return SC.filter_sensor_epoch(SC.filter_scene_quality(scenes))


def wetland_pixels(pixels: DataFrame, *keep: str) -> DataFrame:
    """``bs, pv, npv, TCW`` with unusable pixels at nodata, and ``water`` as 0 or 1.

    Expects the cover, reflectance and water bands in one row; see
    ``combine.juxtapose`` for products stored apart. ``keep`` names other
    columns to carry along.
    """
    ready = pixels.select(
        *keep,
        *[F.col(b) for b in S.COVER_BANDS],
        P.tasselled_cap("wetness", nodata=S.nodata_of(S.SURFACE_PRODUCT)).alias(P.tasselled_cap_name("wetness")),
        P.water_value(F.col("water")).alias("water"),
        P.pixel_quality_mask(F.col("fmask"), F.col("nbart_contiguity"), F.col("water")).alias("pmask"),
    )
    return C.apply_mask(ready, "pmask", WETLAND_NODATA)


def wetland_sums(pixels: DataFrame, keys: Sequence[str], threshold: float = S.WET_THRESHOLD) -> DataFrame:
    """Per key: valid and wet pixel counts, water, and summed cover in percent.

    Cover counts only where wetness is valid and below the threshold.
    """
    wetness, water = F.col("TCW"), F.col("water")
    valid = P.is_valid(wetness, S.WETNESS_NODATA)
    ground = valid & P.is_dry_ground(wetness, threshold)
    return pixels.groupBy(*keys).agg(
        (F.sum(water) + F.count_if(valid)).alias("valid"),
        F.sum(water).alias("water"),
        F.count_if(P.is_wet(wetness, threshold)).alias("wet"),
        *[F.sum(F.when(ground, F.col(b)).otherwise(0).cast("double")).alias(b) for b in S.COVER_BANDS],
    )


def wetland_area(pixels: DataFrame, keys: Sequence[str], threshold: float = S.WET_THRESHOLD) -> DataFrame:
    """:func:`wetland_sums` with cover as summed fractions."""
    return _as_fractions(wetland_sums(pixels, keys, threshold))


def _as_fractions(sums: DataFrame) -> DataFrame:
    return sums.withColumns({b: F.col(b) / 100 for b in S.COVER_BANDS})


class Product(NamedTuple):
    """A product stored by itself: its pixels and its own scenes."""

    pixels: DataFrame
    scenes: DataFrame


class _Request(NamedTuple):
    """What the wetland drill is asked for, apart from where pixels come from."""

    polygons: DataFrame
    grid: Grid
    mask: G.Mask
    time: object
    ranges: DataFrame | None

    def spine(self, scenes: DataFrame, footprints: int) -> DataFrame:
        extents = G.polygon_extents(self.polygons, self.grid)
        grouped = scenes.withColumn("grp", F.col("ts"))
        spine = G.time_spine(extents, grouped, self.grid, ranges=self.ranges, footprints=footprints)
        return spine.select("poly_id", F.col("time").alias("ts"))


class _Held(NamedTuple):
    """Usable wetland pixels ``(ts, place, bands)`` inside any polygon, and the times they may have."""

    pixels: DataFrame
    times: Callable[[], DataFrame]  # poly_id, ts; only built where pixels are composited
    scenes: DataFrame  # of which no time is outside


def _together(pixels: DataFrame, scenes: DataFrame, overlapping: bool, source: Grid | None):
    """One table of joined pixels: tiles first, then the mask, then scenes.

    With ``source`` the pixels lie on that longitude/latitude grid and are resampled to the
    metric grid of the request. Files are pruned to the source tiles under the request's
    tiles; a mask on the target's grid is met right after.
    """
    def held(q: _Request, sets: bool) -> _Held:
        sc = wetland_scenes(SC.filter_time_range(scenes, q.time))
        bands = (*S.COVER_BANDS, *S.REFLECTANCE_BANDS, "fmask", "nbart_contiguity", "water")
        px = SC.filter_time_range(pixels, q.time).select("scene_id", "ts", *_PLACE, *bands)
        segments = q.mask.overlay().segments
        extents = G.polygon_extents(q.polygons, q.grid)
        _, footprints = G.scene_sizes(sc, source or q.grid)
        early = sets and not overlapping
        if source is None:
            near = _near(px, G.polygon_tiles(q.polygons, q.grid), q.mask, early)
            kept = _of_scenes(near, G.scene_tiles(sc, extents, q.grid), footprints)
        else:
            under = R.source_tiles(G.extent_blocks(extents, q.grid).select("_tx", "_ty").distinct(), q.grid, source)
            asked = _of_scenes(px.filter(G.tile_filter(under)), G.scenes_on_tiles(sc, under, source), footprints)
            moved = R.reproject_nearest(asked, source, q.grid)
            placed = moved.select("scene_id", "ts", F.col("target_tile").alias("tile_id"), F.col("ty").alias("y"), F.col("tx").alias("x"), *bands)
            if not overlapping:
                placed = wetland_pixels(placed, "ts", *_PLACE)  # five bands move, not twelve
            placed = dealt(placed, 2 * q.mask.bound)
            kept = G.in_segments(placed, segments) if early else _inside(placed, segments)
        if overlapping:
            values = {b.name: b.nodata for b in (*S.COVER_PRODUCT, *S.SURFACE_PRODUCT, *S.WATER_PRODUCT)}
            kept = _fuse_exact(kept, sc, values)
            kept = G.in_segments(kept, segments) if sets else kept
        keep = ("ts", *_PLACE, *(_SET if sets else ()))
        if source is None or overlapping:
            kept = wetland_pixels(kept, *keep)
        return _Held(kept.select(*keep, *WETLAND_NODATA, "water"), lambda: q.spine(sc, footprints), sc)

    return held


def _apart(cover: Product, surfaces: Mapping[str, Product], water: Product):
    """Products stored apart: cover, the collated sensors and water, side by side at exact times.

    Each has its own scenes; those of the sensors are filtered by quality and calendar.
    Scenes are aligned before pixels: a time and tile that one of the three lacks is not
    read from the others further than the scan. Each table is read once. Tables bucketed
    by tile and time (``sources.pixels.write_bucketed``) are not shuffled: each is cut to
    the mask where it lies, and sorted only for the joins.
    """
    def held(q: _Request, sets: bool) -> _Held:
        keys = ["ts", *_PLACE]
        good = {n: Product(p.pixels, wetland_scenes(p.scenes)) for n, p in surfaces.items()}
        every = [cover, *good.values(), water]
        scenes = [SC.filter_time_range(p.scenes, q.time) for p in every]
        extents = G.polygon_extents(q.polygons, q.grid)
        tiled = [G.scene_tiles(s, extents, q.grid, "ts") for s in scenes]
        footprints = G.footprints(scenes, q.grid)
        spots = [t.select("ts", "tile_id") for t in tiled]
        common = spots[0].join(reduce(DataFrame.unionByName, spots[1:-1]), ["ts", "tile_id"], "left_semi").join(
            spots[-1], ["ts", "tile_id"], "left_semi"
        ).distinct()
        near_tiles = G.polygon_tiles(q.polygons, q.grid)
        # The products are aligned, so all are dealt by tile if one is.
        most = max(2 * q.mask.bound, *footprints)

        def near(i: int, product: Product, scene_tiles: DataFrame, bands: Sequence[str]) -> DataFrame:
            px = SC.filter_time_range(product.pixels, q.time).select("scene_id", *keys, *bands)
            asked = scene_tiles.join(common, ["ts", "tile_id"], "left_semi").select("scene_id", "tile_id")
            cut = _near(px, near_tiles, q.mask, sets and i == 0)  # cover brings the set
            return C.with_scene_tiles(dealt(cut, most), beside(asked, footprints[i])).drop("scene_id")

        surface = (*S.REFLECTANCE_BANDS, "fmask", "nbart_contiguity")
        wanted = [S.COVER_BANDS, *[surface] * len(surfaces), ("water",)]
        parts = [near(i, *x) for i, x in enumerate(zip(every, tiled, wanted))]
        base = C.juxtapose(parts[0], parts[-1], keys)
        kept = C.collate_beside(base, dict(zip(surfaces, parts[1:-1])), keys)

        def times() -> DataFrame:
            first, *others = (
                q.spine(s, n) for s, n in
                ((scenes[0], footprints[0]), (reduce(DataFrame.unionByName, scenes[1:-1]), sum(footprints[1:-1])), (scenes[-1], footprints[-1]))
            )
            return reduce(lambda a, b: a.join(b, ["poly_id", "ts"], "left_semi"), others, first)

        return _Held(wetland_pixels(kept, *keys, *(_SET if sets else ())), times, scenes[-1])

    return held


def _windowed(source, q: _Request, aggregate: int | DataFrame) -> DataFrame:
    """Usable pixels with the window they fall in: ``anchor, n_times, days``."""
    found = source(q, False)
    held = G.inside_each(found.pixels, q.mask.each)
    if isinstance(aggregate, int):
        windows = T.anchored_windows(found.times(), aggregate).withColumn("days", F.lit(aggregate))
    else:
        asked = found.times().join(counted(aggregate.select("poly_id", F.col("aggregate").alias("days"))), "poly_id", "left")
        windows = T.anchored_windows(asked.withColumn("days", F.coalesce("days", F.lit(0))), "days", turns=True)
    placed, on, most = _beside_pixels(windows, found, q)
    return dealt(held, most).join(placed, ["poly_id", *on])


def _beside_pixels(windows: DataFrame, found: _Held, q: _Request) -> tuple[DataFrame, list[str], int]:
    """Windows as pixels meet them, the columns they meet on beside the request, and the number pixels are dealt for."""
    extents = G.polygon_extents(q.polygons, q.grid)
    tiles = G.extent_tiles(extents, q.grid).select("poly_id", "tile_id")
    n_times = most = G.spine_bound(extents, found.scenes, q.grid)
    if n_times > tuning.BROADCAST_ROWS:  # that counts every scene of a tile
        n_times, most = G.window_bounds(extents, found.scenes, q.grid)
    if n_times <= tuning.BROADCAST_ROWS:
        return F.broadcast(windows), ["ts"], 0
    # With the tile in the key, a polygon and time of any size is many groups.
    # Pixels that were dealt for the mask or for scenes are not moved here, nor for their merge.
    return beside(windows.join(tiles.hint("merge"), "poly_id"), most), ["ts", "tile_id"], most


def _composite(source, q: _Request, aggregate: int | DataFrame) -> DataFrame:
    """``(poly_id, anchor, pixel)`` rows, each pixel read once and merged once.

    Where requests differ, means and first values are taken side by side and the request's
    length of window chooses. A window of one time comes out as that time by either rule.
    """
    keys = ["poly_id", "anchor", *_PLACE]
    placed = _windowed(source, q, aggregate)
    if isinstance(aggregate, int):
        rule = T.average_over_day if aggregate == 1 else T.composite_first_valid
        return _typed(rule(placed, keys, WETLAND_NODATA), keys)
    placed = placed.withColumn("anchor", F.when(F.col("days") == 0, F.col("ts")).otherwise(F.col("anchor")))
    return _either(placed, keys)


def _either(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels merged by the rule that the days of their window say."""
    return _typed(T.composite_either(placed, keys, WETLAND_NODATA), keys)


def _typed(merged: DataFrame, keys: list[str]) -> DataFrame:
    types = {b: "float" for b in WETLAND_NODATA} | {"water": "int"}
    return merged.select(*keys, *[F.col(c).cast(t).alias(c) for c, t in types.items()])


def _request(polygons, grid, time, ranges, mask) -> _Request:
    mask = mask or G.polygon_mask(polygons, grid, all_touched=True, ranges=ranges)
    return _Request(polygons, grid, mask, time, ranges)


def _areas(source, q: _Request, aggregate: int | DataFrame) -> DataFrame:
    if not isinstance(aggregate, int) and q.ranges is None:
        return _areas_per_request(source, q, aggregate)
    if not isinstance(aggregate, int) or aggregate > 0:
        return wetland_area(_composite(source, q, aggregate), ["poly_id", F.col("anchor").alias("time")])
    sums = wetland_sums(source(q, True).pixels, [*_SET, "ts"])
    return _as_fractions(G.spread(sums, q.mask.overlay().members, "ts").withColumnRenamed("ts", "time"))


def _areas_per_request(source, q: _Request, aggregate: DataFrame) -> DataFrame:
    """Areas where requests differ in their length of window, if they have no time ranges.

    Requests without windows take every time as it is, so they are laid over each other: a
    pixel of a time is merged once for all of them, and sums are spread to them. One with
    windows is a set of its own. Pixels are read and merged once.
    """
    found = source(q, False)
    days = aggregate.groupBy("poly_id").agg(F.max("aggregate").alias("days")).filter("days != 0")
    days = counted(days)
    own_set = {"set_a": F.expr("xxhash64(poly_id, 1)"), "set_b": F.expr("xxhash64(poly_id, 2)")}
    apart = q.mask.each.join(days.drop("days"), "poly_id", "left_semi").withColumns(own_set)
    over = G.overlay(q.mask.each.join(days, "poly_id", "left_anti"), q.mask.bound)
    span = ["tile_id", "y", "x_from", "x_to", *_SET]
    spans = over.segments.select(*span, F.lit(None).cast("bigint").alias("own")).unionByName(
        apart.select(*span, F.col("set_a").alias("own"))
    )
    windowed = q.polygons.select("poly_id").distinct().join(days.drop("days"), "poly_id", "left_semi")
    members = over.members.unionByName(windowed.withColumns(own_set))
    # A span gives at most two segments, or stays one.
    bound = 2 * q.mask.bound
    held = G.in_segments(dealt(found.pixels, bound), beside(spans, bound), "own")
    windows, on, most = _beside_pixels(T.anchored_windows(found.times().join(days, "poly_id"), "days", turns=True), found, q)
    # Pixels of a set without windows have no ``own`` and are not looked up.
    windows = windows.withColumns({"own": own_set["set_a"], "set_b": own_set["set_b"]}).drop("poly_id")
    placed = dealt(held, most).join(windows, ["own", "set_b", *on], "left").filter("own IS NULL OR anchor IS NOT NULL")
    single = {"anchor": F.col("ts"), "n_times": F.lit(1), "days": F.lit(0), "turn": F.lit(0)}
    placed = placed.withColumns({c: F.coalesce(F.col(c), v) for c, v in single.items()})
    merged = _either(placed, [*_SET, "anchor", *_PLACE])
    sums = wetland_sums(merged, [*_SET, F.col("anchor").alias("ts")])
    areas = G.spread(sums, members, "ts").join(found.times().hint("merge"), ["poly_id", "ts"], "left_semi")
    return _as_fractions(areas.withColumnRenamed("ts", "time"))


def wetland_composite(
    pixels: DataFrame,
    scenes: DataFrame,
    polygons: DataFrame,
    grid: Grid,
    aggregate: int | DataFrame,
    time=None,
    ranges: DataFrame | None = None,
    overlapping: bool = False,
    mask: G.Mask | None = None,
) -> DataFrame:
    """Pixels merged over windows of ``aggregate`` days: ``(poly_id, anchor, pixel)`` rows.

    Windows follow each polygon's own times, so pixels are merged per polygon.
    ``aggregate`` may be a table ``(poly_id, aggregate)``, one value per request.
    """
    return _composite(_together(pixels, scenes, overlapping, None), _request(polygons, grid, time, ranges, mask), aggregate)


def wetland_areas(
    pixels: DataFrame,
    scenes: DataFrame,
    polygons: DataFrame,
    grid: Grid,
    time=None,
    ranges: DataFrame | None = None,
    aggregate: int | DataFrame = 0,
    overlapping: bool = False,
    mask: G.Mask | None = None,
    source: Grid | None = None,
) -> DataFrame:
    """:func:`wetland_area` per polygon and time, after compositing if asked.

    ``aggregate`` 0 keeps every time; 1 averages windows of one day; more days
    take the first usable value in windows of that length. A table ``(poly_id,
    aggregate)`` gives each request its own; one without a row has 0.
    """
    if source is not None and (not isinstance(aggregate, int) or aggregate):
        raise ValueError("windows follow scenes on the request's own grid; drill stored, reprojected pixels for them")
    return _areas(_together(pixels, scenes, overlapping, source), _request(polygons, grid, time, ranges, mask), aggregate)


def _wetland_shares(areas: DataFrame, mask: G.Mask, outlines: DataFrame) -> DataFrame:
    kept = areas.join(mask.area(), "poly_id").filter(
        F.col("valid") / F.col("total_area") > F.lit(S.MIN_VALID_SHARE)
    )
    shares = kept.dropna().select(
        "poly_id", "time",
        *[(F.col(c) / F.col("valid")).alias(c) for c in ("water", "wet", *S.COVER_BANDS)],
    )
    return shares.join(G.convex_hull(outlines), "poly_id")


def wetland_drill(
    pixels: DataFrame, scenes: DataFrame, polygons: DataFrame, grid: Grid,
    outlines: DataFrame | None = None, **options,
) -> DataFrame:
    """``poly_id, time, water, wet, bs, pv, npv, geometry``.

    Shares of the valid area, for times at which more than nine tenths of the
    polygon is valid. ``outlines`` are the polygons in request coordinates, for the
    hull, where ``polygons`` were projected. With ``source``, pixels lie on that
    longitude/latitude grid and are resampled to ``grid``, which is in metres.
    """
    mask = G.polygon_mask(polygons, grid, all_touched=True, ranges=options.get("ranges"))
    areas = wetland_areas(pixels, scenes, polygons, grid, mask=mask, **options)
    return _wetland_shares(areas, mask, polygons if outlines is None else outlines)


def wetland_drill_products(
    cover: Product,
    surfaces: Mapping[str, Product],
    water: Product,
    polygons: DataFrame,
    grid: Grid,
    time=None,
    ranges: DataFrame | None = None,
    aggregate: int | DataFrame = 0,
    outlines: DataFrame | None = None,
) -> DataFrame:
    """:func:`wetland_drill` over cover, sensors and water stored apart, each with its own scenes.

    ``surfaces`` are the sensors by name. Their scenes are filtered by quality figure and
    sensor calendar; those of cover and water are taken as they are. A time or pixel that
    one of the three lacks gives nothing. ``aggregate`` is as in :func:`wetland_areas`;
    windows follow the times that all three have.
    """
    mask = G.polygon_mask(polygons, grid, all_touched=True, ranges=ranges)
    areas = _areas(_apart(cover, surfaces, water), _request(polygons, grid, time, ranges, mask), aggregate)
    return _wetland_shares(areas, mask, polygons if outlines is None else outlines)
