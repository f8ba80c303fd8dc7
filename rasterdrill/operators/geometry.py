"""Polygons and points against the pixel grid.

A polygon is a set of vertex rows ``(poly_id, ring, seq, vx, vy)``, rings closed
and ``seq`` counting from 0. Its mask is held as *spans*: ``(poly_id, y, x_from,
x_to)``, disjoint runs of pixels in a row. Spans are far fewer than pixels, and
they join to pixels by tile and row, so no pixel ever meets an edge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterdrill import tuning
from rasterdrill.grid import Grid
from rasterdrill.sources.times import inside_range, read_ranges
from rasterdrill.tuning import beside, counted, dealt, sized

# Vertices per sort group: a ring of any length is split into blocks of this many.
RING_BLOCK = 4096


def edges(polygons: DataFrame, grid: Grid, block: int = RING_BLOCK) -> DataFrame:
    """Directed ring edges ``(poly_id, xa, ya, xb, yb)`` in pixel units.

    A ring is cut into blocks that share their end vertex, so one huge ring does
    not become one sort group.
    """
    own = f"CAST(floor(seq / {block}) AS BIGINT)"
    blocks = f"IF(seq > 0 AND seq % {block} = 0, array({own}, {own} - 1), array({own}))"
    in_ring = "OVER (PARTITION BY poly_id, ring, block ORDER BY seq)"
    return (
        polygons.select(
            "poly_id", "ring", "seq",
            grid.col(F.col("vx")).alias("xa"),
            grid.row(F.col("vy")).alias("ya"),
            F.expr(f"explode({blocks}) AS block"),
        )
        .selectExpr("poly_id", "xa", "ya", f"lead(xa) {in_ring} AS xb", f"lead(ya) {in_ring} AS yb")
        .filter("xb IS NOT NULL")
    )


def _edge_x(y: str) -> str:
    """Where the edge is at height ``y``; meaningless for a level edge."""
    return f"(xa + ({y} - ya) * (xb - xa) / (yb - ya))"


def _on_grid(spans: DataFrame, grid: Grid) -> DataFrame:
    """Spans cut to the grid's columns, so that mask, area and tiles agree."""
    return spans.withColumns(
        {
            "x_from": F.greatest("x_from", F.lit(grid.first_col).cast("bigint")),
            "x_to": F.least("x_to", F.lit(grid.last_col).cast("bigint")),
        }
    ).filter("x_to >= x_from")


def spans_centre(polygons: DataFrame, grid: Grid) -> DataFrame:
    """Spans of pixels whose centre lies inside, by the even-odd rule over all rings."""
    first, last = "CAST(ceil(least(ya, yb) - 0.5D) AS BIGINT)", "CAST(ceil(greatest(ya, yb) - 0.5D) AS BIGINT) - 1"
    along = "OVER (PARTITION BY poly_id, y ORDER BY cx)"
    spans = (
        edges(polygons, grid)
        .selectExpr("*", f"explode(IF({last} >= {first}, sequence({first}, {last}), NULL)) AS y")
        .selectExpr("poly_id", "y", f"{_edge_x('y + 0.5D')} AS cx")
        .selectExpr("poly_id", "y", "cx", f"row_number() {along} AS n", f"lead(cx) {along} AS next")
        .filter("n % 2 = 1")
        .selectExpr(
            "poly_id", "y",
            "CAST(ceil(cx - 0.5D) AS BIGINT) AS x_from",
            "CAST(ceil(next - 0.5D) AS BIGINT) - 1 AS x_to",
        )
    )
    return _on_grid(spans, grid)


def _edge_enters(x: str) -> str:
    """Separating-axis test: the edge enters the open square of pixel ``x`` of row ``y``."""
    return (
        f"(least(xa, xb) < {x} + 1 AND greatest(xa, xb) > {x}"
        f" AND abs((xb - xa) * (y + 0.5D - ya) - (yb - ya) * ({x} + 0.5D - xa))"
        " < 0.5D * (abs(xb - xa) + abs(yb - ya)))"
    )


def _edge_spans(polygons: DataFrame, grid: Grid) -> DataFrame:
    """Per edge and row, the run of pixels whose open square the edge enters.

    The run is found by clipping the edge to the row; its two end pixels are
    settled by the separating-axis test, which decides edges through a corner.
    """
    first, last = "CAST(floor(least(ya, yb)) AS BIGINT)", "CAST(ceil(greatest(ya, yb)) AS BIGINT) - 1"
    start = _edge_x("greatest(least(ya, yb), CAST(y AS DOUBLE))")
    end = _edge_x("least(greatest(ya, yb), y + 1.0D)")
    spans = (
        edges(polygons, grid)
        .selectExpr("*", f"explode(IF({last} >= {first}, sequence({first}, {last}), NULL)) AS y")
        .selectExpr("*", f"IF(ya = yb, xa, {start}) AS p", f"IF(ya = yb, xb, {end}) AS q")
        .selectExpr(
            "*",
            "CAST(floor(least(p, q)) AS BIGINT) AS f",
            "CAST(ceil(greatest(p, q)) AS BIGINT) - 1 AS t",
        )
        .selectExpr(
            "poly_id", "y",
            f"CASE WHEN {_edge_enters('(f - 1)')} THEN f - 1 WHEN {_edge_enters('f')} THEN f ELSE f + 1 END AS x_from",
            f"CASE WHEN {_edge_enters('(t + 1)')} THEN t + 1 WHEN {_edge_enters('t')} THEN t ELSE t - 1 END AS x_to",
        )
    )
    return _on_grid(spans, grid)


def merge_spans(spans: DataFrame, keys: Sequence[str] = ("poly_id", "y")) -> DataFrame:
    """Join overlapping or adjoining spans of a row, so each pixel is named once.

    Spans that start together are folded first, which bounds what a row sorts by
    its width, however many spans cover it.
    """
    along = f"PARTITION BY {', '.join(keys)} ORDER BY x_from"
    return (
        spans.groupBy(*keys, "x_from").agg(F.max("x_to").alias("x_to"))
        .selectExpr(
            "*", f"max(x_to) OVER ({along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach"
        )
        .selectExpr("*", f"sum(IF(reach IS NULL OR x_from > reach + 1, 1, 0)) OVER ({along}) AS run")
        .groupBy(*keys, "run")
        .agg(F.min("x_from").alias("x_from"), F.max("x_to").alias("x_to"))
        .drop("run")
    )


def spans_all_touched(polygons: DataFrame, grid: Grid) -> DataFrame:
    """Spans of pixels the polygon touches: centres inside, or entered by an edge.

    A polygon that only runs along a pixel's border does not touch it.
    """
    return merge_spans(spans_centre(polygons, grid).unionByName(_edge_spans(polygons, grid)))


def spans_of(polygons: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    return (spans_all_touched if all_touched else spans_centre)(polygons, grid)


def spans_to_pixels(spans: DataFrame) -> DataFrame:
    """One row per mask pixel. For output; the drills work on spans."""
    return spans.select("poly_id", "y", F.explode(F.sequence("x_from", "x_to")).alias("x"))


def tile_spans(spans: DataFrame, grid: Grid) -> DataFrame:
    """Cut spans at tile borders and add ``tile_id``."""
    tile, tx = F.lit(grid.tile), F.col("_tx")
    return (
        spans.withColumn(
            "_tx", F.explode(F.sequence(grid.block(F.col("x_from")), grid.block(F.col("x_to"))))
        )
        .select(
            *[c for c in spans.columns if c not in ("x_from", "x_to")],
            grid.tile_number(tx, grid.block(F.col("y"))).alias("tile_id"),
            F.greatest("x_from", tx * tile).alias("x_from"),
            F.least(F.col("x_to"), tx * tile + tile - 1).alias("x_to"),
        )
    )


def span_bound(polygons: DataFrame, grid: Grid, enough: int | None = None) -> int:
    """An upper bound on the number of tile spans, from vertices alone.

    A row of a polygon has at most as many runs as the polygon has vertices, and
    cutting at tile borders adds one piece per tile column of its extent. If that
    is above ``enough`` (the broadcast limit), edges are measured instead: an edge starts at most one
    run in each row it meets.
    """
    enough = tuning.BROADCAST_ROWS if enough is None else enough
    per_polygon = (
        polygons.select("poly_id", grid.col(F.col("vx")).alias("_c"), grid.row(F.col("vy")).alias("_r"))
        .groupBy("poly_id")
        .agg(
            (F.max("_r") - F.min("_r") + 2).alias("_rows"),
            ((F.max("_c") - F.min("_c")) / F.lit(float(grid.tile)) + 2).alias("_tiles"),
            F.count(F.lit(1)).alias("_n"),
        )
        .agg(
            F.sum(F.col("_rows") * (F.col("_tiles") + F.col("_n"))).alias("loose"),
            F.sum(F.col("_rows") * F.col("_tiles")).alias("cuts"),
        )
    )
    per_polygon = tuning.one_row(per_polygon)
    if per_polygon["loose"] is None or per_polygon["loose"] <= enough:
        return int(per_polygon["loose"] or 0)
    runs = tuning.one_row(edges(polygons, grid).agg(F.sum(F.abs(F.col("yb") - F.col("ya")) + 2).alias("n")))["n"]
    return int(per_polygon["cuts"] + (runs or 0))


class Overlay(NamedTuple):
    """Polygons laid over each other: each pixel lies in one segment, each segment in one set.

    ``segments (tile_id, y, x_from, x_to, set_a, set_b)`` are disjoint; ``members (set_a,
    set_b, poly_id)`` name the polygons of a set, with ``start`` and ``end`` if requests
    have time ranges.
    """

    segments: DataFrame
    members: DataFrame


def overlay(each: DataFrame, bound: int) -> Overlay:
    """Sweep over the tile spans ``each`` of every row of pixels.

    A polygon enters the set where its span starts and leaves it where the span ends. The
    number of a set is the exclusive or of its polygons' numbers, two of 64 bits, so it
    follows from a running aggregate over the places where spans start or end; no row
    holds the polygons of a pixel, however many there are. Two different sets meet with a
    chance of 2^-128. A set's polygons are those over one of its segments.
    """
    set_, row = ["set_a", "set_b"], ["tile_id", "y"]
    turn = "stack(2, x_from, 1L, x_to + 1, -1L) AS (x, step)"
    events = (
        each.selectExpr(*row, "xxhash64(poly_id, 1) AS ha", "xxhash64(poly_id, 2) AS hb", turn)
        .repartition(*row)  # once, for the sums and for the sweep
        .groupBy(*row, "x")
        .agg(F.expr("bit_xor(ha) AS ha"), F.expr("bit_xor(hb) AS hb"), F.sum("step").alias("step"))
    )
    along = "OVER (PARTITION BY tile_id, y ORDER BY x)"
    segments = (
        events.selectExpr(
            *row, "x AS x_from", f"lead(x) {along} - 1 AS x_to",
            f"bit_xor(ha) {along} AS set_a", f"bit_xor(hb) {along} AS set_b", f"sum(step) {along} AS deep",
        )
        .filter("deep > 0")
        .drop("deep")
    )
    shown = segments.groupBy(*set_).agg(F.min(F.struct(*row, "x_from")).alias("at")).select(
        *set_, F.col("at.tile_id").alias("_tile_id"), F.col("at.y").alias("_y"), F.col("at.x_from").alias("_x")
    )
    held = each.join(
        sized(shown, 2 * bound), F.expr("tile_id = _tile_id AND y = _y AND _x >= x_from AND _x <= x_to")
    )
    columns = [c for c in each.columns if c in ("poly_id", "start", "end")]
    # Each span starts and ends once, so there are at most twice as many segments.
    return Overlay(beside(segments, 2 * bound), held.select(*set_, *columns))


def in_segments(pixels: DataFrame, segments: DataFrame, *columns: str) -> DataFrame:
    """Pixels with the set of polygons that hold them, and ``columns`` of the segment; those of none go."""
    joined = pixels.join(_aside(segments), F.expr(_IN_SPAN))
    return joined.select(*[F.col(f"_{c}").alias(c) for c in ("set_a", "set_b", *columns)], *pixels.columns)


def spread(sums: DataFrame, members: DataFrame, time: str) -> DataFrame:
    """From sums per set and ``time`` to sums per polygon and ``time``, where each column is a sum.

    Where polygons have time ranges, sums outside a polygon's range do not count for it.
    """
    values = [c for c in sums.columns if c not in ("set_a", "set_b", time)]
    joined = sums.join(members, ["set_a", "set_b"])
    if "start" in members.columns:
        joined = joined.filter(inside_range(F.col(time), F.col("start"), F.col("end")))
    return joined.groupBy("poly_id", time).agg(*[F.sum(c).alias(c) for c in values])


class Mask:
    """A set of polygons on the grid.

    ``spans`` are per polygon; ``each`` are the same cut at tile borders, hinted
    for broadcast only if ``bound``, a proven number of rows, allows it, else dealt by tile. Where
    requests have time ranges, ``each`` carries their ``start`` and ``end`` as times.
    """

    def __init__(self, spans: DataFrame, each: DataFrame, bound: int):
        self.spans, self.each, self.bound = spans, each, bound
        self._overlay: Overlay | None = None

    def union(self) -> DataFrame:
        """Tile spans of all polygons together: each pixel at most once."""
        plain = self.each.select("tile_id", "y", "x_from", "x_to")
        return sized(merge_spans(plain, ("tile_id", "y")), self.bound)

    def overlay(self) -> Overlay:
        if self._overlay is None:
            self._overlay = overlay(self.each, self.bound)
        return self._overlay

    def area(self) -> DataFrame:
        """Mask size per polygon; a polygon without any mask pixel has no row."""
        size = F.expr("sum(x_to - x_from + 1) AS total_area")
        return self.spans.groupBy("poly_id").agg(size)


def polygon_mask(
    polygons: DataFrame, grid: Grid, all_touched: bool = False, ranges: DataFrame | None = None
) -> Mask:
    """``ranges (poly_id, start, end)`` limits requests in time; one without a row takes all times."""
    bound = span_bound(polygons, grid)
    spans = spans_of(polygons, grid, all_touched)
    cut = tile_spans(spans, grid)
    if ranges is not None:
        cut = cut.join(counted(read_ranges(ranges, "poly_id")), "poly_id", "left")
    return Mask(spans, beside(cut, bound), bound)


# Edges nearer to a tile than this part of its width count as inside it.
_NEAR_TILE = 1e-6


class TwoLevelMask(NamedTuple):
    """A mask in two levels: tiles wholly inside a polygon, and spans in the others.

    ``full (poly_id, tile_id)`` has one row per tile that lies inside as a whole,
    ``border_tiles (poly_id, tile_id)`` names the tiles an edge comes near, and ``border
    (poly_id, tile_id, y, x_from, x_to)`` holds the spans there. The two levels are
    disjoint and together the mask of :func:`polygon_mask`. ``bound`` is a proven number of
    rows for each.
    """

    full: DataFrame
    border_tiles: DataFrame
    border: DataFrame
    bound: int

    def area(self, grid: Grid) -> DataFrame:
        """:meth:`Mask.area`, from rows that grow with the outline and with whole tiles."""
        whole = self.full.select("poly_id", F.lit(grid.tile * grid.tile).cast("bigint").alias("n"))
        cut = self.border.select("poly_id", F.expr("x_to - x_from + 1 AS n"))
        return whole.unionByName(cut).groupBy("poly_id").agg(F.sum("n").alias("total_area"))


def _tile_runs_of_edges(polygons: DataFrame, grid: Grid) -> DataFrame:
    """Runs of tiles ``(poly_id, y, x_from, x_to)``, in tile rows and columns, that edges come near.

    A tile an edge only comes near is as good as one it enters: its spans are found pixel by
    pixel either way.
    """
    near, size = f"{_NEAR_TILE}D", f"{float(grid.tile)}D"
    first, last = f"CAST(floor(least(ya, yb) - {near}) AS BIGINT)", f"CAST(floor(greatest(ya, yb) + {near}) AS BIGINT)"
    start = _edge_x(f"greatest(least(ya, yb), y - {near})")
    end = _edge_x(f"least(greatest(ya, yb), y + 1 + {near})")
    runs = (
        edges(polygons, grid)
        .selectExpr("poly_id", *[f"{c} / {size} AS {c}" for c in ("xa", "ya", "xb", "yb")])
        .selectExpr("*", f"explode(sequence({first}, {last})) AS y")
        .selectExpr("poly_id", "y", f"IF(ya = yb, xa, {start}) AS p", f"IF(ya = yb, xb, {end}) AS q")
        .selectExpr(
            "poly_id", "y",
            f"CAST(floor(least(p, q) - {near}) AS BIGINT) AS x_from",
            f"CAST(floor(greatest(p, q) + {near}) AS BIGINT) AS x_to",
        )
    )
    return merge_spans(runs)


def _grid_of_tiles(grid: Grid) -> Grid:
    """The grid whose pixels are the tiles of ``grid``, with the same numbers."""
    return replace(grid, res_x=grid.res_x * grid.tile, res_y=grid.res_y * grid.tile, tile=1)


def two_level_mask(polygons: DataFrame, grid: Grid, all_touched: bool = False) -> TwoLevelMask:
    """The mask of each polygon as whole tiles and as spans of border tiles.

    No edge comes near a tile that is not of the border, so all its pixels lie on one
    side, that of its centre: whole tiles are the tiles whose centre is inside, on a grid
    of tiles, without those of the border. Spans of pixel rows are cut to border tiles
    before they are cut at tile borders; a wide polygon is not spread over its inside.
    """
    coarse = _grid_of_tiles(grid)
    runs = _on_grid(_tile_runs_of_edges(polygons, grid), coarse)
    border_tiles = tile_spans(runs, coarse).select("poly_id", "tile_id")
    inside = tile_spans(spans_centre(polygons, coarse), coarse).select("poly_id", "tile_id")
    full = inside.join(border_tiles, ["poly_id", "tile_id"], "left_anti")
    rows = spans_of(polygons, grid, all_touched).withColumn("_ty", grid.block(F.col("y")))
    runs = _aside(runs.withColumnsRenamed({"y": "row", "poly_id": "poly"}))
    meets = f"poly_id = _poly AND _ty = _row AND x_to >= _x_from * {grid.tile} AND x_from < (_x_to + 1) * {grid.tile}"
    bound = span_bound(polygons, grid)
    cut = rows.join(sized(runs, bound), F.expr(meets)).selectExpr(
        "poly_id", "y", f"greatest(x_from, _x_from * {grid.tile}) AS x_from",
        f"least(x_to, (_x_to + 1) * {grid.tile} - 1) AS x_to",
    )
    return TwoLevelMask(full, border_tiles, tile_spans(cut, grid), bound)


def _aside(df: DataFrame) -> DataFrame:
    """Rename every column for the small side of a join, so names never clash."""
    return df.select(*[F.col(c).alias("_" + c) for c in df.columns])


# A pixel lies in a (renamed) tile span. Tile and row are the join keys.
_IN_SPAN = "tile_id = _tile_id AND y = _y AND x >= _x_from AND x <= _x_to"
# A pixel's square overlaps a (renamed) extent in one of the extent's tiles.
_IN_EXTENT = "tile_id = _tile_id AND x < _bx1 AND x + 1 > _bx0 AND y < _by1 AND y + 1 > _by0"


def inside_any(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels inside at least one polygon, each once."""
    return pixels.join(_aside(mask), F.expr(_IN_SPAN), "left_semi")


def inside_each(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels with the ``poly_id`` of every polygon that holds them, in its time range if it has one."""
    joined = pixels.join(_aside(mask), F.expr(_IN_SPAN))
    if "start" in mask.columns:
        joined = joined.filter(inside_range(F.col("ts"), F.col("_start"), F.col("_end")))
    return joined.select(F.col("_poly_id").alias("poly_id"), *pixels.columns)


def mask_polygon(pixels: DataFrame, spans: DataFrame, nodata: dict[str, float | None]) -> DataFrame:
    """The dense form of masking: rows stay, bands outside turn to nodata or null.

    ``pixels`` carries ``poly_id``: the pixels of the polygon's extent. ``spans``
    are that polygon's tile spans, disjoint, so a pixel finds at most one.
    """
    inside = F.col("_x_from").isNotNull()
    out = []
    for c in pixels.columns:
        if c in nodata:
            other = F.lit(nodata[c]).cast(pixels.schema[c].dataType)
            out.append(F.when(inside, F.col(c)).otherwise(other).alias(c))
        else:
            out.append(F.col(c))
    joined = pixels.join(_aside(spans), F.expr("poly_id = _poly_id AND " + _IN_SPAN), "left")
    return joined.select(*out, inside.alias("inside"))


def polygon_pixel_area(polygons: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """``total_area`` per polygon, from geometry, whether or not pixels were observed."""
    return polygon_mask(polygons, grid, all_touched).area()


def polygon_extents(polygons: DataFrame, grid: Grid) -> DataFrame:
    """Extent of each polygon in pixel units: ``bx0, by0, bx1, by1``."""
    return (
        polygons.select("poly_id", grid.col(F.col("vx")).alias("_c"), grid.row(F.col("vy")).alias("_r"))
        .groupBy("poly_id")
        .agg(
            F.min("_c").alias("bx0"), F.min("_r").alias("by0"),
            F.max("_c").alias("bx1"), F.max("_r").alias("by1"),
        )
    )


def extent_tiles(extents: DataFrame, grid: Grid) -> DataFrame:
    """One row per tile of the grid an extent overlaps; columns of ``extents`` are kept."""
    return extent_blocks(extents, grid).drop("_tx", "_ty")


def extent_blocks(extents: DataFrame, grid: Grid) -> DataFrame:
    """:func:`extent_tiles` with the tile's column and row, ``_tx`` and ``_ty``."""
    def blocks(lo: str, hi: str) -> tuple[Column, Column]:
        return grid.block(F.col(lo)), F.ceil(F.col(hi) / F.lit(float(grid.tile))).cast("bigint") - 1

    def listed(first: Column, last: Column) -> Column:
        return F.explode(F.when(last >= first, F.sequence(first, last)))

    left, right = blocks("bx0", "bx1")
    left = F.greatest(left, F.lit(grid.first_tile_x).cast("bigint"))
    right = F.least(right, F.lit(grid.first_tile_x + grid.tiles_across - 1).cast("bigint"))
    return (
        extents.withColumn("_tx", listed(left, right))
        .withColumn("_ty", listed(*blocks("by0", "by1")))
        .withColumn("tile_id", grid.tile_number(F.col("_tx"), F.col("_ty")))
    )


def grid_status(polygons: DataFrame, grid: Grid) -> DataFrame:
    """``poly_id, grid_status``: 'ok', 'partly off the grid' or 'off the grid'.

    Only columns can be off; what is off counts neither in mask nor in area.
    """
    first, end = F.lit(float(grid.first_col)), F.lit(float(grid.last_col + 1))
    x0, x1 = F.col("bx0"), F.col("bx1")
    status = (
        F.when((x1 <= first) | (x0 >= end), "off the grid")
        .when((x0 < first) | (x1 > end), "partly off the grid")
        .otherwise("ok")
    )
    return polygon_extents(polygons, grid).select("poly_id", status.alias("grid_status"))


def _hinted_tiles(extents: DataFrame, grid: Grid) -> tuple[DataFrame, int]:
    """Extent tiles under their join names, broadcast only if counted to be few, and their number.

    The count multiplies tile rows by tile columns; nothing is exploded for it.
    """
    def across(lo: str, hi: str) -> Column:
        return F.greatest(grid.block(F.col(hi)) - grid.block(F.col(lo)) + 1, F.lit(0))

    n = tuning.one_row(extents.agg(F.sum(across("bx0", "bx1") * across("by0", "by1")).alias("n")))["n"]
    return _aside(beside(extent_tiles(extents, grid), int(n or 0))), int(n or 0)


# Tiles that may be named in a filter one by one; beyond that ``tile_intervals`` gives this many.
TILE_LIST = 10_000
TILE_INTERVALS = 256
# Intervals spelled out in a filter. Each names the tile twice, and where the tile is computed each
# copy computes it: some hundred of them are more than a method of generated code may hold.
FILTER_INTERVALS = 8


def _tile_slices(tiles: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """A level, and the least and greatest of ``tiles (tile_id)`` in each slice of ``2 ** level`` numbers.

    Tiles are counted at ever coarser slices of their numbers, at once; the finest level
    with few enough slices is collected.
    """
    levels = range(0, 60, 4)
    held = tiles.select("tile_id")
    counts = held.agg(*[F.approx_count_distinct(F.shiftright("tile_id", n)).alias(f"n{n}") for n in levels]).first()
    level = next((n for n in levels if counts[f"n{n}"] * 2 <= TILE_LIST), levels[-1])
    slices = held.groupBy(F.shiftright("tile_id", level).alias("s")).agg(F.min("tile_id").alias("a"), F.max("tile_id").alias("b"))
    return level, sorted((r["a"], r["b"]) for r in slices.filter("s IS NOT NULL").collect())  # some TILE_LIST rows at most


def _closed(ends: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Sorted intervals with the smallest gaps closed, until there are at most ``most``; those without a gap are one."""
    gaps = [i for i in range(1, len(ends)) if ends[i][0] - ends[i - 1][1] > 1]
    gaps.sort(key=lambda i: ends[i][0] - ends[i - 1][1], reverse=True)
    cuts = [0, *sorted(gaps[: most - 1]), len(ends)]
    return [(ends[i][0], ends[j - 1][1]) for i, j in zip(cuts, cuts[1:]) if i < j]


def tile_intervals(tiles: DataFrame, most: int | None = None) -> list[tuple[int, int]]:
    """At most ``most`` intervals of tile numbers that hold all of ``tiles (tile_id)``.

    They are the least and greatest tile of each slice of numbers (see :func:`_tile_slices`),
    with the smallest gaps closed. On a curve (see ``Grid.curve``) a slice is a square, so an
    interval holds little beyond what was asked for.
    """
    return _closed(_tile_slices(tiles)[1], most or TILE_INTERVALS)


def tile_filter(tiles: DataFrame) -> Column:
    """A condition on ``tile_id`` that holds for the listed ``tiles (tile_id)``, for the file partitions.

    Up to ``TILE_LIST`` tiles are named; beyond that the slices of numbers that hold them are,
    by one lookup however many there are, between the ends of at most ``FILTER_INTERVALS``
    intervals.
    """
    wanted = tiles.select("tile_id").distinct()
    with tuning.one_job(tiles.sparkSession):
        named = wanted.limit(TILE_LIST + 1).toArrow().column(0).to_pylist()
        tile = F.col("tile_id")
        if len(named) <= TILE_LIST:
            return tile.isin(sorted(named))
        level, ends = _tile_slices(wanted)
    any_ = F.lit(False)
    for low, high in _closed(ends, FILTER_INTERVALS):
        any_ = any_ | tile.between(low, high)
    if len(_closed(ends, len(ends))) > FILTER_INTERVALS:  # else nothing lies between
        any_ = any_ & F.shiftright("tile_id", level).isin([a >> level for a, _ in ends])
    return any_


def at_tiles(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels of the tiles listed in ``tiles (tile_id)``, by :func:`tile_filter`.

    It does not hang on how a later join is planned. Where requests cover most tiles there
    is nothing to prune.
    """
    return pixels.filter(tile_filter(tiles))


def at_polygons(pixels: DataFrame, polygons: DataFrame, grid: Grid) -> DataFrame:
    """:func:`at_tiles` for the tiles under any polygon's extent."""
    return at_tiles(pixels, extent_tiles(polygon_extents(polygons, grid), grid))


def polygon_tiles(polygons: DataFrame, grid: Grid) -> Column:
    """:func:`tile_filter` for the tiles under any polygon's extent."""
    return tile_filter(extent_tiles(polygon_extents(polygons, grid), grid))


def prune_bbox(pixels: DataFrame, polygons: DataFrame, grid: Grid) -> DataFrame:
    """Pixels under the extent of any polygon.

    The overall extent enters as scalar subqueries, which Spark runs first and
    hands to the file scan; the tile list then prunes file partitions.
    """
    extents = polygon_extents(polygons, grid)
    x, y = F.col("x"), F.col("y")

    def edge(expr: Column) -> Column:
        return extents.select(expr.cast("int")).scalar()

    boxed = at_polygons(pixels, polygons, grid).filter(
        (x >= edge(F.min(F.floor("bx0")))) & (x <= edge(F.max(F.ceil("bx1"))))
        & (y >= edge(F.min(F.floor("by0")))) & (y <= edge(F.max(F.ceil("by1"))))
    )
    tiles, n = _hinted_tiles(extents, grid)
    return dealt(boxed, n).join(tiles, F.expr(_IN_EXTENT), "left_semi")


def pixels_in_extents(pixels: DataFrame, polygons: DataFrame, grid: Grid) -> DataFrame:
    """Every pixel of every polygon's extent, with ``poly_id``."""
    tiles, n = _hinted_tiles(polygon_extents(polygons, grid), grid)
    joined = dealt(pixels, n).join(tiles, F.expr(_IN_EXTENT))
    return joined.select(F.col("_poly_id").alias("poly_id"), *pixels.columns)


def _tiles_of_scene(grid: Grid) -> Column:
    def span(lo: str, hi: str) -> Column:
        return grid.block(F.col(hi)) - grid.block(F.col(lo)) + 1

    return span("sx0", "sx1") * span("sy0", "sy1")


def scene_sizes(scenes: DataFrame, grid: Grid) -> tuple[int, int]:
    """Number of scenes, and a bound on the number of tiles they cover."""
    row = tuning.one_row(scenes.agg(F.count(F.lit(1)).alias("n"), F.sum(_tiles_of_scene(grid)).alias("tiles")))
    return row["n"], int(row["tiles"] or 0)


def footprints(tables: Sequence[DataFrame], grid: Grid) -> list[int]:
    """The bound of :func:`scene_sizes` for several tables of scenes, in one job."""
    parts = [t.select(F.lit(i).alias("i"), _tiles_of_scene(grid).alias("tiles")) for i, t in enumerate(tables)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("i").agg(F.sum("tiles").alias("tiles"))
    with tuning.one_job(tables[0].sparkSession):
        found = {r["i"]: int(r["tiles"] or 0) for r in sums.collect()}
    return [found.get(i, 0) for i in range(len(tables))]


def scene_tiles(scenes: DataFrame, extents: DataFrame, grid: Grid, *columns: str) -> DataFrame:
    """``scene_id, tile_id`` and ``columns`` for the tiles that scenes and extents share.

    The join key of pixels to scenes: no scene, and no tile, is one group.
    """
    return scenes_on_tiles(scenes, extent_tiles(extents, grid).select("tile_id").distinct(), grid, *columns)


def scenes_on_tiles(scenes: DataFrame, tiles: DataFrame, grid: Grid, *columns: str) -> DataFrame:
    """``scene_id, tile_id`` and ``columns`` for the given ``tiles (tile_id)`` that scenes cover."""
    areas = scenes.select(
        "scene_id", *columns,
        F.col("sx0").alias("bx0"), F.col("sy0").alias("by0"),
        F.col("sx1").alias("bx1"), F.col("sy1").alias("by1"),
    )
    held = extent_tiles(areas, grid).select("scene_id", F.col("tile_id"), *columns)
    return held.join(tiles, "tile_id", "left_semi")


def _scenes_per_tile(scenes: DataFrame, grid: Grid) -> DataFrame:
    areas = scenes.select(
        F.col("sx0").alias("bx0"), F.col("sy0").alias("by0"),
        F.col("sx1").alias("bx1"), F.col("sy1").alias("by1"),
    )
    return extent_tiles(areas, grid).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))


def spine_bound(extents: DataFrame, scenes: DataFrame, grid: Grid) -> int:
    """A bound on the rows of :func:`time_spine`: scenes per tile, summed over extents."""
    held = _scenes_per_tile(scenes, grid)
    asked = extent_tiles(extents, grid).groupBy("tile_id").agg(F.count(F.lit(1)).alias("m"))
    return int(tuning.one_row(held.join(asked.hint("merge"), "tile_id").agg(F.sum(F.col("n") * F.col("m")).alias("n")))["n"] or 0)


def window_bounds(extents: DataFrame, scenes: DataFrame, grid: Grid) -> tuple[int, int]:
    """Closer bounds: on the exact times of all extents, and on their sum with each time on every tile of its extent.

    An extent has at most as many times as there are scenes on its tiles, and as ``scenes``
    have times at all. Neither a spine nor windows are built for it.
    """
    asked = extent_tiles(extents, grid).select("poly_id", "tile_id").hint("merge")
    per = asked.join(_scenes_per_tile(scenes, grid), "tile_id", "left").groupBy("poly_id")
    times = F.least(F.coalesce("n", F.lit(0)), scenes.select(F.count_distinct("ts")).scalar())
    each = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).select("m", times.alias("n"))
    row = tuning.one_row(each.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("most")))
    return int(row["n"] or 0), int(row["most"] or 0)


def time_spine(
    extents: DataFrame,
    scenes: DataFrame,
    grid: Grid,
    keys: Sequence[str] = ("poly_id",),
    ranges: DataFrame | None = None,
    footprints: int | None = None,
) -> DataFrame:
    """Every time group under each extent: ``(*keys, grp, time, n_scenes)``.

    ``scenes`` carry their own extent ``sx0, sy0, sx1, sy1`` in pixel units and
    ``grp`` from ``group_scenes``; the label ``time`` is the first scene time of
    the group. Rows exist even where no pixel was ever valid. ``ranges`` limits
    each key to its own ``start`` and ``end`` (a key without a row takes all times); ``footprints`` is the number of
    scene tiles, if known.
    """
    if footprints is None:
        _, footprints = scene_sizes(scenes, grid)
    if ranges is not None:
        extents = extents.join(counted(read_ranges(ranges, keys[0])), keys[0], "left")
    asked = tuning.dealt(extent_tiles(extents, grid), footprints)
    areas = scenes.select(
        "ts", "grp",
        F.col("sx0").alias("bx0"), F.col("sy0").alias("by0"),
        F.col("sx1").alias("bx1"), F.col("sy1").alias("by1"),
    )
    held = _aside(beside(extent_tiles(areas, grid), footprints))
    overlap = "bx0 < _bx1 AND bx1 > _bx0 AND by0 < _by1 AND by1 > _by0"
    # A scene that meets an extent in several tiles counts once: at its first one.
    first_tile = grid.tile_id(
        F.greatest("bx0", "_bx0", F.lit(float(grid.first_col))), F.greatest("by0", "_by0")
    )
    met = asked.join(held, F.expr("tile_id = _tile_id AND " + overlap)).filter(
        F.col("tile_id") == first_tile
    )
    if ranges is not None:
        met = met.filter(inside_range(F.col("_ts"), F.col("start"), F.col("end")))
    return met.groupBy(*keys, F.col("_grp").alias("grp")).agg(
        F.min("_ts").alias("time"), F.count(F.lit(1)).alias("n_scenes")
    )


def points_to_pixels(points: DataFrame, grid: Grid) -> DataFrame:
    """Add the pixel ``(tile_id, y, x)`` that holds each ``(lon, lat)``."""
    x = F.floor(grid.col(F.col("lon"))).cast("bigint")
    y = F.floor(grid.row(F.col("lat"))).cast("bigint")
    return points.withColumns({"x": x, "y": y}).withColumn(
        "tile_id", grid.tile_id(F.col("x"), F.col("y"))
    )


def pixel_at_point(pixels: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """Pixels at the points, with ``point_id, lon, lat`` of the request point."""
    located = points_to_pixels(points, grid).select("point_id", "lon", "lat", "tile_id", "y", "x")
    n = tuning.rows_of(located)
    located = _aside(beside(located, n))
    joined = dealt(pixels, n).join(located, F.expr("tile_id = _tile_id AND y = _y AND x = _x"))
    return joined.select(
        F.col("_point_id").alias("point_id"),
        F.col("_lon").alias("lon"),
        F.col("_lat").alias("lat"),
        *pixels.columns,
    )


# --- convex hull -----------------------------------------------------------

def _turn(o: Column, a: Column, b: Column) -> Column:
    return (a["vx"] - o["vx"]) * (b["vy"] - o["vy"]) - (a["vy"] - o["vy"]) * (b["vx"] - o["vx"])


def _chain(points: Column) -> Column:
    """Lower hull of sorted points: fold that keeps only left turns.

    Along a convex stack the turns towards a point are left up to a corner and not
    after it, so the last corner to keep is found by halving.
    """
    def push(stack: Column, p: Column) -> Column:
        def halve(span: Column, _: Column) -> Column:
            # Corner lo is kept, corners above hi are not.
            lo, hi = span["lo"], span["hi"]
            k = F.floor((lo + hi + 1) / F.lit(2)).cast("int")
            left = _turn(F.element_at(stack, k - 1), F.element_at(stack, k), p) > 0
            return (
                F.when(lo >= hi, span)
                .when(left, F.struct(k.alias("lo"), hi.alias("hi")))
                .otherwise(F.struct(lo.alias("lo"), (k - 1).alias("hi")))
            )

        whole = F.struct(F.lit(1).alias("lo"), F.size(stack).alias("hi"))
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(stack) + F.lit(1))).cast("int") + 1)
        kept = F.aggregate(steps, whole, halve)["lo"]
        return F.array_append(F.slice(stack, 1, kept), p)

    rest = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.when(
        F.size(points) <= 1, points
    ).otherwise(F.aggregate(rest, F.slice(points, 1, 1), push))


def _ring(points: Column) -> Column:
    """Hull corners, counter-clockwise from the smallest ``(vx, vy)``, not closed."""
    lower, upper = _chain(points), _chain(F.reverse(points))
    trim = lambda c: F.slice(c, 1, F.size(c) - 1)
    return F.when(F.size(points) <= 1, points).otherwise(F.concat(trim(lower), trim(upper)))


def _collect_corners(df: DataFrame, *keys: str) -> DataFrame:
    corner = F.struct("vx", "vy")
    return (
        df.groupBy(*keys)
        .agg(F.sort_array(F.collect_set(corner)).alias("_pts"))
        .select(*keys, F.explode(_ring(F.col("_pts"))).alias("_p"))
        .select(*keys, "_p.vx", "_p.vy")
    )


def convex_hull(polygons: DataFrame, block: int = 512) -> DataFrame:
    """``(poly_id, geometry)``: WKT of each polygon's convex hull.

    Blocks of a ring are reduced to their own hulls first. That shrinks a coastline;
    on a convex arc every corner stays, and all meet in one row.
    """
    blocks = polygons.select(
        "poly_id", "ring", F.floor(F.col("seq") / F.lit(block)).alias("_b"), "vx", "vy"
    )
    corners = _collect_corners(blocks, "poly_id", "ring", "_b")
    text = lambda p: F.concat(p["vx"].cast("string"), F.lit(" "), p["vy"].cast("string"))
    ring = F.col("_ring")
    listed = F.array_join(F.transform(ring, text), ", ")
    closed = F.concat(listed, F.lit(", "), text(F.element_at(ring, 1)))
    return (
        corners.groupBy("poly_id")
        .agg(F.sort_array(F.collect_set(F.struct("vx", "vy"))).alias("_pts"))
        .select("poly_id", _ring(F.col("_pts")).alias("_ring"))
        .select(
            "poly_id",
            F.when(F.size(ring) == 1, F.concat(F.lit("POINT ("), listed, F.lit(")")))
            .when(F.size(ring) == 2, F.concat(F.lit("LINESTRING ("), listed, F.lit(")")))
            .otherwise(F.concat(F.lit("POLYGON (("), closed, F.lit("))")))
            .alias("geometry"),
        )
    )
