"""Masks against brute force over every pixel, and hulls against a plain walk."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rasterdrill.grid import Grid
from rasterdrill.operators import geometry as G
from rasterdrill.operators import reproject as R

GRID = Grid(tile=8, tiles_across=16, first_tile_x=-4)
SCHEMA = "poly_id bigint, ring int, seq int, vx double, vy double"


def vertices(poly_id, *rings):
    return [
        (poly_id, r, i, float(x), float(y))
        for r, pts in enumerate(rings)
        for i, (x, y) in enumerate([*pts, pts[0]])
    ]


def star(rng, n):
    """A random simple polygon around a random centre."""
    cx, cy = rng.uniform(5, 25), rng.uniform(5, 25)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + rng.uniform(1, 9) * math.cos(a), cy + rng.uniform(1, 9) * math.sin(a)) for a in angles]


def edges_of(rows):
    out = []
    for a, b in zip(rows, rows[1:]):
        if a[1] == b[1]:
            out.append((a[3], a[4], b[3], b[4]))
    return out


def centre_inside(edges, x, y):
    cx, cy, n = x + 0.5, y + 0.5, 0
    for xa, ya, xb, yb in edges:
        if (ya <= cy < yb) or (yb <= cy < ya):
            n += xa + (cy - ya) * (xb - xa) / (yb - ya) <= cx
    return n % 2 == 1


def touched(edges, x, y):
    cx, cy = x + 0.5, y + 0.5
    for xa, ya, xb, yb in edges:
        if (
            min(xa, xb) < x + 1 and max(xa, xb) > x and min(ya, yb) < y + 1 and max(ya, yb) > y
            and abs((xb - xa) * (cy - ya) - (yb - ya) * (cx - xa)) < 0.5 * (abs(xb - xa) + abs(yb - ya))
        ):
            return True
    return centre_inside(edges, x, y)


def random_polygons():
    rng = random.Random(5)
    polys = {i: vertices(i, star(rng, rng.randint(3, 12))) for i in range(25)}
    polys[25] = vertices(25, [(1, 1), (30, 1), (30, 30), (1, 30)], [(5, 5), (9, 5), (9, 9), (5, 9)])
    polys[26] = vertices(26, [(1.4, 2.3), (5.6, 2.3), (5.6, 2.4), (1.4, 2.4)])
    polys[27] = vertices(27, [(-3.5, -2.5), (6.5, -2.5), (2.2, 7.5)])
    polys[28] = vertices(28, [(4, 4), (8, 8), (4, 12), (0, 8)])
    return polys


@pytest.mark.parametrize("test,all_touched", [(centre_inside, False), (touched, True)])
def test_masks_match_brute_force(spark, rows, test, all_touched):
    polys = random_polygons()
    df = spark.createDataFrame([v for p in polys.values() for v in p], SCHEMA)
    got = rows(G.spans_to_pixels(G.spans_of(df, GRID, all_touched)), "poly_id", "x", "y")
    want = sorted(
        (i, x, y)
        for i, p in polys.items()
        for x in range(-8, 40)
        for y in range(-8, 40)
        if test(edges_of(p), x, y)
    )
    assert got == want


def test_border_is_not_touched(spark, rows):
    """A square on pixel borders touches only the pixels it holds."""
    df = spark.createDataFrame(vertices(1, [(2, 2), (4, 2), (4, 4), (2, 4)]), SCHEMA)
    got = rows(G.spans_to_pixels(G.spans_all_touched(df, GRID)), "x", "y")
    assert got == [(2, 2), (2, 3), (3, 2), (3, 3)]


def test_sliver_has_no_centre(spark):
    df = spark.createDataFrame(vertices(1, [(1.4, 2.3), (5.6, 2.3), (5.6, 2.4), (1.4, 2.4)]), SCHEMA)
    assert G.spans_centre(df, GRID).count() == 0
    assert G.polygon_pixel_area(df, GRID, all_touched=True).first()["total_area"] == 5


def test_long_rings_are_split(spark, rows):
    """Cutting a ring into small sort groups gives the same edges."""
    df = spark.createDataFrame(vertices(1, star(random.Random(1), 40)), SCHEMA)
    whole, cut = G.edges(df, GRID), G.edges(df, GRID, block=3)
    assert rows(whole) == rows(cut) and cut.count() == 40


def test_tile_spans_and_bound(spark):
    polys = random_polygons()
    df = spark.createDataFrame([v for p in polys.values() for v in p], SCHEMA)
    for all_touched in (False, True):
        spans = G.spans_of(df, GRID, all_touched)
        tiles = G.tile_spans(spans, GRID)
        wide = tiles.filter(F.floor(F.col("x_from") / 8) != F.floor(F.col("x_to") / 8))
        assert wide.count() == 0
        n = tiles.count()
        assert n <= G.span_bound(df, GRID)
        assert n <= G.span_bound(df, GRID, enough=0)


def test_grid_may_run_south(spark, rows):
    """With a negative row size, rows count downwards from the origin."""
    grid = Grid(origin_x=100.0, origin_y=50.0, res_x=10.0, res_y=-10.0, tile=8, tiles_across=8)
    df = spark.createDataFrame(vertices(1, [(110, 40), (130, 40), (130, 20), (110, 20)]), SCHEMA)
    assert rows(G.spans_to_pixels(G.spans_centre(df, grid)), "x", "y") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def hull(points):
    pts = sorted(set(points))
    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ) <= 0:
                out.pop()
            out.append(p)
        return out
    return half(pts)[:-1] + half(pts[::-1])[:-1]


def test_convex_hull(spark):
    rng = random.Random(9)
    polys = {i: vertices(i, star(rng, rng.randint(3, 30))) for i in range(20)}
    df = spark.createDataFrame([v for p in polys.values() for v in p], SCHEMA)
    for block in (512, 4):
        for r in G.convex_hull(df, block=block).collect():
            body = r["geometry"].removeprefix("POLYGON ((").removesuffix("))")
            got = [tuple(map(float, p.split())) for p in body.split(", ")]
            want = hull([(v[3], v[4]) for v in polys[r["poly_id"]]])
            assert got == [*want, want[0]]


def test_hull_of_a_line(spark):
    df = spark.createDataFrame(vertices(1, [(0, 0), (1, 1), (2, 2)]), SCHEMA)
    assert G.convex_hull(df).first()["geometry"] == "LINESTRING (0.0 0.0, 2.0 2.0)"


def test_scene_over_several_tiles_counts_once(spark):
    """A wide scene meets a wide polygon in four tiles, and is one scene."""
    extents = spark.createDataFrame([(1, 2.0, 2.0, 20.0, 14.0)], "poly_id int, bx0 double, by0 double, bx1 double, by1 double")
    scenes = spark.sql(
        "SELECT TIMESTAMP_NTZ '2000-01-01' AS ts, 1 AS grp, sx0, sy0, sx1, sy1 FROM VALUES"
        " (0D, 0D, 40D, 16D), (5D, 5D, 12D, 12D), (20D, 0D, 30D, 8D) AS s(sx0, sy0, sx1, sy1)"
    )
    got = G.time_spine(extents, scenes, GRID).collect()
    assert [r["n_scenes"] for r in got] == [2]


def test_polygons_on_both_sides_of_the_meridian(spark):
    """The metric grid holds the whole system: mask, area, tiles and spine agree west and east."""
    corners = [(0, 0), (300, 0), (300, -300), (0, -300), (0, 0)]
    places = {1: (-1_507_000.0, -3_500_000.0), 2: (1_552_000.0, -3_900_000.0), 3: (-4_000_000.0, 900_000.0)}
    rows = [(k, 0, i, x + dx, y + dy) for k, (x, y) in places.items() for i, (dx, dy) in enumerate(corners)]
    po = spark.createDataFrame(rows, "poly_id int, ring int, seq int, vx double, vy double")
    mask = G.polygon_mask(po, R.METRIC_GRID)
    in_tiles = mask.each.selectExpr("poly_id", "x_to - x_from + 1 AS n").groupBy("poly_id").sum("n")
    assert {tuple(r) for r in mask.area().collect()} == {tuple(r) for r in in_tiles.collect()}
    area = dict(tuple(r) for r in mask.area().collect())
    assert set(area) == {1, 2, 3} and all(81 <= n <= 100 for n in area.values())
    tiles = G.extent_tiles(G.polygon_extents(po, R.METRIC_GRID), R.METRIC_GRID)
    assert {r[0] for r in tiles.select("poly_id").distinct().collect()} == {1, 2, 3}
    assert {r["grid_status"] for r in G.grid_status(po, R.METRIC_GRID).collect()} == {"ok"}


def test_what_leaves_the_grid_is_said_and_counts_nowhere(spark):
    grid = Grid(tile=8, tiles_across=2, first_tile_x=-1)
    rows = [(k, 0, i, x0 + dx, dy) for k, x0 in ((1, -4.0), (2, 4.0), (3, 30.0)) for i, (dx, dy) in
            enumerate([(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (0.0, 4.0), (0.0, 0.0)])]
    po = spark.createDataFrame(rows, "poly_id int, ring int, seq int, vx double, vy double")
    got = {r["poly_id"]: r["grid_status"] for r in G.grid_status(po, grid).collect()}
    assert got == {1: "ok", 2: "partly off the grid", 3: "off the grid"}
    assert dict(tuple(r) for r in G.polygon_pixel_area(po, grid).collect()) == {1: 32, 2: 16}


def test_hull_of_many_corners(spark):
    n = 8000
    po = spark.range(n).selectExpr(
        "1 AS poly_id", "0 AS ring", "CAST(id AS INT) AS seq",
        f"cos(2 * pi() * id / {n}) AS vx", f"sin(2 * pi() * id / {n}) AS vy",
    )
    text = G.convex_hull(po).first()["geometry"]
    assert text.count(",") == n
