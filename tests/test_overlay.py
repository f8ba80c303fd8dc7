"""Overlay of polygons, products apart, resampling inside a drill, tile intervals: answers and plans."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F
from test_plans import exchanges, read_of_the_store, stored, wide  # noqa: F401

from rasterdrill import tuning
from rasterdrill.grid import Grid
from rasterdrill.operators import combine as C
from rasterdrill.operators import geometry as G
from rasterdrill.operators import reproject as R
from rasterdrill.plans import cube
from rasterdrill.plans import drills as D
from rasterdrill.sources import pixels as PX

SF = "/root/testdata/sf0.001"
TILE = Grid(tile=16, tiles_across=4, first_tile_x=0)


def rectangles(spark, n, seed=1, grid=16):
    """Overlapping rectangles with corners between pixel centres, some of them equal."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        x0, y0 = rnd.randint(0, grid - 3), rnd.randint(0, grid - 3)
        x1, y1 = rnd.randint(x0 + 1, grid), rnd.randint(y0 + 1, grid)
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        rows += [(k, 0, i, float(x), float(y)) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "poly_id int, ring int, seq int, vx double, vy double")


def test_each_pixel_lies_in_one_segment_of_its_set(spark):
    """Two hundred polygons over one tile: rows after the mask join equal the pixels."""
    po = rectangles(spark, 200)
    mask = G.polygon_mask(po, TILE)
    over = mask.overlay()
    px = spark.range(256).selectExpr(
        "timestamp_ntz'2014-05-01' AS ts", "0L AS tile_id", "cast(id div 16 AS int) AS y", "cast(id % 16 AS int) AS x", "id AS b"
    )
    held = G.in_segments(px, over.segments)
    inside = G.inside_any(px, mask.union())
    assert held.count() == inside.count() <= 256
    assert held.drop("set_a", "set_b").exceptAll(inside).count() == 0
    # The polygons of a pixel's set are those that hold it.
    spread = held.join(over.members, ["set_a", "set_b"]).select("poly_id", *px.columns)
    each = G.inside_each(px, mask.each)
    assert each.count() > 20 * inside.count()
    assert spread.exceptAll(each).count() == 0 and each.exceptAll(spread).count() == 0
    sums = held.groupBy("set_a", "set_b", "ts").agg(F.sum("b").alias("b"))
    want = {r["poly_id"]: r["b"] for r in each.groupBy("poly_id").agg(F.sum("b").alias("b")).collect()}
    assert {r["poly_id"]: r["b"] for r in G.spread(sums, over.members, "ts").collect()} == want


def test_overlay_beyond_the_broadcast_limit(spark, monkeypatch):
    po = rectangles(spark, 40, seed=2)
    few = G.polygon_mask(po, TILE).overlay()
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    many = G.polygon_mask(po, TILE).overlay()
    for a, b in zip(few, many):
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_no_polygon_gives_no_segment(spark):
    over = G.polygon_mask(rectangles(spark, 1).limit(0), TILE).overlay()
    assert over.segments.count() == over.members.count() == 0


# --- products apart ----------------------------------------------------------

def test_collate_beside_is_juxtapose_of_collate(spark):
    keys = ["ts", "x"]
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")], "ts int, x int, band string")
    one = spark.createDataFrame([(1, 1, 10), (2, 1, None)], "ts int, x int, blue int")
    two = spark.createDataFrame([(1, 1, 20), (1, 2, 21), (9, 9, 0)], "ts int, x int, blue int")
    got = C.collate_beside(base, {"one": one, "two": two}, keys)
    want = C.juxtapose(base, C.collate({"one": one, "two": two}), keys)
    assert sorted(map(tuple, got.select(*want.columns[:3], "blue", "product").collect()), key=str) == sorted(
        map(tuple, want.select(*want.columns[:3], "blue", "product").collect()), key=str
    )


@pytest.fixture(scope="module")
def bucketed(spark):
    """Each product as a table of its own, bucketed by tile and time."""
    made = {}
    for name in ("cover", "water", *cube.SENSORS):
        px, sc = cube.product(spark, SF, name)
        table = f"{name}_{uuid.uuid4().hex}"
        PX.write_bucketed(px, table, 4)
        made[name] = (table, D.Product(spark.table(table), sc))
    yield {n: p for n, (_, p) in made.items()}
    for table, _ in made.values():
        spark.sql(f"DROP TABLE {table}")


def drill_of(products, po):
    sensors = {n: products[n] for n in cube.SENSORS}
    return D.wetland_drill_products(products["cover"], sensors, products["water"], po, cube.GRID)


def plan_exchanges(df):
    """Tables below each shuffle of the plan, and the kind of node right below it."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.initialPlan())
        if node.nodeName() == "Exchange":
            out.append((node.child().nodeName(), node.child().toString()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_bucketed_products_align_without_a_shuffle(spark, bucketed):
    po = cube.polygons(spark, SF)
    drill = drill_of(bucketed, po)
    tables = [f"default.{n}_" for n in bucketed]
    below = [(kind, text) for kind, text in plan_exchanges(drill) if any(t in text for t in tables)]
    # Pixels move as sums per set and time, then those by set and by polygon; none before that.
    assert below and all(kind == "HashAggregate" or "HashAggregate(keys=[set_a" in text for kind, text in below)
    assert sum(kind == "HashAggregate" and "partial_sum" in text.split("\n")[0] and "set_a" in text.split("\n")[0] for kind, text in below) == 1
    plain = {n: D.Product(*cube.product(spark, SF, n)) for n in bucketed}
    want = sorted(map(tuple, drill_of(plain, po).collect()))
    got = sorted(map(tuple, drill.collect()))
    assert got == want and len(got) > 100


def test_each_product_is_read_once(spark, bucketed):
    text = drill_of(bucketed, cube.polygons(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    for name in bucketed:
        table = bucketed[name].pixels
        path = table.inputFiles()[0].rsplit("/", 2)[1]
        assert text.count(f"spark_catalog.default.{path}") <= 1


# --- resampling inside the drill ---------------------------------------------

def test_source_tiles_cover_what_targets_take(spark):
    """No pixel of a target tile comes from a source tile that is not listed."""
    px = cube.pixels(spark, SF).select("tile_id", "y", "x").distinct()
    moved = R.reproject_nearest(px, cube.LONLAT_GRID, cube.TARGET_GRID)
    moved = moved.withColumns({"_tx": cube.TARGET_GRID.block(F.col("tx")), "_ty": cube.TARGET_GRID.block(F.col("ty"))})
    pairs = moved.select("_tx", "_ty", "tile_id").distinct().collect()
    assert len({(r["_tx"], r["_ty"]) for r in pairs}) > 3
    for spot in {(r["_tx"], r["_ty"]) for r in pairs}:
        one = spark.createDataFrame([spot], "_tx bigint, _ty bigint")
        listed = {r["tile_id"] for r in R.source_tiles(one, cube.TARGET_GRID, cube.LONLAT_GRID).collect()}
        assert {r["tile_id"] for r in pairs if (r["_tx"], r["_ty"]) == spot} <= listed


def test_resampling_reads_only_the_tiles_below(spark, stored):  # noqa: F811
    po = cube.projected_polygons(spark, SF).filter("poly_id = 5")
    px = wide(spark, stored)
    n_files = len(px.inputFiles())
    drill = D.wetland_areas(px, cube.scenes(spark, SF), po, cube.TARGET_GRID, source=cube.LONLAT_GRID)
    files, _ = read_of_the_store(drill)
    assert 0 < files <= n_files * 3 // 4  # its tile and those beside it, of four in a row


def test_windows_through_a_projection_are_refused(spark):
    with pytest.raises(ValueError):
        D.wetland_areas(cube.pixels(spark, SF), cube.scenes(spark, SF), cube.projected_polygons(spark, SF),
                        cube.TARGET_GRID, aggregate=1, source=cube.LONLAT_GRID)


# --- tiles on a curve --------------------------------------------------------

CURVE = Grid(tile=8, tiles_across=1 << 12, curve=True)


def test_morton_numbers_keep_squares_together(spark):
    rows = spark.range(64).selectExpr("id div 8 AS ty", "id % 8 AS tx")
    got = {(r["tx"], r["ty"]): r["n"] for r in rows.select("tx", "ty", CURVE.tile_number(F.col("tx"), F.col("ty")).alias("n")).collect()}
    assert len(set(got.values())) == 64
    for size in (2, 4, 8):  # aligned squares are runs
        for x in range(0, 8, size):
            for y in range(0, 8, size):
                own = [got[i, j] for i in range(x, x + size) for j in range(y, y + size)]
                assert max(own) - min(own) == size * size - 1
    far = spark.createDataFrame([(-2000, -5), (2000, 5_000_000), (0, 0)], "tx bigint, ty bigint")
    assert far.select(CURVE.tile_number(F.col("tx"), F.col("ty"))).distinct().count() == 3


def test_intervals_hold_all_tiles_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(G, "TILE_LIST", 200)
    rnd = random.Random(7)
    spots = {(cx + rnd.randint(0, 15), cy + rnd.randint(0, 15)) for cx, cy in ((-900, 40), (700, -1200), (0, 0)) for _ in range(300)}
    tiles = spark.createDataFrame(sorted(spots), "tx bigint, ty bigint").select(CURVE.tile_number(F.col("tx"), F.col("ty")).alias("tile_id"))
    found = G.tile_intervals(tiles, 40)
    assert 3 <= len(found) <= 40
    wanted = {r["tile_id"] for r in tiles.collect()}
    assert all(any(a <= t <= b for a, b in found) for t in wanted)
    # Three squares of 256 tiles: the intervals hold them and not the land between.
    assert sum(b - a + 1 for a, b in found) <= 3 * 4 * 256


def test_scattered_tiles_read_their_files(spark, tmp_path, monkeypatch):
    """Two far-off groups of tiles beyond the list: files between them are not read."""
    monkeypatch.setattr(G, "TILE_LIST", 4)
    grid = Grid(tile=1, tiles_across=1 << 12, curve=True)
    every = spark.range(400).select((F.col("id") % 20 * 50).alias("x"), F.floor(F.col("id") / 20).cast("bigint").alias("y"))
    px = every.withColumn("tile_id", grid.tile_id(F.col("x"), F.col("y")))
    path = str(tmp_path / "pixels")
    px.write.partitionBy("tile_id").parquet(path)
    table = spark.read.schema("x bigint, y bigint, tile_id bigint").parquet(path)
    wanted = px.filter("x IN (0, 950)")
    files, rows = read_of_the_store(G.at_tiles(table, wanted.select("tile_id")))
    assert files == rows == 40


# --- planning ----------------------------------------------------------------

def jobs_while(spark, build):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "planning")
    build()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n


@pytest.fixture(scope="module")
def metadata(spark, tmp_path_factory):
    """Scenes, polygons and points as stored tables, so that jobs are the library's own."""
    out = []
    for name in ("scenes", "polygons", "points"):
        df, path = getattr(cube, name)(spark, SF), str(tmp_path_factory.mktemp("metadata") / name)
        df.write.parquet(path)
        out.append(spark.read.schema(df.schema).parquet(path))
    return out


@pytest.mark.parametrize("name", ["cover", "mangrove", "wetland", "daily", "points", "products"])
def test_a_frame_is_built_in_few_jobs(spark, stored, metadata, name):  # noqa: F811
    sc, po, pt = metadata
    px = wide(spark, stored)
    part = D.Product(px, sc)
    build = {
        "cover": lambda: D.cover_drill(px, sc, po, cube.GRID),
        "mangrove": lambda: D.mangrove_drill(px, sc, po, cube.GRID),
        "wetland": lambda: D.wetland_drill(px, sc, po, cube.GRID),
        "daily": lambda: D.wetland_drill(px, sc, po, cube.GRID, aggregate=1),
        "points": lambda: D.point_water_drill(px, sc, pt, cube.GRID),
        "products": lambda: D.wetland_drill_products(part, {n: part for n in cube.SENSORS}, part, po, cube.GRID),
    }[name]
    assert jobs_while(spark, build) <= 4


@pytest.mark.parametrize("aggregate", [1, 365, "table"])
def test_windows_read_pixels_once(spark, stored, aggregate):  # noqa: F811
    po = cube.polygons(spark, SF)
    if aggregate == "table":
        aggregate = po.select("poly_id").distinct().withColumn("aggregate", F.col("poly_id").cast("int") % 3)
    drill = D.wetland_areas(wide(spark, stored), cube.scenes(spark, SF), po, cube.GRID, aggregate=aggregate)
    plan = drill._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "swir2" in line for line in plan.splitlines()) == 1


def test_a_filter_of_many_tiles_names_the_tile_a_few_times(spark, monkeypatch):
    """A tile that is computed is computed once per mention: 256 intervals were more code than a method may hold."""
    monkeypatch.setattr(G, "TILE_LIST", 2000)
    tiles = spark.range(900).select((F.col("id") * 50).alias("tile_id"))
    held = G.tile_filter(tiles)
    assert str(held).count("tile_id") <= 2 * G.FILTER_INTERVALS + 1
    found = {r["tile_id"] for r in spark.range(-100, 46_000).withColumnRenamed("id", "tile_id").filter(held).collect()}
    assert {50 * i for i in range(900)} <= found and len(found) < 46_000 / 2


def test_tiles_without_a_gap_are_one_interval(spark, monkeypatch):
    monkeypatch.setattr(G, "TILE_LIST", 200)
    tiles = spark.range(-7, 1200).withColumnRenamed("id", "tile_id")
    assert G.tile_intervals(tiles) == [(-7, 1199)]
    assert str(G.tile_filter(tiles)).count("tile_id") == 2
