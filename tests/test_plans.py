"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from rasterdrill import schema as S
from rasterdrill import tuning
from rasterdrill.operators import geometry as G
from rasterdrill.plans import cube
from rasterdrill.plans import drills as D
from rasterdrill.plans.queries import QUERIES
from rasterdrill.sources import pixels as PX

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"write_drill_parquet"}))
def test_no_python_rows_and_no_cross_join(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["fc_drill", "wit_drill", "mangrove_drill", "wofs_pixel_drill"])
def test_pixel_aggregates_hash(spark, name):
    """No aggregate of pixels needs sorted input: all buffers are fixed-width.

    Only the one segment that stands for each set of polygons is found by a sort.
    """
    lines = physical(QUERIES[name](spark, SF)).splitlines()
    assert all("set_a" in line and "struct" in line for line in lines if "SortAggregate" in line)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "pixels")
    PX.write_pixels(cube.pixels(spark, SF), path, files_per_tile=2)
    return path


def bands():
    return (*S.COVER_PRODUCT, *S.WATER_PRODUCT, *S.SURFACE_PRODUCT, *S.CANOPY_PRODUCT)


def wide(spark, path):
    names = ["water", "fmask", "nbart_contiguity", *S.REFLECTANCE_BANDS, *S.COVER_BANDS, "canopy_cover_class"]
    fields = ", ".join(f"{b} int" for b in names)
    return spark.read.schema(
        f"scene_id bigint, ts timestamp_ntz, y int, x int, {fields}, tile_id bigint"
    ).parquet(path)


def test_scan_reads_only_what_is_asked(spark, stored):
    plan = PX.scan_pixels(wide(spark, stored), ["bs"], time=("2000", "2001-06"))
    text = plan._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    read = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "bs" in read and "pv" not in read and "nir" not in read
    assert "GreaterThanOrEqual(ts,2000-01-01T00:00)" in text
    assert "LessThanOrEqual(ts,2001-06-30T23:59:59.999999)" in text


def test_stored_table_answers_like_the_frame(spark, stored, rows):
    sc, po = cube.scenes(spark, SF), cube.polygons(spark, SF)
    for drill in (D.cover_counts, D.mangrove_drill, D.wetland_areas):
        want = rows(drill(cube.pixels(spark, SF), sc, po, cube.GRID).na.fill(-5))
        assert rows(drill(wide(spark, stored), sc, po, cube.GRID).na.fill(-5)) == want


def read_of_the_store(df):
    """Files and rows that the executed plan read from the stored pixels."""
    df.collect()
    files, rows, todo = 0, 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("Scan parquet") and "/pixels" in node.toString():
            files += node.metrics().apply("numFiles").value()
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return files, rows


DRILLS = {
    "cover": lambda px, sc, po: D.cover_drill(px, sc, po, cube.GRID),
    "mangrove": lambda px, sc, po: D.mangrove_drill(px, sc, po, cube.GRID),
    "wetland": lambda px, sc, po: D.wetland_areas(px, sc, po, cube.GRID),
    "water": lambda px, sc, po: D.point_water_drill(
        px, sc, po.filter("seq = 0 AND ring = 0").selectExpr("poly_id AS point_id", "vx AS lon", "vy AS lat"), cube.GRID
    ),
}


@pytest.mark.parametrize("limit", [None, -1])
@pytest.mark.parametrize("name", DRILLS)
def test_tiles_without_a_request_are_not_read(spark, stored, monkeypatch, name, limit):
    """However the mask is joined, and where the polygons are a kept table."""
    if limit is not None:
        monkeypatch.setattr(tuning, "BROADCAST_ROWS", limit)
    po = cube.polygons(spark, SF).filter("poly_id = 1").persist()
    px = wide(spark, stored)
    n_tiles, n_files = px.select("tile_id").distinct().count(), len(px.inputFiles())
    files, _ = read_of_the_store(DRILLS[name](px, cube.scenes(spark, SF), po))
    po.unpersist()
    assert n_tiles == 4 and 0 < files <= n_files // n_tiles


def test_a_limit_on_listed_tiles_changes_no_answer(spark, stored, monkeypatch, rows):
    po = cube.polygons(spark, SF).filter("poly_id IN (1, 2)")
    drill = lambda: rows(D.mangrove_drill(wide(spark, stored), cube.scenes(spark, SF), po, cube.GRID))
    want = drill()
    monkeypatch.setattr(G, "TILE_LIST", 0)
    assert drill() == want


def exchanges(df):
    """Of every shuffle in the plan: its keys, the node below, and whether pixels pass it."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        if node.nodeName() == "Exchange":
            below = node.child()
            keys = re.search(r"hashpartitioning\((.*?), \d+\)", node.outputPartitioning().toString())
            keys = re.sub(r"#\d+L?", "", keys.group(1)).split(", ") if keys else []
            out.append((keys, below.nodeName(), "/pixels" in below.toString()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


@pytest.mark.parametrize("name", ["cover", "mangrove", "wetland", "windows"])
def test_pixels_never_move_by_scene_or_polygon_alone(spark, stored, monkeypatch, name):
    """With nothing broadcast, a shuffle of pixels holds the tile; sums go by polygon and time."""
    monkeypatch.setattr(tuning, "BROADCAST_ROWS", -1)
    drill = DRILLS.get(name, lambda *a: D.wetland_areas(*a, cube.GRID, aggregate=1))
    found = exchanges(drill(wide(spark, stored), cube.scenes(spark, SF), cube.polygons(spark, SF)))
    sums = ["set_a", "set_b"]  # sums per set of polygons and time, on their way to the polygons
    moved = [keys for keys, below, pixels in found if pixels and below != "HashAggregate" and keys != sums]
    assert moved and all("tile_id" in keys or "_tile_id" in keys for keys in moved)


def test_aligned_products_are_joined_without_another_shuffle(spark, stored):
    px, sc, po = wide(spark, stored), cube.scenes(spark, SF), cube.polygons(spark, SF)
    water = px.select("scene_id", "ts", "tile_id", "y", "x", "water")
    drill = D.cover_drill_products((px.drop("water"), sc), (water, sc), po, cube.GRID)
    moved = [keys for keys, below, pixels in exchanges(drill) if pixels and "y" in keys and "x" in keys]
    assert len(moved) == 2  # one per product, for its own merge


def test_extent_bounds_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    po = cube.polygons(spark, SF).filter("poly_id = 1")
    pruned = G.prune_bbox(wide(spark, stored).select("tile_id", "y", "x", "bs"), po, cube.GRID)
    scan = next(s for s in physical(pruned).splitlines() if "FileScan" in s and "/pixels" in s)
    filters = re.search(r"DataFilters: \[(.*?)\], Format", scan).group(1)
    assert re.search(r"x#\d+ >= .*ubquery", filters) and re.search(r"y#\d+ <= .*ubquery", filters)
    xs = pruned.agg(F.min("x"), F.max("x"), F.max("y")).first()
    assert tuple(xs) == (8 + cube.WEST, 15 + cube.WEST, 7 + cube.NORTH)


def test_declared_schema(spark, tmp_path):
    path = str(tmp_path / "cover")
    px = cube.pixels(spark, SF).select("scene_id", "ts", "tile_id", "y", "x", *[F.col(b).cast("smallint") for b in S.COVER_BANDS])
    px.filter("scene_id < 9").write.parquet(path)
    back = PX.read_pixels(spark, path, S.COVER_PRODUCT, time="1995")
    assert back.columns == ["scene_id", "ts", "tile_id", "y", "x", *S.COVER_BANDS]
    assert back.schema["bs"].dataType.simpleString() == "smallint" and back.count() > 0
    assert sum(b.itemsize for b in bands()) == 6 + 2 + 14 + 1
