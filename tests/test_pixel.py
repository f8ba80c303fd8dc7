"""Hand-worked per-pixel values, scene filters and projection."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterdrill import schema as S
from rasterdrill.functions import pixel as P
from rasterdrill.functions.projection import Albers
from rasterdrill.grid import Grid
from rasterdrill.operators import reproject as R
from rasterdrill.sources import scenes as SC
from rasterdrill.sources.times import first_moment, inside_range, inside_request, last_moment, read_ranges


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value,observation,names",
    [
        (0, "dry", ["dry"]),
        (4, "not observable", ["sea", "dry"]),
        (128, "wet", ["water_observed", "wet"]),
        (132, "wet", ["sea", "water_observed", "wet"]),
        (1, "not observable", ["nodata"]),
        (64, "not observable", ["cloud"]),
        (128 + 16, "not observable", ["high_slope", "water_observed"]),
        (128 + 1, "not observable", ["nodata", "water_observed"]),
        (4 + 1, "wet", ["nodata", "sea"]),
    ],
)
def test_water_classes(spark, value, observation, names):
    assert one(spark, P.classify_water(F.lit(value))) == observation
    assert one(spark, P.decode_flags(F.lit(value))) == names


def test_all_water_values_against_bits(spark):
    """Every byte value, against the rules written with plain bit tests."""
    w = F.col("id").cast("int")
    got = spark.range(256).select(
        "id", P.water_value(w).alias("v"),
        P.pixel_quality_mask(F.lit(1), F.lit(1), w).alias("q"),
        P.flag_mask(w, S.CLEAR_DRY_LAND).alias("c"),
    ).collect()
    for r in got:
        i = r["id"]
        assert r["v"] == int(i & 128 != 0 and i & 64 == 0 and i & 32 == 0 and i & 2 == 0 and i & 1 == 0)
        assert r["q"] == (i & 128 == 0 and i & 64 == 0 and i & 32 == 0 and i & 2 == 0 and i & 1 == 0)
        assert r["c"] == (i == 0)


@pytest.mark.parametrize("fmask,contiguity,good", [(0, 1, False), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, True), (1, 0, False)])
def test_quality(spark, fmask, contiguity, good):
    assert one(spark, P.pixel_quality_mask(F.lit(fmask), F.lit(contiguity), F.lit(0))) == good


BANDS = {"blue": 600, "green": 700, "red": 800, "nir": 2000, "swir1": 1500, "swir2": 900}


def test_tasselled_cap(spark):
    for category, weights in S.TASSELLED_CAP.items():
        want = np.float32(sum(BANDS[b] * w for b, w in weights.items()))
        assert one(spark, P.tasselled_cap(category), **BANDS) == pytest.approx(float(want), rel=1e-6)
    assert [P.tasselled_cap_name(c) for c in S.TASSELLED_CAP] == ["TCB", "TCG", "TCW"]


@pytest.mark.parametrize("value", [-1, -999])
def test_tasselled_cap_missing_band(spark, value):
    assert one(spark, P.tasselled_cap(), **(BANDS | {"red": value})) == -9999.0


def test_tasselled_cap_zero_is_data(spark):
    assert one(spark, P.tasselled_cap(), **(BANDS | {"red": 0})) != -9999.0


def test_threshold_belongs_to_neither_side(spark):
    at = F.lit(-350.0).cast("float")
    assert one(spark, P.is_wet(at)) is False and one(spark, P.is_dry_ground(at)) is False


@pytest.mark.parametrize(
    "cover,top",
    [((50, 30, 20), "BS"), ((40, 40, 20), "BS"), ((20, 40, 40), "PV"), ((10, 20, 70), "NPV"), ((-1, -1, -1), "BS"), ((1, None, 2), None)],
)
def test_dominant_cover(spark, cover, top):
    assert one(spark, P.dominant_cover(*[F.lit(c) for c in cover])) == top


def test_nodata_round_trip(spark):
    held = P.nodata_to_null(F.lit(-9999.0), -9999)
    assert one(spark, held) is None
    assert one(spark, P.null_to_nodata(held, -9999)) == -9999.0
    assert one(spark, P.nodata_to_null(F.lit(-9998.0), -9999)) == -9998.0


@pytest.mark.parametrize(
    "product,ts,used",
    [
        ("ls8", "2013-01-01 00:00:00", True), ("ls8", "2012-12-31 23:59:59", False),
        ("ls7", "2003-05-31 00:00:00", True), ("ls7", "2003-05-31 00:00:01", False),
        ("ls7", "2010-01-01 00:00:00", True), ("ls7", "2013-05-31 00:00:00", True),
        ("ls7", "2013-05-31 00:00:01", False), ("ls5", "1999-12-31 00:00:00", True),
        ("ls5", "2000-06-01 00:00:00", False), ("ls5", "2003-01-01 00:00:00", True),
        ("ls5", "2011-12-31 00:00:00", True), ("ls5", "2011-12-31 00:00:01", False),
        ("ls9", "2020-01-01 00:00:00", False),
    ],
)
def test_sensor_calendar(spark, product, ts, used):
    assert one(spark, SC.sensor_in_epoch(F.lit(product), F.lit(ts).cast("timestamp_ntz"))) == used


def test_quality_range_keeps_its_ends(spark, rows):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.001), (4, -0.1), (5, None)], "scene_id int, gqa_iterative_mean_xy double")
    assert rows(SC.filter_scene_quality(df), "scene_id") == [(1,), (2,)]


def test_solar_day_is_local(spark):
    """Just before UTC midnight at 150 E it is already next morning."""
    ts = F.lit("1994-12-31 23:59:48").cast("timestamp_ntz")
    assert str(one(spark, SC.solar_day(ts, F.lit(150.0)))) == "1995-01-01"
    assert str(one(spark, SC.solar_day(ts, F.lit(-150.0)))) == "1994-12-31"


@pytest.mark.parametrize(
    "text,first,last",
    [
        ("2000", "2000-01-01 00:00:00", "2000-12-31 23:59:59.999999"),
        ("2000-02", "2000-02-01 00:00:00", "2000-02-29 23:59:59.999999"),
        ("2019-07-10", "2019-07-10 00:00:00", "2019-07-10 23:59:59.999999"),
        ("2019-07-10T01:02:03", "2019-07-10 01:02:03", "2019-07-10 01:02:03"),
        ("soon", "None", "None"),
    ],
)
def test_partial_dates(spark, text, first, last):
    assert str(one(spark, first_moment(F.lit(text)))) == first
    assert str(one(spark, last_moment(F.lit(text)))) == last


def test_range_without_an_end_takes_all(spark):
    ts = F.lit("1990-01-01").cast("timestamp_ntz")
    assert one(spark, inside_request(ts, F.lit("2000"), F.lit(None).cast("string"))) is True
    assert one(spark, inside_request(ts, F.lit("2000"), F.lit("2001"))) is False


def test_ranges_read_once_hold_the_same_times(spark):
    """Years, months, days, instants, offsets, blanks, missing ends and ends that cannot be read, in every pair."""
    ends = [None, "", "soon", "2000", " 2000 ", "2001-02", "2000-02-29", "2001-02-30", "2001-02-03T04:05:06.5", "2001-02-03T04:05:06+10:00"]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in ends for b in ends)]
    moments = ["1999-12-31 23:59:59.999999", "2000-01-01", "2000-02-29 23:59:59.999999", "2000-12-31 23:59:59.999999", "2001-02-02 18:05:06",
               "2001-02-02 18:05:07", "2001-02-03 04:05:06.5", "2001-02-28 23:59:59.999999", "2001-03-01", None]
    ranges = spark.createDataFrame(pairs, "id int, start string, end string")
    ts = spark.createDataFrame([(t,) for t in moments], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    held = [
        {(r["id"], r["ts"]) for r in ts.crossJoin(of).filter(inside(F.col("ts"), F.col("start"), F.col("end"))).collect()}
        for of, inside in ((ranges, inside_request), (read_ranges(ranges, "id"), inside_range))
    ]
    assert held[0] == held[1] and 200 < len(held[0]) < len(pairs) * len(moments)


def test_albers_round_trip_and_known_corner(spark):
    """Out and back, and the projection's own centre line."""
    al = Albers()
    df = spark.range(400).select(
        (F.lit(112.0) + F.col("id") % 20 * 2.1).alias("lon"),
        (F.lit(-44.0) + F.floor(F.col("id") / 20) * 1.7).alias("lat"),
    )
    out = R.project_points(df)
    lon, lat = al.inverse(F.col("east"), F.col("north"))
    worst = out.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-11
    east, north = al.forward(F.lit(132.0), F.lit(0.0))
    assert one(spark, east) == pytest.approx(0, abs=1e-6)
    assert one(spark, north) == pytest.approx(0, abs=1e-6)
    # Equal area: a small cell keeps its area on the ellipsoid.
    e, d = math.radians(0.001), 0.001
    corners = spark.createDataFrame([(140.0, -30.0), (140.0 + d, -30.0), (140.0, -30.0 + d)], "lon double, lat double")
    p = [(r["east"], r["north"]) for r in R.project_points(corners).collect()]
    area = abs((p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[2][0] - p[0][0]) * (p[1][1] - p[0][1]))
    s = math.sin(math.radians(-30 + d / 2))
    radius2 = al.semi_major**2 * (1 - al.e2) / (1 - al.e2 * s * s) ** 2
    assert area == pytest.approx(radius2 * math.cos(math.radians(-30 + d / 2)) * e * e, rel=1e-5)


@pytest.mark.parametrize("res", [0.0003, 0.002, 0.00011])
def test_reprojection_fills_each_target_once(spark, res):
    """Finer and coarser sources: inside the area no target pixel is missed or doubled."""
    source = Grid(origin_x=148.5, origin_y=-35.0, res_x=res, res_y=-res)
    px = spark.range(40 * 40).select((F.col("id") % 40).alias("x"), F.expr("id div 40").alias("y"))
    moved = R.reproject_nearest(px, source).persist()
    n, distinct = moved.count(), moved.select("tx", "ty").distinct().count()
    assert n == distinct > 0
    # In a row of targets, columns are consecutive: nothing is missed between.
    gaps = moved.groupBy("ty").agg((F.max("tx") - F.min("tx") + 1 - F.count("tx")).alias("g")).agg(F.max("g")).first()[0]
    assert gaps == 0
    moved.unpersist()
