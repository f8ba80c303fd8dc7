"""Request texts: features, times, parameters."""

import json

import pytest

from rasterdrill.sources import requests as RQ

POINT = {"geometry": {"type": "Point", "coordinates": [141.25, -20.5]}, "crs": {"properties": {"name": "EPSG:4326"}}}
RING = [[150.0, -30.0], [150.75, -30.0], [150.5, -30.625], [150.0, -30.0]]
HOLE = [[150.25, -30.125], [150.5, -30.125], [150.375, -30.25], [150.25, -30.125]]


def polygon(kind, coordinates):
    return {"features": [{"geometry": {"type": kind, "coordinates": coordinates}}]}


def frame(spark, *payloads):
    texts = [p if isinstance(p, str) or p is None else json.dumps(p) for p in payloads]
    return spark.createDataFrame(list(enumerate(texts)), "request_id int, payload string")


@pytest.mark.parametrize(
    "payload,status",
    [
        ({"features": [POINT]}, "ok"),
        ({"features": []}, "no features specified"),
        ({"features": [POINT, POINT]}, "multiple features specified"),
        ({}, "invalid request"),
        ("not json", "invalid request"),
        (json.dumps({"features": [POINT]}) + "\n" + json.dumps({"features": []}), "ok"),
    ],
)
def test_status(spark, payload, status):
    r = RQ.read_features(frame(spark, payload)).first()
    assert r["status"] == status
    assert (r["geom_type"] == "Point") == (status == "ok")


@pytest.mark.parametrize(
    "geometry,status",
    [
        ({"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, RQ.OTHER_GEOMETRY),
        ({"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, RQ.OTHER_GEOMETRY),
        ({"type": "GeometryCollection", "geometries": []}, RQ.OTHER_GEOMETRY),
        ({"type": "Polygon", "coordinates": "x"}, RQ.BAD_GEOMETRY),
        ({"type": "Polygon", "coordinates": [[[1, 2], [3]]]}, RQ.BAD_GEOMETRY),
        ({"type": "Polygon", "coordinates": [[[1, 2], ["a", 4]]]}, RQ.BAD_GEOMETRY),
        ({"type": "Point", "coordinates": [1]}, RQ.BAD_GEOMETRY),
        ({"type": "Point", "coordinates": {"x": 1}}, RQ.BAD_GEOMETRY),
        ({"type": "Polygon", "coordinates": []}, RQ.EMPTY_GEOMETRY),
        ({"type": "Polygon", "coordinates": [[]]}, RQ.EMPTY_GEOMETRY),
        ({"type": "Point", "coordinates": None}, RQ.EMPTY_GEOMETRY),
        (None, RQ.EMPTY_GEOMETRY),
        ({"type": "Point", "coordinates": [1, 2, 3]}, "ok"),
        ({"type": "MultiPolygon", "coordinates": [[RING], [HOLE]]}, "ok"),
    ],
)
def test_no_geometry_vanishes(spark, geometry, status):
    """A request with status 'ok' has vertices, and any other has none."""
    df = frame(spark, {"features": [{"geometry": geometry}]})
    got = RQ.parse_feature_requests(df, "request_id").collect()
    assert {r["status"] for r in got} == {status}
    assert all((r["vx"] is not None) == (status == "ok") for r in got)


def test_a_drill_says_which_kind_it_takes(spark):
    df = frame(spark, {"features": [POINT]}, polygon("Polygon", [RING]))
    for kind, want in (("point", ["ok", RQ.OTHER_GEOMETRY]), ("polygon", [RQ.OTHER_GEOMETRY, "ok"])):
        got = RQ.read_features(df, kind=kind).orderBy("request_id").collect()
        assert [r["status"] for r in got] == want


def test_open_rings_are_closed(spark):
    df = frame(spark, polygon("Polygon", [RING[:-1], HOLE]))
    got = RQ.polygon_vertices(RQ.read_features(df), "request_id").orderBy("ring", "seq").collect()
    assert [(r["vx"], r["vy"]) for r in got] == [tuple(p) for p in [*RING, *HOLE]]


@pytest.mark.parametrize("zone", ["UTC", "Australia/Sydney"])
def test_offsets_are_applied_in_any_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2021-02-01T00:00:00+10:00", "2021-02-01T00:00:00Z", "2021-02-01T05:00:00.25-0330", "2021-02-01T07:08:09", "2021-02-01", "T+10:00"]
        df = spark.createDataFrame([(i, stamp(t), stamp("2030-01-01")) for i, t in enumerate(texts)], "request_id int, start string, `end` string")
        got = [str(r["start"]) for r in RQ.parse_time_requests(df).orderBy("request_id").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2021-01-31 14:00:00", "2021-02-01 00:00:00", "2021-02-01 08:30:00.250000", "2021-02-01 07:08:09", "2021-02-01 00:00:00", "None"]


def test_stated_crs_is_ignored_unless_asked_for(spark):
    df = frame(spark, {"features": [POINT]})
    assert RQ.read_features(df).first()["crs"] == RQ.DEFAULT_CRS
    assert RQ.read_features(df, honor_crs=True).first()["crs"] == "EPSG:4326"


def test_points_ignore_height(spark):
    at = {"features": [{"geometry": {"type": "Point", "coordinates": [133.5, -25.0625, 31]}}]}
    r = RQ.point_locations(RQ.read_features(frame(spark, at)), "request_id").first()
    assert (r["lon"], r["lat"]) == (133.5, -25.0625)


def test_polygons_and_multipolygons_become_vertices(spark):
    df = frame(spark, polygon("Polygon", [RING, HOLE]), polygon("MultiPolygon", [[RING], [HOLE]]), {})
    got = RQ.polygon_vertices(RQ.read_features(df), "request_id").orderBy("poly_id", "ring", "seq").collect()
    want = [
        (k, r, i, x, y)
        for k in (0, 1) for r, pts in enumerate([RING, HOLE]) for i, (x, y) in enumerate(pts)
    ]
    assert [tuple(r) for r in got] == want


def test_one_bad_request_leaves_the_others(spark):
    got = RQ.parse_feature_requests(frame(spark, "?", {"features": [POINT]}), "request_id").collect()
    assert [(r["request_id"], r["status"], r["vx"]) for r in sorted(got)] == [
        (0, "invalid request", None), (1, "ok", 141.25),
    ]


def stamp(text):
    return json.dumps({"properties": {"timestamp": {"date-time": text}}}, indent=1)


@pytest.mark.parametrize(
    "start,end,got,status",
    [
        (stamp("2021-02-01"), stamp("2021-03-01T10:00:00"), ("2021-02-01 00:00:00", "2021-03-01 10:00:00"), "ok"),
        (stamp("2021-02-01"), None, ("None", "None"), "ok"),
        (None, stamp("2021-02-01"), ("None", "None"), "ok"),
        (None, None, ("None", "None"), "ok"),
        (stamp("soon"), stamp("2021-02-01"), ("None", "None"), RQ.BAD_TIME),
        (stamp("soon"), None, ("None", "None"), RQ.BAD_TIME),
        ("{}", stamp("2021-02-01"), ("None", "None"), RQ.BAD_TIME),
    ],
)
def test_times(spark, start, end, got, status):
    """Only an absent end means all times; one that cannot be read is an error."""
    df = spark.createDataFrame([(start, end)], "start string, end string")
    parsed = RQ.parse_time_requests(df)
    r = parsed.first()
    assert (str(r["start"]), str(r["end"])) == got and r["status"] == status
    assert RQ.usable(parsed).count() == (status == "ok")


@pytest.mark.parametrize(
    "text,days",
    [(None, 0), ("{}", 0), ('{"aggregate": 16}', 16), ('{"aggregate": "7"}\n{"aggregate": 1}', 7),
     ('{"aggregate": "x"}', None), ('{"aggregate": -1}', None), ('{"aggregate": 1.5}', None), ("{broken", None), ("[1]", None)],
)
def test_parameters(spark, text, days):
    df = spark.createDataFrame([(text,)], "parameters string")
    r = RQ.parse_parameters(df).first()
    assert (r["aggregate"], r["status"]) == (days, "ok" if days is not None else RQ.BAD_PARAMETERS)


def test_requests_go_to_the_metric_grid(spark):
    """In the system they state, if that is asked for; west and east of the meridian."""
    def at(crs, x, y):
        return {"features": [{"geometry": {"type": "Point", "coordinates": [x, y]}, "crs": {"properties": {"name": crs}}}]}

    df = frame(spark, at("EPSG:4326", 132.0, 0.0), at("EPSG:3577", -1500000.0, -3500000.0), at("EPSG:1", 1, 2),
               at("EPSG:4326", 116.0, -32.0), at("EPSG:4326", 149.0, -35.0))
    read = RQ.read_features(df, honor_crs=True)
    assert [r["status"] for r in read.orderBy("request_id").collect()] == ["ok", "ok", RQ.BAD_CRS, "ok", "ok"]
    got = {r["point_id"]: (r["lon"], r["lat"]) for r in RQ.point_locations(RQ.usable(read), "request_id", metric=True).collect()}
    assert abs(got[0][0]) < 1e-6 and abs(got[0][1]) < 1e-3
    assert got[1] == (-1500000.0, -3500000.0) and got[3][0] < -1.4e6 and got[4][0] > 1.4e6
