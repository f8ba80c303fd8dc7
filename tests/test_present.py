"""CSV, JSON, chart rows and files."""

import json
from datetime import datetime

import pytest

from rasterdrill import schema as S
from rasterdrill.operators import present as V

COVER = "poly_id int, time timestamp_ntz, BS double, PV double, NPV double, Unobservable double"


@pytest.fixture
def cover(spark):
    return spark.createDataFrame(
        [
            (1, datetime(2014, 6, 1, 0, 0, 9), 12.5, 25.0, 50.0, 12.5),
            (1, datetime(2014, 5, 1, 0, 0, 9), None, None, None, None),
            (2, datetime(2014, 5, 1, 0, 0, 9), 100.0, 0.0, 0.0, 0.0),
        ],
        COVER,
    )


def test_csv(cover):
    got = {r["poly_id"]: r["data"] for r in V.drill_to_csv(cover, S.COVER_SERIES).collect()}
    head = "time,Bare Soil,Photosynthetic Vegetation,Non-Photosynthetic Vegetation,Unobservable\n"
    assert got == {
        1: head + "2014-05-01,,,,\n2014-06-01,12.5,25.0,50.0,12.5\n",
        2: head + "2014-05-01,100.0,0.0,0.0,0.0\n",
    }


def test_point_csv_leaves_out_the_place(spark):
    df = spark.createDataFrame(
        [(1, datetime(2014, 5, 1), 3.4, 1.7, "wet")],
        "point_id int, time timestamp_ntz, longitude double, latitude double, observation string",
    )
    assert V.drill_to_csv(df, S.WATER_SERIES, "point_id").first()["data"] == "time,Observation\n2014-05-01,wet\n"


@pytest.mark.parametrize("process,name,enabled", [("water", "WOfS", False), ("cover", "FC", True), ("mangrove", "Mangrove Cover", True)])
def test_catalogue_entry(spark, process, name, enabled):
    csv = spark.createDataFrame([(1, 'time,"a"\n2014-05-01,é\n')], "poly_id int, data string")
    entry = json.loads(V.drill_catalog_json(csv, process).first()["json"])
    assert entry == {
        "data": 'time,"a"\n2014-05-01,é\n', "isEnabled": enabled, "type": "csv", "name": name,
        "tableStyle": {"columns": S.STYLES[process]},
    }


def test_melt_and_stack(cover, rows):
    melted = V.melt_cover(cover, list(S.COVER_SERIES))
    assert melted.columns == ["poly_id", "time", "Cover Type", "Area"]
    assert melted.count() == 8  # the time without values is left out
    stack = V.normalized_stack(cover, list(S.COVER_SERIES))
    assert rows(stack.filter("poly_id = 1"), "Cover Type", "share") == [
        ("BS", 0.125), ("NPV", 0.5), ("PV", 0.25), ("Unobservable", 0.125),
    ]


def test_styles(spark, cover, rows):
    styled = V.style_join(V.melt_cover(cover, list(S.COVER_SERIES)), V.style_table(spark, "cover", S.COVER_SERIES))
    assert rows(styled.filter("poly_id = 2"), "ord", "label", "color", "units", "active") == [
        (0, "Bare Soil", "#8B0000", "%", True),
        (1, "Photosynthetic Vegetation", "green", "%", True),
        (2, "Non-Photosynthetic Vegetation", "#dac586", "%", True),
        (3, "Unobservable", "grey", "%", False),
    ]


def test_ticks(spark):
    df = spark.createDataFrame(
        [(1, datetime(2014, 5, 1), 133.50000149, -25.0625, "dry")],
        "point_id int, time timestamp_ntz, longitude double, latitude double, observation string",
    )
    r = V.wofs_tick_series(df).first()
    assert (r["color"], r["title"]) == ("red", "Water Observations for -25.062500,133.500001")


def test_parquet_run_can_be_repeated(spark, cover, tmp_path):
    base = str(tmp_path)
    V.write_drill_parquet(cover, base, "wetland", "a")
    path = V.write_drill_parquet(cover, base, "wetland", "a")
    V.write_drill_parquet(cover.limit(1), base, "wetland", "b")
    assert list((tmp_path / "identifier=wetland" / "run_id=a").glob("*.snappy.parquet"))
    assert path.endswith("identifier=wetland/run_id=a")
    back = V.read_drill_parquet(spark, base)
    assert back.filter("run_id = 'a'").drop("identifier", "run_id").exceptAll(cover).count() == 0
    assert {r["run_id"]: r["count"] for r in back.groupBy("run_id").count().collect()} == {"a": 3, "b": 1}


def test_bulk_csv(spark, cover, tmp_path):
    V.write_drill_csv(cover, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "2,2014-05-01,100.0,0.0,0.0,0.0" in text
