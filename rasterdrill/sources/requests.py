"""Drill requests as text: GeoJSON features, time ranges and parameters.

A request table may hold any number of requests. A request that cannot be used
gets a ``status`` other than 'ok' and no geometry; it does not stop the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterdrill.functions.projection import Albers
from rasterdrill.sources.times import instant

# What a request without exactly one feature is told.
NO_FEATURES = "no features specified"
MANY_FEATURES = "multiple features specified"
# What a request is told whose time or parameters cannot be read; it is not drilled.
BAD_TIME = "invalid time"
BAD_PARAMETERS = "invalid parameters"
BAD_CRS = "unknown reference system"
# What a request is told whose geometry cannot be drilled.
EMPTY_GEOMETRY = "empty geometry"
BAD_GEOMETRY = "invalid geometry"
OTHER_GEOMETRY = "unsupported geometry"
# Kinds of geometry that drills of polygons and of points take.
KINDS = {"polygon": ("Polygon", "MultiPolygon"), "point": ("Point",)}
# The reference system of a feature that states none.
DEFAULT_CRS = "urn:ogc:def:crs:OGC:1.3:CRS84"

# Names of longitude/latitude and of the metric system.
LONLAT_CRS = (DEFAULT_CRS, "EPSG:4326", "urn:ogc:def:crs:EPSG::4326")
METRIC_CRS = ("EPSG:3577", "urn:ogc:def:crs:EPSG::3577")

_CRS = "crs STRUCT<properties: STRUCT<name: STRING>>"
_FEATURES = (
    f"features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, {_CRS}>>, {_CRS}"
)
_RINGS = "array<array<array<double>>>"


def first_line(payload: Column) -> Column:
    """Only the first line of a payload is read."""
    return F.substring_index(payload, "\n", 1)


def _geometry_status(kind: Column, coordinates: Column, kinds: tuple[str, ...]) -> Column:
    """Why a geometry cannot be drilled, or 'ok': every 'ok' has a vertex, and each vertex two numbers."""
    points = F.coalesce(F.flatten(_rings(kind, coordinates)), _point(kind, coordinates))
    bare = F.regexp_replace(coordinates, r"[\[\]\s,]", "") == ""
    short = F.exists(points, lambda p: p.isNull() | (F.size(p) < 2) | F.try_element_at(p, F.lit(1)).isNull() | F.try_element_at(p, F.lit(2)).isNull())
    return (
        F.when(kind.isNull(), F.lit(EMPTY_GEOMETRY))
        .when(~kind.isin(*kinds), F.lit(OTHER_GEOMETRY))
        .when(coordinates.isNull() | bare, F.lit(EMPTY_GEOMETRY))
        .when(points.isNull() | (F.size(points) < 1) | F.coalesce(short, F.lit(True)), F.lit(BAD_GEOMETRY))
        .otherwise(F.lit("ok"))
    )


def read_features(
    requests: DataFrame, payload: str = "payload", honor_crs: bool = False, kind: str | None = None
) -> DataFrame:
    """Add ``status``, ``geom_type``, ``coordinates`` (JSON text) and ``crs``.

    A stated reference system is ignored unless ``honor_crs``; then one that
    :func:`on_metric_grid` does not know gives a status. So does a geometry without
    vertices, one that cannot be read, and one of a kind that the drill does not take:
    ``kind`` is 'polygon' or 'point', by default either. A request with status 'ok' has a
    vertex, so none vanishes.
    """
    parsed = F.from_json(first_line(F.col(payload)), _FEATURES)
    feature = F.try_element_at(F.col("_doc.features"), F.lit(1))
    n = F.size(F.col("_doc.features"))
    status = (
        F.when(F.col("_doc.features").isNull(), F.lit("invalid request"))
        .when(n < 1, F.lit(NO_FEATURES))
        .when(n > 1, F.lit(MANY_FEATURES))
        .otherwise(F.lit("ok"))
    )
    stated = F.coalesce(F.col("_doc.crs.properties.name"), feature["crs"]["properties"]["name"])
    crs = F.coalesce(stated, F.lit(DEFAULT_CRS)) if honor_crs else F.lit(DEFAULT_CRS)
    good = F.col("status") == "ok"
    kinds = KINDS[kind] if kind else tuple(k for ks in KINDS.values() for k in ks)
    geometry = _geometry_status(feature["geometry"]["type"], feature["geometry"]["coordinates"], kinds)
    return (
        requests.withColumn("_doc", parsed)
        .withColumn("status", status)
        .withColumn("status", F.when(good, geometry).otherwise(F.col("status")))
        .withColumn("crs", crs)
        .withColumn(
            "status",
            F.when((F.col("status") == "ok") & ~F.col("crs").isin(*LONLAT_CRS, *METRIC_CRS), F.lit(BAD_CRS))
            .otherwise(F.col("status")),
        )
        .withColumns(
            {
                "geom_type": F.when(good, feature["geometry"]["type"]),
                "coordinates": F.when(good, feature["geometry"]["coordinates"]),
                "crs": F.when(good, F.col("crs")),
            }
        )
        .drop("_doc")
    )


def _closed(ring: Column) -> Column:
    """A ring that ends where it starts; the last corner may be left out of a request."""
    first = F.slice(ring, 1, 1)
    return F.when((F.size(ring) > 0) & (first != F.slice(ring, -1, 1)), F.concat(ring, first)).otherwise(ring)


def _rings(kind: Column | None = None, text: Column | None = None) -> Column:
    """Rings of a polygon or multipolygon; even-odd filling needs no nesting."""
    kind, text = (F.col("geom_type"), F.col("coordinates")) if kind is None else (kind, text)
    rings = F.when(kind == "Polygon", F.from_json(text, _RINGS)).when(
        kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{_RINGS}>"))
    )
    return F.transform(rings, _closed)


def _point(kind: Column, text: Column) -> Column:
    return F.when(kind == "Point", F.array(F.from_json(text, "array<double>")))


def on_metric_grid(df: DataFrame, x: str, y: str, crs: str = "crs", albers: Albers = Albers()) -> DataFrame:
    """Coordinates ``x, y`` in metres of the metric system, from the system each row states.

    For :func:`polygon_vertices` and :func:`point_locations` before they meet a grid in
    metres. Longitude comes first, as in GeoJSON.
    """
    east, north = albers.forward(F.col(x), F.col(y))
    metric = F.col(crs).isin(*METRIC_CRS)
    return df.withColumns({x: F.when(metric, F.col(x)).otherwise(east), y: F.when(metric, F.col(y)).otherwise(north)})


def polygon_vertices(features: DataFrame, key: str, metric: bool = False) -> DataFrame:
    """Vertex rows ``(poly_id, ring, seq, vx, vy)`` of polygon requests.

    In request coordinates, as the hull is reported; in metres if ``metric``, as drills
    on a metric grid need them.
    """
    rows = (
        features.filter(F.col("geom_type").isin("Polygon", "MultiPolygon"))
        .select(F.col(key).alias("poly_id"), "crs", F.posexplode(_rings()).alias("ring", "_pts"))
        .select("poly_id", "crs", "ring", F.posexplode("_pts").alias("seq", "_p"))
        .select("poly_id", "crs", "ring", "seq", F.col("_p")[0].alias("vx"), F.col("_p")[1].alias("vy"))
    )
    return (on_metric_grid(rows, "vx", "vy") if metric else rows).drop("crs")


def point_locations(features: DataFrame, key: str, metric: bool = False) -> DataFrame:
    """``(point_id, lon, lat)`` of point requests; a height is ignored. In metres if ``metric``."""
    at = F.from_json("coordinates", "array<double>")
    rows = (
        features.filter(F.col("geom_type") == "Point")
        .select(F.col(key).alias("point_id"), "crs", at.alias("_p"))
        .select("point_id", "crs", F.col("_p")[0].alias("lon"), F.col("_p")[1].alias("lat"))
    )
    return (on_metric_grid(rows, "lon", "lat") if metric else rows).drop("crs")


def parse_feature_requests(requests: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """One row per vertex, or one row without a vertex for a request in error.

    ``(key, status, geom_type, ring, seq, vx, vy)``; a point is ring 0, vertex 0.
    """
    point = F.when(
        F.col("geom_type") == "Point", F.array(F.array(F.from_json("coordinates", "array<double>")))
    )
    return (
        read_features(requests, payload)
        .select(
            key, "status", "geom_type",
            F.posexplode_outer(F.coalesce(_rings(), point)).alias("ring", "_pts"),
        )
        .select(key, "status", "geom_type", "ring", F.posexplode_outer("_pts").alias("seq", "_p"))
        .select(
            key, "status", "geom_type", "ring", "seq",
            F.col("_p")[0].alias("vx"), F.col("_p")[1].alias("vy"),
        )
    )


def parse_time_requests(requests: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Replace the two payloads by timestamps and add ``status``.

    An offset is applied, so times are UTC. A range missing an end has neither, which means all times. An end that is stated
    but cannot be read is no range: the status is not 'ok'.
    """
    path = "$.properties.timestamp.date-time"
    path_quoted = "$.properties.timestamp['date-time']"

    def moment(c: str) -> Column:
        text = F.coalesce(F.get_json_object(c, path), F.get_json_object(c, path_quoted))
        return instant(text)

    both = F.col("_start").isNotNull() & F.col("_end").isNotNull()
    bad = (F.col(start).isNotNull() & F.col("_start").isNull()) | (F.col(end).isNotNull() & F.col("_end").isNull())
    return (
        requests.withColumns({"_start": moment(start), "_end": moment(end)})
        .withColumn("status", F.when(bad, F.lit(BAD_TIME)).otherwise(F.lit("ok")))
        .withColumns({start: F.when(both, F.col("_start")), end: F.when(both, F.col("_end"))})
        .drop("_start", "_end")
    )


def usable(requests: DataFrame) -> DataFrame:
    """Requests that may be drilled: every ``*status`` column is 'ok'."""
    out = requests
    for c in [c for c in requests.columns if c.endswith("status")]:
        out = out.filter(F.col(c) == "ok")
    return out


def parse_parameters(requests: DataFrame, payload: str = "parameters") -> DataFrame:
    """Replace the payload by a map, empty if absent, and add ``aggregate`` in days and ``status``.

    A payload that is no JSON object, or an ``aggregate`` that is no whole number of 0 or
    more, gives a status other than 'ok' and no ``aggregate``.
    """
    params = F.from_json(first_line(F.col(payload)), "map<string,string>")
    stated = F.try_element_at(F.col("_params"), F.lit("aggregate"))
    days = stated.try_cast("int")
    bad = (F.col("_given") & F.col("_params").isNull()) | (stated.isNotNull() & (days.isNull() | (days < 0)))
    return (
        requests.withColumns({"_given": F.col(payload).isNotNull(), "_params": params})
        .withColumn("status", F.when(bad, F.lit(BAD_PARAMETERS)).otherwise(F.lit("ok")))
        .withColumn("aggregate", F.when(F.col("status") == "ok", F.coalesce(days, F.lit(0))))
        .withColumn(payload, F.coalesce("_params", F.create_map().cast("map<string,string>")))
        .drop("_given", "_params")
    )
