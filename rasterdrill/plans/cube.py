"""A raster archive derived from the driver's tables, see ``FIXTURES.md``.

The driver's tables hold no rasters. Every part is a pixel, every order a scene
over one tile of 8 x 8 pixels, every supplier a polygon and every customer a
point or a request, so the archive grows with the tables. Pixels come from an
equi-join of parts and orders on the tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterdrill.functions.projection import Albers
from rasterdrill.grid import Grid
from rasterdrill.tuning import by_tile

# The origin lies inside the archive, so pixels, polygons and scenes lie on both sides of it.
WEST, NORTH = -32, -24
GRID = Grid(tile=8, tiles_across=8, first_tile_x=WEST // 8, first_tile_y=NORTH // 8)

# The same pixels seen as a longitude/latitude grid, for the projection operators.
LONLAT_GRID = Grid(origin_x=148.5, origin_y=-35.0, res_x=0.0003, res_y=-0.0003, tile=8, tiles_across=8,
                   first_tile_x=WEST // 8, first_tile_y=NORTH // 8)


# Stated, so that reading a table starts no job to look at its files.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _n_tiles(spark: SparkSession, sf_dir: str):
    parts = table(spark, sf_dir, "part")
    return parts.select((F.floor(F.max("p_partkey") / 64) + 1).cast("bigint")).scalar()


def _tile_origin(tile: str):
    t = F.col(tile)
    return (t % 8) * 8 + WEST, F.floor(t / F.lit(8.0)).cast("bigint") * 8 + NORTH


def scenes(spark: SparkSession, sf_dir: str, having: str = "true") -> DataFrame:
    """One scene per order; two overlapping scenes per tile and pass, 37 days apart.

    ``having`` is a condition on the order, for products that were not made of every scene.
    """
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    keyed = table(spark, sf_dir, "orders").select(
        order.alias("scene_id"), cust, "o_orderstatus", "o_orderpriority", _n_tiles(spark, sf_dir).alias("n")
    )
    placed = keyed.filter(having).select(
        "scene_id",
        (F.col("scene_id") % F.col("n")).alias("tile_id"),
        F.expr("scene_id div n").alias("visit"),
        cust,
    ).withColumn("pass", F.expr("visit div 2"))
    late = F.when(cust % 3 == 0, 50).otherwise(0)
    seconds = F.col("pass") * 37 * 86400 + (F.col("visit") % 2) * 25 - 12 + late
    ox, oy = _tile_origin("tile_id")
    return placed.select(
        "scene_id",
        "tile_id",
        (
            F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'")
            + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
        ).alias("ts"),
        F.element_at(F.array(F.lit("ls5"), F.lit("ls7"), F.lit("ls8")), (F.col("pass") % 3 + 1).cast("int"))
        .alias("product"),
        (F.lit(148.5) + (F.col("tile_id") % 8) * F.lit(0.125)).alias("lon"),
        (cust % 12 / F.lit(10.0)).alias("gqa_iterative_mean_xy"),
        ox.cast("double").alias("sx0"),
        oy.cast("double").alias("sy0"),
        (ox + 8).cast("double").alias("sx1"),
        (oy + 8).cast("double").alias("sy1"),
    )


def pixels(spark: SparkSession, sf_dir: str, taken: DataFrame | None = None) -> DataFrame:
    """Dense pixel table: each scene (of ``taken``, if given) sees every pixel of its tile."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size", "p_partkey div 64 AS tile_id", "p_partkey % 64 AS cell"
    )
    # The order file is one small block; spread the scenes before they multiply, by tile as
    # an archive is stored.
    shots = scenes(spark, sf_dir) if taken is None else taken
    shots = by_tile(shots.select("scene_id", "tile_id", "ts"))
    raw = shots.join(by_tile(parts).hint("shuffle_hash"), "tile_id")
    ox, oy = _tile_origin("tile_id")

    def noise(a: int, b: int, i: int) -> str:
        return f"(p_partkey * {a} + scene_id * {b} + {i} * 15485863) % 10007"

    mixed = raw.select(
        "scene_id", "ts", "tile_id", "p_size",
        (oy + F.expr("cell div 8")).cast("int").alias("y"),
        (ox + F.col("cell") % 8).cast("int").alias("x"),
        F.expr("(p_partkey * 7919 + scene_id * 104729) % 10007 % 100").alias("m"),
        F.expr("CASE WHEN scene_id % 5 = 0 THEN 60 ELSE 1 END").alias("cp"),
        F.expr(noise(7919, 104729, 1)).alias("n1"),
        F.expr(noise(7919, 104729, 2)).alias("n2"),
        F.expr(noise(6101, 92821, 3)).alias("n3"),
        F.expr(noise(5003, 81799, 4)).alias("n4"),
        F.expr(noise(4001, 73999, 5)).alias("n5"),
        F.expr(noise(3001, 64997, 6)).alias("n6"),
    )
    bands = {
        "water": "CASE WHEN m < 1 THEN 1 WHEN m < 2 THEN 2 WHEN m < 2 + cp THEN 64"
        " WHEN m < 3 + cp THEN 32 WHEN m < 5 + cp THEN 8 WHEN m < 7 + cp THEN 16"
        " WHEN m < 9 + cp THEN 4 WHEN m < 10 + cp THEN 132 WHEN p_size <= 10 THEN 128 ELSE 0 END",
        "fmask": "CASE WHEN m < 1 THEN 0 WHEN m >= 2 AND m < 2 + cp THEN 2"
        " WHEN m >= 2 AND m < 3 + cp THEN 3 ELSE 1 END",
        "nbart_contiguity": "CASE WHEN m = 1 THEN 0 ELSE 1 END",
        "blue": "CASE WHEN n1 % 997 = 0 THEN -999 ELSE 100 + n1 % 3000 END",
        "green": "CASE WHEN n2 % 101 = 0 THEN -2 - n2 % 990 ELSE 100 + n2 % 3000 END",
        "red": "100 + n3 % 3000",
        "nir": "100 + n4 % 3000",
        "swir1": "100 + n5 % 3000",
        "swir2": "100 + n6 % 3000",
        "bs": "CASE WHEN m < 1 THEN -1 ELSE n4 % 101 END",
        "pv": "CASE WHEN m < 1 THEN -1 ELSE n5 % (101 - n4 % 101) END",
        "npv": "CASE WHEN m < 1 THEN -1 ELSE 100 - n4 % 101 - n5 % (101 - n4 % 101) END",
        "canopy_cover_class": "CASE WHEN p_size > 40 THEN 255 ELSE n6 % 4 END",
    }
    return mixed.select(
        "scene_id", "ts", "tile_id", "y", "x",
        *[F.expr(f"CAST({e} AS INT)").alias(b) for b, e in bands.items()],
    )


# The sensors, and what each of the other products was made of.
SENSORS = ("ls5", "ls7", "ls8")
MADE_OF = {
    "cover": "NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
    "water": "NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')",
}
COVER, SURFACE, WATER = 0, 1, 2


def product(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Pixels and scenes of a product stored by itself, with scene numbers of its own.

    ``cover`` and ``water`` were not made of every scene; each sensor has its own table.
    """
    if name in SENSORS:
        kind, sc = SURFACE, scenes(spark, sf_dir).filter(F.col("product") == name)
        bands = ["blue", "green", "red", "nir", "swir1", "swir2", "fmask", "nbart_contiguity"]
    else:
        kind, sc = (COVER, scenes(spark, sf_dir, MADE_OF[name])) if name == "cover" else (WATER, scenes(spark, sf_dir, MADE_OF[name]))
        bands = ["bs", "pv", "npv"] if name == "cover" else ["water"]
    number = F.col("scene_id") * 3 + kind
    px = pixels(spark, sf_dir, sc).select(number.alias("scene_id"), "ts", "tile_id", "y", "x", *bands)
    return px, sc.withColumn("scene_id", number)


# Shape templates: (kind, ring, seq, dx, dy, fy); a corner is the tile's origin
# plus (dx, dy), plus fy times the grid's height. Triangle; notched shape with a
# hole; sliver without a pixel centre; two shapes across tiles; the whole grid.
SHAPES = """
 (0,0,0,0.3,0.4,0),(0,0,1,7.6,1.1,0),(0,0,2,3.2,7.7,0),(0,0,3,0.3,0.4,0),
 (1,0,0,0.2,0.1,0),(1,0,1,7.9,0.1,0),(1,0,2,7.9,7.4,0),(1,0,3,4.1,5.3,0),(1,0,4,0.2,7.4,0),(1,0,5,0.2,0.1,0),
 (1,1,0,2.3,1.7,0),(1,1,1,5.6,1.7,0),(1,1,2,5.6,3.8,0),(1,1,3,2.3,3.8,0),(1,1,4,2.3,1.7,0),
 (2,0,0,1.4,2.3,0),(2,0,1,5.6,2.3,0),(2,0,2,5.6,2.4,0),(2,0,3,1.4,2.4,0),(2,0,4,1.4,2.3,0),
 (3,0,0,4.3,3.2,0),(3,0,1,14.7,2.1,0),(3,0,2,13.6,10.4,0),(3,0,3,5.2,9.3,0),(3,0,4,4.3,3.2,0),
 (4,0,0,1.5,6.2,0),(4,0,1,7.7,0.6,0),(4,0,2,13.3,5.4,0),(4,0,3,11.8,12.9,0),(4,0,4,3.1,11.3,0),(4,0,5,1.5,6.2,0),
 (5,0,0,0.2,0.3,0),(5,0,1,63.8,0.3,0),(5,0,2,63.8,-0.3,1),(5,0,3,0.2,-0.3,1),(5,0,4,0.2,0.3,0)
"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per supplier: supplier 0 covers the grid, some lie off it."""
    shapes = spark.sql(f"SELECT * FROM VALUES {SHAPES} AS t(kind, ring, seq, dx, dy, fy)")
    key = F.col("s_suppkey")
    placed = (
        table(spark, sf_dir, "supplier")
        .select(
            key.alias("poly_id"),
            F.when(key == 0, 5).otherwise(key % 5).alias("kind"),
            _n_tiles(spark, sf_dir).alias("n"),
        )
        .withColumn("tile", F.col("poly_id") % F.col("n"))
    )
    ox, oy = _tile_origin("tile")
    off = F.when(F.col("poly_id") % 50 == 49, 1000).otherwise(0)
    height = F.ceil(F.col("n") / F.lit(8.0)) * 8
    return (
        placed.withColumns({"ox": ox + off, "oy": oy, "h": height})
        .join(F.broadcast(shapes), "kind")
        .select(
            "poly_id",
            F.col("ring").cast("int").alias("ring"),
            F.col("seq").cast("int").alias("seq"),
            (F.col("ox") + F.col("dx").cast("double")).alias("vx"),
            (F.col("oy") + F.col("dy").cast("double") + F.col("fy") * F.col("h")).alias("vy"),
        )
    )


# The metric grid that the archive is resampled to, and its origin's system.
TARGET_GRID = Grid(res_x=30.0, res_y=-30.0, tile=8)


def projected_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons in metres, with the archive seen as a longitude/latitude grid."""
    lon = F.lit(LONLAT_GRID.origin_x) + F.col("vx") * F.lit(LONLAT_GRID.res_x)
    lat = F.lit(LONLAT_GRID.origin_y) + F.col("vy") * F.lit(LONLAT_GRID.res_y)
    east, north = Albers().forward(lon, lat)
    return polygons(spark, sf_dir).withColumns({"vx": east, "vy": north})


def lonlat_requests(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """The polygons as request texts in longitude and latitude, as they lie on a metric grid."""
    east = F.lit(grid.origin_x) + F.col("vx") * F.lit(grid.res_x)
    north = F.lit(grid.origin_y) + F.col("vy") * F.lit(grid.res_y)
    lon, lat = Albers().inverse(east, north)
    corner = F.struct("seq", F.array(F.round(lon, 9), F.round(lat, 9)).alias("p"))
    rings = (
        polygons(spark, sf_dir).groupBy("poly_id", "ring")
        .agg(F.sort_array(F.collect_list(corner)).getField("p").alias("ps"))
        .groupBy("poly_id").agg(F.sort_array(F.collect_list(F.struct("ring", "ps"))).getField("ps").alias("rings"))
    )
    text = F.concat(
        F.lit('{"features":[{"geometry":{"type":"Polygon","coordinates":'), F.to_json("rings"), F.lit("}}]}")
    )
    return rings.select(F.col("poly_id").alias("request_id"), text.alias("payload"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per customer, spread over the grid; some fall off its last tile."""
    key = F.col("c_custkey")
    rows = F.ceil(F.col("n") / F.lit(8.0)).cast("bigint") * 800
    return (
        table(spark, sf_dir, "customer")
        .select(key.alias("point_id"), _n_tiles(spark, sf_dir).alias("n"))
        .select(
            "point_id",
            ((F.col("point_id") * 1301 % 6400) / F.lit(100.0) + (WEST + 0.003)).alias("lon"),
            ((F.col("point_id") * 2903 % rows) / F.lit(100.0) + (NORTH + 0.003)).alias("lat"),
        )
    )


# Request payloads as text, one per customer or order, the same SQL for both engines
# but for the quoting of "end" (see ``request_texts``).

REQUEST_TEXTS = """
  SELECT request_id, CASE request_id % 12
    WHEN 0 THEN concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[', lon, ',', lat, ',-12.5]}}]}')
    WHEN 1 THEN concat('{"features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[', ring, ']},"properties":{"name":"a"}}]}')
    WHEN 2 THEN '{"type":"FeatureCollection","features":[]}'
    WHEN 3 THEN concat('{"features":[{"geometry":{"type":"Point","coordinates":[', lon, ',', lat, ']}},{"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    WHEN 4 THEN concat('{"features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[', ring, ',', hole, ']},"crs":{"properties":{"name":"EPSG:3577"}}}]}', chr(10), '{"not":"read"}')
    WHEN 5 THEN '{"type":"FeatureCollection"}'
    WHEN 6 THEN concat('{"features":[{"geometry":{"type":"LineString","coordinates":[[', lon, ',', lat, '],[1,2]]}}]}')
    WHEN 7 THEN '{"features":[{"geometry":{"type":"GeometryCollection","geometries":[]}}]}'
    WHEN 8 THEN '{"features":[{"geometry":{"type":"Polygon","coordinates":"x"}}]}'
    WHEN 9 THEN '{"features":[{"geometry":{"type":"Polygon","coordinates":[]}}]}'
    WHEN 10 THEN '{"features":[{"geometry":null}]}'
    ELSE concat('{"features":[{"geometry":{"type":"MultiPolygon","coordinates":[[', ring, '],[', hole, ']]}}]}') END AS payload
  FROM (SELECT request_id, lon, lat,
      concat('[[', lon, ',', lat, '],[', lon, '5,', lat, '],[', lon, '5,', lat, '5],[', lon, ',', lat, '5],[', lon, ',', lat, ']]') AS ring,
      concat('[[', lon, '1,', lat, '1],[', lon, '2,', lat, '1],[', lon, '2,', lat, '2],[', lon, '1,', lat, '1]]') AS hole
    FROM (SELECT c_custkey AS request_id, concat(146 + c_custkey % 7, '.', 101 + c_custkey % 877) AS lon,
        concat('-', 20 + c_custkey % 17, '.', 101 + c_custkey % 839) AS lat FROM customer) k) t
"""

TIME_TEXTS = """
  SELECT o_orderkey AS request_id,
    concat('{"properties":{"timestamp":{"date-time":"', 1990 + o_orderkey % 30, '-0', 1 + o_custkey % 9, '-1', o_orderkey % 10,
      CASE o_orderkey % 6 WHEN 0 THEN 'T10:20:30' WHEN 1 THEN 'T10:20:30+10:00' WHEN 2 THEN 'T23:20:30.5-03:30' WHEN 3 THEN 'T10:20:30Z' ELSE '' END, '"}}}') AS start,
    CASE WHEN o_orderkey % 4 = 3 THEN NULL
      WHEN o_orderkey % 11 = 5 THEN '{"properties":{"timestamp":{"date-time":"soon"}}}'
      ELSE concat('{"properties":{"timestamp":{"date-time":"', 2005 + o_custkey % 20, '-1', o_orderkey % 3, '-2', o_custkey % 9, '"}}}')
      END AS "end"
  FROM orders
"""

PARAMETER_TEXTS = """
  SELECT c_custkey AS request_id, CASE c_custkey % 5
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('{"aggregate":', c_custkey % 400, '}')
    WHEN 2 THEN concat('{"aggregate":"', c_custkey % 30, '","note":"x"}', chr(10), '{"aggregate":1}')
    WHEN 3 THEN '{}'
    ELSE CASE c_custkey % 4 WHEN 0 THEN '{broken' WHEN 1 THEN '{"aggregate":"soon"}' WHEN 2 THEN '{"aggregate":-3}'
      ELSE concat('{"note":"', c_custkey, '"}') END END AS parameters
  FROM customer
"""

# Time ranges per request: whole years, months, days, none, or one end only.
RANGE_TEXTS = """
  SELECT c_custkey AS point_id, CASE c_custkey % 5
      WHEN 0 THEN concat(1995 + c_custkey % 13)
      WHEN 1 THEN concat(1995 + c_custkey % 17, '-0', 1 + c_custkey % 9)
      WHEN 2 THEN concat(1995 + c_custkey % 11, '-12-31')
      WHEN 3 THEN NULL ELSE '2001' END AS start,
    CASE c_custkey % 5
      WHEN 0 THEN concat(1995 + c_custkey % 13 + c_custkey % 4)
      WHEN 1 THEN concat(2012 + c_custkey % 5, '-1', c_custkey % 3)
      WHEN 2 THEN concat(2010 + c_custkey % 7, '-01-01')
      ELSE NULL END AS "end"
  FROM customer
"""


def request_texts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the payload tables above, over the customers or the orders."""
    text = sql.replace('"end"', "`end`").replace("{", "{{").replace("}", "}}")
    used = {n: table(spark, sf_dir, n) for n in ("customer", "orders") if f"FROM {n}" in sql}
    for name in used:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **used)
