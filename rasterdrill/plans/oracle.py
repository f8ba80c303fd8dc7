"""DuckDB SQL that answers each registered query by brute force.

The blocks below rebuild the archive of ``cube.py`` as common table expressions.
Masks are tested pixel by pixel against every edge, windows are walked by a
recursive query and reprojection enumerates the target grid, so the SQL shares
no method with the Spark jobs it checks.
"""

from __future__ import annotations

import re

from rasterdrill.functions.projection import Albers
from rasterdrill.plans.cube import (
    LONLAT_GRID,
    MADE_OF,
    PARAMETER_TEXTS,
    RANGE_TEXTS,
    REQUEST_TEXTS,
    SHAPES,
    TIME_TEXTS,
)

_BITS_CLEAR = (
    "((water & 251) = 0 AND (water & 8) = 0 AND (water & 16) = 0"
    " AND (water & 32) = 0 AND (water & 64) = 0 AND (water & 4) = 0)"
)
_TCW = (
    "CAST(coalesce(CASE WHEN blue > -999 THEN blue * CAST(0.0315 AS DOUBLE) END"
    " + CASE WHEN green > -999 THEN green * CAST(0.2021 AS DOUBLE) END"
    " + CASE WHEN red > -999 THEN red * CAST(0.3102 AS DOUBLE) END"
    " + CASE WHEN nir > -999 THEN nir * CAST(0.1594 AS DOUBLE) END"
    " + CASE WHEN swir1 > -999 THEN swir1 * CAST(-0.6806 AS DOUBLE) END"
    " + CASE WHEN swir2 > -999 THEN swir2 * CAST(-0.6109 AS DOUBLE) END, -9999) AS FLOAT)"
)
_TCB = _TCW
for _a, _b in zip(("0.0315", "0.2021", "0.3102", "0.1594", "-0.6806", "-0.6109"),
                  ("0.2043", "0.4158", "0.5524", "0.5741", "0.3124", "0.2303"), strict=True):
    _TCB = _TCB.replace(f"CAST({_a} ", f"CAST({_b} ")
_TCG = _TCW
for _a, _b in zip(("0.0315", "0.2021", "0.3102", "0.1594", "-0.6806", "-0.6109"),
                  ("-0.1603", "-0.2819", "-0.4934", "0.7940", "-0.0002", "-0.1446"), strict=True):
    _TCG = _TCG.replace(f"CAST({_a} ", f"CAST({_b} ")
_WV = "CASE WHEN (water & 128) <> 0 AND (water & 99) = 0 THEN 1 ELSE 0 END"
_PMASK = "(fmask NOT IN (0, 2, 3) AND nbart_contiguity = 1 AND (water & 227) = 0)"
_EPOCH = """(product = 'ls8' AND ts >= TIMESTAMP '2013-01-01'
  OR product = 'ls7' AND (ts <= TIMESTAMP '2003-05-31'
     OR ts >= TIMESTAMP '2010-01-01' AND ts <= TIMESTAMP '2013-05-31')
  OR product = 'ls5' AND (ts <= TIMESTAMP '1999-12-31'
     OR ts >= TIMESTAMP '2003-01-01' AND ts <= TIMESTAMP '2011-12-31'))"""
_OBS = """CASE WHEN (water & 8) <> 0 OR (water & 32) <> 0 OR (water & 64) <> 0
    OR (water & 16) <> 0 OR (water & 2) <> 0 THEN 'not observable'
  WHEN (water & 251) = 0 AND (water & 4) <> 0 THEN 'not observable'
  WHEN (water & 251) = 0 THEN 'dry'
  WHEN (water & 251) = 128 OR (water & 4) <> 0 THEN 'wet' ELSE 'not observable' END"""
_TOP = (
    "CASE WHEN bs >= pv AND bs >= npv THEN 'BS' WHEN pv >= npv THEN 'PV' ELSE 'NPV' END"
)

# Each block: name -> (blocks it needs, SQL).
_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def _block(name: str, needs: str, sql: str) -> None:
    _BLOCKS[name] = (tuple(needs.split()), sql)


_block("grid", "", "SELECT CAST(max(p_partkey) // 64 + 1 AS BIGINT) AS n FROM part")
_block("scenes", "grid", """
  SELECT scene_id, tile_id,
    TIMESTAMP '1995-01-01' + to_seconds(CAST((visit // 2) * 37 * 86400 + (visit % 2) * 25 - 12
      + CASE WHEN o_custkey % 3 = 0 THEN 50 ELSE 0 END AS BIGINT)) AS ts,
    CASE (visit // 2) % 3 WHEN 0 THEN 'ls5' WHEN 1 THEN 'ls7' ELSE 'ls8' END AS product,
    148.5::DOUBLE + (tile_id % 8) * 0.125::DOUBLE AS lon,
    CAST(o_custkey % 12 AS DOUBLE) / 10 AS gqa_iterative_mean_xy,
    (tile_id % 8) * 8 - 32 AS sx0, (tile_id // 8) * 8 - 24 AS sy0
  FROM (SELECT o_orderkey AS scene_id, o_custkey, o_orderkey % n AS tile_id, o_orderkey // n AS visit
        FROM orders, grid)""")
_block("good_scenes", "scenes",
       f"SELECT * FROM scenes WHERE gqa_iterative_mean_xy BETWEEN 0 AND 1 AND {_EPOCH}")
for _name, _made in MADE_OF.items():
    _block(f"{_name}_scenes", "", f"SELECT o_orderkey AS scene_id FROM orders WHERE {_made}")
_block("pixels", "scenes", """
  SELECT scene_id, ts, tile_id, y, x,
    CAST(CASE WHEN m < 1 THEN 1 WHEN m < 2 THEN 2 WHEN m < 2 + cp THEN 64 WHEN m < 3 + cp THEN 32
      WHEN m < 5 + cp THEN 8 WHEN m < 7 + cp THEN 16 WHEN m < 9 + cp THEN 4 WHEN m < 10 + cp THEN 132
      WHEN p_size <= 10 THEN 128 ELSE 0 END AS INT) AS water,
    CAST(CASE WHEN m < 1 THEN 0 WHEN m >= 2 AND m < 2 + cp THEN 2
      WHEN m >= 2 AND m < 3 + cp THEN 3 ELSE 1 END AS INT) AS fmask,
    CAST(CASE WHEN m = 1 THEN 0 ELSE 1 END AS INT) AS nbart_contiguity,
    CAST(CASE WHEN n1 % 997 = 0 THEN -999 ELSE 100 + n1 % 3000 END AS INT) AS blue,
    CAST(CASE WHEN n2 % 101 = 0 THEN -2 - n2 % 990 ELSE 100 + n2 % 3000 END AS INT) AS green, CAST(100 + n3 % 3000 AS INT) AS red,
    CAST(100 + n4 % 3000 AS INT) AS nir, CAST(100 + n5 % 3000 AS INT) AS swir1,
    CAST(100 + n6 % 3000 AS INT) AS swir2,
    CAST(CASE WHEN m < 1 THEN -1 ELSE n4 % 101 END AS INT) AS bs,
    CAST(CASE WHEN m < 1 THEN -1 ELSE n5 % (101 - n4 % 101) END AS INT) AS pv,
    CAST(CASE WHEN m < 1 THEN -1 ELSE 100 - n4 % 101 - n5 % (101 - n4 % 101) END AS INT) AS npv,
    CAST(CASE WHEN p_size > 40 THEN 255 ELSE n6 % 4 END AS INT) AS canopy_cover_class
  FROM (SELECT scene_id, ts, tile_id, p_size,
      (tile_id // 8) * 8 - 24 + p_partkey % 64 // 8 AS y, (tile_id % 8) * 8 - 32 + p_partkey % 64 % 8 AS x,
      (p_partkey * 7919 + scene_id * 104729) % 10007 % 100 AS m,
      CASE WHEN scene_id % 5 = 0 THEN 60 ELSE 1 END AS cp,
      (p_partkey * 7919 + scene_id * 104729 + 1 * 15485863) % 10007 AS n1,
      (p_partkey * 7919 + scene_id * 104729 + 2 * 15485863) % 10007 AS n2,
      (p_partkey * 6101 + scene_id * 92821 + 3 * 15485863) % 10007 AS n3,
      (p_partkey * 5003 + scene_id * 81799 + 4 * 15485863) % 10007 AS n4,
      (p_partkey * 4001 + scene_id * 73999 + 5 * 15485863) % 10007 AS n5,
      (p_partkey * 3001 + scene_id * 64997 + 6 * 15485863) % 10007 AS n6
    FROM part JOIN scenes ON p_partkey // 64 = tile_id)""")
_block("poly", "grid", f"""
  SELECT s_suppkey AS poly_id, CAST(ring AS INT) AS ring, CAST(seq AS INT) AS seq,
    CAST((s_suppkey % n) % 8 * 8 + CASE WHEN s_suppkey % 50 = 49 THEN 1000 ELSE 0 END - 32 AS BIGINT)
      + CAST(dx AS DOUBLE) AS vx,
    CAST((s_suppkey % n) // 8 * 8 - 24 AS BIGINT) + CAST(dy AS DOUBLE) + fy * ((n + 7) // 8 * 8) AS vy
  FROM supplier, grid JOIN (VALUES {SHAPES}) AS t(kind, ring, seq, dx, dy, fy)
    ON t.kind = CASE WHEN s_suppkey = 0 THEN 5 ELSE s_suppkey % 5 END""")
_block("points", "grid", """
  SELECT c_custkey AS point_id, CAST(c_custkey * 1301 % 6400 AS DOUBLE) / 100 + (-32 + 0.003::DOUBLE) AS lon,
    CAST(c_custkey * 2903 % ((n + 7) // 8 * 800) AS DOUBLE) / 100 + (-24 + 0.003::DOUBLE) AS lat
  FROM customer, grid""")
_block("edges", "poly", """
  SELECT a.poly_id, a.vx AS xa, a.vy AS ya, b.vx AS xb, b.vy AS yb FROM poly a JOIN poly b
    ON a.poly_id = b.poly_id AND a.ring = b.ring AND b.seq = a.seq + 1""")
_block("extents", "poly", """
  SELECT poly_id, min(vx) AS bx0, min(vy) AS by0, max(vx) AS bx1, max(vy) AS by1
  FROM poly GROUP BY poly_id""")
_block("cells", "extents", """
  SELECT poly_id, x, y FROM (SELECT poly_id, by0, by1,
      unnest(range(CAST(floor(bx0) AS BIGINT), CAST(ceil(bx1) AS BIGINT))) AS x FROM extents) e,
    LATERAL (SELECT unnest(range(CAST(floor(by0) AS BIGINT), CAST(ceil(by1) AS BIGINT))) AS y) r
  WHERE x BETWEEN -32 AND 31""")
_block("mask_c", "cells edges", """
  SELECT c.poly_id, c.x, c.y FROM cells c JOIN edges e ON e.poly_id = c.poly_id
  WHERE ((ya <= y + 0.5::DOUBLE AND yb > y + 0.5::DOUBLE) OR (yb <= y + 0.5::DOUBLE AND ya > y + 0.5::DOUBLE))
    AND xa + (y + 0.5::DOUBLE - ya) * (xb - xa) / (yb - ya) <= x + 0.5::DOUBLE
  GROUP BY c.poly_id, c.x, c.y HAVING count(*) % 2 = 1""")
_block("mask_t", "mask_c", """
  SELECT * FROM mask_c UNION
  SELECT c.poly_id, c.x, c.y FROM cells c JOIN edges e ON e.poly_id = c.poly_id
  WHERE least(xa, xb) < x + 1 AND greatest(xa, xb) > x AND least(ya, yb) < y + 1 AND greatest(ya, yb) > y
    AND abs((xb - xa) * (y + 0.5::DOUBLE - ya) - (yb - ya) * (x + 0.5::DOUBLE - xa))
        < 0.5::DOUBLE * (abs(xb - xa) + abs(yb - ya))""")
_block("area_c", "mask_c", "SELECT poly_id, count(*) AS total_area FROM mask_c GROUP BY poly_id")
_block("area_t", "mask_t", "SELECT poly_id, count(*) AS total_area FROM mask_t GROUP BY poly_id")
_MET = """extents e JOIN {s} s ON bx0 < sx0 + 8 AND bx1 > sx0 AND by0 < sy0 + 8 AND by1 > sy0"""
_DAY = "CAST(ts + to_seconds(CAST(floor(lon * 240) AS BIGINT)) AS DATE)"
_block("spine_day", "extents scenes", f"""
  SELECT poly_id, {_DAY} AS grp, min(ts) AS time, count(*) AS n_scenes
  FROM {_MET.format(s='scenes')} GROUP BY ALL""")
_block("spine_exact", "extents scenes",
       f"SELECT DISTINCT poly_id, ts AS time FROM {_MET.format(s='scenes')}")
_block("spine_good", "extents good_scenes",
       f"SELECT DISTINCT poly_id, ts AS time FROM {_MET.format(s='good_scenes')}")
_ORD = "epoch_us(ts)::HUGEINT * 1000000000 + scene_id"
_block("daily", "pixels", f"""
  SELECT p.*, {_DAY} AS grp, {_ORD.replace('ts)', 'p.ts)').replace('scene_id', 'p.scene_id')} AS ord
  FROM pixels p JOIN (SELECT scene_id, lon FROM scenes) s ON p.scene_id = s.scene_id""")
_BLOCKS["daily"] = (("pixels", "scenes"), _BLOCKS["daily"][1].replace(_DAY, _DAY.replace("ts +", "p.ts +")))
_block("fused", "daily", """
  SELECT grp, tile_id, y, x,
    coalesce(arg_max(water, ord) FILTER (WHERE water & 1 = 0), 1) AS water,
    coalesce(arg_min(bs, ord) FILTER (WHERE bs <> -1), -1) AS bs,
    coalesce(arg_min(pv, ord) FILTER (WHERE pv <> -1), -1) AS pv,
    coalesce(arg_min(npv, ord) FILTER (WHERE npv <> -1), -1) AS npv
  FROM daily GROUP BY ALL""")
_block("cover_counts", "fused mask_c", f"""
  SELECT poly_id, grp, count(*) FILTER (WHERE bs <> -1) AS valid_bs,
    count(*) FILTER (WHERE pv <> -1) AS valid_pv, count(*) FILTER (WHERE npv <> -1) AS valid_npv,
    count(*) FILTER (WHERE {_BITS_CLEAR}) AS seen,
    count(*) FILTER (WHERE {_BITS_CLEAR} AND {_TOP} = 'BS') AS n_bs,
    count(*) FILTER (WHERE {_BITS_CLEAR} AND {_TOP} = 'PV') AS n_pv,
    count(*) FILTER (WHERE {_BITS_CLEAR} AND {_TOP} = 'NPV') AS n_npv
  FROM fused f JOIN mask_c m ON f.x = m.x AND f.y = m.y GROUP BY poly_id, grp""")
_block("cover", "spine_day cover_counts", """
  SELECT poly_id, time, n_bs / nullif(valid_bs, 0) * 100.0::DOUBLE AS BS,
    n_pv / nullif(valid_pv, 0) * 100.0::DOUBLE AS PV, n_npv / nullif(valid_npv, 0) * 100.0::DOUBLE AS NPV,
    (valid_bs - seen) / nullif(valid_bs, 0) * 100.0::DOUBLE AS Unobservable
  FROM spine_day LEFT JOIN cover_counts USING (poly_id, grp)""")
_block("mangrove", "spine_exact pixels mask_c", """
  SELECT s.poly_id, s.time, coalesce(c1, 0) AS Woodland, coalesce(c2, 0) AS "Open Forest",
    coalesce(c3, 0) AS "Closed Forest"
  FROM spine_exact s LEFT JOIN (
    SELECT poly_id, ts, count(*) FILTER (WHERE canopy_cover_class = 1) AS c1,
      count(*) FILTER (WHERE canopy_cover_class = 2) AS c2,
      count(*) FILTER (WHERE canopy_cover_class = 3) AS c3
    FROM pixels p JOIN mask_c m ON p.x = m.x AND p.y = m.y GROUP BY poly_id, ts) c
  ON s.poly_id = c.poly_id AND s.time = c.ts""")
_block("wet", "pixels good_scenes", f"""
  SELECT p.scene_id, p.ts, p.tile_id, y, x, {_WV} AS w,
    CASE WHEN {_PMASK} THEN bs ELSE -1 END AS bs, CASE WHEN {_PMASK} THEN pv ELSE -1 END AS pv,
    CASE WHEN {_PMASK} THEN npv ELSE -1 END AS npv,
    CASE WHEN {_PMASK} THEN {_TCW} ELSE CAST(-9999 AS FLOAT) END AS tcw
  FROM pixels p SEMI JOIN good_scenes g ON p.scene_id = g.scene_id""")
_block("held", "wet mask_t",
       "SELECT poly_id, wet.* FROM wet JOIN mask_t m ON wet.x = m.x AND wet.y = m.y")


def _area_sql(source: str, time: str) -> str:
    ground = "tcw < -350 AND abs(tcw - -9999) >= 0.00001"
    return f"""
  SELECT poly_id, {time} AS time,
    CAST(sum(w) + count(*) FILTER (WHERE abs(tcw - -9999) >= 0.00001) AS BIGINT) AS valid,
    CAST(sum(w) AS BIGINT) AS water, count(*) FILTER (WHERE tcw > -350) AS wet,
    sum(CASE WHEN {ground} THEN CAST(bs AS DOUBLE) ELSE 0 END) / 100 AS bs,
    sum(CASE WHEN {ground} THEN CAST(pv AS DOUBLE) ELSE 0 END) / 100 AS pv,
    sum(CASE WHEN {ground} THEN CAST(npv AS DOUBLE) ELSE 0 END) / 100 AS npv
  FROM {source} GROUP BY poly_id, {time}"""


_block("areas", "held", _area_sql("held", "ts"))
_block("steps", "", "SELECT unnest([1, 16, 365]) AS n_days")
_block("anchors", "spine_good steps", """
  SELECT poly_id, n_days, min(time) AS a FROM spine_good, steps GROUP BY ALL
  UNION ALL
  SELECT c.poly_id, c.n_days, (SELECT min(s.time) FROM spine_good s WHERE s.poly_id = c.poly_id
      AND s.time >= c.a + to_days(CAST(c.n_days AS INTEGER))) AS a
  FROM anchors c WHERE c.a IS NOT NULL""")
_block("windows", "anchors", """
  SELECT poly_id, n_days, ts, anchor FROM (
    SELECT s.poly_id, n_days, s.time AS ts, max(a) AS anchor FROM spine_good s JOIN anchors w
      ON w.poly_id = s.poly_id AND w.a <= s.time GROUP BY ALL)
  QUALIFY anchor < max(ts) OVER (PARTITION BY poly_id)""")
_block("window_sizes", "windows", """
  SELECT poly_id, n_days, anchor, count(*) AS n_times, max(ts) AS last_time FROM windows GROUP BY ALL""")


def _placed(days: int) -> str:
    return f"""held h JOIN windows v ON v.n_days = {days} AND v.poly_id = h.poly_id AND v.ts = h.ts
    JOIN window_sizes z ON z.n_days = {days} AND z.poly_id = h.poly_id AND z.anchor = v.anchor"""


def _mean(band: str, nd: int) -> str:
    good = f"FILTER (WHERE abs({band} - {nd}) >= 0.00001)"
    return (
        f"CAST(CASE WHEN count(*) {good} = max(z.n_times) THEN sum(CAST({band} AS DOUBLE)) {good}"
        f" / max(z.n_times) ELSE {nd} END AS FLOAT) AS {band}"
    )


_block("day_mean", "held windows window_sizes", f"""
  SELECT h.poly_id, v.anchor, y, x, {_mean('bs', -1)}, {_mean('pv', -1)}, {_mean('npv', -1)},
    {_mean('tcw', -9999)}, CAST(sum(w) AS INT) AS w
  FROM {_placed(1)} GROUP BY h.poly_id, v.anchor, y, x""")


def _first(band: str, nd: int) -> str:
    return f"""coalesce((list({band} ORDER BY ts) FILTER (WHERE abs({band} - {nd}) >= 0.00001
      AND (kw = 0 OR kw IS NULL OR ts <= k)))[1], {nd}) AS {band}"""


_block("settled", "held windows window_sizes", f"""
  SELECT h.*, v.anchor, min(h.ts) FILTER (WHERE abs(tcw - -9999) >= 0.00001 OR w > 0)
    OVER (PARTITION BY h.poly_id, v.anchor, y, x) AS k
  FROM {_placed(365)}""")
_block("settled_water", "settled", """
  SELECT *, max(CASE WHEN ts = k THEN w END) OVER (PARTITION BY poly_id, anchor, y, x) AS kw
  FROM settled""")
_block("composite", "settled_water", f"""
  SELECT poly_id, anchor, y, x, {_first('bs', -1)}, {_first('pv', -1)}, {_first('npv', -1)},
    coalesce(max(tcw) FILTER (WHERE ts = k), CAST(-9999 AS FLOAT)) AS tcw,
    coalesce(max(w) FILTER (WHERE ts = k), 0) AS w
  FROM settled_water GROUP BY poly_id, anchor, y, x""")
_block("day_areas", "day_mean", _area_sql("day_mean", "anchor"))
_block("year_areas", "composite", _area_sql("composite", "anchor"))
# Hull corners: ends of directed edges that leave no vertex strictly to the right.
_block("hull", "poly", """
  SELECT DISTINCT a.poly_id, a.vx, a.vy FROM poly a JOIN poly b ON a.poly_id = b.poly_id
    AND (a.vx <> b.vx OR a.vy <> b.vy)
  WHERE NOT EXISTS (SELECT 1 FROM poly c WHERE c.poly_id = a.poly_id AND
    (b.vx - a.vx) * (c.vy - a.vy) - (b.vy - a.vy) * (c.vx - a.vx) < 0)""")
_block("hull_turn", "hull", """
  SELECT poly_id, vx, vy, (atan2(vy - cy, vx - cx) - atan2(fy - cy, fx - cx) + 4 * pi()
      + 0.000000001) % (2 * pi()) AS turn
  FROM hull JOIN (SELECT poly_id, avg(vx) AS cx, avg(vy) AS cy,
      min({'vx': vx, 'vy': vy}).vx AS fx, min({'vx': vx, 'vy': vy}).vy AS fy
    FROM hull GROUP BY poly_id) USING (poly_id)""")
_block("hulls", "hull_turn", """
  SELECT poly_id, 'POLYGON ((' || string_agg(CAST(vx AS VARCHAR) || ' ' || CAST(vy AS VARCHAR), ', ' ORDER BY turn)
    || ', ' || first(CAST(vx AS VARCHAR) || ' ' || CAST(vy AS VARCHAR) ORDER BY turn) || '))' AS geometry
  FROM hull_turn GROUP BY poly_id""")
_block("point_spine", "points scenes", f"""
  SELECT point_id, lon, lat, x, y, grp, min(ts) AS time FROM (
    SELECT point_id, p.lon, lat, CAST(floor(p.lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y, ts,
      {_DAY.replace('lon *', 's.lon *')} AS grp
    FROM points p JOIN scenes s ON floor(p.lon) < sx0 + 8 AND floor(p.lon) + 1 > sx0
      AND floor(lat) < sy0 + 8 AND floor(lat) + 1 > sy0) GROUP BY ALL""")
_block("point_water", "point_spine fused", """
  SELECT point_id, time, s.lon AS longitude, s.lat AS latitude, coalesce(water, 1) AS water
  FROM point_spine s LEFT JOIN fused f ON f.x = s.x AND f.y = s.y AND f.grp = s.grp""")
_block("observed", "point_water",
       f"SELECT point_id, time, longitude, latitude, {_OBS} AS observation FROM point_water")


def _with(body: str, extra: str = "") -> str:
    """Prefix ``body`` with the blocks it names, those they need, and ``extra`` ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _BLOCKS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in _BLOCKS:
        if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", extra + body):
            visit(name)
    ctes = [f"{n} AS ({_BLOCKS[n][1]})" for n in order] + ([extra] if extra else [])
    return f"WITH RECURSIVE {', '.join(ctes)}\n{body}" if ctes else body


def _r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5::DOUBLE) / 1e6"


_WET_OUT = """
  SELECT a.poly_id, time, {shares}, geometry
  FROM {areas} a JOIN area_t t ON a.poly_id = t.poly_id JOIN hulls h ON a.poly_id = h.poly_id
  WHERE valid / total_area > 0.9"""

_SHARES = ", ".join(f"{_r6(f'{c} / valid')} AS {c}" for c in ("water", "wet", "bs", "pv", "npv"))
_COVER_ROUND = ", ".join(f"{_r6(c)} AS {c}" for c in ("BS", "PV", "NPV", "Unobservable"))


def _cents(column: str, factor: int) -> str:
    return f"CAST(sum(CAST(round(CAST({column} AS DOUBLE) * {factor}) AS BIGINT)) AS BIGINT)"


def _composite_out(source: str) -> str:
    return f"""
  SELECT poly_id, anchor, count(*) AS n_pixels, CAST(sum(w) AS BIGINT) AS sum_water,
    count(*) FILTER (WHERE abs(tcw - -9999) >= 0.00001) AS n_wetness, {_cents('tcw', 100)} AS sum_wetness,
    {_cents('bs', 1000)} AS sum_bs, {_cents('pv', 1000)} AS sum_pv, {_cents('npv', 1000)} AS sum_npv
  FROM {source} GROUP BY poly_id, anchor"""


_AL = Albers()
_G = LONLAT_GRID


def _lat_step(i: int) -> str:
    """One step of the latitude iteration, as a nested query."""
    e2, e = _AL.e2, _AL.e
    return f"""ll{i} AS (SELECT *, phi{i - 1} + pow(1 - {e2!r}::DOUBLE * pow(sin(phi{i - 1}), 2), 2) / (2 * cos(phi{i - 1}))
    * (q / (1 - {e2!r}::DOUBLE) - sin(phi{i - 1}) / (1 - {e2!r}::DOUBLE * pow(sin(phi{i - 1}), 2))
       + ln((1 - {e!r}::DOUBLE * sin(phi{i - 1})) / (1 + {e!r}::DOUBLE * sin(phi{i - 1}))) / (2 * {e!r}::DOUBLE)) AS phi{i}
    FROM ll{i - 1})"""


def _forward(lon: str, lat: str) -> tuple[str, str]:
    e2, e, n = _AL.e2, _AL.e, _AL.n
    s = f"sin(radians({lat}))"
    q = (f"((1 - {e2!r}::DOUBLE) * ({s} / (1 - {e2!r}::DOUBLE * {s} * {s})"
         f" - ln((1 - {e!r}::DOUBLE * {s}) / (1 + {e!r}::DOUBLE * {s})) / (2 * {e!r}::DOUBLE)))")
    rho = f"({_AL.semi_major!r}::DOUBLE / {n!r}::DOUBLE * sqrt({_AL.c!r}::DOUBLE - {n!r}::DOUBLE * {q}))"
    theta = f"({n!r}::DOUBLE * radians({lon} - {_AL.longitude_0!r}::DOUBLE))"
    return f"{rho} * sin({theta})", f"{_AL.rho_0!r}::DOUBLE - {rho} * cos({theta})"


def _source_ctes() -> str:
    """Enumerate the target grid and map every centre back to its source pixel."""
    lon = f"({_G.origin_x!r}::DOUBLE + cx * {_G.res_x!r}::DOUBLE)"
    lat = f"({_G.origin_y!r}::DOUBLE + cy * {_G.res_y!r}::DOUBLE)"
    east, north = _forward(lon, lat)
    steps = ",\n".join(_lat_step(i) for i in range(1, 5))
    n, c, a = _AL.n, _AL.c, _AL.semi_major
    sign = -1 if n < 0 else 1
    return f"""corner AS (SELECT cx, cy FROM (VALUES (-32), (32)) a(cx), (SELECT -24 AS cy UNION ALL SELECT (n + 7) // 8 * 8 - 24 FROM grid)),
box AS (SELECT min({east}) AS e0, max({east}) AS e1, min({north}) AS n0, max({north}) AS n1 FROM corner),
tgt AS (SELECT tx, ty FROM (SELECT unnest(range(CAST(floor(e0 / 30) AS BIGINT) - 9, CAST(ceil(e1 / 30) AS BIGINT) + 9)) AS tx FROM box),
  (SELECT unnest(range(CAST(floor(n1 / -30) AS BIGINT) - 9, CAST(ceil(n0 / -30) AS BIGINT) + 9)) AS ty FROM box)),
tgt_m AS (SELECT tx, ty, (tx + 0.5::DOUBLE) * 30 AS east, {_AL.rho_0!r}::DOUBLE - (ty + 0.5::DOUBLE) * -30 AS dy FROM tgt),
ll_q AS (SELECT *, ({c!r}::DOUBLE - (east * east + dy * dy) * {(n / a) ** 2!r}::DOUBLE) / {n!r}::DOUBLE AS q FROM tgt_m),
ll0 AS (SELECT *, asin(q / 2) AS phi0 FROM ll_q),
{steps},
src AS (SELECT tx, ty,
  floor(({_AL.longitude_0!r}::DOUBLE + degrees(atan2({sign} * east, {sign} * dy) / {n!r}::DOUBLE) - {_G.origin_x!r}::DOUBLE) / {_G.res_x!r}::DOUBLE) AS x,
  floor((degrees(phi4) - ({_G.origin_y!r}::DOUBLE)) / {_G.res_y!r}::DOUBLE) AS y FROM ll4)"""


def _reproject() -> str:
    body = """SELECT ty, p.tile_id, count(*) AS n_obs, count(DISTINCT tx) AS n_target,
    CAST(sum(tx) AS BIGINT) AS sum_tx, CAST(sum(water) AS BIGINT) AS sum_water, CAST(sum(bs * (tx % 97)) AS BIGINT) AS sum_bs
  FROM pixels p JOIN src ON p.x = src.x AND p.y = src.y GROUP BY ty, p.tile_id"""
    return _with(body, _source_ctes())


def _project() -> str:
    east, north = _forward("lon", "lat")
    return f"""SELECT point_id, round({east}, 3) AS east, round({north}, 3) AS north FROM (
  SELECT c_custkey AS point_id, 112 + CAST(c_custkey * 37 % 4200 AS DOUBLE) / 100 AS lon,
    -44 + CAST(c_custkey * 53 % 3400 AS DOUBLE) / 100 AS lat FROM customer)"""


def _per_scene(columns: str, where: str = "") -> str:
    return _with(f"SELECT scene_id, {columns} FROM pixels {where} GROUP BY scene_id")


_CSV_BODY = """SELECT poly_id, concat('{head}', chr(10),
    string_agg(concat(strftime(time, '%Y-%m-%d'), ',', {cols}), chr(10) ORDER BY time), chr(10)) AS data
  FROM {source} GROUP BY poly_id"""


def _csv(source: str, head: str, columns: list[str]) -> str:
    cols = ", ',', ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return _CSV_BODY.format(head=head, cols=cols, source=source)


_MANGROVE_CSV = _csv("mangrove", "time,Woodland,Open Forest,Closed Forest",
                     ["Woodland", '"Open Forest"', '"Closed Forest"'])
_COVER_CSV = _csv(
    "cover",
    "time,Bare Soil,Photosynthetic Vegetation,Non-Photosynthetic Vegetation,Unobservable",
    [_r6(c) for c in ("BS", "PV", "NPV", "Unobservable")],
)

_MELT = """SELECT poly_id, time, unnest([{names}]) AS "Cover Type", unnest([{values}]) AS "Area" FROM {source}"""
_MANGROVE_LONG = _MELT.format(
    names="'Woodland', 'Open Forest', 'Closed Forest'",
    values='CAST(Woodland AS DOUBLE), CAST("Open Forest" AS DOUBLE), CAST("Closed Forest" AS DOUBLE)',
    source="mangrove",
)
_COVER_LONG = _MELT.format(
    names="'BS', 'PV', 'NPV', 'Unobservable'",
    values=", ".join(_r6(c) for c in ("BS", "PV", "NPV", "Unobservable")), source="cover",
)


def _features() -> str:
    return f"""WITH req AS ({REQUEST_TEXTS}),
doc AS (SELECT request_id, CAST(split_part(payload, chr(10), 1) AS JSON) AS d FROM req),
head AS (SELECT request_id, d, CASE WHEN json_array_length(d, '$.features') IS NULL OR NOT json_exists(d, '$.features') THEN 'invalid request'
    WHEN json_array_length(d, '$.features') < 1 THEN 'no features specified'
    WHEN json_array_length(d, '$.features') > 1 THEN 'multiple features specified' ELSE 'ok' END AS status FROM doc),
kinds AS (SELECT request_id, status, json_extract_string(d, '$.features[0].geometry.type') AS kind,
    json_extract(d, '$.features[0].geometry.coordinates') AS xy FROM head),
judged AS (SELECT request_id, kind, xy, CASE WHEN status <> 'ok' THEN status WHEN kind IS NULL THEN 'empty geometry'
    WHEN kind NOT IN ('Point', 'Polygon', 'MultiPolygon') THEN 'unsupported geometry' WHEN xy IS NULL THEN 'empty geometry'
    WHEN json_type(xy) <> 'ARRAY' THEN 'invalid geometry' WHEN json_array_length(xy) = 0 THEN 'empty geometry' ELSE 'ok' END AS status FROM kinds),
geo AS (SELECT request_id, status, CASE WHEN status = 'ok' THEN kind END AS geom_type, CASE WHEN status = 'ok' THEN xy END AS xy FROM judged),
rings AS (SELECT request_id, unnest(r) AS pts, generate_subscripts(r, 1) - 1 AS ring FROM (
    SELECT request_id, CASE geom_type WHEN 'Polygon' THEN CAST(xy AS DOUBLE[][][]) ELSE flatten(CAST(xy AS DOUBLE[][][][])) END AS r
    FROM geo WHERE geom_type IN ('Polygon', 'MultiPolygon'))),
verts AS (SELECT request_id, ring, unnest(pts) AS p, generate_subscripts(pts, 1) - 1 AS seq FROM rings
  UNION ALL SELECT request_id, 0, CAST(xy AS DOUBLE[]), 0 FROM geo WHERE geom_type = 'Point')
SELECT geo.request_id, status, geom_type, CAST(ring AS INT) AS ring, CAST(seq AS INT) AS seq, p[1] AS vx, p[2] AS vy
FROM geo LEFT JOIN verts ON geo.request_id = verts.request_id"""


def _moment(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, 'T.*(Z|[+-][0-9:]+)$') THEN TRY_CAST({text} AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
    ELSE TRY_CAST({text} AS TIMESTAMP) END"""


def _range_end(column: str, first: bool) -> str:
    if first:
        return (f"CAST(CASE length({column}) WHEN 4 THEN {column} || '-01-01' WHEN 7 THEN {column} || '-01'"
                f" ELSE {column} END AS TIMESTAMP)")
    start = _range_end(column, True)
    return (f"{start} + CASE length({column}) WHEN 4 THEN INTERVAL 1 YEAR WHEN 7 THEN INTERVAL 1 MONTH"
            f" ELSE INTERVAL 1 DAY END - INTERVAL 1 MICROSECOND")


_PARAMETERS = f"""req AS ({PARAMETER_TEXTS}),
read AS (SELECT request_id, parameters IS NOT NULL AS given, TRY_CAST(split_part(parameters, chr(10), 1) AS JSON) AS j FROM req),
params AS (SELECT *, CASE WHEN given AND j IS NULL OR stated IS NOT NULL AND (days IS NULL OR days < 0)
    THEN 'invalid parameters' ELSE 'ok' END AS status
  FROM (SELECT *, json_extract_string(j, '$.aggregate') AS stated,
    TRY_CAST(json_extract_string(j, '$.aggregate') AS INT) AS days FROM read))"""


def _with_changed(body: str, extra: str = "", **blocks: tuple[str, str]) -> str:
    """:func:`_with` with other SQL, and other needs, for some blocks."""
    kept = {n: _BLOCKS[n] for n in blocks}
    for name, (needs, sql) in blocks.items():
        _block(name, needs, sql)
    try:
        out = _with(body)
    finally:
        _BLOCKS.update(kept)
    return out.replace("WITH RECURSIVE ", f"WITH RECURSIVE {extra},\n", 1) if extra else out


def _requests_drill() -> str:
    """The wetland drill with a length of window per polygon."""
    def placed(which: str) -> str:
        return f"""held h JOIN want q ON q.poly_id = h.poly_id AND q.days {which}
    JOIN windows v ON v.n_days = q.days AND v.poly_id = h.poly_id AND v.ts = h.ts
    JOIN window_sizes z ON z.n_days = q.days AND z.poly_id = h.poly_id AND z.anchor = v.anchor"""

    want = f"""{_PARAMETERS},
want AS (SELECT request_id AS poly_id, coalesce(days, 0) AS days FROM params WHERE status = 'ok')"""
    first, again = _BLOCKS["anchors"][1].split("UNION ALL")
    start = """
  SELECT s.poly_id, days AS n_days, min(time) AS a FROM spine_good s JOIN want q ON q.poly_id = s.poly_id AND days > 0
  GROUP BY ALL
  """
    body = f"""SELECT * FROM ({_WET_OUT.format(shares=_SHARES, areas="(SELECT * FROM day_areas UNION ALL SELECT * FROM year_areas"
      " UNION ALL SELECT * FROM areas SEMI JOIN (SELECT poly_id FROM want WHERE days = 0) USING (poly_id))")})"""
    return _with_changed(
        body, want,
        anchors=("spine_good", start + "UNION ALL" + again),
        day_mean=("held windows window_sizes", _BLOCKS["day_mean"][1].replace(_placed(1), placed("= 1"))),
        settled=("held windows window_sizes", _BLOCKS["settled"][1].replace(_placed(365), placed("> 1"))),
    )


def _lonlat_drill(east0: float, north0: float) -> str:
    """Cover where polygons went to longitude and latitude, rounded, and back to the metric grid."""
    n, c, a = _AL.n, _AL.c, _AL.semi_major
    sign = -1 if n < 0 else 1
    steps = ",\n".join(_lat_step(i) for i in range(1, 5))
    east, north = _forward("lon", "lat")
    poly = _BLOCKS["poly"][1]
    sql = f"""
  WITH base AS ({poly}),
  m AS (SELECT poly_id, ring, seq, {east0!r}::DOUBLE + vx * 30 AS east, {_AL.rho_0!r}::DOUBLE - ({north0!r}::DOUBLE + vy * -30) AS dy FROM base),
  ll_q AS (SELECT *, ({c!r}::DOUBLE - (east * east + dy * dy) * {(n / a) ** 2!r}::DOUBLE) / {n!r}::DOUBLE AS q FROM m),
  ll0 AS (SELECT *, asin(q / 2) AS phi0 FROM ll_q),
  {steps},
  ll AS (SELECT poly_id, ring, seq,
    round({_AL.longitude_0!r}::DOUBLE + degrees(atan2({sign} * east, {sign} * dy) / {n!r}::DOUBLE), 9) AS lon,
    round(degrees(phi4), 9) AS lat FROM ll4)
  SELECT poly_id, ring, seq, ({east} - {east0!r}::DOUBLE) / 30 AS vx, ({north} - ({north0!r}::DOUBLE)) / -30 AS vy FROM ll"""
    return _with_changed(f"SELECT poly_id, time, {_COVER_ROUND} FROM cover", poly=("grid", sql))


def _products_drill() -> str:
    """Cover and water, each from the scenes it was made of."""
    def spine(of: str) -> str:
        return f"""(SELECT poly_id, {_DAY} AS grp, min(ts) AS time FROM {_MET.format(s='scenes')}
    WHERE scene_id IN (SELECT scene_id FROM {of}_scenes) GROUP BY ALL)"""

    fused = _BLOCKS["fused"][1]
    head, bands = fused.split("SELECT grp, tile_id, y, x,")[1].split("AS water,")
    cover = "SELECT grp, tile_id, y, x," + bands.replace("FROM daily", "FROM daily SEMI JOIN cover_scenes USING (scene_id)")
    water = f"SELECT grp, tile_id, y, x,{head}AS water FROM daily SEMI JOIN water_scenes USING (scene_id) GROUP BY ALL"
    return _with_changed(
        f"SELECT poly_id, time, {_COVER_ROUND} FROM cover",
        fused=("daily cover_scenes water_scenes", f"SELECT * FROM ({water}) w JOIN ({cover}) c USING (grp, tile_id, y, x)"),
        spine_day=("extents scenes cover_scenes water_scenes", f"""SELECT poly_id, grp, least(a.time, b.time) AS time, 0 AS n_scenes
  FROM {spine('cover')} a JOIN {spine('water')} b USING (poly_id, grp)"""),
    )


def _wetland_products(areas: str) -> str:
    """Wetlands from the scenes that sensors, cover and water have in common, by time; times too."""
    both = " AND scene_id IN (SELECT scene_id FROM cover_scenes) AND scene_id IN (SELECT scene_id FROM water_scenes)"
    needs = "cover_scenes water_scenes"
    spine = _BLOCKS["spine_good"][1]

    def times(where: str) -> str:
        return f"({spine.replace('SELECT DISTINCT', 'SELECT').replace('good_scenes s', 'scenes s')} WHERE {where})"

    cover, water = (times(f"scene_id IN (SELECT scene_id FROM {n}_scenes)") for n in ("cover", "water"))
    return _with_changed(
        _WET_OUT.format(shares=_SHARES, areas=areas),
        wet=(f"pixels good_scenes {needs}", _BLOCKS["wet"][1] + " WHERE true" + both.replace("AND scene_id", "AND p.scene_id")),
        spine_good=(f"extents good_scenes scenes {needs}",
                    f"SELECT * FROM ({spine}) g SEMI JOIN {cover} c USING (poly_id, time) SEMI JOIN {water} w USING (poly_id, time)"),
    )


def _reprojected_drill() -> str:
    """Masks on the metric grid; every target pixel takes the source pixel under its centre."""
    east, north = _forward("lon", "lat")
    outline = _BLOCKS["poly"][1]
    projected = f"""SELECT poly_id, ring, seq, ({east}) / 30.0::DOUBLE AS vx, ({north}) / -30.0::DOUBLE AS vy
  FROM (SELECT poly_id, ring, seq, {_G.origin_x!r}::DOUBLE + vx * {_G.res_x!r}::DOUBLE AS lon,
    {_G.origin_y!r}::DOUBLE + vy * {_G.res_y!r}::DOUBLE AS lat FROM ({outline}))"""
    _block("outline", "grid", outline)
    _block("source_of", "grid", f"WITH {_source_ctes()} SELECT * FROM src")
    try:
        return _with_changed(
            _WET_OUT.format(shares=_SHARES, areas="areas"),
            poly=("grid", projected),
            cells=("extents", _BLOCKS["cells"][1].replace("WHERE x BETWEEN -32 AND 31", "")),
            held=("wet mask_t source_of", """SELECT poly_id, wet.* FROM wet JOIN source_of o ON wet.x = o.x AND wet.y = o.y
    JOIN mask_t m ON o.tx = m.x AND o.ty = m.y"""),
            hull=("outline", re.sub(r"\bpoly ([abc])\b", r"outline \1", _BLOCKS["hull"][1])),
        )
    finally:
        del _BLOCKS["outline"], _BLOCKS["source_of"]


def _ranges_drill(ranges: str) -> str:
    """Water at points, each merged over the scenes of its own range."""
    inside = f"""(start IS NULL OR "end" IS NULL
    OR ts >= {_range_end('start', True)} AND ts <= {_range_end('"end"', False)})"""
    spine = _BLOCKS["point_spine"][1].replace(
        "FROM points p JOIN scenes s ON", f"FROM points p JOIN {ranges} r ON r.point_id = p.point_id JOIN scenes s ON {inside} AND"
    ).replace("SELECT point_id, p.lon, lat,", "SELECT p.point_id, p.lon, lat,")
    water = f"""
  SELECT s.point_id, time, s.lon AS longitude, s.lat AS latitude, coalesce(water, 1) AS water
  FROM point_spine s LEFT JOIN (
    SELECT p.point_id, grp, arg_max(water, ord) FILTER (WHERE water & 1 = 0) AS water
    FROM points p JOIN {ranges} r ON r.point_id = p.point_id
      JOIN daily d ON d.x = floor(p.lon) AND d.y = floor(p.lat) AND {inside}
    GROUP BY ALL) f ON f.point_id = s.point_id AND f.grp = s.grp"""
    return _with_changed(
        "SELECT point_id, time, longitude, latitude, observation FROM observed",
        point_spine=("points scenes", spine), point_water=("point_spine daily points", water),
    )


def oracle_sql() -> dict[str, str]:
    """SQL per registered query."""
    ranges = f"(SELECT point_id, start, \"end\" FROM ({RANGE_TEXTS}))"
    out = {
        "scan_pixels": _per_scene(
            "count(*) AS n, CAST(sum(bs) AS BIGINT) AS sum_bs, CAST(sum(pv) AS BIGINT) AS sum_pv,"
            " CAST(sum(npv) AS BIGINT) AS sum_npv, CAST(sum(bs * (x + 64 * y + 1)) AS BIGINT) AS placed_bs"
        ),
        "filter_time_range": _with(f"""
  SELECT p.point_id, count(*) AS n_scenes, min(ts) AS first_ts, max(ts) AS last_ts
  FROM points p JOIN {ranges} r ON p.point_id = r.point_id
    JOIN scenes s ON floor((p.lon + 32) / 8) + 8 * floor((p.lat + 24) / 8) = s.tile_id
  WHERE start IS NULL OR "end" IS NULL
    OR ts >= {_range_end('start', True)} AND ts <= {_range_end('"end"', False)}
  GROUP BY p.point_id"""),
        "prune_bbox": _with("""
  SELECT tile_id, count(*) AS n_pixels, CAST(sum(water) AS BIGINT) AS sum_water FROM pixels p
  WHERE EXISTS (SELECT 1 FROM extents e WHERE p.x < bx1 AND p.x + 1 > bx0 AND p.y < by1 AND p.y + 1 > by0)
  GROUP BY tile_id"""),
        "pixels_in_extents": _with("""
  SELECT poly_id, count(*) AS n_pixels, count(DISTINCT scene_id) AS n_scenes, CAST(sum(water) AS BIGINT) AS sum_water
  FROM pixels p JOIN cells c ON p.x = c.x AND p.y = c.y GROUP BY poly_id"""),
        "filter_scene_quality": _with(
            "SELECT scene_id, ts, gqa_iterative_mean_xy FROM scenes WHERE gqa_iterative_mean_xy BETWEEN 0 AND 1"
        ),
        "filter_sensor_epoch": _with(f"SELECT scene_id, product, ts FROM scenes WHERE {_EPOCH}"),
        "parse_feature_requests": _features(),
        "parse_time_requests": f"""WITH req AS ({TIME_TEXTS}),
texts AS (SELECT *, json_extract_string(start, '$.properties.timestamp."date-time"') AS sa, json_extract_string("end", '$.properties.timestamp."date-time"') AS sb FROM req),
t AS (SELECT request_id, {_moment('sa')} AS a, {_moment('sb')} AS b, start IS NOT NULL AS given_a, "end" IS NOT NULL AS given_b FROM texts)
SELECT request_id, CASE WHEN b IS NOT NULL THEN a END AS start, CASE WHEN a IS NOT NULL THEN b END AS "end",
  CASE WHEN given_a AND a IS NULL OR given_b AND b IS NULL THEN 'invalid time' ELSE 'ok' END AS status FROM t""",
        "parse_parameters": f"""WITH {_PARAMETERS}
SELECT request_id, status, CASE WHEN status = 'ok' THEN coalesce(days, 0) END AS aggregate,
  CAST(coalesce(len(json_keys(j)), 0) AS INT) AS n_parameters FROM params""",
        "write_drill_parquet": _with(
            "SELECT 'wit' AS identifier, 'run-1' AS run_id, * FROM ("
            + _WET_OUT.format(shares=_SHARES, areas="areas") + ")"
        ),
        "drill_to_csv": _with(_COVER_CSV),
        "drill_catalog_json": _with(f"""SELECT poly_id, data, 'true' AS is_enabled, 'csv' AS type,
  'Mangrove Cover' AS name, '#5ECC00' AS open_forest_color FROM ({_MANGROVE_CSV})"""),
        "guard_rail": _with(f"""
  SELECT poly_id, times, ny, nx, times * ny * nx * 6 AS bytes,
    CASE WHEN times * ny * nx * 6 / 1e9 > 20 THEN 'requested area requires '
        || CAST(CAST(floor(times * ny * nx * 6 / 1e9) AS BIGINT) AS VARCHAR) || 'GB data to load - maximum is 20.0GB'
      WHEN times = 0 THEN 'no data returned for query'
      WHEN ny * nx * 6 / 1e9 > 2 THEN 'requested time slices each requires '
        || CAST(CAST(floor(ny * nx * 6 / 1e9) AS BIGINT) AS VARCHAR) || 'GB data to load - maximum is 2.0GB'
      ELSE 'ok' END AS status
  FROM (SELECT e.poly_id, count(DISTINCT grp) AS times,
      CAST(ceil(by1) - floor(by0) AS BIGINT) * 1500 AS ny, CAST(ceil(bx1) - floor(bx0) AS BIGINT) * 1500 AS nx
    FROM extents e LEFT JOIN (SELECT poly_id AS id, {_DAY} AS grp FROM {_MET.format(s='scenes')}
      WHERE poly_id % 3 = 0 OR ts >= CASE poly_id % 3 WHEN 1 THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '2010-02-01' END
        AND ts < CASE poly_id % 3 WHEN 1 THEN TIMESTAMP '2000-04-01' ELSE TIMESTAMP '2010-03-01' END) g
    ON g.id = e.poly_id GROUP BY ALL)"""),
        "collate": _with("""
  SELECT product, p.tile_id, count(*) AS n, CAST(sum(blue) AS BIGINT) AS sum_blue, CAST(sum(swir2) AS BIGINT) AS sum_swir2
  FROM pixels p JOIN (SELECT scene_id, product FROM good_scenes) g ON p.scene_id = g.scene_id GROUP BY ALL"""),
        "juxtapose": _with(f"""
  SELECT tile_id, count(*) AS n, CAST(sum(bs * water) AS BIGINT) AS bs_water, CAST(sum(npv * (x + 1)) AS BIGINT) AS placed_npv
  FROM pixels p WHERE scene_id IN (SELECT scene_id FROM scenes WHERE gqa_iterative_mean_xy BETWEEN 0 AND 1)
    AND scene_id IN (SELECT scene_id FROM scenes WHERE {_EPOCH}) GROUP BY tile_id"""),
        "group_solar_day": _with(
            f"SELECT tile_id, {_DAY} AS solar_day, min(ts) AS time, count(*) AS n_scenes FROM scenes GROUP BY ALL"
        ),
        "fuse_water": _with("""
  SELECT tile_id, grp AS solar_day, count(*) AS n, count(*) FILTER (WHERE water = 1) AS n_nodata,
    count(*) FILTER (WHERE water = 128) AS n_water, CAST(sum(water * (x + 64 * y + 1)) AS BIGINT) AS placed
  FROM fused GROUP BY ALL"""),
        "fuse_first_valid": _with("""
  SELECT tile_id, grp AS solar_day, count(*) AS n, count(*) FILTER (WHERE bs = -1) AS n_nodata,
    CAST(sum(bs * (x + 1)) AS BIGINT) AS placed_bs, CAST(sum(pv * (y + 1)) AS BIGINT) AS placed_pv, CAST(sum(npv) AS BIGINT) AS sum_npv
  FROM fused GROUP BY ALL"""),
        "apply_mask": _with(f"""
  SELECT scene_id, count(*) AS n, count(*) FILTER (WHERE NOT {_PMASK}) AS n_masked,
    CAST(sum(CASE WHEN {_PMASK} THEN bs ELSE -1 END) AS BIGINT) AS sum_bs,
    CAST(sum(CASE WHEN {_PMASK} THEN pv ELSE -1 END) AS BIGINT) AS sum_pv,
    CAST(sum(CASE WHEN {_PMASK} THEN npv ELSE -1 END) AS BIGINT) AS sum_npv,
    {_cents(f'CASE WHEN {_PMASK} THEN {_TCW} ELSE -9999 END', 100)} AS sum_wetness,
    CAST(sum({_WV}) AS BIGINT) AS sum_water
  FROM pixels GROUP BY scene_id"""),
        "reproject_nearest": _reproject(),
        "project_points": _project(),
        "rasterize_centre": _with("SELECT poly_id, y, x FROM mask_c"),
        "rasterize_all_touched": _with("SELECT poly_id, y, x FROM mask_t"),
        "mask_polygon": _with("""
  SELECT c.poly_id, p.tile_id, count(*) AS n, count(m.x) AS n_inside,
    CAST(sum(CASE WHEN m.x IS NULL THEN -1 ELSE bs END) AS BIGINT) AS sum_bs,
    CAST(sum(CASE WHEN m.x IS NULL THEN 1 ELSE water END) AS BIGINT) AS sum_water,
    count(CASE WHEN m.x IS NOT NULL THEN fmask END) AS n_fmask
  FROM pixels p JOIN cells c ON p.x = c.x AND p.y = c.y
    LEFT JOIN mask_c m ON m.poly_id = c.poly_id AND m.x = c.x AND m.y = c.y GROUP BY c.poly_id, p.tile_id"""),
        **dict.fromkeys(("polygon_pixel_area", "polygon_area_two_level"), _with("""
  SELECT t.poly_id, coalesce(c.total_area, 0) AS centre_area, t.total_area AS touched_area
  FROM area_t t LEFT JOIN area_c c ON c.poly_id = t.poly_id""")),
        "convex_hull_wkt": _with("SELECT poly_id, geometry FROM hulls"),
        "pixel_at_point": _with("""
  SELECT point_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, count(*) AS n_obs, CAST(sum(water) AS BIGINT) AS sum_water
  FROM points JOIN pixels ON floor(points.lon) = x AND floor(lat) = y GROUP BY ALL"""),
        "time_spine": _with("SELECT poly_id, grp AS solar_day, time, n_scenes FROM spine_day"),
        "decode_flags": _with("""
  SELECT water, concat_ws(',', CASE WHEN water & 1 <> 0 THEN 'nodata' END, CASE WHEN water & 2 <> 0 THEN 'noncontiguous' END,
    CASE WHEN water & 4 <> 0 THEN 'sea' END, CASE WHEN water & 8 <> 0 THEN 'terrain_or_low_angle' END,
    CASE WHEN water & 16 <> 0 THEN 'high_slope' END, CASE WHEN water & 32 <> 0 THEN 'cloud_shadow' END,
    CASE WHEN water & 64 <> 0 THEN 'cloud' END, CASE WHEN water & 128 <> 0 THEN 'water_observed' END,
    CASE WHEN (water & 251) = 0 THEN 'dry' END, CASE WHEN (water & 251) = 128 THEN 'wet' END) AS flags, count(*) AS n
  FROM pixels GROUP BY ALL"""),
        "flag_mask": _per_scene(f"count(*) FILTER (WHERE {_BITS_CLEAR}) AS n_clear"),
        "classify_water": _per_scene(
            f"count(*) FILTER (WHERE {_OBS} = 'wet') AS n_wet, count(*) FILTER (WHERE {_OBS} = 'dry') AS n_dry,"
            f" count(*) FILTER (WHERE {_OBS} = 'not observable') AS n_hidden"
        ),
        "water_value": _per_scene(f"CAST(sum({_WV}) AS BIGINT) AS n_water, CAST(sum({_WV} * (x + 64 * y + 1)) AS BIGINT) AS placed"),
        "pixel_quality_mask": _per_scene(f"count(*) FILTER (WHERE {_PMASK}) AS n_good"),
        "tasselled_cap": _per_scene(
            f"{_cents(_TCW, 100)} AS wetness, {_cents(_TCB, 100)} AS brightness, {_cents(_TCG, 100)} AS greenness,"
            f" count(*) FILTER (WHERE {_TCW} = -9999) AS n_missing"
        ),
        "nodata_null_roundtrip": _per_scene(
            "count(*) FILTER (WHERE blue = -999) AS n_null, CAST(sum(blue) FILTER (WHERE blue <> -999) AS BIGINT) AS sum_valid,"
            " CAST(sum(blue) AS BIGINT) AS sum_restored"
        ),
        "dominant_cover": _per_scene(
            f"count(*) FILTER (WHERE bs <> -1 AND {_TOP} = 'BS') AS n_bs, count(*) FILTER (WHERE bs <> -1 AND {_TOP} = 'PV') AS n_pv,"
            f" count(*) FILTER (WHERE bs <> -1 AND {_TOP} = 'NPV') AS n_npv, count(*) FILTER (WHERE bs = -1) AS n_none"
        ),
        "wet_threshold": _per_scene(
            f"count(*) FILTER (WHERE {_TCW} > -350) AS n_wet, count(*) FILTER (WHERE {_TCW} < -350) AS n_ground,"
            f" count(*) FILTER (WHERE {_TCW} = -350) AS n_neither"
        ),
        "wofs_pixel_drill": _with("SELECT point_id, time, longitude, latitude, observation FROM observed"),
        "fc_total_valid": _with("""
  SELECT poly_id, time, coalesce(valid_bs, 0) AS valid_bs, coalesce(valid_pv, 0) AS valid_pv, coalesce(valid_npv, 0) AS valid_npv
  FROM spine_day LEFT JOIN cover_counts USING (poly_id, grp)"""),
        "fc_unobservable": _with("""
  SELECT poly_id, time, coalesce(valid_bs, 0) - coalesce(seen, 0) AS unobservable
  FROM spine_day LEFT JOIN cover_counts USING (poly_id, grp)"""),
        "fc_drill": _with(f"SELECT poly_id, time, {_COVER_ROUND} FROM cover"),
        "fc_drill_lonlat": _lonlat_drill(1_500_000.0, -3_900_000.0),
        "fc_drill_products": _products_drill(),
        "wit_drill_products": _wetland_products("areas"),
        "wit_drill_products_yearly": _wetland_products("year_areas"),
        "wit_drill_reprojected": _reprojected_drill(),
        "wit_drill_requests": _requests_drill(),
        "wofs_pixel_drill_ranges": _ranges_drill(ranges),
        **dict.fromkeys(("mangrove_drill", "mangrove_drill_summaries"), _with("SELECT * FROM mangrove")),
        "mangrove_drill_years": _with(
            "SELECT * FROM mangrove WHERE time >= TIMESTAMP '2000-01-01' AND time < TIMESTAMP '2006-01-01'"
        ),
        "wit_cal_area": _with("""
  SELECT poly_id, time, valid, water, wet, """ + ", ".join(f"{_r6(b)} AS {b}" for b in ("bs", "pv", "npv")) + " FROM areas"),
        "wit_drill": _with(_WET_OUT.format(shares=_SHARES, areas="areas")),
        "wit_drill_aggregated": _with(_WET_OUT.format(shares=_SHARES, areas="year_areas")),
        "wit_drill_daily": _with(_WET_OUT.format(shares=_SHARES, areas="day_areas")),
        **{
            name: _with(
                f"SELECT poly_id, anchor, n_times, last_time FROM window_sizes WHERE n_days = {days}"
            )
            for name, days in (
                ("anchored_windows", 365), ("anchored_windows_16", 16), ("anchored_windows_daily", 1)
            )
        },
        "average_over_day": _with(_composite_out("day_mean")),
        "composite_first_valid": _with(_composite_out("composite")),
        "melt_cover": _with(f'SELECT * FROM ({_COVER_LONG}) AS t WHERE "Area" IS NOT NULL'),
        "normalized_stack": _with(f"""
  SELECT *, {_r6('"Area" / nullif(sum("Area") OVER (PARTITION BY poly_id, time), 0)')} AS share FROM ({_MANGROVE_LONG})"""),
        "style_join": _with(f"""
  SELECT m.*, "Cover Type" AS label, color, '#' AS units, true AS active, CAST(ord AS INT) AS ord FROM ({_MANGROVE_LONG}) m
    JOIN (VALUES ('Woodland', '#9FFF4C', 0), ('Open Forest', '#5ECC00', 1), ('Closed Forest', '#3B7F00', 2)) v(label, color, ord)
    ON m."Cover Type" = v.label"""),
        "wofs_tick_series": _with("""
  SELECT point_id, time, observation, CASE observation WHEN 'wet' THEN 'blue' WHEN 'dry' THEN 'red' ELSE 'grey' END AS color,
    concat('Water Observations for ', printf('%.6f', latitude), ',', printf('%.6f', longitude)) AS title FROM observed"""),
    }
    return out
