"""Drill statistics over satellite-image time series held as pixel tables.

Everything is DataFrame in, DataFrame out (or Column in, Column out), so a
drill of one polygon and a drill of a hundred thousand polygons is one job.
"""

from rasterdrill.grid import Grid
from rasterdrill.plans.drills import (
    cover_drill,
    mangrove_drill,
    point_water_drill,
    wetland_drill,
)

__all__ = [
    "Grid",
    "cover_drill",
    "mangrove_drill",
    "point_water_drill",
    "wetland_drill",
]
