"""Admission of requests by the size of the data they would load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterdrill import schema as S
from rasterdrill.grid import Grid
from rasterdrill.operators.geometry import polygon_extents, time_spine


def guard_rail(
    polygons: DataFrame,
    scenes: DataFrame,
    grid: Grid,
    product: Sequence[S.BandSpec],
    ranges: DataFrame | None = None,
    max_gb: float = S.MAX_GB,
    max_gb_per_time: float = S.MAX_GB_PER_TIME,
    refine: int = 1,
) -> DataFrame:
    """``(poly_id, times, ny, nx, bytes, status)`` from metadata alone.

    ``scenes`` are grouped (``group_scenes``). ``refine`` is the number of load
    pixels per grid pixel and axis, for a product finer than the grid. The first
    failing check names the status; 'ok' otherwise.
    """
    extents = polygon_extents(polygons, grid)
    times = (
        time_spine(extents, scenes, grid, ranges=ranges)
        .groupBy("poly_id")
        .agg(F.count(F.lit(1)).alias("times"))
    )

    def cells(lo: str, hi: str):
        return ((F.ceil(hi) - F.floor(lo)) * refine).cast("bigint")

    itemsize = sum(b.itemsize for b in product)
    sized = (
        extents.join(times, "poly_id", "left")
        .select(
            "poly_id",
            F.coalesce("times", F.lit(0)).alias("times"),
            cells("by0", "by1").alias("ny"),
            cells("bx0", "bx1").alias("nx"),
        )
        .withColumn("bytes", F.col("times") * F.col("ny") * F.col("nx") * itemsize)
    )
    gb = F.col("bytes") / F.lit(S.GB)
    gb_per_time = F.col("bytes") / F.nullif(F.col("times"), F.lit(0)) / F.lit(S.GB)
    return sized.withColumn(
        "status",
        F.when(
            gb > max_gb,
            F.concat(
                F.lit("requested area requires "), F.floor(gb).cast("bigint").cast("string"),
                F.lit(f"GB data to load - maximum is {max_gb}GB"),
            ),
        )
        .when(F.col("times") == 0, F.lit("no data returned for query"))
        .when(
            gb_per_time > max_gb_per_time,
            F.concat(
                F.lit("requested time slices each requires "),
                F.floor(gb_per_time).cast("bigint").cast("string"),
                F.lit(f"GB data to load - maximum is {max_gb_per_time}GB"),
            ),
        )
        .otherwise(F.lit("ok")),
    )
