"""Reading and writing pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterdrill import schema as S
from rasterdrill.sources.scenes import filter_time_range

KEY_COLUMNS = ("scene_id", "ts", "tile_id", "y", "x")


def scan_pixels(
    source: DataFrame, bands: Sequence[str], time=None, keys: Sequence[str] = KEY_COLUMNS
) -> DataFrame:
    """Only the measurements asked for; columns and time are pruned in the file scan."""
    return filter_time_range(source, time).select(*keys, *bands)


def read_pixels(
    spark: SparkSession, path: str, product: Sequence[S.BandSpec], time=None
) -> DataFrame:
    """A stored pixel table of a product, with its declared schema."""
    stored = spark.read.schema(S.pixel_schema(tuple(product))).parquet(path)
    return scan_pixels(stored, [b.name for b in product], time)


def write_pixels(pixels: DataFrame, path: str, files_per_tile: int = 1) -> None:
    """Store a pixel table: one folder per tile, rows sorted by row and time.

    Drills join on ``tile_id``, so tiles without a polygon are never opened; the
    sort gives tight row-group ranges for ``y`` and ``ts``. Rows of a tile go to
    ``files_per_tile`` writers by scene, so a much-observed tile is split.
    """
    part = F.pmod(F.hash("scene_id"), F.lit(files_per_tile))
    (
        pixels.withColumn("_part", part)
        .repartition("tile_id", "_part")
        .drop("_part")
        .sortWithinPartitions("tile_id", "y", "ts")
        .write.mode("overwrite")
        .partitionBy("tile_id")
        .parquet(path)
    )


def write_bucketed(pixels: DataFrame, table: str, buckets: int) -> None:
    """Store a pixel table bucketed by tile and time, for products that are aligned.

    Tables with the same number of buckets meet on ``(ts, tile_id, y, x)`` without a
    shuffle (``tuning.SESSION_CONF`` lets a join be satisfied with buckets on some of its
    keys). Neither a tile nor a time is one bucket. Rows of a bucket are sorted by tile, so
    a filter on tiles skips row groups.
    """
    keys = ("tile_id", "ts")
    (
        pixels.repartition(buckets, *keys)
        .sortWithinPartitions(*keys, "y", "x")
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys, "y", "x")
        .saveAsTable(table)
    )
