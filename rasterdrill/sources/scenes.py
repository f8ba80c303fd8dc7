"""Scene metadata: filters that need no pixel, and the grouping of scenes in time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterdrill import schema as S
from rasterdrill.sources.times import time_between


def filter_time_range(df: DataFrame, time=None, ts: str = "ts") -> DataFrame:
    """Keep rows inside ``time``; a year, month or day counts whole; None keeps all."""
    return df if time is None else df.filter(time_between(F.col(ts), time))


def filter_scene_quality(
    scenes: DataFrame, column: str = "gqa_iterative_mean_xy", bounds=S.QUALITY_RANGE
) -> DataFrame:
    """Keep scenes whose quality figure lies in ``bounds``, ends included."""
    return scenes.filter(F.col(column).between(*bounds))


def sensor_in_epoch(
    product: Column, ts: Column, epochs: Mapping[str, tuple] = S.SENSOR_EPOCHS
) -> Column:
    """True where the sensor was in use; a sensor without an entry never is."""
    out = F.lit(False)
    for name, periods in epochs.items():
        for start, end in periods:
            inside = product == F.lit(name)
            if start is not None:
                inside = inside & (ts >= F.lit(start).cast("timestamp_ntz"))
            if end is not None:
                inside = inside & (ts <= F.lit(end).cast("timestamp_ntz"))
            out = out | inside
    return out


def filter_sensor_epoch(
    scenes: DataFrame, product: str = "product", ts: str = "ts", epochs=S.SENSOR_EPOCHS
) -> DataFrame:
    return scenes.filter(sensor_in_epoch(F.col(product), F.col(ts), epochs))


def solar_day(ts: Column, lon: Column) -> Column:
    """Local solar date: the Earth turns one degree in 240 seconds."""
    shift = F.make_dt_interval(secs=F.floor(lon * F.lit(240)).cast("decimal(18,6)"))
    return (ts + shift).cast("date")


def group_scenes(scenes: DataFrame, by: str = "solar_day") -> DataFrame:
    """Add ``grp``, the time group of a scene, and ``ord``, its order inside the group.

    ``by`` is 'solar_day' or 'exact'. The order is by time then scene number, a
    unique key; as one small integer it lets the merge of overlapping scenes run
    as a hash aggregate. Groups hold the scenes of one day, so no window
    partition grows with the archive's length.
    """
    grp = F.col("ts") if by == "exact" else solar_day(F.col("ts"), F.col("lon"))
    order = Window.partitionBy("grp").orderBy("ts", "scene_id")
    return scenes.withColumn("grp", grp).withColumn("ord", F.row_number().over(order))


def group_solar_day(scenes: DataFrame, *keys: str) -> DataFrame:
    """One row per solar day (and ``keys``), labelled with its first scene time."""
    return (
        scenes.withColumn("solar_day", solar_day(F.col("ts"), F.col("lon")))
        .groupBy(*keys, "solar_day")
        .agg(F.min("ts").alias("time"), F.count(F.lit(1)).alias("n_scenes"))
    )
