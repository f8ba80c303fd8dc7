"""Drill results as chart data, CSV text, JSON and files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterdrill import schema as S


# --- chart data --------------------------------------------------------------

def melt_cover(
    df: DataFrame, series: Sequence[str], keys: Sequence[str] = ("poly_id", "time")
) -> DataFrame:
    """Long form ``(*keys, Cover Type, Area)`` without missing values."""
    doubled = df.select(*keys, *[F.col(f"`{s}`").cast("double").alias(s) for s in series])
    return doubled.unpivot(list(keys), list(series), "Cover Type", "Area").dropna(subset=["Area"])


def normalized_stack(
    df: DataFrame, series: Sequence[str], keys: Sequence[str] = ("poly_id", "time")
) -> DataFrame:
    """:func:`melt_cover` with ``share``: each type's part of its time's total.

    The total is taken across the columns of the wide row, before it is melted,
    so no shuffle is needed.
    """
    values = {s: F.col(f"`{s}`").cast("double") for s in series}
    total = None
    for v in values.values():
        part = F.coalesce(v, F.lit(0.0))
        total = part if total is None else total + part
    rows = F.explode(
        F.array(*[F.struct(F.lit(s).alias("Cover Type"), v.alias("Area")) for s, v in values.items()])
    )
    return (
        df.select(*keys, total.alias("_total"), rows.alias("_r"))
        .select(*keys, "_total", "_r.*")
        .dropna(subset=["Area"])
        .withColumn("share", F.col("Area") / F.nullif(F.col("_total"), F.lit(0.0)))
        .drop("_total")
    )


def style_table(
    spark: SparkSession, process: str, series: Mapping[str, str] | None = None
) -> DataFrame:
    """``(series, label, color, units, active, ord)`` of a drill's chart."""
    style = S.STYLES[process]
    series = series or {label: label for label in style}
    rows = [
        (short, label, style[label]["chartLineColor"], style[label]["units"], style[label]["active"], i)
        for i, (short, label) in enumerate(series.items())
    ]
    return spark.createDataFrame(
        rows, "series string, label string, color string, units string, active boolean, ord int"
    )


def style_join(melted: DataFrame, styles: DataFrame) -> DataFrame:
    """Attach label, colour and drawing order. Styles are a fixed handful of rows."""
    return melted.join(F.broadcast(styles), melted["Cover Type"] == styles["series"]).drop("series")


def wofs_tick_series(observations: DataFrame) -> DataFrame:
    """``point_id, time, observation, color, title`` of the point drill's chart."""
    colours = F.lit(None)
    for name, colour in S.OBSERVATION_COLOURS.items():
        colours = F.when(F.col("observation") == name, F.lit(colour)).otherwise(colours)
    return observations.select(
        "point_id", "time", "observation",
        colours.alias("color"),
        F.format_string("Water Observations for %.6f,%.6f", "latitude", "longitude").alias("title"),
    )


# --- text --------------------------------------------------------------------

def _line(values: Sequence[Column]) -> Column:
    return F.concat_ws(",", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def drill_to_csv(df: DataFrame, series: Mapping[str, str], key: str = "poly_id") -> DataFrame:
    """``(key, data)``: one CSV text per request, time first, under given labels.

    ``series`` maps result columns to labels. Dates are written without the time
    of day, missing values as nothing. A request has one line per time.
    """
    lines = df.select(
        key, "time",
        _line([F.date_format("time", "yyyy-MM-dd"), *[F.col(f"`{c}`") for c in series]]).alias("line"),
    )
    head = ",".join(["time", *series.values()]) + "\n"
    return lines.groupBy(key).agg(
        F.concat(
            F.lit(head),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("time", "line"))), lambda r: r["line"]),
                "\n",
            ),
            F.lit("\n"),
        ).alias("data")
    )


def drill_catalog_json(csv: DataFrame, process: str, key: str = "poly_id") -> DataFrame:
    """``(key, json)``: the CSV wrapped as a catalogue entry with its table style."""
    fields = {
        "data": F.col("data"),
        "isEnabled": F.lit(S.RESULT_ENABLED[process]),
        "type": F.lit("csv"),
        "name": F.lit(S.RESULT_NAME[process]),
    }
    entry = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    style = json.dumps({"tableStyle": {"columns": S.STYLES[process]}}, separators=(",", ":"))
    # The style is a constant, so it is appended as text: {...entry} + {...style}.
    body = F.expr("substr(_entry, 1, length(_entry) - 1)")
    return csv.withColumn("_entry", entry).select(
        key, F.concat(body, F.lit("," + style[1:])).alias("json")
    )


# --- files -------------------------------------------------------------------

def write_drill_parquet(df: DataFrame, base: str, identifier: str, run_id: str) -> str:
    """Store a result as Snappy Parquet under its drill and run; returns the folder.

    Writing a run again replaces that run only, so a failed job can be repeated.
    """
    path = f"{base.rstrip('/')}/identifier={identifier}/run_id={run_id}"
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def read_drill_parquet(spark: SparkSession, base: str) -> DataFrame:
    """All stored results, with ``identifier`` and ``run_id`` as columns."""
    return spark.read.option("basePath", base).parquet(f"{base.rstrip('/')}/identifier=*/run_id=*")


def write_drill_csv(df: DataFrame, path: str) -> None:
    """Bulk CSV: one header per file, dates without the time of day."""
    day = df.withColumn("time", F.date_format("time", "yyyy-MM-dd"))
    day.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
