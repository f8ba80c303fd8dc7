"""Compositing over time: windows anchored at their first time."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterdrill import schema as S
from rasterdrill.functions.pixel import is_valid


def anchored_windows(
    times: DataFrame,
    days: int | str,
    key: str = "poly_id",
    time: str = "ts",
    keep_trailing: bool = False,
    turns: bool = False,
) -> DataFrame:
    """Windows of whole-day length over each key's times.

    A window starts at a time and takes every later one less than ``days`` whole
    days away; the next time starts another. Returns ``(key, time, anchor,
    n_times)`` for each time. A last window that holds only the last time is
    dropped unless ``keep_trailing``. Rows without a time are left out. ``days`` may
    name a column, one value per key, which is returned too; where it is 0 every
    time is a window, none dropped. With ``turns`` each time has its ``turn`` in the window,
    from 0.

    Times are sorted by Spark, spilling as it needs, and one pass walks them. It
    holds one window and one batch, however long a series is.
    """
    of_days = F.lit(days) if isinstance(days, int) else F.col(days)
    distinct = times.select(key, F.col(time).alias("_t"), of_days.cast("int").alias("_days"))
    distinct = distinct.filter("_t IS NOT NULL").distinct()
    kind = times.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField(time, T.TimestampNTZType()),
        T.StructField("anchor", T.TimestampNTZType()), T.StructField("n_times", T.LongType()),
        T.StructField("days", T.IntegerType()), T.StructField("turn", T.LongType()),
    ])

    def emit(keys: pa.Array, t: np.ndarray, n_days: int, starts: list[int], end: int) -> pa.RecordBatch:
        size = np.diff([*starts, end])
        moments = pa.array(t[:end]).cast(pa.timestamp("us"))
        anchor = pa.array(np.repeat(t[starts], size)).cast(pa.timestamp("us"))
        turn = pa.array(np.arange(end) - np.repeat(starts, size))
        columns = [keys[:end], moments, anchor, pa.array(np.repeat(size, size)), pa.array(np.full(end, n_days, np.int32)), turn]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, t, d = None, None, None  # the window that is open, of one key
        for batch in batches:
            if not batch.num_rows:
                continue
            more, u, v = batch.column(0), batch.column(1).cast(pa.int64()).to_numpy(), batch.column(2).to_numpy()
            keys, t, d = (more, u, v) if keys is None else (pa.concat_arrays([keys, more]), np.append(t, u), np.append(d, v))
            same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
            both_null = keys.is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(~(same | (both_null[1:] & both_null[:-1]))) + 1
            for a, b in zip([0, *cuts], [*cuts, len(t)]):
                starts, i, own, n_days = [], 0, t[a:b], int(d[a])
                length = max(n_days * 86_400_000_000, 1)
                while i < len(own):
                    starts.append(i)
                    i = int(np.searchsorted(own, own[i] + length))
                end = len(own)
                open_ = b == len(t)  # the key may go on in the next batch
                if open_ or end - starts[-1] == 1 and n_days and not keep_trailing:
                    end = starts.pop()
                if starts:
                    yield emit(keys[a:b], own, n_days, starts, end)
                if open_:
                    keys, t, d = keys[a + end : b], own[end:], d[a + end : b]
        if keys is not None and (len(t) > 1 or not d[0] or keep_trailing):
            yield emit(keys, t, int(d[0]), [0], len(t))

    sorted_ = distinct.repartition(key).sortWithinPartitions(key, "_t")
    out = sorted_.mapInArrow(walk, schema)
    return out.drop(*(["days"] if isinstance(days, int) else []), *([] if turns else ["turn"]))


def _means(nodata: Mapping[str, float], water: str) -> dict[str, Column]:
    def mean(band: str, nd: float) -> Column:
        value = F.when(is_valid(F.col(band), nd), F.col(band).cast("double"))
        full = F.count(value) == F.max("n_times")
        return F.when(full, F.sum(value) / F.max("n_times")).otherwise(F.lit(nd)).cast("float")

    return {b: mean(b, nd) for b, nd in nodata.items()} | {water: F.sum(water).cast("int")}


def average_over_day(
    pixels: DataFrame, keys: list[str], nodata: Mapping[str, float], water: str = "water"
) -> DataFrame:
    """Mean per pixel over a window; nodata if any of the window's times is nodata.

    ``pixels`` carry ``n_times`` of their window, so a pixel absent at some time
    counts as nodata there. Water is the number of times with water.
    """
    return pixels.groupBy(*keys).agg(*[c.alias(n) for n, c in _means(nodata, water).items()])


def _first_values(nodata: Mapping[str, float], time: str, lead: str, water: str) -> list[Column]:
    """Aggregates of :func:`composite_first_valid`, to be chosen from by :func:`_settled`."""
    t = F.col(time)
    settled = F.when(is_valid(F.col(lead), nodata[lead]) | (F.col(water) > 0), t)
    aggs = [
        F.min(settled).alias("_k"),
        F.min_by(lead, settled).alias("_lead"),
        F.min_by(water, settled).alias("_water"),
    ]
    for b in nodata:
        if b != lead:
            seen = F.when(is_valid(F.col(b), nodata[b]), t)
            aggs += [F.min(seen).alias(f"_t_{b}"), F.min_by(b, seen).alias(f"_v_{b}")]
    return aggs


def _settled(nodata: Mapping[str, float], lead: str, water: str) -> dict[str, Column]:
    def pick(band: str) -> Column:
        too_late = (F.col("_water") > 0) & (F.col(f"_t_{band}") > F.col("_k"))
        usable = F.col(f"_t_{band}").isNotNull() & ~F.coalesce(too_late, F.lit(False))
        return F.when(usable, F.col(f"_v_{band}")).otherwise(F.lit(nodata[band]))

    return {b: pick(b) for b in nodata if b != lead} | {
        lead: F.coalesce(F.col("_lead"), F.lit(float(nodata[lead])).cast("float")),
        water: F.coalesce(F.col("_water"), F.lit(S.WATER_VALUE_NODATA)),
    }


def composite_first_valid(
    pixels: DataFrame,
    keys: list[str],
    nodata: Mapping[str, float],
    time: str = "ts",
    lead: str = "TCW",
    water: str = "water",
) -> DataFrame:
    """First usable value per pixel over a window, water ending the search.

    A pixel settles at its first time with a valid ``lead`` band or with water;
    that time gives the lead band and water. Other bands take their first valid
    value, but none from after a time at which water settled the pixel.

    Water is only ever seen where the other bands are masked out, which makes
    this closed form equal to a walk through the times in order.
    """
    out = pixels.groupBy(*keys).agg(*_first_values(nodata, time, lead, water))
    return out.select(*keys, *[c.alias(n) for n, c in _settled(nodata, lead, water).items()])


# A turn and a whole number or null share one long, turn first.
_SHIFT, _OFFSET = 1 << 33, (1 << 31) + 1
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType)


def _packed(turn: Column, value: Column) -> Column:
    return turn.cast("bigint") * F.lit(_SHIFT) + F.coalesce(value.cast("bigint") + F.lit(_OFFSET), F.lit(0))


def _unpacked(packed: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The turn and the value of :func:`_packed`."""
    value = F.nullif(F.pmod(packed, F.lit(_SHIFT)), F.lit(0).cast("bigint")) - F.lit(_OFFSET)
    return F.shiftright(packed, 33), value.cast(kind)


def composite_either(
    pixels: DataFrame,
    keys: list[str],
    nodata: Mapping[str, float],
    turn: str = "turn",
    lead: str = "TCW",
    water: str = "water",
) -> DataFrame:
    """:func:`composite_first_valid` where windows are longer than a day, else :func:`average_over_day`.

    ``pixels`` carry ``days`` and ``n_times`` of their window and their ``turn`` in it (see
    :func:`anchored_windows`). Both are taken in one aggregate, so pixels are read and moved
    once. Whole numbers are packed with their turn, as a group's buffer is held for every pixel.
    """
    kinds = {c: pixels.schema[c].dataType for c in (*nodata, water)}
    t, long_ = F.col(turn), F.col("days") > 1
    # A group is of one window, so one number says its rule and, for means, its times.
    pixels = pixels.withColumn("n_times", F.when(long_, F.lit(-1)).otherwise(F.col("n_times")))
    means = _means(nodata, water)
    settled = F.when(is_valid(F.col(lead), nodata[lead]) | (F.col(water) > 0), t)
    seen = {b: F.when(is_valid(F.col(b), nodata[b]), t) for b in nodata if b != lead}
    turns = {water: settled} | seen
    aggs, found = [F.min_by(lead, settled).alias("_lead")], {}
    for c, at in turns.items():
        if isinstance(kinds[c], _WHOLE):
            aggs.append(F.min(_packed(at, F.col(c))).alias(f"_p_{c}"))
            found[c] = _unpacked(F.col(f"_p_{c}"), kinds[c])
        else:
            aggs += [F.min(at).alias(f"_p_{c}"), F.min_by(c, at).alias(f"_q_{c}")]
            found[c] = F.col(f"_p_{c}"), F.col(f"_q_{c}")
    out = pixels.groupBy(*keys).agg(
        (F.max("n_times") < 0).alias("_first"), *[c.alias(f"_m_{n}") for n, c in means.items()], *aggs
    )
    k, wet = found.pop(water)
    names = {"_k": k, "_water": wet} | {f"_{n}_{b}": v for b, pair in found.items() for n, v in zip("tv", pair)}
    out = out.withColumns(names)
    chosen = _settled(nodata, lead, water)
    return out.select(*keys, *[F.when(F.col("_first"), chosen[n]).otherwise(F.col(f"_m_{n}")).alias(n) for n in means])
