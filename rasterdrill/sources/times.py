"""Time ranges whose ends may be whole years, months or days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths of a year, a month and a day in ISO form.
_YEAR, _MONTH, _DAY = 4, 7, 10


def instant(text: Column) -> Column:
    """The UTC time of an ISO text; null if malformed.

    An offset or Z at the end is applied; a text without one is UTC as it stands. It does
    not hang on the session's time zone.
    """
    t = F.trim(text)
    zoned = t.rlike(r"[T ][0-9:.]+\s*(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)$")
    seconds = (F.unix_micros(t.try_cast("timestamp")) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    utc = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return F.when(zoned, utc).otherwise(t.try_cast("timestamp_ntz"))


def first_moment(text: Column) -> Column:
    """First microsecond of an ISO year, month, day or instant; null if malformed."""
    t = F.trim(text)
    padded = (
        F.when(F.length(t) == _YEAR, F.concat(t, F.lit("-01-01")))
        .when(F.length(t) == _MONTH, F.concat(t, F.lit("-01")))
        .otherwise(t)
    )
    return instant(padded)


def last_moment(text: Column) -> Column:
    """Last microsecond of an ISO year, month or day; an instant is itself."""
    t, start = F.trim(text), first_moment(text)
    microsecond = F.expr("INTERVAL '0.000001' SECOND")
    return (
        F.when(F.length(t) == _YEAR, start + F.expr("INTERVAL '1' YEAR") - microsecond)
        .when(F.length(t) == _MONTH, start + F.expr("INTERVAL '1' MONTH") - microsecond)
        .when(F.length(t) == _DAY, start + F.expr("INTERVAL '1' DAY") - microsecond)
        .otherwise(start)
    )


def time_between(ts: Column, time) -> Column:
    """``ts`` inside one ISO value, or inside a pair of them, both ends included.

    The ends are constants, so the condition reaches the file scan.
    """
    start, end = (time, time) if isinstance(time, str) else time
    return (ts >= first_moment(F.lit(str(start)))) & (ts <= last_moment(F.lit(str(end))))


def inside_request(ts: Column, start: Column, end: Column) -> Column:
    """``ts`` inside a request's own range; a request missing either end takes all."""
    given = start.isNotNull() & end.isNotNull()
    return ~given | ((ts >= first_moment(start)) & (ts <= last_moment(end)))


# Ends of a range that holds no time.
_NEVER = ("9999-12-31 00:00:00", "0001-01-01 00:00:00")


def read_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """``(key, start, end)`` of requests as times, for :func:`inside_range`.

    Texts are read here once per request; :func:`inside_request` reads them again for each
    row they meet. A range missing either end has neither, and one with an end that cannot
    be read holds no time.
    """
    given = F.col("start").isNotNull() & F.col("end").isNotNull()
    ends = first_moment(F.col("start")), last_moment(F.col("end"))
    good = ends[0].isNotNull() & ends[1].isNotNull()
    never = [F.lit(t).cast("timestamp_ntz") for t in _NEVER]
    return ranges.select(
        key, *[F.when(given, F.when(good, t).otherwise(n)).alias(c) for c, t, n in zip(("start", "end"), ends, never)]
    )


def inside_range(ts: Column, start: Column, end: Column) -> Column:
    """``ts`` inside a range of :func:`read_ranges`; a request without one takes all."""
    return start.isNull() | ((ts >= start) & (ts <= end))
