"""Per-pixel expressions: bit flags, water classes, wetness, dominant cover.

Each takes and returns columns built from Spark's own functions, so they stay
inside generated code.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterdrill import schema as S


def _bits(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask))


def has_flag(value: Column, flag: S.Flag) -> Column:
    return _bits(value, flag.mask) == F.lit(flag.match)


def decode_flags(value: Column, flags: Iterable[S.Flag] = S.WATER_FLAGS) -> Column:
    """Names of all flags that hold, in the order of the flag table."""
    return F.array_compact(F.array(*[F.when(has_flag(value, f), F.lit(f.name)) for f in flags]))


def flag_mask(
    value: Column, wanted: Mapping[str, bool], flags: Iterable[S.Flag] = S.WATER_FLAGS
) -> Column:
    """True where every named flag has the wanted state."""
    by_name = {f.name: f for f in flags}
    out = F.lit(True)
    for name, state in wanted.items():
        held = has_flag(value, by_name[name])
        out = out & (held if state else ~held)
    return out


def classify_water(value: Column, flags: Iterable[S.Flag] = S.WATER_FLAGS) -> Column:
    """'wet', 'dry' or 'not observable' of a water bit field; first rule wins."""
    by_name = {f.name: f for f in flags}

    def held(name: str) -> Column:
        return has_flag(value, by_name[name])

    spoilt = (
        held("terrain_or_low_angle") | held("cloud_shadow") | held("cloud")
        | held("high_slope") | held("noncontiguous")
    )
    return (
        F.when(spoilt, F.lit("not observable"))
        .when(held("dry") & held("sea"), F.lit("not observable"))
        .when(held("dry"), F.lit("dry"))
        .when(held("wet") | held("sea"), F.lit("wet"))
        .otherwise(F.lit("not observable"))
    )


def water_value(value: Column) -> Column:
    """1 for clear observed water, else 0. Slope, terrain and sea bits are ignored."""
    wet = (_bits(value, 0b1000_0000) != 0) & (_bits(value, 0b0110_0011) == 0)
    return F.coalesce(wet, F.lit(False)).cast("int")


def pixel_quality_mask(fmask: Column, contiguity: Column, water: Column) -> Column:
    """True for clear, contiguous pixels that are not water."""
    good = ~fmask.isin(0, 2, 3) & (contiguity == 1) & (_bits(water, 0b1110_0011) == 0)
    return F.coalesce(good, F.lit(False))


def tasselled_cap(
    category: str = "wetness",
    coefficients: Mapping[str, Mapping[str, float]] = S.TASSELLED_CAP,
    nodata: Mapping[str, float] | None = None,
    missing: float = S.WETNESS_NODATA,
) -> Column:
    """Weighted band sum; ``missing`` where any band is at or below its nodata."""
    nodata = nodata or {}
    total = None
    for band, weight in coefficients[category].items():
        low = nodata.get(band, S.REFLECTANCE_NODATA)
        term = F.when(F.col(band) > F.lit(low), F.col(band) * F.lit(float(weight)))
        total = term if total is None else total + term
    return F.coalesce(total, F.lit(float(missing))).cast("float")


def tasselled_cap_name(category: str = "wetness") -> str:
    return "TC" + category[0].upper()


def is_valid(value: Column, nodata: float) -> Column:
    """False at the nodata sentinel, within a small tolerance."""
    return F.abs(value - F.lit(nodata)) >= F.lit(S.NODATA_TOLERANCE)


def nodata_to_null(value: Column, nodata: float) -> Column:
    return F.when(is_valid(value, nodata), value)


def null_to_nodata(value: Column, nodata: float) -> Column:
    return F.coalesce(value, F.lit(nodata))


def dominant_cover(bs: Column, pv: Column, npv: Column) -> Column:
    """'BS', 'PV' or 'NPV', ties to the first; null unless all three are present."""
    b, p, n = (c.cast("smallint") for c in (bs, pv, npv))
    return F.when(
        b.isNotNull() & p.isNotNull() & n.isNotNull(),
        F.when((b >= p) & (b >= n), F.lit("BS")).when(p >= n, F.lit("PV")).otherwise(F.lit("NPV")),
    )


def is_wet(wetness: Column, threshold: float = S.WET_THRESHOLD) -> Column:
    return wetness > F.lit(threshold)


def is_dry_ground(wetness: Column, threshold: float = S.WET_THRESHOLD) -> Column:
    """Strictly below the threshold: a pixel exactly at it is neither wet nor dry."""
    return wetness < F.lit(threshold)
