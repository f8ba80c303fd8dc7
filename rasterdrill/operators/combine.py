"""Putting products together: stacking sensors, aligning bands, merging overlaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterdrill import schema as S

PIXEL_KEY = ("grp", "tile_id", "y", "x")


def collate(products: Mapping[str, DataFrame], name: str = "product") -> DataFrame:
    """Stack products that share bands, each row tagged with its product."""
    tagged = [df.withColumn(name, F.lit(label)) for label, df in products.items()]
    return reduce(DataFrame.unionByName, tagged)


def juxtapose(left: DataFrame, right: DataFrame, keys: Sequence[str] = PIXEL_KEY) -> DataFrame:
    """Bands of two products side by side where both have the time and the pixel.

    Each side is unique on ``keys`` (fused, or one scene per time). Sides that
    were fused on the same keys are already partitioned on them, so the join
    adds no shuffle.
    """
    return left.join(right, list(keys))


def collate_beside(
    base: DataFrame, products: Mapping[str, DataFrame], keys: Sequence[str], name: str = "product"
) -> DataFrame:
    """:func:`juxtapose` of ``base`` with :func:`collate` of ``products``, without their union.

    Each row of ``base`` comes once per product that has its key. A union forgets how its
    parts are bucketed and would be shuffled; an outer join for each product keeps the
    partitioning of ``base``, and every table is read once. Each product is unique on ``keys``.
    """
    bands = [c for c in next(iter(products.values())).columns if c not in keys]
    out, sides = base, []
    for i, (label, df) in enumerate(products.items()):
        side = df.select(*keys, F.struct(F.lit(label).alias(name), *bands).alias(f"_side{i}"))
        out = out.join(side, list(keys), "left")
        sides.append(F.col(f"_side{i}"))
    held = F.filter(F.array(*sides), lambda s: s.isNotNull())
    return out.select(*base.columns, F.inline(held))


def with_scene(
    pixels: DataFrame, scenes: DataFrame, *columns: str, on: Sequence[str] = ("scene_id",)
) -> DataFrame:
    """Keep pixels of the given scenes and add scene columns.

    ``scenes`` carries its own broadcast hint (see ``tuning.counted`` and ``tuning.beside``).
    Where scenes name the tile they cover, ``on`` may hold it.
    """
    return pixels.join(scenes.select(*on, *columns), list(on))


def with_scene_tiles(pixels: DataFrame, tiles: DataFrame, *columns: str) -> DataFrame:
    """:func:`with_scene` by scene and tile (see ``geometry.scene_tiles``)."""
    return with_scene(pixels, tiles, *columns, on=("scene_id", "tile_id"))


def water_is_valid(value: Column) -> Column:
    return value.bitwiseAND(F.lit(1)) == 0


# An integer band and its turn share one long, turn first.
_SHIFT, _OFFSET = 1 << 32, 1 << 31


def _chosen(band: str, dtype: T.DataType, turn: Column, last: bool) -> Column:
    """Aggregate: the band's value at its first or last turn; null turns do not count.

    For integer bands the turn and the value are packed into one long, so the
    choice is a plain min or max and the shuffled row is half as wide.
    """
    if not isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.max_by(band, turn) if last else F.min_by(band, turn)
    packed = turn.cast("bigint") * F.lit(_SHIFT) + F.col(band).cast("bigint") + F.lit(_OFFSET)
    best = F.max(packed) if last else F.min(packed)
    return (F.pmod(best, F.lit(_SHIFT)) - F.lit(_OFFSET)).cast(dtype)


def fuse(
    pixels: DataFrame,
    first_valid: Mapping[str, float] | None = None,
    water: str | None = None,
    keys: Sequence[str] = PIXEL_KEY,
    order: str = "ord",
) -> DataFrame:
    """One row per key from overlapping scenes of a group, in one aggregate.

    Bands in ``first_valid`` take the first source that is not their nodata;
    ``water`` takes the last source whose nodata bit is clear. A pixel without
    a valid source is nodata.

    Products that share scenes are fused together, each band by its own rule.
    The key holds the pixel, so no group exceeds the scenes over one pixel in
    one day, whatever polygon, scene or day dominates the table. All buffers are
    fixed-width numbers, which keeps this a hash aggregate.
    """
    aggs = []
    for band, nodata in (first_valid or {}).items():
        turn = F.when(F.col(band) != F.lit(nodata), F.col(order))
        first = _chosen(band, pixels.schema[band].dataType, turn, last=False)
        aggs.append(F.coalesce(first, F.lit(nodata)).alias(band))
    if water is not None:
        turn = F.when(water_is_valid(F.col(water)), F.col(order))
        last = _chosen(water, pixels.schema[water].dataType, turn, last=True)
        aggs.append(F.coalesce(last, F.lit(S.WATER_NODATA)).alias(water))
    return pixels.groupBy(*keys).agg(*aggs)


def fuse_water(pixels: DataFrame, keys: Sequence[str] = PIXEL_KEY) -> DataFrame:
    return fuse(pixels, water="water", keys=keys)


def fuse_first_valid(
    pixels: DataFrame, bands: Mapping[str, float], keys: Sequence[str] = PIXEL_KEY
) -> DataFrame:
    return fuse(pixels, first_valid=bands, keys=keys)


def apply_mask(df: DataFrame, mask: str, nodata: Mapping[str, float]) -> DataFrame:
    """Bands in ``nodata`` become their sentinel where ``mask`` is not true; mask goes."""
    keep = F.coalesce(F.col(mask), F.lit(False))
    masked = {
        b: F.when(keep, F.col(b)).otherwise(F.lit(nd).cast(df.schema[b].dataType))
        for b, nd in nodata.items()
    }
    return df.withColumns(masked).drop(mask)
