"""The pixel grid: an affine map from coordinates to rows, columns and tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# Bits of a Morton number, for 2^30 tile columns and rows.
_MORTON = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
_ROW_SHIFT = 1 << 29


def _spread_bits(n: Column) -> Column:
    """Bits of a number below 2^30 with a gap after each."""
    n = n.cast("bigint")
    for shift, mask in _MORTON:
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


@dataclass(frozen=True)
class Grid:
    """Pixel ``(x, y)`` covers the square from its corner to the next one.

    ``res_y`` is negative for a grid whose rows run southwards. ``tile`` is the
    edge of a square block of pixels; the tile number is a stored column of the
    pixel table, so joining on it prunes files and bounds the size of a group.

    Pixel and tile coordinates run both ways from the origin. Tile columns
    ``first_tile_x`` up to ``first_tile_x + tiles_across - 1`` are on the grid, by default
    as many on either side of the origin; tile rows have no limit, and ``first_tile_y`` only says where numbers start. So every
    tile has a number of its own.

    ``curve`` numbers tiles along a Morton curve instead of row by row: near tiles have near
    numbers in both directions, so the tiles under a request are few intervals.
    """

    origin_x: float = 0.0
    origin_y: float = 0.0
    res_x: float = 1.0
    res_y: float = 1.0
    tile: int = 256
    tiles_across: int = 1 << 20
    first_tile_x: int | None = None
    first_tile_y: int = 0
    curve: bool = False

    def __post_init__(self) -> None:
        if self.first_tile_x is None:
            object.__setattr__(self, "first_tile_x", -(self.tiles_across // 2))

    def col(self, vx: Column) -> Column:
        """Fractional column of an easting or longitude."""
        return (vx - F.lit(self.origin_x)) / F.lit(self.res_x)

    def row(self, vy: Column) -> Column:
        """Fractional row of a northing or latitude."""
        return (vy - F.lit(self.origin_y)) / F.lit(self.res_y)

    def x_centre(self, x: Column) -> Column:
        return F.lit(self.origin_x) + (x + F.lit(0.5)) * F.lit(self.res_x)

    def y_centre(self, y: Column) -> Column:
        return F.lit(self.origin_y) + (y + F.lit(0.5)) * F.lit(self.res_y)

    def block(self, cell: Column) -> Column:
        """Tile row or tile column of a pixel row or column (floors below zero)."""
        return F.floor(cell / F.lit(float(self.tile))).cast("bigint")

    @property
    def first_col(self) -> int:
        return self.first_tile_x * self.tile

    @property
    def last_col(self) -> int:
        return (self.first_tile_x + self.tiles_across) * self.tile - 1

    def tile_number(self, tx: Column, ty: Column) -> Column:
        """Number of the tile in column ``tx`` and row ``ty``."""
        if self.curve:
            # Rows run both ways, so they are counted from far north of any grid.
            return _spread_bits(tx - F.lit(self.first_tile_x)).bitwiseOR(
                F.shiftleft(_spread_bits(ty - F.lit(self.first_tile_y) + F.lit(_ROW_SHIFT)), 1)
            )
        return (ty - F.lit(self.first_tile_y)) * F.lit(self.tiles_across) + (tx - F.lit(self.first_tile_x))

    def tile_id(self, x: Column, y: Column) -> Column:
        return self.tile_number(self.block(x), self.block(y))
