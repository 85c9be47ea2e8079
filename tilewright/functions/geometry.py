"""Sizes, levels, tiles and view geometry as column expressions.  Pixel counts are BIGINT throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import DEFAULT

MIN_ZOOM, MAX_ZOOM = 0.01, 32.0
FIT_MARGIN, MIN_VISIBLE = 32, 64
TINY_ZOOM = 1e-6


def long(c: Column | str | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c).cast("long")


def idiv(a: Column, b: Column | int) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.call_function("div", long(a), long(b))


def ceil_div(a: Column, b: Column | int) -> Column:
    return idiv(long(a) + long(b) - 1, b)


def pow2(level: Column) -> Column:
    """2 to the power of a column."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def fit_within(w: Column, h: Column, most: Column | int) -> Column:
    """STRUCT<width, height>: the longest side becomes ``most`` where it is longer."""
    most = long(most)
    fits = (w <= most) & (h <= most)
    fw = F.when(fits, long(w)).when(w >= h, most).otherwise(F.greatest(idiv(long(w) * most, h), long(1)))
    fh = F.when(fits, long(h)).when(w >= h, F.greatest(idiv(long(h) * most, w), long(1))).otherwise(most)
    return F.struct(fw.alias("width"), fh.alias("height"))


def level_side(side: Column, level: Column | int) -> Column:
    """A side after ``level`` halvings that round up."""
    return ceil_div(side, pow2(F.lit(level) if isinstance(level, int) else level))


def max_level(w: Column, h: Column, tile: Column | int) -> Column:
    """Halvings until both sides fit a tile."""
    longest, tile = F.greatest(long(w), long(h)), long(tile)
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda z: ceil_div(longest, pow2(z)) > tile)).cast("int")


def tile_grid(w: Column, h: Column, tile: Column | int) -> Column:
    return F.struct(ceil_div(w, tile).alias("tiles_x"), ceil_div(h, tile).alias("tiles_y"))


def tile_rect(w: Column, h: Column, tile: Column | int, tx: Column, ty: Column) -> Column:
    tile = long(tile)
    return F.struct(
        (tx * tile).alias("x"), (ty * tile).alias("y"), F.least(tile, long(w) - tx * tile).alias("width"), F.least(tile, long(h) - ty * tile).alias("height")
    )


def nearest_index(target: Column, source_size: Column | int, target_size: Column | int) -> Column:
    return idiv(long(target) * long(source_size), target_size)


def raster_max_side(w: Column, h: Column, budget: int = DEFAULT.raster_max_bytes) -> Column:
    """Null where a 24-bit raster is within the budget, else the longest side that is."""
    size = long(w) * long(h) * 3
    side = F.floor(F.greatest(w, h).cast("double") * F.sqrt(F.lit(float(budget)) / size.cast("double")))
    return F.when(size > budget, F.greatest(side.cast("long"), long(1)))


def row_stride(w: Column, bytes_per_pixel: Column | int) -> Column:
    return idiv(long(w) * long(bytes_per_pixel) + 3, 4) * 4


def row_offset(data_offset: Column, stride: Column, height: Column, bottom_up: Column, row: Column) -> Column:
    stored = F.when(bottom_up, long(height) - 1 - long(row)).otherwise(long(row))
    return long(data_offset) + stored * long(stride)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.least(F.greatest(value, low), high)


@dataclass(frozen=True)
class View:
    """Columns of a view: zoom, offset, viewport, image size and rotation."""

    zoom: Column
    ox: Column
    oy: Column
    vw: Column
    vh: Column
    w: Column
    h: Column
    rotation: Column

    @classmethod
    def of_columns(cls) -> "View":
        return cls(*[F.col(c) for c in ("zoom", "ox", "oy", "vw", "vh", "w", "h", "rotation")])

    def shown(self) -> tuple[Column, Column]:
        """Image size as displayed: sides swap at a quarter turn."""
        turned = self.rotation.isin(90, 270)
        return F.when(turned, self.h).otherwise(self.w), F.when(turned, self.w).otherwise(self.h)


def visible_rect(v: View) -> Column:
    """STRUCT<x0, y0, x1, y1>: the part of the image that the viewport shows, in image pixels.

    A quarter turn maps a viewport axis to one image axis, so the box of the four corners is that of two.
    """
    zoom = F.greatest(v.zoom, F.lit(TINY_ZOOM))
    turn = F.pmod(v.rotation, F.lit(360))
    left, right = (F.lit(0.0) - v.ox) / zoom, (v.vw - v.ox) / zoom
    top, bottom = (F.lit(0.0) - v.oy) / zoom, (v.vh - v.oy) / zoom
    x0 = F.when(turn == 90, top).when(turn == 180, v.w - right).when(turn == 270, v.w - bottom).otherwise(left)
    x1 = F.when(turn == 90, bottom).when(turn == 180, v.w - left).when(turn == 270, v.w - top).otherwise(right)
    y0 = F.when(turn == 90, v.h - right).when(turn == 180, v.h - bottom).when(turn == 270, left).otherwise(top)
    y1 = F.when(turn == 90, v.h - left).when(turn == 180, v.h - top).when(turn == 270, right).otherwise(bottom)
    w, h, zero = v.w.cast("double"), v.h.cast("double"), F.lit(0.0)
    return F.struct(clamp(x0, zero, w).alias("x0"), clamp(y0, zero, h).alias("y0"), clamp(x1, zero, w).alias("x1"), clamp(y1, zero, h).alias("y1"))


def tile_range(rect: Column, level: Column, w: Column, h: Column, tile: Column | int) -> Column:
    """STRUCT<tx0, ty0, tx1, ty1> (inclusive) of a level's tiles that meet a rectangle."""
    scale = pow2(level)
    span = long(tile) * scale
    last = lambda side: ceil_div(ceil_div(side, scale), tile) - 1
    low = lambda edge: F.greatest(long(0), F.floor(edge / span))
    high = lambda edge, side: F.least(last(side), F.floor((edge - 1) / span))
    return F.struct(low(rect["x0"]).alias("tx0"), low(rect["y0"]).alias("ty0"), high(rect["x1"], w).alias("tx1"), high(rect["y1"], h).alias("ty1"))


def fit_zoom(mode: Column, v: View) -> Column:
    """Zoom of a display mode: fit-window, fit-width or actual-size, with a margin, within the limits."""
    sw, sh = v.shown()
    by_w = F.greatest(v.vw - FIT_MARGIN, F.lit(1.0)) / sw
    by_h = F.greatest(v.vh - FIT_MARGIN, F.lit(1.0)) / sh
    zoom = F.when(mode == "actual-size", F.lit(1.0)).when(mode == "fit-width", by_w).otherwise(F.least(by_w, by_h))
    return clamp(zoom, MIN_ZOOM, MAX_ZOOM)


def clamp_offset(offset: Column, content: Column, viewport: Column) -> Column:
    """Centre what fits; of what does not, keep some pixels in sight."""
    seen = F.least(F.lit(float(MIN_VISIBLE)), viewport / 2)
    return F.when(content <= viewport, (viewport - content) / 2).otherwise(F.least(viewport - seen, F.greatest(seen - content, offset)))


def zoom_at(zoom: Column, offset: Column, target: Column, anchor: Column) -> Column:
    """Offset after zooming so that the anchor stays in place (before clamping)."""
    return anchor - (anchor - offset) * (clamp(target, MIN_ZOOM, MAX_ZOOM) / zoom)


def view_center(v: View) -> Column:
    """STRUCT<x, y>: the viewport's centre in the image, as shares of its displayed size."""
    sw, sh = v.shown()
    return F.struct(clamp((v.vw / 2 - v.ox) / (sw * v.zoom), 0, 1).alias("x"), clamp((v.vh / 2 - v.oy) / (sh * v.zoom), 0, 1).alias("y"))


def navigator_rect(v: View, size: int) -> Column:
    """STRUCT<x, y, width, height>: the viewport's box in an overview of ``size`` pixels."""
    sw, sh = v.shown()
    scale = F.lit(float(size)) / F.greatest(sw, sh, F.lit(1))
    zero = F.lit(0.0)
    return F.struct(
        F.greatest(zero, -v.ox / v.zoom * scale).alias("x"),
        F.greatest(zero, -v.oy / v.zoom * scale).alias("y"),
        F.least(sw * scale, v.vw / v.zoom * scale).alias("width"),
        F.least(sh * scale, v.vh / v.zoom * scale).alias("height"),
    )
