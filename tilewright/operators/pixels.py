"""Pixel operators in pixel form: rows (image_id, x, y, r, g, b, a), all built-in and exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

CHANNELS = ("r", "g", "b")


def generate_raster(images: DataFrame) -> DataFrame:
    """Gradient pixels of (image_id, width, height): R = x mod 256, G = y mod 256, B = 0."""
    rows = images.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    cells = rows.select("image_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "y")
    return cells.select("image_id", "x", "y", (F.col("x") % 256).alias("r"), (F.col("y") % 256).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))


def box_downsample(pixels: DataFrame, has_alpha: bool) -> DataFrame:
    """Mean of each 2x2 block over the pixels that exist, rounded to nearest in whole numbers.

    With alpha, colours are premultiplied (truncating), averaged, and divided by the mean alpha (truncating,
    255 at most; 0 where it is 0).  One shuffle, on whole blocks, with partial sums.
    """
    a = G.long("a")
    value = lambda c: G.idiv(G.long(c) * a, 255) if has_alpha else G.long(c)
    block = [F.col("image_id"), G.idiv(F.col("x"), 2).cast("int").alias("x"), G.idiv(F.col("y"), 2).cast("int").alias("y")]
    sums = pixels.groupBy(*block).agg(F.count("*").alias("n"), F.sum(a).alias("sa"), *[F.sum(value(c)).alias(f"s{c}") for c in CHANNELS])
    mean = lambda c: G.idiv(F.col(f"s{c}") + G.idiv(F.col("n"), 2), F.col("n"))
    alpha = mean("a") if has_alpha else F.lit(255).cast("long")
    rows = sums.select("image_id", "x", "y", alpha.alias("a"), *[mean(c).alias(c) for c in CHANNELS])
    back = lambda c: F.when(F.col("a") == 0, F.lit(0)).otherwise(F.least(G.idiv(F.col(c) * 255, F.greatest(F.col("a"), F.lit(1))), F.lit(255)))
    return rows.select("image_id", "x", "y", *[(back(c) if has_alpha else F.col(c)).cast("int").alias(c) for c in CHANNELS], F.col("a").cast("int").alias("a"))


def orient(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Apply the EXIF orientation of ``sizes`` (image_id, width, height, orientation); unknown values do
    nothing.  5 to 8 swap the sides."""
    x, y, o = F.col("x"), F.col("y"), F.col("orientation")
    right, bottom = F.col("width") - 1 - x, F.col("height") - 1 - y
    nx = F.when(o.isin(2, 3), right).when(o.isin(5, 8), y).when(o.isin(6, 7), bottom).otherwise(x)
    ny = F.when(o.isin(3, 4), bottom).when(o.isin(5, 6), x).when(o.isin(7, 8), right).otherwise(y)
    return pixels.join(sizes, "image_id").select("image_id", nx.cast("int").alias("x"), ny.cast("int").alias("y"), *CHANNELS, "a")


def swap_channels(pixels: DataFrame) -> DataFrame:
    """BGR(A) to RGB(A) or back; alpha is 255 where it is absent."""
    a = F.coalesce(F.col("a"), F.lit(255)) if "a" in pixels.columns else F.lit(255)
    return pixels.select("image_id", "x", "y", F.col("b").alias("r"), "g", F.col("r").alias("b"), a.cast("int").alias("a"))


def pixels_to_tiles(pixels: DataFrame, tile_size: int) -> DataFrame:
    """Adds tile column and row, and the place inside the tile."""
    cell = lambda c: G.idiv(F.col(c), tile_size).cast("int")
    return pixels.withColumns({"tx": cell("x"), "ty": cell("y"), "px": (F.col("x") % tile_size).cast("int"), "py": (F.col("y") % tile_size).cast("int")})


def cut_tiles(pixels: DataFrame, tile_size: int, z: int = 0) -> DataFrame:
    """One row per tile: image_id, z, tx, ty, width, height (clipped at the edges) and pixel count."""
    tiled = pixels_to_tiles(pixels, tile_size)
    return tiled.groupBy("image_id", F.lit(z).alias("z"), "tx", "ty").agg(
        (F.max("px") + 1).alias("width"), (F.max("py") + 1).alias("height"), F.count("*").alias("n_pixels"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("checksum")
    )


def build_pyramid(pixels: DataFrame, levels: int, has_alpha: bool, keep=lambda df, z: df) -> dict[int, DataFrame]:
    """Levels 1 to ``levels``, each from the one before.  ``keep`` may write a level and read it back, which
    cuts the lineage; with it, all images advance one level a job."""
    out, current = {}, pixels
    for z in range(1, levels + 1):
        current = out[z] = keep(box_downsample(current, has_alpha), z)
    return out


def nearest_preview(pixels: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Nearest-neighbour reduction into a box of ``most``: the target grid names its source pixels, and an
    equi-join fetches just those."""
    target = sizes.withColumn("t", G.fit_within(F.col("width"), F.col("height"), most))
    rows = target.select("image_id", "width", "height", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t.height") - 1)).alias("ny"))
    grid = rows.select("image_id", "width", "height", "t", "ny", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t.width") - 1)).alias("nx"))
    wanted = grid.select(
        "image_id",
        F.col("nx").cast("int"),
        F.col("ny").cast("int"),
        G.nearest_index(F.col("nx"), F.col("width"), F.col("t.width")).cast("int").alias("x"),
        G.nearest_index(F.col("ny"), F.col("height"), F.col("t.height")).cast("int").alias("y"),
    )
    return wanted.join(pixels, ["image_id", "x", "y"]).select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y"), *CHANNELS, "a")


def read_region(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """Rectangles (rect_id, image_id, rx, ry, rw, rh, tw, th, width, height) scaled to (tw, th) by nearest
    sampling.  The rectangle is clamped to the image; outside it, everything is zero."""
    w = F.least(F.col("rw"), F.col("width") - F.col("rx"))
    h = F.least(F.col("rh"), F.col("height") - F.col("ry"))
    clamped = rects.withColumns({"cw": w, "ch": h, "inside": (w > 0) & (h > 0)}).where("tw > 0 and th > 0")
    rows = clamped.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("th") - 1))).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tw") - 1)))
    source = lambda at, size, target, base: F.when(F.col("inside"), F.col(base) + G.nearest_index(F.col(at), F.greatest(F.col(size), F.lit(0)), F.col(target))).cast("int")
    wanted = rows.select("rect_id", "image_id", "u", "v", source("u", "cw", "tw", "rx").alias("x"), source("v", "ch", "th", "ry").alias("y"))
    found = wanted.join(pixels, ["image_id", "x", "y"], "left")
    return found.select("rect_id", "image_id", F.col("u").alias("x"), F.col("v").alias("y"), *[F.coalesce(c, F.lit(0)).alias(c) for c in (*CHANNELS, "a")])


def area_resize(pixels: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Averaging reduction into a box of ``most``: each source pixel counts for the target cell that holds
    its centre; rounded to nearest.  Images that fit stay as they are."""
    target = sizes.withColumn("t", G.fit_within(F.col("width"), F.col("height"), most)).select("image_id", "width", "height", "t")
    cell = lambda c, size, to: G.idiv((2 * G.long(c) + 1) * F.col(f"t.{to}"), 2 * G.long(size)).cast("int")
    placed = pixels.join(target, "image_id").select("image_id", cell("x", "width", "width").alias("x"), cell("y", "height", "height").alias("y"), *CHANNELS, "a")
    means = placed.groupBy("image_id", "x", "y").agg(F.count("*").alias("n"), *[F.sum(G.long(c)).alias(c) for c in (*CHANNELS, "a")])
    return means.select("image_id", "x", "y", *[G.idiv(F.col(c) + G.idiv(F.col("n"), 2), F.col("n")).cast("int").alias(c) for c in (*CHANNELS, "a")])
