"""Queries over pixels, tiles and pyramids: pixel form, and tile form turned back into pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import pixels, tiles
from ..scratch import materialize
from .derive import derived
from .registry import query

_SIZE = 8
_COLUMNS = ("image_id", "x", "y", "r", "g", "b", "a")


def _mean(value: str) -> str:
    return f"(CAST(sum({value}) AS BIGINT) + count(*) // 2) // count(*)"


def _down(source: str, alpha: bool) -> str:
    """SQL of one 2x2 mean over a table of pixels."""
    if not alpha:
        return f"SELECT image_id, x // 2 AS x, y // 2 AS y, CAST({_mean('r')} AS INT) AS r, CAST({_mean('g')} AS INT) AS g, CAST({_mean('b')} AS INT) AS b, 255 AS a FROM {source} GROUP BY image_id, x // 2, y // 2"
    inner = f"SELECT image_id, x // 2 AS x, y // 2 AS y, {_mean('a')} AS a, {_mean('r * a // 255')} AS pr, {_mean('g * a // 255')} AS pg, {_mean('b * a // 255')} AS pb FROM {source} GROUP BY image_id, x // 2, y // 2"
    back = lambda c: f"CAST(CASE WHEN a = 0 THEN 0 ELSE least(p{c} * 255 // greatest(a, 1), 255) END AS INT) AS {c}"
    return f"SELECT image_id, x, y, {back('r')}, {back('g')}, {back('b')}, CAST(a AS INT) AS a FROM ({inner})"


def _odd(spark, sf_dir):
    """Rasters with odd sides, which together hold every value of the table."""
    return derived(spark, sf_dir, "odd_pixels").select(*_COLUMNS)


@query(_down("odd_pixels", False), "pixels", "odd_pixels")
def box_downsample(spark, sf_dir):
    return pixels.box_downsample(_odd(spark, sf_dir), has_alpha=False)


@query(_down("odd_pixels", True), "pixels", "odd_pixels")
def box_downsample_alpha(spark, sf_dir):
    return pixels.box_downsample(_odd(spark, sf_dir), has_alpha=True)


_PYRAMID = f"""WITH l1 AS ({_down('odd_pixels', True)}), l2 AS ({_down('l1', True)}), l3 AS ({_down('l2', True)})
    SELECT 1 AS z, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3"""


@query(_PYRAMID, "pixels", "odd_pixels")
def build_pyramid(spark, sf_dir):
    """Three levels in pixel form."""
    levels = pixels.build_pyramid(_odd(spark, sf_dir), 3, has_alpha=True)
    out = None
    for z, level in levels.items():
        rows = level.select(F.lit(z).alias("z"), *_COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_PYRAMID, "pixels", "odd_pixels")
def build_pyramid_tiles(spark, sf_dir):
    """The same levels in tile form: 4 x 4 tiles of bytes, halved and assembled, turned into pixels again."""
    base = tiles.from_pixels(_odd(spark, sf_dir), 4)
    levels = tiles.build_pyramid(base, 3, 4, has_alpha=True, keep=lambda level, z: materialize(level, f"level{z}"))
    return tiles.to_pixels(levels, 4).select("z", *_COLUMNS)


def _sized(source: str) -> str:
    return f"(SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY image_id)"


_ORIENT = f"""SELECT image_id, CAST(CASE WHEN o IN (2, 3) THEN w - 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN h - 1 - y ELSE x END AS INT) AS x,
    CAST(CASE WHEN o IN (3, 4) THEN h - 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN w - 1 - x ELSE y END AS INT) AS y, r, g, b, a
    FROM (SELECT p.*, w, h, CAST(p.image_id % 10 AS INT) AS o FROM odd_pixels p JOIN {_sized('odd_pixels')} USING (image_id))"""


def _sizes(rows):
    return rows.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


@query(_ORIENT, "pixels", "odd_pixels")
def orient(spark, sf_dir):
    rows = _odd(spark, sf_dir)
    return pixels.orient(rows, _sizes(rows).withColumn("orientation", (F.col("image_id") % 10).cast("int")))


@query(_ORIENT, "pixels", "odd_pixels")
def orient_rasters(spark, sf_dir):
    """The same on whole rasters of bytes."""
    rasters = tiles.from_pixels(_odd(spark, sf_dir), 16).withColumn("orientation", (F.col("image_id") % 10).cast("int"))
    return tiles.to_pixels(tiles.orient(rasters), 16).select(*_COLUMNS)


@query("SELECT image_id, x, y, b AS r, g, r AS b, a FROM pixels", "pixels")
def swap_channels(spark, sf_dir):
    return pixels.swap_channels(derived(spark, sf_dir, "pixels"))


@query("SELECT image_id, x, y, CAST(x // 3 AS INT) AS tx, CAST(y // 3 AS INT) AS ty, CAST(x % 3 AS INT) AS px, CAST(y % 3 AS INT) AS py FROM pixels", "pixels")
def pixels_to_tiles(spark, sf_dir):
    return pixels.pixels_to_tiles(derived(spark, sf_dir, "pixels"), 3).select("image_id", "x", "y", "tx", "ty", "px", "py")


@query(
    "SELECT image_id, 0 AS z, CAST(x // 3 AS INT) AS tx, CAST(y // 3 AS INT) AS ty, CAST(max(x % 3) + 1 AS INT) AS width, CAST(max(y % 3) + 1 AS INT) AS height, count(*) AS n_pixels, CAST(sum(r + g + b) AS BIGINT) AS checksum FROM pixels GROUP BY image_id, x // 3, y // 3",
    "pixels",
)
def cut_tiles(spark, sf_dir):
    return pixels.cut_tiles(derived(spark, sf_dir, "pixels"), 3)


def _fitted(source: str, most: int) -> str:
    """SQL of image_id, w, h and the sides (tw, th) in a box."""
    side = lambda a, b, wins: f"CASE WHEN w <= {most} AND h <= {most} THEN {a} WHEN {wins} THEN {most} ELSE greatest({a} * {most} // {b}, 1) END"
    return f"(SELECT image_id, w, h, {side('w', 'h', 'w >= h')} AS tw, {side('h', 'w', 'w < h')} AS th FROM {_sized(source)})"


def _nearest(source: str, most: int) -> str:
    grid = f"(SELECT *, unnest(range(0, th)) AS ny FROM (SELECT *, unnest(range(0, tw)) AS nx FROM {_fitted(source, most)}))"
    return f"SELECT p.image_id, CAST(nx AS INT) AS x, CAST(ny AS INT) AS y, r, g, b, a FROM {source} p JOIN {grid} g ON p.image_id = g.image_id AND p.x = nx * w // tw AND p.y = ny * h // th"


@query(_nearest("odd_pixels", 5), "pixels", "odd_pixels")
def nearest_preview(spark, sf_dir):
    rows = _odd(spark, sf_dir)
    return pixels.nearest_preview(rows, _sizes(rows), 5)


@query(f"WITH preview AS ({_nearest('odd_pixels', 5)}) {_nearest('preview', 3)}", "pixels", "odd_pixels")
def navigator_preview(spark, sf_dir):
    """The navigator's picture comes from the preview, not from the raster."""
    rows = _odd(spark, sf_dir)
    preview = pixels.nearest_preview(rows, _sizes(rows), 5)
    return pixels.nearest_preview(preview, _sizes(preview), 3)


_AREA = f"""SELECT image_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, {', '.join(f'CAST({_mean(c)} AS INT) AS {c}' for c in 'rgba')}
    FROM (SELECT p.*, (2 * x + 1) * tw // (2 * w) AS tx, (2 * y + 1) * th // (2 * h) AS ty FROM odd_pixels p JOIN {_fitted('odd_pixels', 4)} USING (image_id)) GROUP BY image_id, tx, ty"""


@query(_AREA, "pixels", "odd_pixels")
def generic_preview(spark, sf_dir):
    rows = _odd(spark, sf_dir)
    return pixels.area_resize(rows, _sizes(rows), 4)


@query(_AREA, "pixels", "odd_pixels")
def thumbnail(spark, sf_dir):
    """Thumbnails in raster form: decoded from encoded files, reduced, and encoded as PNG again."""
    encoded = tiles.encode_png(tiles.from_pixels(_odd(spark, sf_dir), 16))
    thumbs = tiles.thumbnails(encoded.select("image_id", F.col("png").alias("content")), 4)
    return tiles.to_pixels(tiles.decode(thumbs.select("image_id", "content")), 16).select(*_COLUMNS)


@query(
    """SELECT p.image_id AS rect_id, p.image_id, CAST(u AS INT) AS x, CAST(v AS INT) AS y, coalesce(q.r, 0) AS r, coalesce(q.g, 0) AS g, coalesce(q.b, 0) AS b, coalesce(q.a, 0) AS a
    FROM (SELECT DISTINCT image_id, image_id % 9 AS rx, image_id % 5 AS ry, 1 + image_id % 6 AS rw, 1 + image_id % 4 AS rh FROM pixels) p, (SELECT unnest(range(0, 3)) AS u) a, (SELECT unnest(range(0, 2)) AS v) b
    LEFT JOIN pixels q ON q.image_id = p.image_id AND least(rw, 8 - rx) > 0 AND q.x = rx + u * least(rw, 8 - rx) // 3 AND q.y = ry + v * least(rh, 8 - ry) // 2""",
    "pixels",
)
def read_region(spark, sf_dir):
    rows = derived(spark, sf_dir, "pixels").select(*_COLUMNS)
    i = F.col("image_id")
    rects = _sizes(rows).select(
        i.alias("rect_id"), "image_id", (i % 9).alias("rx"), (i % 5).alias("ry"), (1 + i % 6).alias("rw"), (1 + i % 4).alias("rh"), F.lit(3).alias("tw"), F.lit(2).alias("th"), "width", "height"
    )
    return pixels.read_region(rows, rects)


@query("SELECT image_id, x, y, r, g, b, 255 AS a FROM pixels", "pixels")
def write_bmp(spark, sf_dir):
    """Encode each raster as a BMP file, parse its header, decode it."""
    rasters = tiles.from_pixels(derived(spark, sf_dir, "pixels").select(*_COLUMNS[:-1], F.lit(255).alias("a")), 16)
    files = tiles.encode_bmp(rasters, alpha=False)
    return tiles.to_pixels(tiles.decode(files.select("image_id", F.col("bmp").alias("content"))), 16).select(*_COLUMNS)


@query("SELECT image_id, x, y, r, g, b, a FROM pixels", "pixels")
def encode_png(spark, sf_dir):
    """Encode each raster as PNG and decode it: lossless, alpha included."""
    encoded = tiles.encode_png(tiles.from_pixels(derived(spark, sf_dir, "pixels").select(*_COLUMNS), 16))
    return tiles.to_pixels(tiles.decode(encoded.select("image_id", F.col("png").alias("content"))), 16).select(*_COLUMNS)


@query(
    """SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x % 256 AS INT) AS r, CAST(y % 256 AS INT) AS g, 0 AS b, 255 AS a
    FROM (SELECT *, unnest(range(0, h)) AS y FROM (SELECT *, unnest(range(0, w)) AS x FROM (SELECT image_id, 1 + width // 500 AS w, 1 + height // 500 AS h FROM catalog)))""",
    "catalog",
)
def generate_raster(spark, sf_dir):
    """Rasters of the catalog's sizes, at a scale of 1 to 500."""
    side = lambda c: (1 + G.idiv(F.col(c), 500)).cast("int").alias(c)
    return pixels.generate_raster(derived(spark, sf_dir, "catalog").select("image_id", side("width"), side("height")))


_LEVELS = """levels AS (SELECT image_id, z, (w + (1 << z) - 1) // (1 << z) AS width, (h + (1 << z) - 1) // (1 << z) AS height FROM view_images, (SELECT unnest(range(0, 9)) AS z)
    WHERE z = 0 OR (greatest(w, h) + (1 << (z - 1)) - 1) // (1 << (z - 1)) > 256)"""


@query(
    f"""WITH {_LEVELS}, t AS (SELECT *, ((width + 255) // 256) * ((height + 255) // 256) AS tiles FROM levels)
    SELECT image_id, count(*) AS levels, CAST(sum(tiles) AS BIGINT) AS tiles, CAST(sum(width * height * 4) AS BIGINT) AS decoded_bytes, arg_max(tiles, z) > 179 AS over_budget FROM t GROUP BY image_id""",
    "view_images",
)
def tile_counts(spark, sf_dir):
    from ..operators import views

    return views.tile_counts(views.level_table(derived(spark, sf_dir, "view_images"), 256))


@query(
    """SELECT image_id, CASE WHEN width <= 4096 AND height <= 4096 THEN CAST(width AS BIGINT) WHEN width >= height THEN 4096 ELSE greatest(CAST(width AS BIGINT) * 4096 // height, 1) END AS fit_width,
    CASE WHEN width <= 4096 AND height <= 4096 THEN CAST(height AS BIGINT) WHEN width >= height THEN greatest(CAST(height AS BIGINT) * 4096 // width, 1) ELSE 4096 END AS fit_height,
    (width * 3 + 3) // 4 * 4 AS stride, CASE WHEN CAST(width AS BIGINT) * height * 3 > 100000000 THEN CAST(greatest(floor(greatest(width, height) * sqrt(CAST(100000000 AS DOUBLE) / (CAST(width AS BIGINT) * height * 3))), 1) AS BIGINT) END AS raster_side,
    (height + 511) // 512 * CAST((width + 511) // 512 AS BIGINT) AS tiles, CAST(least(512, width - (width - 1) // 512 * 512) AS BIGINT) AS last_tile_width,
    54 + CAST(height - 1 - height // 2 AS BIGINT) * ((width * 3 + 3) // 4 * 4) AS middle_row FROM catalog""",
    "catalog",
)
def raster_geometry(spark, sf_dir):
    """fit_within, row_stride, raster_max_side, tile_grid, tile_rect and row_offset of every image."""
    w, h = F.col("width"), F.col("height")
    fit, grid = G.fit_within(w, h, 4096), G.tile_grid(w, h, 512)
    last = G.tile_rect(w, h, 512, G.idiv(w - 1, 512), F.lit(0))
    stride = G.row_stride(w, 3)
    return derived(spark, sf_dir, "catalog").select(
        "image_id", fit["width"].alias("fit_width"), fit["height"].alias("fit_height"), stride.alias("stride"), G.raster_max_side(w, h, 100_000_000).alias("raster_side"), (grid["tiles_x"] * grid["tiles_y"]).alias("tiles"), last["width"].alias("last_tile_width"),
        G.row_offset(F.lit(54), stride, h, F.lit(True), G.idiv(h, 2)).alias("middle_row"),
    )


@query("SELECT image_id, CASE WHEN m <= 256 THEN 0 WHEN m <= 512 THEN 1 WHEN m <= 1024 THEN 2 WHEN m <= 2048 THEN 3 WHEN m <= 4096 THEN 4 WHEN m <= 8192 THEN 5 ELSE 6 END AS max_level FROM (SELECT image_id, greatest(w, h) AS m FROM view_images)", "view_images")
def max_level(spark, sf_dir):
    return derived(spark, sf_dir, "view_images").select("image_id", G.max_level(F.col("w"), F.col("h"), 256).alias("max_level"))


@query(f"WITH {_LEVELS} SELECT image_id, z, width, height FROM levels", "view_images")
def level_dims(spark, sf_dir):
    from ..operators import views

    return views.level_table(derived(spark, sf_dir, "view_images"), 256).select("image_id", F.col("z").cast("long"), "width", "height")
