"""Queries over image files: files made from the given tables are written to the shared folder and read back."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kernels as K
from ..operators import tiles
from ..scratch import scratch_path
from ..sources import images, store, thumbnails
from ..streaming import jobs
from .derive import derived, table
from .library_queries import _SUPPORTED
from .raster_queries import _AREA, _COLUMNS, _odd
from .registry import ORACLES, query
from .stream_queries import _run, with_state_store


def _written(spark: SparkSession, files: DataFrame, name: str) -> str:
    """The folder that ``files`` (name, content) are now in."""
    root = scratch_path(spark, name)
    images.write_files(files, root).write.format("noop").mode("overwrite").save()
    return root


def _id_of(path) -> F.col:
    return F.regexp_extract(path, r"([0-9]+)\.[a-z]+$", 1).cast("long")


def _catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "catalog")
    name = F.concat(F.element_at(F.split("directory", "/"), -1), F.lit("/"), F.col("image_id").cast("string"), F.lit(" "), F.element_at(F.split("path", "/"), -1))
    return rows.select(name.alias("name"), F.encode(F.repeat("name", 3), "UTF-8").alias("content"))


_SCANNED = f"SELECT replace(directory, '/library/', '') AS directory, image_id || ' ' || name AS name, CAST(3 * strlen(name) AS BIGINT) AS size FROM catalog WHERE ext IN ({_SUPPORTED})"


@query(_SCANNED, "catalog")
def scan_catalog(spark, sf_dir):
    root = _written(spark, _catalog_files(spark, sf_dir), "library")
    return images.scan_catalog(spark, [f"{root}/*"]).select(F.element_at(F.split("directory", "/"), -1).alias("directory"), "name", "size")


@query(_SCANNED, "catalog")
def stream_catalog(spark, sf_dir):
    """The same files as they come in."""
    root = _written(spark, _catalog_files(spark, sf_dir), "library")
    seen = with_state_store(spark, lambda: _run(jobs.stream_catalog(spark, f"{root}/*").writeStream, spark, "arrivals"))
    before = seen.withColumns({"size": F.lit(0).cast("long"), "scanned_at": F.col("scanned_at") - F.expr("interval 1 hour")})
    return jobs.newest_scan(before, seen).select(F.element_at(F.split("path", "/"), -2).alias("directory"), "name", "size")


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.from_pixels(_odd(spark, sf_dir), 16)


_ODD_NAMES = ("", "a b ", "#", "100% ", "%41 ", "what?", 'q"', "{x}", "a+b&c=", "[1]", "ü漢 ", "a;b,c'", "~^|`", "%", "$(x) ")


def _image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as BMP (every third) and PNG files, opaque ones of the latter as GIF where their number ends in 7; of every
    eleventh each, one is cut short and one is no image.  Names hold what file names may hold."""
    rasters = _rasters(spark, sf_dir)
    bmp = tiles.encode_bmp(rasters.where("image_id % 3 = 0"), alpha=False).select("image_id", F.lit(".bmp").alias("ext"), F.col("bmp").alias("content"))
    opaque = rasters.join(_odd(spark, sf_dir).groupBy("image_id").agg(F.min("a").alias("low")), "image_id").where("image_id % 3 != 0")
    gif_too = (F.col("image_id") % 10 == 7) & (F.col("low") == 255)
    png = tiles.encode_png(opaque.where(~gif_too)).select("image_id", F.lit(".png").alias("ext"), F.col("png").alias("content"))
    gif = tiles.encode_gif(opaque.where(gif_too)).select("image_id", F.lit(".gif").alias("ext"), F.col("gif").alias("content"))
    i = F.col("image_id")
    content = F.when(i % 11 == 0, F.encode(F.lit("no image"), "UTF-8")).when(i % 11 == 1, F.substring("content", 1, 20)).otherwise(F.col("content"))
    odd = F.element_at(F.array(*map(F.lit, _ODD_NAMES)), (i % len(_ODD_NAMES)).cast("int") + 1)
    return bmp.unionByName(png).unionByName(gif).select(F.concat(odd, i.cast("string"), "ext").alias("name"), content.alias("content"))


@query(
    """SELECT image_id, x, y, r, g, b, CASE WHEN image_id % 3 = 0 THEN 255 ELSE a END AS a, CAST(NULL AS VARCHAR) AS error FROM odd_pixels WHERE image_id % 11 > 1
    UNION ALL SELECT DISTINCT image_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN image_id % 11 = 0 THEN 'UNSUPPORTED_FORMAT' ELSE 'DECODE_ERROR' END FROM odd_pixels WHERE image_id % 11 <= 1""",
    "pixels",
    "odd_pixels",
)
def decode_images(spark, sf_dir):
    root = _written(spark, _image_files(spark, sf_dir), "images")
    found = images.decode_images(spark, [f"{root}/*"]).withColumn("image_id", _id_of(F.col("path")))
    good = found.where("error is null").select("image_id", F.lit(0).alias("z"), F.lit(0).alias("tx"), F.lit(0).alias("ty"), "width", "height", "data")
    bad = found.where("error is not null").select("image_id", *[F.lit(None).cast("int").alias(c) for c in _COLUMNS[1:]], "error")
    return tiles.to_pixels(good, 16).select(*_COLUMNS, F.lit(None).cast("string").alias("error")).unionByName(bad)


@query("SELECT image_id, CAST(max(x) + 1 AS INT) AS width, CAST(max(y) + 1 AS INT) AS height, true AS close FROM odd_pixels GROUP BY image_id", "pixels", "odd_pixels")
def encode_jpeg(spark, sf_dir):
    """Lossy files, read by the JVM's decoder; ``close``: the error, on white, is within what the quality allows."""
    rasters = _rasters(spark, sf_dir)
    files = tiles.encode_jpeg(rasters, 95).select(F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("name"), F.col("jpeg").alias("content"))
    found = images.decode_images(spark, [_written(spark, files, "lossy")])
    back = found.select(_id_of(F.col("path")).alias("image_id"), F.lit(0).alias("z"), F.lit(0).alias("tx"), F.lit(0).alias("ty"), "width", "height", "data")
    flat = lambda c: F.col(f"o.{c}") * F.col("o.a") / 255 + 255 - F.col("o.a")
    pairs = tiles.to_pixels(back, 16).alias("p").join(_odd(spark, sf_dir).alias("o"), ["image_id", "x", "y"])
    error = F.sqrt(F.avg(sum(((F.col(f"p.{c}") - flat(c)) * (F.col(f"p.{c}") - flat(c)) for c in "rgb"), F.lit(0)) / 3))
    return pairs.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), (error <= 10).alias("close"))


def _bmp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, path, bmp) of BMP files, and their headers read back."""
    rasters = tiles.from_pixels(derived(spark, sf_dir, "pixels").select(*_COLUMNS[:-1], F.lit(255).alias("a")), 16)
    named = tiles.encode_bmp(rasters, alpha=False).select(F.concat(F.col("image_id").cast("string"), F.lit(".bmp")).alias("name"), F.col("bmp").alias("content"))
    root = _written(spark, named, "bitmaps")
    files = images.read_files(spark, [f"{root}/*"])
    return images.bmp_info(files.select(_id_of(F.col("path")).alias("image_id"), "path", F.substring("content", 1, 54).alias("header")))


@query("SELECT image_id, x, y, r, g, b, 255 AS a FROM pixels", "pixels")
def cut_bmp(spark, sf_dir):
    """Bands of tile rows, read from BMP files by byte ranges."""
    return tiles.to_pixels(images.cut_bmp(_bmp_files(spark, sf_dir), 3), 3).select(*_COLUMNS)


@query(ORACLES["read_region"].replace("coalesce(q.a, 0)", "CASE WHEN q.a IS NULL THEN 0 ELSE 255 END"))
def read_region_bmp(spark, sf_dir):
    """Rectangles of BMP files by ranged reads."""
    i = F.col("image_id")
    rects = _bmp_files(spark, sf_dir).select(
        i.alias("rect_id"), "path", "bmp", (i % 9).cast("int").alias("rx"), (i % 5).cast("int").alias("ry"), (1 + i % 6).cast("int").alias("rw"), (1 + i % 4).cast("int").alias("rh"), F.lit(3).alias("tw"), F.lit(2).alias("th")
    )
    found = images.read_regions(rects).select(F.col("rect_id").alias("image_id"), F.lit(0).alias("z"), F.lit(0).alias("tx"), F.lit(0).alias("ty"), "width", "height", "data")
    return tiles.to_pixels(found, 16).select(F.col("image_id").alias("rect_id"), *_COLUMNS)


@query(_AREA.replace("SELECT image_id,", "SELECT md5(CAST(image_id AS VARCHAR)) AS cache_key, 4 AS size, image_id,", 1), "pixels", "odd_pixels")
def thumbnails_sink(spark, sf_dir):
    """Thumbnails published under their keys, twice, and read back."""
    path = scratch_path(spark, "thumbnails")
    encoded = tiles.encode_png(_rasters(spark, sf_dir)).select("image_id", F.col("png").alias("content"))
    thumbs = tiles.thumbnails(encoded, 4).select("image_id", F.md5(F.col("image_id").cast("string")).alias("cache_key"), F.lit(4).alias("size"), "content")
    images.thumbnails_sink(thumbs, path)
    images.thumbnails_sink(thumbs.unionByName(thumbs), path)
    stored = store.read_store(spark, path)
    return tiles.to_pixels(tiles.decode(stored), 16).select(*_COLUMNS).join(stored.select("image_id", "cache_key", "size"), "image_id")


@query(
    """SELECT DISTINCT image_id, CASE image_id % 11 WHEN 0 THEN 'UNSUPPORTED_FORMAT' WHEN 1 THEN 'DECODE_ERROR' END AS error, image_id % 11 > 1 AS stored,
    CASE WHEN image_id % 11 < 2 THEN 1 ELSE 0 END AS again FROM odd_pixels""",
    "pixels",
    "odd_pixels",
)
def thumbnail_job(spark, sf_dir):
    """From listing to stored thumbnails, run twice: the second run finds only what cannot be made."""
    root, path = _written(spark, _image_files(spark, sf_dir), "images"), scratch_path(spark, "thumbnails")
    first = thumbnails.build_thumbnails(spark, [root], path, 4)
    second = thumbnails.build_thumbnails(spark, [root], path, 4).groupBy("path").agg(F.count("*").alias("n"))
    stored = store.read_store(spark, path).select("cache_key", F.lit(True).alias("kept"))
    rows = first.join(stored, "cache_key", "left").join(second, "path", "left")
    return rows.select(_id_of(F.col("path")).alias("image_id"), "error", F.coalesce("kept", F.lit(False)).alias("stored"), F.coalesce("n", F.lit(0)).cast("int").alias("again"))


@query("SELECT image_id, x, y, r, g, b, a FROM odd_pixels", "pixels", "odd_pixels")
def tiles_sink(spark, sf_dir):
    path = scratch_path(spark, "tiles")
    tiles.tiles_sink(tiles.from_pixels(_odd(spark, sf_dir), 4), path)
    return tiles.to_pixels(spark.read.parquet(path), 4).select(*_COLUMNS)


@query("SELECT p_partkey AS path, CAST(CASE WHEN p_partkey % 10 BETWEEN 1 AND 8 AND p_partkey % 7 <> 0 THEN p_partkey % 10 ELSE 1 END AS INT) AS orientation FROM part")
def exif_orientation(spark, sf_dir):
    """JPEG, PNG and TIFF files with the orientation in their first directory, in both byte orders; values out of
    range, and blocks that are cut short."""
    i = F.col("p_partkey")
    value = F.lpad(F.hex(i % 10), 4, "0")
    swapped = F.concat(F.substring(value, 3, 2), F.substring(value, 1, 2))
    little = F.concat(F.lit("49492A000800000001001201030001000000"), swapped, F.lit("0000" + "00000000"))
    big = F.concat(F.lit("4D4D002A00000008000101120003" + "00000001"), value, F.lit("0000" + "00000000"))
    block = F.when(i % 2 == 0, little).otherwise(big)
    block = F.when(i % 7 == 0, F.substring(block, 1, 24)).otherwise(block)
    word = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    size = F.call_function("div", F.length(block), F.lit(2))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFE1"), word(size + 8, 4), F.lit("457869660000"), block, F.lit("FFDA0002"))
    png = F.concat(F.lit(K.PNG_SIGNATURE.hex()), word(size, 8), F.lit(b"eXIf".hex()), block, F.lit("00000000"))
    content = F.when(i % 3 == 0, jpeg).when(i % 3 == 1, png).otherwise(block)
    return images.exif_orientation(table(spark, sf_dir, "part").select(i.cast("string").alias("path"), F.unhex(content).alias("content"))).select(F.col("path").cast("long").alias("path"), "orientation")


#: Primaries of a wide colour space as XYZ columns, and a straight tone curve.
_PRIMARIES = ((0.60974, 0.31111, 0.01947), (0.20528, 0.62567, 0.06087), (0.14919, 0.06322, 0.74457))


def _profile() -> bytes:
    """A small RGB matrix profile."""
    fixed = lambda v: round(v * 65536)
    bodies = {n + b"XYZ": b"XYZ \0\0\0\0" + struct.pack(">3i", *map(fixed, p)) for n, p in zip((b"r", b"g", b"b"), _PRIMARIES)}
    bodies |= {n + b"TRC": b"curv\0\0\0\0" + struct.pack(">I", 0) for n in (b"r", b"g", b"b")}
    at, table_, data = 132 + 12 * len(bodies), struct.pack(">I", len(bodies)), b""
    for name, body in bodies.items():
        table_ += struct.pack(">4sII", name, at + len(data), len(body))
        data += body
    head = bytearray(128)
    head[16:20], head[36:40] = b"RGB ", b"acsp"
    return bytes(head) + table_ + data


def _srgb_sql() -> str:
    matrix = K.XYZ_TO_SRGB @ (np.round(np.array(_PRIMARIES) * 65536) / 65536).T
    linear = [f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {' + '.join(f'({v!r})::DOUBLE * ({c} / 255.0::DOUBLE)' for v, c in zip(row.tolist(), 'rgb'))}))" for row in matrix]
    curve = lambda v: f"CAST(round(255 * CASE WHEN {v} <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * {v} ELSE 1.055::DOUBLE * pow({v}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) AS INT)"
    value = lambda v, c: f"CASE WHEN image_id % 3 = 0 THEN {c} ELSE {curve(v)} END AS {c}"
    return f"SELECT image_id, x, y, {', '.join(value(v, c) for v, c in zip(linear, 'rgb'))}, a FROM odd_pixels"


@query(_srgb_sql(), "pixels", "odd_pixels")
def to_srgb(spark, sf_dir):
    """Two of three rasters carry a colour profile."""
    icc = F.when(F.col("image_id") % 3 != 0, F.unhex(F.lit(_profile().hex())))
    return tiles.to_pixels(tiles.to_srgb(_rasters(spark, sf_dir).withColumn("icc", icc)), 16).select(*_COLUMNS)
