"""Queries over headers of files of eight formats, made from ``part`` by byte layouts and read back by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..sources import headers, images
from .derive import table
from .file_queries import _id_of, _written
from .library_queries import _FACTS, _LARGE, _MODE, _SUPPORTED, _SYSTEM
from .registry import query

_FORMATS = ("jpg", "png", "gif", "bmp", "webp", "tif", "heic", "jxl")


def _big(v: Column | int, n: int) -> Column:
    """A number as the hexadecimal digits of ``n`` bytes, highest first."""
    return F.lpad(F.hex((F.lit(v) if isinstance(v, int) else v).cast("long")), 2 * n, "0")


def _little(v: Column | int, n: int) -> Column:
    return N.little_endian(F.lit(v) if isinstance(v, int) else v, n)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _ascii(text: str) -> str:
    return text.encode().hex()


def _filler(n: Column) -> Column:
    return F.repeat(F.lit("5A"), n.cast("int"))


def _box(kind: str, *body: Column | str) -> Column:
    content = _text(*body)
    return _text(_big(F.length(content) / 2 + 8, 4), _ascii(kind), content)


def _contents(w: Column, h: Column) -> list[Column]:
    """One file of each format, in hexadecimal digits."""
    i = F.col("image_id")
    block = lambda marker, n: _text(f"FF{marker}", _big(n + 2, 2), _filler(n))
    frame = F.when(i % 16 == 0, "C0").otherwise("C2")
    jpeg = _text("FFD8", block("E0", F.lit(14)), block("E1", (i * 53) % 60000), F.repeat(F.lit("FF"), (i % 5).cast("int")), block("C4", F.lit(28)), "FF", frame, "001108", _big(h, 2), _big(w, 2), "03012200021101031101FFDA")
    png = _text("89504E470D0A1A0A0000000D", _ascii("IHDR"), _big(w, 4), _big(h, 4), "0806000000")
    gif = _text(F.when(i % 16 == 2, _ascii("GIF87a")).otherwise(_ascii("GIF89a")), _little(w, 2), _little(h, 2), "F00000")
    down = F.when(i % 16 == 3, F.lit(1 << 32) - h).otherwise(h)  # a negative height: rows from the top
    bmp = _text("424D", "00" * 8, "36000000", "28000000", _little(w, 4), _little(down, 4), "0100", "1800", "00" * 24)
    sides = (w - 1) + F.call_function("shiftleft", (h - 1).cast("long"), F.lit(14))
    kind = F.floor(i / 8) % 3
    webp = _text(
        _ascii("RIFF"), "00000000", _ascii("WEBP"),
        F.when(kind == 0, _text(_ascii("VP8X"), "0A000000", "10000000", _little(w - 1, 3), _little(h - 1, 3)))
        .when(kind == 1, _text(_ascii("VP8L"), "20000000", "2F", _little(sides, 4)))
        .otherwise(_text(_ascii("VP8 "), "20000000", "B04000", "9D012A", _little(w, 2), _little(h, 2))),
        "00" * 8,
    )
    gap = (i * 7) % 2500 * 2
    entry = lambda n, tag, v: _text(n(tag, 2), F.when(i % 3 == 0, _text(n(3, 2), n(1, 4), n(v, 2), "0000")).otherwise(_text(n(4, 2), n(1, 4), n(v, 4))))
    directory = lambda n: _text(n(gap + 8, 4), _filler(gap), n(2, 2), entry(n, 256, w), entry(n, 257, h), "00000000")
    tiff = F.when(i % 16 == 5, _text("49492A00", directory(_little))).otherwise(_text("4D4D002A", directory(_big)))
    ispe = lambda x, y: _box("ispe", "00000000", _big(x, 4), _big(y, 4))
    owned = _box("ipma", "00000000", "00000002", F.when(i % 3 == 0, "0001010100020102").otherwise("0002010200010101"))
    meta = _box("meta", "00000000", _box("pitm", "00000000", "0002"), _box("iprp", _box("ipco", ispe(160, 120), ispe(w, h)), owned))
    heif = _text(_box("ftyp", _ascii("heic"), "00000000", _ascii("mif1")), F.when(i % 16 == 6, _box("mdat", _filler((i * 31) % 9000))).otherwise(F.lit("")), meta)
    bits = F.lit(2 << 1) + F.call_function("shiftleft", (h - 1).cast("long"), F.lit(3)) + F.lit(2 << 24) + F.call_function("shiftleft", (w - 1).cast("long"), F.lit(26))
    jxl = _text("FF0A", _little(bits, 6), "00" * 12)
    return [jpeg, png, gif, bmp, webp, tiff, heif, jxl]


def _headed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and content; of every 13 files one is cut short, of every 17 one is no image."""
    i = F.col("image_id")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), ((F.col("p_partkey") * 37) % 14000 + 1).cast("long").alias("w"), ((F.col("p_partkey") * 101) % 9000 + F.col("p_size")).cast("long").alias("h"))
    which = (i % len(_FORMATS)).cast("int")
    made = None
    for k, digits in enumerate(_contents(F.col("w"), F.col("h"))):
        made = F.when(which == k, digits) if made is None else made.when(which == k, digits)
    cut = F.when(which == 2, 8).when(which == 7, 4).otherwise(20)
    content = F.when(i % 17 == 0, F.encode(F.repeat(F.lit("no image "), 9), "UTF-8")).when(i % 13 == 0, F.unhex(F.substring(made, F.lit(1), 2 * cut))).otherwise(F.unhex(made))
    return rows.select(F.concat(i.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _FORMATS)), which + 1)).alias("name"), content.alias("content"))


_NAMES = "['jpg', 'png', 'gif', 'bmp', 'webp', 'tif', 'heic', 'jxl']"
_MADE = f"""m AS (SELECT p_partkey AS image_id, {_NAMES}[p_partkey % 8 + 1] AS ext, p_partkey % 17 = 0 AS alien, p_partkey % 13 = 0 OR p_partkey % 17 = 0 AS bad,
    CAST((p_partkey * 37) % 14000 + 1 AS INT) AS width, CAST((p_partkey * 101) % 9000 + p_size AS INT) AS height FROM part)"""


@query(
    f"""WITH {_MADE} SELECT image_id, CASE WHEN NOT alien THEN ['jpeg', 'png', 'gif', 'bmp', 'webp', 'tiff', 'heif', 'jxl'][image_id % 8 + 1] END AS format, CASE WHEN NOT bad THEN width END AS width, CASE WHEN NOT bad THEN height END AS height,
    CASE WHEN alien THEN 'UNSUPPORTED_FORMAT' WHEN bad THEN 'DECODE_ERROR' END AS error, true AS few FROM m"""
)
def probe_headers(spark, sf_dir):
    """Dimensions of eight formats from their own headers; ``few``: no file was read beyond some KB."""
    root = _written(spark, _headed_files(spark, sf_dir), "headed")
    found = headers.probe_headers(images.scan_catalog(spark, [root]).select("path"))
    return found.select(_id_of(F.col("path")).alias("image_id"), "format", "width", "height", "error", (F.col("bytes_read") <= 8192).alias("few"))


_PROBED = _FACTS[_FACTS.index("g AS") :].replace("SELECT path, ext, size, direct", "SELECT image_id, ext, size, direct")


@query(
    f"""WITH {_MADE}, f AS (SELECT image_id, ext, 0 AS size, false AS heif, CASE WHEN NOT bad AND ext NOT IN ({_SYSTEM}) THEN width END AS dw, CASE WHEN NOT bad AND ext NOT IN ({_SYSTEM}) THEN height END AS dh,
      CASE WHEN NOT bad AND ext IN ({_SYSTEM}) THEN width END AS sw, CASE WHEN NOT bad AND ext IN ({_SYSTEM}) THEN height END AS sh FROM m WHERE ext IN ({_SUPPORTED})), {_PROBED}
    SELECT image_id, width, height, ext AS format, CASE WHEN width IS NOT NULL THEN {_LARGE} END AS is_large,
      CASE WHEN width IS NULL THEN NULL WHEN direct THEN 'normal' WHEN sysd THEN 'largeCandidate' ELSE {_MODE} END AS load_mode, CASE WHEN width IS NOT NULL THEN ext = 'bmp' END AS tileable,
      CASE WHEN width IS NOT NULL THEN direct OR NOT sysd END AS can_fallback_to_normal, CASE WHEN width IS NULL THEN 'DECODE_ERROR' END AS error FROM h"""
)
def probe_files(spark, sf_dir):
    """From a listing to probe rows: names, headers and policy in one job."""
    root = _written(spark, _headed_files(spark, sf_dir), "headed")
    found = headers.probe_files(images.scan_catalog(spark, [root]))
    return found.select(_id_of(F.col("path")).alias("image_id"), "width", "height", "format", "is_large", "load_mode", "tileable", "can_fallback_to_normal", "error")
