"""File sources and sinks: listings, header reads, decoding, thumbnails."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions import naming as N
from ..policy import DEFAULT
from ..scratch import materialize, materialize_parts, temporary
from .listing import list_files, place
from .store import publish

HEADER_BYTES = 64
#: So many files are handed to Spark's image source at once: it keeps all of its files on the driver.
NAMED = 20_000
RASTERS = "path string, width int, height int, data binary, orientation int, converted boolean, error string"
DECODED = ["path", "width", "height", "data", "orientation", "converted", "error"]


def plain_path(path):
    """Spark's file URIs (file:/ and file:///) as plain paths."""
    return F.regexp_replace(path, "^file:/+", "/")


def scan_catalog(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """Supported files of the directories themselves, not below: directory, path, name, size, modified_ms.

    Tasks list the directories, so no file is opened, and the driver holds none; files that vanish meanwhile are skipped.  As
    with Spark's own listing, names that begin with a dot or an underscore are left out, and files of no bytes.
    """
    named = list_files(spark, dirs).select(N.parent_dir(F.col("path")).alias("directory"), "path", N.base_name(F.col("path")).alias("name"), "size", "modified_ms")
    return named.where(N.is_supported(F.col("name")))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and content of files that are small enough to be rows."""
    return spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths).select(plain_path(F.col("path")).alias("path"), "content")


def _origin_path(origin):
    """The plain path of the image source's origin, a URI in which all but letters, digits and a few marks are escaped."""
    return plain_path(F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))))


def decode_images(spark: SparkSession, paths: list[str], upright: bool = True) -> DataFrame:
    """``decode_files`` of the files of some folders, patterns of paths or files."""
    return decode_files(list_files(spark, paths).select("path"), upright)


def decode_files(files: DataFrame, upright: bool = True, each: Callable[[DataFrame], DataFrame] = lambda rasters: rasters) -> DataFrame:
    """``each`` of the rasters of ``files`` (path; each path once): path, width, height, data (RGBA), orientation, converted and error of image files.

    Spark's image source decodes JPEG, PNG, GIF (first frame) and BMP in the JVM; the task that holds the pixels reads the
    colour profile and the EXIF orientation from the file, converts to sRGB and turns the pixels upright, so that pixels
    are never shuffled.  Any file name will do.  A file that cannot be read is a row with a code, and the job goes on.
    Files are rows here; rasters that are too large for that are cut by ``cut_bmp``.

    Files are read by name, ``NAMED`` at a time; what ``each`` makes of them is written where there are more.  ``each`` sees some of
    the files at once, so it has to work row by row, or by joins on the path.
    """
    spark = files.sparkSession
    with temporary() as tables:
        named = tables.keep(materialize(files.select("path"), "named"))
    pieces = -(-named.count() // NAMED)

    def names(piece: int) -> list[str]:
        rows = named if pieces == 1 else named.where(F.pmod(F.xxhash64("path"), F.lit(pieces)) == piece)
        return still_there([r["path"] for r in rows.collect()])

    empty = spark.createDataFrame([], RASTERS)
    read = lambda piece: each(_decoded(spark, found, upright)) if (found := names(piece)) else each(empty)
    if pieces <= 1:
        with _small_files(spark):
            return read(0)
    return materialize_parts(spark, (read(k) for k in range(pieces)), "decoded", lambda: _small_files(spark))


def still_there(paths: list[str]) -> list[str]:
    """Those of some files of one store that have not vanished."""
    if not paths:
        return []
    store = place(paths[0])[0]
    return [p for p, f in zip(paths, store.get_file_info([place(p)[1] for p in paths])) if f.type == fs.FileType.File]


def _escaped(path: str) -> str:
    """A path that is read as it is, not as a pattern."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


@contextmanager
def _small_files(spark: SparkSession) -> Iterator[None]:
    """Named files are looked up in one go, not by a task each, and small ones share tasks."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.threshold": str(2 * NAMED), "spark.sql.files.openCostInBytes": str(64 << 10)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _decoded(spark: SparkSession, paths: list[str], upright: bool) -> DataFrame:
    seen = spark.read.format("image").option("ignoreMissingFiles", True).load([_escaped(p) for p in paths])
    pixels = seen.select(F.col("image.origin").alias("origin"), _origin_path(F.col("image.origin")).alias("path"), "image.width", "image.height", "image.nChannels", "image.data")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                try:
                    with opened(t["path"] if t["path"].startswith("/") else t["origin"]) as f:
                        content = f.read()
                except (OSError, pa.ArrowInvalid):
                    out.append((t["path"], None, None, None, None, None, "IO_ERROR"))
                    continue
                if not t["width"] or t["width"] <= 0:
                    out.append((t["path"], None, None, None, None, None, "DECODE_ERROR" if K.known_format(content) else "UNSUPPORTED_FORMAT"))
                    continue
                raw = np.frombuffer(t["data"], dtype=np.uint8).reshape(t["height"], t["width"], t["nChannels"])
                block = np.full((t["height"], t["width"], 4), 255, dtype=np.uint8)
                block[..., :3] = raw[..., 2::-1] if t["nChannels"] >= 3 else raw
                if t["nChannels"] == 4:
                    block[..., 3] = raw[..., 3]
                orientation = K.exif_orientation(content)
                block, done = K.icc_to_srgb(block, K.icc_profile(content))
                block = K.oriented(block, orientation) if upright else block
                out.append((t["path"], block.shape[1], block.shape[0], block.tobytes(), orientation, done, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], type=t) for t in kinds], names=DECODED)

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.string()]
    return pixels.mapInArrow(finish, RASTERS)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row's ``content`` to ``root``/``name`` (names may have directories); returns name and bytes
    when acted on.  A task that is run again writes the same files again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                path = f"{base}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"name": batch["name"], "bytes": [len(c) for c in batch["content"]]})

    return files.select("name", "content").mapInPandas(run, "name string, bytes long")


def exif_orientation(files: DataFrame) -> DataFrame:
    """path and orientation (1 to 8) of JPEG, PNG and TIFF files (path, content); 1 where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "orientation": [K.exif_orientation(bytes(c)) if c is not None else 1 for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, orientation int")


def bmp_info(headers: DataFrame, max_side: int = DEFAULT.bmp_max_side) -> DataFrame:
    """Adds ``bmp`` (width, height, bits, bottom_up, pixel_data_offset, row_stride) or ``error`` from the
    first 54 bytes in ``header``.  Built-in functions only; checks run in a fixed order."""
    h = F.col("header")
    byte = lambda i: F.substring(F.hex(F.substring(h, 1, 54)), 2 * i + 1, 2)
    unsigned = lambda at, n: F.conv(F.concat(*[byte(at + k) for k in reversed(range(n))]), 16, 10).try_cast("long")
    signed = lambda at: F.when(unsigned(at, 4) >= 1 << 31, unsigned(at, 4) - (1 << 32)).otherwise(unsigned(at, 4))
    width, height = F.abs(signed(18)), F.abs(signed(22))
    bits, compression = unsigned(28, 2), unsigned(30, 4)
    inside = lambda side: (side > 0) & (side <= max_side)
    error = (
        F.when(h.isNull() | (F.octet_length(h) < 54) | (byte(0) != "42") | (byte(1) != "4D"), F.lit("DECODE_ERROR"))
        .when(unsigned(14, 4) < 40, F.lit("DECODE_ERROR"))
        .when(~inside(width) | ~inside(height), F.lit("DECODE_ERROR"))
        .when(compression != 0, F.lit("UNSUPPORTED_FORMAT"))
        .when(~bits.isin(24, 32), F.lit("UNSUPPORTED_FORMAT"))
    )
    stride = F.call_function("div", width * bits + 31, F.lit(32).cast("long")) * 4
    info = F.struct(
        width.cast("int").alias("width"), height.cast("int").alias("height"), bits.cast("int").alias("bits"), (signed(22) > 0).alias("bottom_up"), unsigned(10, 4).alias("pixel_data_offset"), stride.alias("row_stride")
    )
    return headers.withColumn("error", error).withColumn("bmp", F.when(F.col("error").isNull(), info))


def opened(path: str):
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Byte ranges (path, start, length) of large files: path, start, data; null where a file is missing or
    short.  Paths are local ones or URIs that Arrow's file systems know (file, hdfs, s3, gs, abfs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for path, start, length in zip(batch["path"], batch["start"], batch["length"]):
                try:
                    with opened(path) as f:
                        raw = f.read_at(int(length), int(start))
                    data.append(raw if len(raw) == length else None)
                except (OSError, pa.ArrowInvalid):
                    data.append(None)
            yield batch[["path", "start"]].assign(data=data)

    return ranges.select("path", "start", "length").mapInPandas(run, "path string, start long, data binary")


def bmp_bands(info: DataFrame, tile_size: int) -> DataFrame:
    """One row per band of tile rows: (image_id, path, bmp, ty, rows, start, length), the unit of work for a
    file of any size.  A bottom-up file's band lies mirrored."""
    b = F.col("bmp")
    bands = info.where("bmp is not null").withColumn("ty", F.explode(F.sequence(F.lit(0), F.call_function("div", b["height"] - 1, F.lit(tile_size)).cast("int"))))
    rows = F.least(F.lit(tile_size), b["height"] - F.col("ty") * tile_size)
    first = F.when(b["bottom_up"], b["height"] - F.col("ty") * tile_size - rows).otherwise(F.col("ty") * tile_size)
    return bands.withColumn("rows", rows.cast("int")).select(
        "image_id", "path", "bmp", "ty", "rows", (b["pixel_data_offset"] + first.cast("long") * b["row_stride"]).alias("start"), (F.col("rows").cast("long") * b["row_stride"]).alias("length")
    )


def cut_bmp(info: DataFrame, tile_size: int, partitions: int | None = None) -> DataFrame:
    """Level-0 tiles of BMP files, band by band with ranged reads; bands are dealt out evenly, so one huge
    file is shared by all executors."""
    bands = bmp_bands(info, tile_size)
    bands = bands.repartition(partitions, "image_id", "ty") if partitions else bands.repartition("image_id", "ty")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                bmp = t.bmp if isinstance(t.bmp, dict) else t.bmp.asDict()
                shape = {"width": bmp["width"], "bits": bmp["bits"], "stride": bmp["row_stride"]}
                with opened(t.path) as f:
                    band = K.bmp_rows(f.read_at(t.length, t.start), shape, t.rows, bmp["bottom_up"])
                out = []
                for tx in range(-(-bmp["width"] // tile_size)):
                    block = band[:, tx * tile_size : (tx + 1) * tile_size]
                    out.append((t.image_id, 0, tx, t.ty, block.shape[1], block.shape[0], block.tobytes()))
                yield pd.DataFrame(out, columns=["image_id", "z", "tx", "ty", "width", "height", "data"])

    return bands.mapInPandas(run, "image_id long, z int, tx int, ty int, width int, height int, data binary")


def read_regions(rects: DataFrame) -> DataFrame:
    """Rectangles of BMP files, scaled by nearest sampling: rect_id, width, height, data (RGBA).

    ``rects``: rect_id, path, bmp, rx, ry, rw, rh, tw, th.  A rectangle is clamped to the image; outside it,
    everything is zero.  Only the bytes of the wanted rows between its sides are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.itertuples():
                bmp = t.bmp if isinstance(t.bmp, dict) else t.bmp.asDict()
                block = np.zeros((t.th, t.tw, 4), dtype=np.uint8)
                w, h, size = min(t.rw, bmp["width"] - t.rx), min(t.rh, bmp["height"] - t.ry), bmp["bits"] // 8
                if w > 0 and h > 0:
                    columns = np.arange(t.tw) * w // t.tw
                    with opened(t.path) as f:
                        for v in range(t.th):
                            y = t.ry + v * h // t.th
                            row = bmp["height"] - 1 - y if bmp["bottom_up"] else y
                            raw = f.read_at(w * size, bmp["pixel_data_offset"] + row * bmp["row_stride"] + t.rx * size)
                            block[v] = K.bmp_rows(raw, {"width": w, "bits": bmp["bits"], "stride": w * size}, 1, False)[0][columns]
                out.append((t.rect_id, t.tw, t.th, block.tobytes()))
            yield pd.DataFrame(out, columns=["rect_id", "width", "height", "data"])

    wanted = rects.where("tw > 0 and th > 0").select("rect_id", "path", "bmp", "rx", "ry", "rw", "rh", "tw", "th")
    return wanted.mapInPandas(run, "rect_id long, width int, height int, data binary")


def thumbnails_sink(thumbs: DataFrame, path: str) -> int:
    """Publish thumbnails (cache_key, size, content, ...) under their keys, at once and each key once, whoever else writes;
    returns the store's version.  ``store.read_store`` reads them."""
    return publish(thumbs, path)
