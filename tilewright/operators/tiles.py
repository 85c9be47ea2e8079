"""Pixel operators in tile form: rows (image_id, z, tx, ty, width, height, data) of RGBA bytes.

This is the form for large rasters: a tile is at most a few MB, a level moves a quarter of the bytes of the
one before, and no step holds a whole image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kernels as K

TILE = "image_id long, z int, tx int, ty int, width int, height int, data binary"


def from_pixels(pixels: DataFrame, tile_size: int) -> DataFrame:
    """Tiles of level 0 from pixel rows, by groups of one tile."""
    keyed = pixels.withColumns({"tx": F.call_function("div", F.col("x"), F.lit(tile_size)).cast("int"), "ty": F.call_function("div", F.col("y"), F.lit(tile_size)).cast("int")})
    keyed = keyed.select("image_id", "tx", "ty", (F.col("x") % tile_size).alias("px"), (F.col("y") % tile_size).alias("py"), "r", "g", "b", "a")
    cells = keyed.groupBy("image_id", "tx", "ty").agg(
        (F.max("px") + 1).cast("int").alias("width"), (F.max("py") + 1).cast("int").alias("height"), F.sort_array(F.collect_list(F.struct("py", "px", "r", "g", "b", "a"))).alias("cells")
    )
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    data = F.unhex(F.array_join(F.transform("cells", lambda c: F.concat(byte(c["r"]), byte(c["g"]), byte(c["b"]), byte(c["a"]))), ""))
    return cells.select(F.col("image_id").cast("long").alias("image_id"), F.lit(0).alias("z"), "tx", "ty", "width", "height", data.alias("data"))


def to_pixels(tiles: DataFrame, tile_size: int) -> DataFrame:
    """Pixel rows of tiles; for checks and small rasters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for t in batch.itertuples():
                ys, xs = np.mgrid[0 : t.height, 0 : t.width]
                place = [np.full(xs.size, t.image_id), np.full(xs.size, t.z), t.tx * tile_size + xs.ravel(), t.ty * tile_size + ys.ravel()]
                parts.append(np.column_stack([*place, _array(t).reshape(-1, 4)]))
            if parts:
                yield pd.DataFrame(np.concatenate(parts), columns=["image_id", "z", "x", "y", "r", "g", "b", "a"])

    return tiles.select("image_id", "z", "tx", "ty", "width", "height", "data").mapInPandas(run, "image_id long, z int, x int, y int, r int, g int, b int, a int")


def _array(t) -> np.ndarray:
    return np.frombuffer(t.data, dtype=np.uint8).reshape(t.height, t.width, 4)


def _map(tiles: DataFrame, change: Callable[[object], dict], schema: str = TILE) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([change(t) for t in batch.itertuples(index=False)], columns=columns)

    return tiles.mapInPandas(run, schema)


def halve(tiles: DataFrame, has_alpha: bool) -> DataFrame:
    """Each tile at half its size: tile sides are even, so no 2x2 block crosses a tile."""

    def change(t) -> dict:
        half = K.halve(_array(t), has_alpha)
        return {"image_id": t.image_id, "z": t.z + 1, "tx": t.tx, "ty": t.ty, "width": half.shape[1], "height": half.shape[0], "data": half.tobytes()}

    return _map(tiles, change)


def assemble(quarters: DataFrame, tile_size: int) -> DataFrame:
    """Join up to four halved neighbours into one tile of the next level.

    Neighbours are shuffled to one partition and stand together in it, so they are joined as they stream by;
    at most four tiles are held.
    """
    half = tile_size // 2

    def join(group: list) -> dict:
        width = max((t.tx % 2) * half + t.width for t in group)
        height = max((t.ty % 2) * half + t.height for t in group)
        block = np.zeros((height, width, 4), dtype=np.uint8)
        for t in group:
            x, y = (t.tx % 2) * half, (t.ty % 2) * half
            block[y : y + t.height, x : x + t.width] = _array(t)
        first = group[0]
        return {"image_id": first.image_id, "z": first.z, "tx": first.tx // 2, "ty": first.ty // 2, "width": width, "height": height, "data": block.tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list = []
        for batch in batches:
            done = []
            for t in batch.itertuples(index=False):
                if group and (t.image_id, t.z, t.tx // 2, t.ty // 2) != (group[0].image_id, group[0].z, group[0].tx // 2, group[0].ty // 2):
                    done.append(join(group))
                    group = []
                group.append(t)
            if done:
                yield pd.DataFrame(done)
        if group:
            yield pd.DataFrame([join(group)])

    parent = [F.call_function("div", F.col(c), F.lit(2)) for c in ("tx", "ty")]
    columns = [c.split()[0] for c in TILE.split(", ")]
    return quarters.select(*columns).repartition("image_id", "z", *parent).sortWithinPartitions("image_id", "z", *parent).mapInPandas(run, TILE)


def build_pyramid(level0: DataFrame, levels: int, tile_size: int, has_alpha: bool, keep: Callable[[DataFrame, int], DataFrame] = lambda df, z: df) -> DataFrame:
    """Levels 1 to ``levels`` of all images at once; ``keep`` may write each level and read it back."""
    if tile_size % 2:
        raise ValueError("tile sides have to be even")
    current, out = level0, None
    for z in range(1, levels + 1):
        current = keep(assemble(halve(current, has_alpha), tile_size), z)
        out = current if out is None else out.unionByName(current)
    return out


def orient(rasters: DataFrame) -> DataFrame:
    """Whole rasters (one tile each) turned by their column ``orientation``."""

    def change(t) -> dict:
        turned = K.oriented(_array(t), int(t.orientation))
        return {"image_id": t.image_id, "z": t.z, "tx": 0, "ty": 0, "width": turned.shape[1], "height": turned.shape[0], "data": turned.tobytes()}

    return _map(rasters, change)


def encode_png(tiles: DataFrame) -> DataFrame:
    return _map(tiles, lambda t: {"image_id": t.image_id, "z": t.z, "tx": t.tx, "ty": t.ty, "png": K.encode_png(_array(t))}, "image_id long, z int, tx int, ty int, png binary")


def encode_bmp(tiles: DataFrame, alpha: bool = True) -> DataFrame:
    return _map(tiles, lambda t: {"image_id": t.image_id, "z": t.z, "tx": t.tx, "ty": t.ty, "bmp": K.encode_bmp(_array(t), alpha)}, "image_id long, z int, tx int, ty int, bmp binary")


def encode_jpeg(tiles: DataFrame, quality: int = 85) -> DataFrame:
    """Lossy, on white where a tile is not opaque."""
    return _map(tiles, lambda t: {"image_id": t.image_id, "z": t.z, "tx": t.tx, "ty": t.ty, "jpeg": K.encode_jpeg(_array(t), quality)}, "image_id long, z int, tx int, ty int, jpeg binary")


def encode_gif(tiles: DataFrame) -> DataFrame:
    """Opaque tiles of at most 256 colours, without loss."""
    return _map(tiles, lambda t: {"image_id": t.image_id, "z": t.z, "tx": t.tx, "ty": t.ty, "gif": K.encode_gif(_array(t))}, "image_id long, z int, tx int, ty int, gif binary")


def decode(files: DataFrame) -> DataFrame:
    """(image_id, content) to whole rasters, with ``error`` where a file cannot be read (data is null then)."""

    def change(t) -> dict:
        row = {"image_id": t.image_id, "z": 0, "tx": 0, "ty": 0, "width": 0, "height": 0, "data": None, "error": None}
        try:
            block = K.decode(bytes(t.content) if t.content is not None else b"")
        except K.FormatError as e:
            return row | {"error": e.code}
        return row | {"width": block.shape[1], "height": block.shape[0], "data": np.ascontiguousarray(block).tobytes()}

    return _map(files.select("image_id", "content"), change, TILE + ", error string")


def thumbnails(files: DataFrame, px: int) -> DataFrame:
    """(image_id, content) of PNG and BMP files to PNG thumbnails in a box of ``px``: decoded, converted to sRGB,
    turned upright, averaged, encoded.  ``raster_thumbnails`` takes what ``images.decode_images`` read."""

    def change(t) -> dict:
        row = {"image_id": t.image_id, "width": None, "height": None, "content": None, "error": None}
        try:
            content = bytes(t.content) if t.content is not None else b""
            block, _ = K.icc_to_srgb(K.decode(content), K.icc_profile(content))
            small = K.resize_area(K.oriented(block, K.exif_orientation(content)), px)
        except K.FormatError as e:
            return row | {"error": e.code}
        return row | {"width": small.shape[1], "height": small.shape[0], "content": K.encode_png(small)}

    return _map(files.select("image_id", "content"), change, "image_id long, width int, height int, content binary, error string")


def raster_thumbnails(rasters: DataFrame, px: int) -> DataFrame:
    """Decoded rasters (path, width, height, data, error), of any format, to PNG thumbnails; errors go along."""

    def change(t) -> dict:
        row = {"path": t.path, "width": None, "height": None, "content": None, "error": t.error}
        if t.data is None:
            return row
        small = K.resize_area(np.frombuffer(t.data, dtype=np.uint8).reshape(int(t.height), int(t.width), 4), px)
        return row | {"width": small.shape[1], "height": small.shape[0], "content": K.encode_png(small)}

    return _map(rasters.select("path", "width", "height", "data", "error"), change, "path string, width int, height int, content binary, error string")


def to_srgb(rasters: DataFrame) -> DataFrame:
    """Rasters with a column ``icc`` (binary, or null) converted to sRGB; ``converted`` tells whether."""

    def change(t) -> dict:
        block, done = K.icc_to_srgb(_array(t), bytes(t.icc) if t.icc is not None else None)
        return {"image_id": t.image_id, "z": t.z, "tx": t.tx, "ty": t.ty, "width": t.width, "height": t.height, "data": block.tobytes(), "converted": done}

    return _map(rasters, change, TILE + ", converted boolean")


def morton(tx: Column, ty: Column, bits: int = 24) -> Column:
    """The bits of both numbers in turn: near tiles have near keys."""
    bit = lambda c, k: F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))
    spread = lambda c, odd: reduce(lambda a, b: a + b, [F.shiftleft(bit(c, k), 2 * k + odd) for k in range(bits)])
    return spread(tx, 0) + spread(ty, 1)


def tiles_sink(tiles: DataFrame, path: str, group_bytes: int = 16 << 20, partitions: int | None = None) -> None:
    """Write tiles clustered for viewports: ranged by image, level and Morton key, so that each row group is a compact patch of
    one level and its least and greatest tx and ty tell readers whether to open it.  A large level is cut over many files."""
    keyed = tiles.withColumn("morton", morton(F.col("tx"), F.col("ty")))
    order = ["image_id", "z", "morton"]
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("append").option("parquet.block.size", str(group_bytes)).parquet(path)


def read_viewport(spark: SparkSession, path: str, image_id: int, z: int, box: tuple[int, int, int, int]) -> DataFrame:
    """The stored tiles of a level within (tx0, ty0, tx1, ty1), ends included."""
    x0, y0, x1, y1 = box
    where = (F.col("image_id") == image_id) & (F.col("z") == z) & F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1)
    return spark.read.parquet(path).where(where).drop("morton")
