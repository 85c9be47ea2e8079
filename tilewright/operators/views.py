"""View-log operators: level of detail, tile demand, prefetch ring, serving."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..policy import DEFAULT
from .scans import scan

COARSER, FINER = 0.45, 1.1
#: Levels beyond this are never chosen: the smallest scale is one of TINY_ZOOM.
DEEPEST = 20


def frame_limits(scale: np.ndarray, most: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each frame: the level chosen without one before, the least and the greatest that are kept, and the last there is.
    A frame without a scale (NaN) has -1 for all."""
    none = np.isnan(scale)
    scale = np.maximum(np.where(none, 1.0, scale), G.TINY_ZOOM)
    most = np.maximum(most, 0)
    fresh = np.clip(np.floor(np.log2(1 / scale)), 0, most)
    steps = scale[:, None] * np.exp2(np.arange(DEEPEST + 1))
    low = np.minimum((steps < COARSER).sum(axis=1), most)
    high = np.maximum((steps <= FINER).sum(axis=1) - 1, 0)
    return tuple(np.where(none, -1, v).astype(int).tolist() for v in (fresh, low, high, most))


def next_level(scale: float, previous: int | None, most: int) -> int:
    """Level of detail with hysteresis."""
    return start_levels(previous).step(*(v[0] for v in frame_limits(np.array([scale], dtype=float), np.array([most]))))


def start_levels(previous: int | None) -> _Levels:
    """A session's state after the level ``previous`` (None: before its first frame)."""
    return _Levels(-1 if previous is None else previous)


class _Levels:
    """A session's level; -1 before its first frame."""

    def __init__(self, level: int = -1) -> None:
        self.level = level

    def step(self, fresh: int, low: int, high: int, most: int) -> int | None:
        if most < 0:
            return None
        level = self.level
        if level < 0 or level > most:
            level = fresh
        else:
            level = low if level < low else level
            level = high if level > high else level
        self.level = level
        return level

    def end(self) -> int:
        return self.level


class _AnyLevel:
    """All levels that a session can have had, from -1 on; soon they are one."""

    def __init__(self) -> None:
        self.states, self.one = [_Levels(k) for k in range(-1, DEEPEST + 1)], False

    def step(self, *limits: int) -> tuple[int | None, list[int] | None]:
        if self.one:
            return self.states[0].step(*limits), None
        levels = [s.step(*limits) for s in self.states]
        if levels[0] is None:
            return None, None
        self.one = len(set(levels)) == 1
        return (levels[0], None) if self.one else (None, levels)

    def end(self) -> list[int]:
        return [self.states[0 if self.one else k].level for k in range(len(self.states))]


class _LodFold:
    columns, answer, cases = ("scale", "max_level"), "int", "array<int>"

    def first(self) -> int:
        return -1

    def begin(self) -> _Levels:
        return _Levels()

    def unknown(self) -> _AnyLevel:
        return _AnyLevel()

    def resume(self, end: list[int], start: int) -> int:
        return end[start + 1]

    def pick(self, cases: Column, start: Column) -> Column:
        return F.get(cases, (start + 1).cast("int"))

    def prepare(self, columns: list[pa.Array]) -> list[list]:
        scale, most = (c.cast(pa.float64()) for c in columns)
        return list(frame_limits(scale.fill_null(float("nan")).to_numpy(), np.nan_to_num(most.fill_null(0.0).to_numpy())))


def lod_select(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), session: str = "session_id", partitions: int | None = None) -> DataFrame:
    """Adds level: each frame's choice starts from the session's choice before.

    ``events``: scale (zoom times pixel ratio), max_level (null: 0).  A frame without a scale has no level and changes
    nothing.  Null sessions are one session.  A long session is cut over many tasks (``scans``): a range that begins within
    one keeps the answers for every level it can have had, which after a few frames are the same.
    """
    return scan(events, _LodFold(), "level", [session], list(order), partitions)


def with_ranges(events: DataFrame, tile_size: int) -> DataFrame:
    """Adds rect and range of a level's visible tiles; ``events`` has the view, w, h and level."""
    rows = events.withColumn("rect", G.visible_rect(G.View.of_columns()))
    return rows.withColumn("range", G.tile_range(F.col("rect"), F.col("level"), F.col("w"), F.col("h"), tile_size))


def tile_cover(rects: DataFrame, keys: tuple[str, ...] = ("image_id", "z"), value: str = "n") -> DataFrame:
    """(keys, tx, ty, value): for each tile the sum of ``value`` over the rectangles (x0, x1, y0, y1, ends included) that hold it,
    where that is not zero.  Rectangles of no tiles count nothing.

    A rectangle is four corners of a difference array, whatever its size; corners that meet are added first.  Sums down each
    column of corners tell how a row of tiles differs from the tile to its left, for runs of rows; sums along each row then
    give the tiles.  So rows are made for corners, for the rows that a column of corners spans, and for the tiles that come
    out, and never for the tiles of each rectangle.
    """
    corner = lambda x, y, sign: F.struct(F.col(x[0]).cast("long") + x[1], F.col(y[0]).cast("long") + y[1], F.col(value) * sign)
    ends = [(("x0", 0), ("y0", 0), 1), (("x1", 1), ("y0", 0), -1), (("x0", 0), ("y1", 1), -1), (("x1", 1), ("y1", 1), 1)]
    named = F.array(*[corner(*e).cast("struct<tx:bigint,ty:bigint,d:bigint>") for e in ends])
    corners = rects.where("x0 <= x1 and y0 <= y1").select(*keys, F.explode(named).alias("c")).groupBy(*keys, "c.tx", "c.ty").agg(F.sum("c.d").alias("d")).where("d != 0")
    down = Window.partitionBy(*keys, "tx").orderBy("ty")
    columns = corners.select(*keys, "tx", "ty", F.sum("d").over(down).alias("d"), F.lead("ty").over(down).alias("below")).where("d != 0")
    steps = columns.select(*keys, "tx", F.explode(F.sequence("ty", F.col("below") - 1)).alias("ty"), "d")
    along = Window.partitionBy(*keys, "ty").orderBy("tx")
    runs = steps.select(*keys, "tx", "ty", F.sum("d").over(along).alias(value), F.lead("tx").over(along).alias("right")).where(f"{value} != 0")
    return runs.select(*keys, F.explode(F.sequence("tx", F.col("right") - 1)).alias("tx"), "ty", value)


def visible_tiles(ranged: DataFrame) -> DataFrame:
    """(image_id, z, tx, ty, views): tiles that views show, with how many.  Work grows with views, not with the tiles they show."""
    r = F.col("range")
    rects = ranged.select("image_id", F.col("level").alias("z"), r["tx0"].alias("x0"), r["tx1"].alias("x1"), r["ty0"].alias("y0"), r["ty1"].alias("y1"), F.lit(1).cast("long").alias("views"))
    return tile_cover(rects, value="views")


def prefetch_ring(ranged: DataFrame, tile_size: int, radius: int = DEFAULT.prefetch_radius) -> DataFrame:
    """(image_id, z, tx, ty, views): tiles around the visible ones, inside the level's grid: the widened ranges less the
    ranges themselves."""
    scale = G.pow2(F.col("level"))
    last = lambda side: G.ceil_div(G.ceil_div(F.col(side), scale), tile_size) - 1
    r = F.col("range")
    rect = lambda x0, x1, y0, y1, n: F.struct(*[c.cast("long").alias(k) for c, k in zip((x0, x1, y0, y1, F.lit(n)), ("x0", "x1", "y0", "y1", "views"))])
    wide = rect(F.greatest(F.lit(0), r["tx0"] - radius), F.least(last("w"), r["tx1"] + radius), F.greatest(F.lit(0), r["ty0"] - radius), F.least(last("h"), r["ty1"] + radius), 1)
    shown = rect(r["tx0"], r["tx1"], r["ty0"], r["ty1"], -1)
    return tile_cover(ranged.select("image_id", F.col("level").alias("z"), F.explode(F.array(wide, shown)).alias("r")).select("image_id", "z", "r.*"), value="views")


def tile_priority(demand: DataFrame) -> DataFrame:
    """Adds priority, the first part of the loading order (session_id, priority, z, ty, tx): the coarser level
    first, then the target, then the ring.  Nothing is sorted here; ``caching.ordered_before`` numbers rows."""
    rank = F.when(F.col("z") == F.col("target_level") + 1, F.lit(0)).when(~F.col("ring"), F.lit(1)).otherwise(F.lit(2))
    return demand.withColumn("priority", rank)


def serve_tiles(requests: DataFrame, images: DataFrame, levels: DataFrame, tile_size: int) -> DataFrame:
    """Status and code of tile requests (request_id, image_id, z, tx, ty), checked in a fixed order: unknown
    image, not tileable, level beyond the last, level not ready, tile outside its level's grid.

    ``images``: image_id, tileable, max_level; ``levels``: image_id, z, width, height, ready.
    """
    rows = requests.join(images.select("image_id", "tileable", "max_level"), "image_id", "left").join(levels, ["image_id", "z"], "left")
    outside = (F.col("tx") >= G.ceil_div(F.col("width"), tile_size)) | (F.col("ty") >= G.ceil_div(F.col("height"), tile_size)) | (F.col("tx") < 0) | (F.col("ty") < 0)
    cases = [
        (F.col("max_level").isNull(), 404, "SESSION_NOT_FOUND"),
        (~F.col("tileable"), 415, "TILES_UNAVAILABLE"),
        ((F.col("z") > F.col("max_level")) | F.col("width").isNull(), 400, "TILE_OUT_OF_RANGE"),
        (~F.col("ready"), 425, "LEVEL_NOT_READY"),
        (outside, 400, "TILE_OUT_OF_RANGE"),
    ]
    status, code = F.lit(None).cast("int"), F.lit(None).cast("string")
    for condition, number, name in reversed(cases):
        status, code = F.when(condition, F.lit(number)).otherwise(status), F.when(condition, F.lit(name)).otherwise(code)
    return rows.select("request_id", "image_id", "z", "tx", "ty", F.coalesce(status, F.lit(200)).alias("status"), code.alias("code"))


def level_table(images: DataFrame, tile_size: int) -> DataFrame:
    """(image_id, z, width, height, tiles) of every level of (image_id, w, h)."""
    deep = images.withColumn("z", F.explode(F.sequence(F.lit(0), G.max_level(F.col("w"), F.col("h"), tile_size))))
    sized = deep.select("image_id", "z", G.level_side(F.col("w"), F.col("z")).alias("width"), G.level_side(F.col("h"), F.col("z")).alias("height"))
    return sized.withColumn("tiles", G.ceil_div(F.col("width"), tile_size) * G.ceil_div(F.col("height"), tile_size))


def tile_counts(levels: DataFrame, budget: int = DEFAULT.tile_cache) -> DataFrame:
    """Per image: levels, tiles, decoded bytes, and whether its coarsest level alone exceeds 70 % of the tile budget."""
    top = F.max_by("tiles", "z")
    return levels.groupBy("image_id").agg(
        F.count("*").alias("levels"), F.sum("tiles").alias("tiles"), F.sum(F.col("width") * F.col("height") * 4).alias("decoded_bytes"), (top > budget * 7 // 10).alias("over_budget")
    )
