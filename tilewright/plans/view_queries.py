"""Queries over the view log: geometry, levels of detail, tile demand, serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import caching, views
from .derive import derived
from .registry import ORACLES, query

_TILE = 256

_RECT = """v AS (SELECT e.*, i.w, i.h FROM views e JOIN view_images i USING (image_id)),
    q AS (SELECT *, (0 - ox) / zoom AS l, (vw - ox) / zoom AS r, (0 - oy) / zoom AS t, (vh - oy) / zoom AS b FROM v),
    rect AS (SELECT *, least(greatest(CASE rotation WHEN 90 THEN t WHEN 180 THEN w - r WHEN 270 THEN w - b ELSE l END, 0), w) AS x0,
        least(greatest(CASE rotation WHEN 90 THEN b WHEN 180 THEN w - l WHEN 270 THEN w - t ELSE r END, 0), w) AS x1,
        least(greatest(CASE rotation WHEN 90 THEN h - r WHEN 180 THEN h - b WHEN 270 THEN l ELSE t END, 0), h) AS y0,
        least(greatest(CASE rotation WHEN 90 THEN h - l WHEN 180 THEN h - t WHEN 270 THEN r ELSE b END, 0), h) AS y1 FROM q)"""

_LEVEL = """lv AS (SELECT *, CAST(event_id % 4 AS BIGINT) AS level FROM rect),
    rg AS (SELECT *, greatest(0, CAST(floor(x0 / (256 << level)) AS BIGINT)) AS tx0, greatest(0, CAST(floor(y0 / (256 << level)) AS BIGINT)) AS ty0,
        ((w + (1 << level) - 1) // (1 << level) + 255) // 256 - 1 AS mx, ((h + (1 << level) - 1) // (1 << level) + 255) // 256 - 1 AS my,
        CAST(floor((x1 - 1) / (256 << level)) AS BIGINT) AS ux, CAST(floor((y1 - 1) / (256 << level)) AS BIGINT) AS uy FROM lv),
    r AS (SELECT *, least(mx, ux) AS tx1, least(my, uy) AS ty1 FROM rg)"""


def _events(spark, sf_dir):
    return derived(spark, sf_dir, "views").join(derived(spark, sf_dir, "view_images"), "image_id")


def _ranged(spark, sf_dir):
    return views.with_ranges(_events(spark, sf_dir).withColumn("level", (F.col("event_id") % 4).cast("int")), _TILE)


@query(f"WITH {_RECT} SELECT event_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM rect", "views", "view_images")
def visible_rect(spark, sf_dir):
    rect = G.visible_rect(G.View.of_columns())
    return _events(spark, sf_dir).select("event_id", rect.alias("k")).select("event_id", *[F.round(f"k.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"WITH {_RECT}, {_LEVEL} SELECT event_id, tx0, ty0, tx1, ty1 FROM r", "views", "view_images")
def tile_range(spark, sf_dir):
    return _ranged(spark, sf_dir).select("event_id", *[F.col(f"range.{c}") for c in ("tx0", "ty0", "tx1", "ty1")])


@query(
    f"""WITH {_RECT}, {_LEVEL} SELECT image_id, CAST(level AS INT) AS z, tx, ty, CAST(count(*) AS BIGINT) AS views FROM (SELECT image_id, level, unnest(range(tx0, tx1 + 1)) AS tx, ty0, ty1 FROM r WHERE tx0 <= tx1 AND ty0 <= ty1),
    (SELECT unnest(range(0, 64)) AS ty) WHERE ty BETWEEN ty0 AND ty1 GROUP BY image_id, level, tx, ty""",
    "views",
    "view_images",
)
def visible_tiles(spark, sf_dir):
    return views.visible_tiles(_ranged(spark, sf_dir))


@query(
    f"""WITH {_RECT}, {_LEVEL}, s AS (SELECT image_id, level, tx0, tx1, ty0, ty1, unnest(range(greatest(0, tx0 - 1), least(mx, tx1 + 1) + 1)) AS tx, greatest(0, ty0 - 1) AS ay, least(my, ty1 + 1) AS b FROM r)
    SELECT image_id, CAST(level AS INT) AS z, tx, ty, CAST(count(*) AS BIGINT) AS views FROM s, (SELECT unnest(range(0, 64)) AS ty)
    WHERE ty BETWEEN ay AND b AND NOT (tx BETWEEN tx0 AND tx1 AND ty BETWEEN ty0 AND ty1) GROUP BY image_id, level, tx, ty""",
    "views",
    "view_images",
)
def prefetch_ring(spark, sf_dir):
    return views.prefetch_ring(_ranged(spark, sf_dir), _TILE)


_SCALED = "e AS (SELECT session_id, event_id, ts, zoom * dpr AS scale, 5 AS top FROM views)"


@query(
    f"""WITH {_SCALED}, o AS (SELECT session_id, list(scale ORDER BY ts, event_id) AS scales, list(event_id ORDER BY ts, event_id) AS ids FROM e GROUP BY session_id),
    f AS (SELECT session_id, ids, scales, 1 AS k, CAST(least(greatest(floor(log2(1 / scales[1])), 0), 5) AS INT) AS level FROM o
      UNION ALL SELECT session_id, ids, scales, k + 1,
        CASE WHEN scales[k + 1] * (1 << level) < 0.45 THEN coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda l: l >= level AND scales[k + 1] * (1 << l) >= 0.45)), 5)
             WHEN scales[k + 1] * (1 << level) > 1.1 THEN coalesce(list_max(list_filter([0, 1, 2, 3, 4, 5], lambda l: l <= level AND scales[k + 1] * (1 << l) <= 1.1)), 0) ELSE level END
      FROM f WHERE k < len(ids))
    SELECT ids[k] AS event_id, level FROM f""",
    "views",
)
def lod_select(spark, sf_dir):
    events = derived(spark, sf_dir, "views").select("session_id", "event_id", "ts", (F.col("zoom") * F.col("dpr")).alias("scale"), F.lit(5).alias("max_level"))
    return views.lod_select(events).select("event_id", "level")


ORACLES["lod_select"] = ORACLES["lod_select"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    f"""WITH {_RECT}, g AS (SELECT *, CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS sw, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS sh FROM v)
    SELECT event_id, round(least(32, greatest(0.01, least(greatest(vw - 32, 1) / sw, greatest(vh - 32, 1) / sh))), 6) AS window_zoom, round(least(32, greatest(0.01, greatest(vw - 32, 1) / sw)), 6) AS width_zoom,
      round(CASE WHEN sw * zoom <= vw THEN (vw - sw * zoom) / 2 ELSE least(vw - least(64, vw / 2), greatest(least(64, vw / 2) - sw * zoom, ox)) END, 6) AS clamped_x,
      round(vw / 2 - (vw / 2 - ox) * (least(32, greatest(0.01, zoom * 1.1)) / zoom), 6) AS zoomed_x,
      round(least(1, greatest(0, (vw / 2 - ox) / (sw * zoom))), 6) AS center_x, round(least(1, greatest(0, (vh / 2 - oy) / (sh * zoom))), 6) AS center_y FROM g""",
    "views",
    "view_images",
)
def view_geometry(spark, sf_dir):
    """fit_zoom, clamp_offset, zoom_at and view_center of every view."""
    v = G.View.of_columns()
    sw, _ = v.shown()
    center = G.view_center(v)
    six = lambda c, name: F.round(c, 6).alias(name)
    return _events(spark, sf_dir).select(
        "event_id",
        six(G.fit_zoom(F.lit("fit-window"), v), "window_zoom"),
        six(G.fit_zoom(F.lit("fit-width"), v), "width_zoom"),
        six(G.clamp_offset(v.ox, sw * v.zoom, v.vw), "clamped_x"),
        six(G.zoom_at(v.zoom, v.ox, v.zoom * 1.1, v.vw / 2), "zoomed_x"),
        six(center["x"], "center_x"),
        six(center["y"], "center_y"),
    )


@query(
    f"""WITH {_RECT}, g AS (SELECT *, CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS sw, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS sh FROM v), s AS (SELECT *, 180.0 / greatest(sw, sh, 1) AS k FROM g)
    SELECT event_id, round(greatest(0, -ox / zoom * k), 5) AS x, round(greatest(0, -oy / zoom * k), 5) AS y, round(least(sw * k, vw / zoom * k), 5) AS width, round(least(sh * k, vh / zoom * k), 5) AS height FROM s""".replace(
        "180.0", "CAST(180 AS DOUBLE)"
    ),
    "views",
    "view_images",
)
def navigator_rect(spark, sf_dir):
    box = G.navigator_rect(G.View.of_columns(), 180)
    return _events(spark, sf_dir).select("event_id", *[F.round(box[c], 5).alias(c) for c in ("x", "y", "width", "height")])


_SERVE = """im AS (SELECT image_id, w, h, image_id % 5 <> 0 AS tileable, CASE WHEN greatest(w, h) <= 256 THEN 0 WHEN greatest(w, h) <= 512 THEN 1 WHEN greatest(w, h) <= 1024 THEN 2 WHEN greatest(w, h) <= 2048 THEN 3 WHEN greatest(w, h) <= 4096 THEN 4 WHEN greatest(w, h) <= 8192 THEN 5 ELSE 6 END AS top FROM view_images WHERE image_id % 17 <> 0),
    rq AS (SELECT event_id AS request_id, image_id, CAST(event_id % 7 AS INT) AS z, CAST(event_id % 11 AS INT) AS tx, CAST(event_id % 6 AS INT) AS ty FROM views),
    j AS (SELECT rq.*, im.tileable, im.top, (w + (1 << z) - 1) // (1 << z) AS lw, (h + (1 << z) - 1) // (1 << z) AS lh, z = 0 OR (rq.image_id + z) % 3 <> 0 AS ready FROM rq LEFT JOIN im USING (image_id))"""


@query(
    f"""WITH {_SERVE} SELECT request_id, image_id, z, tx, ty, CASE WHEN top IS NULL THEN 404 WHEN NOT tileable THEN 415 WHEN z > top THEN 400 WHEN NOT ready THEN 425 WHEN tx >= (lw + 255) // 256 OR ty >= (lh + 255) // 256 THEN 400 ELSE 200 END AS status,
    CASE WHEN top IS NULL THEN 'SESSION_NOT_FOUND' WHEN NOT tileable THEN 'TILES_UNAVAILABLE' WHEN z > top THEN 'TILE_OUT_OF_RANGE' WHEN NOT ready THEN 'LEVEL_NOT_READY' WHEN tx >= (lw + 255) // 256 OR ty >= (lh + 255) // 256 THEN 'TILE_OUT_OF_RANGE' END AS code FROM j""",
    "views",
    "view_images",
)
def serve_tiles(spark, sf_dir):
    images = derived(spark, sf_dir, "view_images").where("image_id % 17 != 0")
    levels = views.level_table(images, _TILE).withColumn("ready", (F.col("z") == 0) | ((F.col("image_id") + F.col("z")) % 3 != 0))
    facts = images.select("image_id", (F.col("image_id") % 5 != 0).alias("tileable"), G.max_level(F.col("w"), F.col("h"), _TILE).alias("max_level"))
    e = F.col("event_id")
    requests = derived(spark, sf_dir, "views").select(e.alias("request_id"), "image_id", (e % 7).cast("int").alias("z"), (e % 11).cast("int").alias("tx"), (e % 6).cast("int").alias("ty"))
    return views.serve_tiles(requests, facts, levels.select("image_id", "z", "width", "height", "ready"), _TILE)


@query(
    """SELECT session_id, event_id, z, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN z = t + 1 THEN 0 WHEN NOT ring THEN 1 ELSE 2 END, z, event_id) AS place
    FROM (SELECT session_id, event_id, CAST(event_id % 4 AS INT) AS z, CAST(session_id % 3 AS INT) AS t, event_id % 5 = 0 AS ring FROM views)""",
    "views",
)
def tile_priority(spark, sf_dir):
    rows = derived(spark, sf_dir, "views").select("session_id", "event_id", (F.col("event_id") % 4).cast("int").alias("z"), (F.col("session_id") % 3).cast("int").alias("target_level"), (F.col("event_id") % 5 == 0).alias("ring"), F.col("event_id").alias("tx"), F.lit(0).alias("ty"))
    ranked = views.tile_priority(rows).withColumn("one", F.lit(1))
    placed = caching.ordered_before(ranked, "one", ["priority", "z", "ty", "tx"], ["session_id"])
    return placed.select("session_id", "event_id", "z", (F.col("__before") + 1).cast("long").alias("place"))


@query(f"SELECT image_id, z, tx, ty FROM ({ORACLES['visible_tiles']}) UNION SELECT image_id, z, tx, ty FROM ({ORACLES['prefetch_ring']})")
def prefetch_plan(spark, sf_dir):
    """Distinct tiles to have ready: what views show and the ring around it."""
    ranged = _ranged(spark, sf_dir)
    tiles = views.visible_tiles(ranged).unionByName(views.prefetch_ring(ranged, _TILE))
    return tiles.select("image_id", "z", "tx", "ty").distinct()
