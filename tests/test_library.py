"""Unit examples for catalog, classification, keys, retention and view geometry."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tilewright import policy as P
from tilewright.functions import geometry as G
from tilewright.functions import naming as N
from tilewright.operators import caching, catalog, views


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_supported_names(spark):
    good = ["photo.jpg", "a.JPEG", "b.PnG", "c.webp", "d.gif", "e.bmp", "f.svg", "g.avif", "h.AVIF", "x.pef"]
    bad = ["photo.txt", "photo.flif", "photo", ".jpg", "", None]
    assert column(spark, good + bad, "string", N.is_supported) == [True] * len(good) + [False] * len(bad)


def compare(a, b):
    """Digit runs by value, then by length; other bytes without case; then length; then bytes."""
    x, y, i, j = a.encode(), b.encode(), 0, 0
    while i < len(x) and j < len(y):
        if chr(x[i]).isdigit() and chr(y[j]).isdigit():
            p, q = i, j
            while p < len(x) and chr(x[p]).isdigit():
                p += 1
            while q < len(y) and chr(y[q]).isdigit():
                q += 1
            left, right = (int(x[i:p]), p - i), (int(y[j:q]), q - j)
            if left != right:
                return -1 if left < right else 1
            i, j = p, q
            continue
        left, right = chr(x[i]).lower(), chr(y[j]).lower()
        if left != right:
            return -1 if left < right else 1
        i, j = i + 1, j + 1
    return (len(x) > len(y)) - (len(x) < len(y)) or (x > y) - (x < y)


def test_natural_order(spark):
    from functools import cmp_to_key

    rng = random.Random(1)
    names = {"scan9", "Scan09", "scan11", "SCAN11", "scan011", "", "0", "00", "z", "Z", "p3q7", "p03q7", "p3q07"}
    names |= {"".join(rng.choice("aB0129._ -") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["name"] for r in catalog.natural_sort(df).collect()]
    assert got == sorted(names, key=cmp_to_key(compare))


def test_classification(spark):
    """Just below and just at each threshold of the policy, in pixels, sides, and whole megabytes."""
    d = P.DEFAULT
    side = d.side_threshold
    across = d.pixel_threshold // 5000  # 5000 x across are exactly the threshold
    cases = {
        (5000, across - 1, 0, "webp"): (False, "normal"),
        (5000, across, 0, "webp"): (True, "tileRequired"),
        (side - 1, 7, 0, "gif"): (False, "normal"),
        (3, side, 0, "gif"): (True, "normal"),  # a long side makes it large, but not tiled
        (20, 30, d.file_threshold_mb * P.MB - 1, "jpeg"): (False, "normal"),
        (20, 30, d.file_threshold_mb * P.MB, "jpeg"): (True, "tileRequired"),
        (20, 30, d.bmp_candidate_mb * P.MB - 1, "bmp"): (False, "normal"),
        (20, 30, d.bmp_candidate_mb * P.MB, "bmp"): (True, "largeCandidate"),
        (20, 30, d.bmp_required_mb * P.MB - 1, "bmp"): (True, "largeCandidate"),
        (20, 30, d.bmp_required_mb * P.MB, "bmp"): (True, "tileRequired"),
        (20, 30, d.bmp_candidate_mb * P.MB, "tif"): (False, "normal"),
    }
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, w int, h int, size long, ext string")
    found = df.select("i", catalog.is_large(F.col("w"), F.col("h"), F.col("size"), F.col("ext")).alias("large"), catalog.load_mode(F.col("w"), F.col("h"), F.col("size"), F.col("ext")).alias("mode"))
    assert [(r["large"], r["mode"]) for r in found.orderBy("i").collect()] == list(cases.values())


def test_probe(spark):
    facts = [
        ("a.svg", "svg", 10, False, None, None, None, None), ("t.tiff", "tiff", 10, False, None, None, 8, 6), ("big.tiff", "tiff", 400 * P.MB, False, None, None, 8, 6), ("r.dng", "dng", 10, False, None, None, 80, 60),
        ("n.png", "png", 10, True, None, None, 30, 20), ("p.png", "png", 10, False, 30, 20, None, None), ("odd.png", "png", 10, False, None, None, 7, 7), ("bad.png", "png", 10, False, None, None, None, None),
    ]
    rows = {r["path"]: r for r in catalog.probe_images(spark.createDataFrame(facts, "path string, ext string, size long, heif boolean, width int, height int, source_width int, source_height int")).collect()}
    assert (rows["a.svg"]["load_mode"], rows["a.svg"]["width"], rows["a.svg"]["can_fallback_to_normal"]) == ("normal", 0, True)
    assert (rows["t.tiff"]["load_mode"], rows["t.tiff"]["tileable"], rows["t.tiff"]["can_fallback_to_normal"]) == ("normal", False, True)
    assert (rows["big.tiff"]["load_mode"], rows["big.tiff"]["width"], rows["big.tiff"]["can_fallback_to_normal"]) == ("largeCandidate", 8, False)
    assert (rows["r.dng"]["load_mode"], rows["r.dng"]["raw_preview"]) == ("largeCandidate", True)
    assert rows["n.png"]["load_mode"] == "normal" and rows["n.png"]["width"] == 0
    assert (rows["p.png"]["width"], rows["p.png"]["load_mode"]) == (30, "normal")
    assert (rows["odd.png"]["width"], rows["odd.png"]["load_mode"]) == (7, "largeCandidate")
    assert (rows["bad.png"]["error"], rows["bad.png"]["load_mode"]) == ("DECODE_ERROR", None)


def test_keys(spark):
    row = spark.range(1).select(
        N.cache_key(F.lit("/a.jpg"), F.lit(102400), F.lit(1700000000000), F.lit(160)).alias("t"), N.pyramid_key(F.lit("/ü.bmp"), F.lit(5), F.lit(17), F.lit(512), F.lit(1)).alias("p")
    ).first()
    assert row["t"] == "ab7fe6c7415bd03eeac2213cd13170b7"
    le = lambda v, n: v.to_bytes(n, "little")
    assert row["p"] == hashlib.sha256("/ü.bmp".encode() + b"\0" + le(5, 8) + le(17, 16) + le(512, 4) + le(1, 4)).hexdigest()


def test_heif(spark):
    heads = [b"\0\0\0\x18ftypheic", b"\0\0\0\x18ftypisom\0\0\0\0mp41mif1", b"\0\0\0\x18ftypisom\0\0\0\0mp41mif", b"\x89PNG\r\n\x1a\n1234", b"\0\0\0\x18ftyphe", b"", None]
    assert column(spark, heads, "binary", N.sniff_heif) == [True, True, False, False, False, False, False]


def test_format_size(spark):
    assert column(spark, [0, 1023, 1024, 10240, 1536 * 1024, 5 * 1024**4, None], "long", N.format_size) == ["0 B", "1023 B", "1.00 KB", "10.0 KB", "1.50 MB", "5.00 TB", "-"]


def test_levels(spark):
    """Levels halve both sides, rounding up, until one tile holds the image; boxes keep the longer side's bound."""
    rng = random.Random(17)
    shapes = [(rng.randint(1, 40_000), rng.randint(1, 40_000)) for _ in range(60)] + [(256, 256), (257, 256), (1, 1), (1, 70_000)]
    df = spark.createDataFrame(shapes, "w int, h int")
    for tile in (256, 1024):
        for r in df.select("w", "h", G.max_level(F.col("w"), F.col("h"), tile).alias("m")).collect():
            level, side = 0, max(r["w"], r["h"])
            while side > tile:
                level, side = level + 1, -(-side // 2)
            assert r["m"] == level
    for r in df.select("w", *[G.level_side(F.col("w"), z).alias(f"z{z}") for z in range(6)]).collect():
        assert [r[f"z{z}"] for z in range(6)] == [-(-r["w"] // 2**z) for z in range(6)]
    for r in df.select("w", "h", G.fit_within(F.col("w"), F.col("h"), 3000).alias("f")).collect():
        w, h = tuple(r["f"])
        if max(r["w"], r["h"]) <= 3000:
            assert (w, h) == (r["w"], r["h"])
        else:
            assert max(w, h) == 3000 and abs(w * r["h"] - h * r["w"]) <= max(r["w"], r["h"])
    for r in df.select("w", "h", G.raster_max_side(F.col("w"), F.col("h")).alias("s")).collect():
        if r["s"] is not None:
            share = r["s"] / max(r["w"], r["h"])
            assert share < 1 and 3 * (r["w"] * share) * (r["h"] * share) <= P.DEFAULT.raster_max_bytes * 1.001


def view(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, zoom double, ox double, oy double, vw double, vh double, w int, h int, rotation int")


def test_visible_rect(spark):
    """The corners of the window, taken back through rotation, offset and zoom, bound what is seen."""
    rng = random.Random(23)
    rows = []
    for _ in range(80):
        w, h = rng.randint(50, 900), rng.randint(50, 900)
        rows.append((rng.choice([0.5, 1.0, 3.0]), rng.uniform(-500, 200), rng.uniform(-500, 200), 320.0, 200.0, w, h, rng.choice([0, 90, 180, 270])))
    back = {0: lambda x, y, w, h: (x, y), 90: lambda x, y, w, h: (y, h - x), 180: lambda x, y, w, h: (w - x, h - y), 270: lambda x, y, w, h: (w - y, x)}
    for r in view(spark, rows).select("*", G.visible_rect(G.View.of_columns()).alias("k")).collect():
        corners = [back[r["rotation"]]((sx - r["ox"]) / r["zoom"], (sy - r["oy"]) / r["zoom"], r["w"], r["h"]) for sx in (0, r["vw"]) for sy in (0, r["vh"])]
        clip = lambda v, most: min(max(v, 0), most)
        xs, ys = sorted(clip(x, r["w"]) for x, _ in corners), sorted(clip(y, r["h"]) for _, y in corners)
        assert tuple(r["k"]) == pytest.approx((xs[0], ys[0], xs[-1], ys[-1]))


def test_level_choice():
    """A level is left only where it would look too coarse or too fine; between the margins nothing changes."""
    rng = random.Random(9)
    for _ in range(2000):
        scale, most, before = 2.0 ** rng.uniform(-8, 2), rng.randint(0, 7), rng.randint(0, 9)
        level = views.next_level(scale, before, most)
        assert 0 <= level <= most
        if before > most:  # no level of this image: the finest that is not finer than the screen
            assert level == views.next_level(scale, None, most) and (level in (0, most) or 0.5 < scale * 2**level <= 1)
        else:
            assert (level == most or scale * 2**level >= views.COARSER) and (level == 0 or scale * 2**level <= views.FINER)
            assert level == before or not views.COARSER <= scale * 2**before <= views.FINER


def test_lod_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rng = random.Random(3)
        events = [(s, t, 100 * s + t, 2.0 ** rng.uniform(-6, 1), 5) for s in range(4) for t in range(15)]
        got = {r["event_id"]: r["level"] for r in views.lod_select(spark.createDataFrame(events, "session_id long, ts long, event_id long, scale double, max_level int")).collect()}
        for s in range(4):
            level = None
            for _, _, e, scale, most in (x for x in events if x[0] == s):
                level = views.next_level(scale, level, most)
                assert got[e] == level
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_neighbours(spark):
    """Nearer ones first, and of two as near the one before; nobody beyond the ends."""
    names = [f"n{k}" for k in range(7)]
    placed = catalog.position(spark.createDataFrame([("d", f"d/{n}", n) for n in names] + [("e", "e/x", "x")], "directory string, path string, name string"))
    got = {}
    for r in catalog.neighbours(placed, 3).orderBy("path", "rank").collect():
        got.setdefault(r["path"], []).append(r["neighbour"])
    for i, name in enumerate(names):
        steps = [i + s for d in (1, 2, 3) for s in (-d, d)]
        assert got[f"d/{name}"] == [f"d/{names[j]}" for j in steps if 0 <= j < len(names)]
    assert "e/x" not in got and catalog.neighbours(placed, 0).count() == 0
    ends = {r["path"]: (r["has_previous"], r["has_next"]) for r in placed.collect()}
    assert ends["d/n0"] == (False, True) and ends["d/n6"] == (True, False) and ends["d/n3"] == (True, True) and ends["e/x"] == (False, False)


def slow_evictions(files, limit):
    """Oldest first, one by one, while more than the low mark is left."""
    gone = set()
    for root in {f[0] for f in files}:
        own = sorted((f for f in files if f[0] == root), key=lambda f: (f[2] is not None, f[2] or 0, f[1]))
        left = sum(f[3] or 0 for f in own)
        if limit > 0 and left > limit * 90 // 100:
            for _, path, _, size in own:
                if left > limit * 70 // 100:
                    gone.add(path)
                    left -= size or 0
    return gone


@pytest.mark.parametrize("times", [[5], [1, 2, 3], list(range(5000)), [-(1 << 62), 0, 3, 1 << 62, None], [1_700_000_000_000_000 + k * k * 997 for k in range(3000)]])
def test_evict_watermark(spark, times):
    rng = random.Random(len(times))
    files = [(rng.choice([None, 1, 2, 3]), f"p{k}", rng.choice(times), rng.choice([0, 1, 7, 900, None])) for k in range(400)]
    df = spark.createDataFrame(files, "root long, path string, mtime long, size long")
    for limit in (0, 9_000, 40_000, 1 << 40):
        got = caching.evict_watermark(df, limit, ["root"])
        assert {r["path"] for r in got.where("evict").collect()} == slow_evictions(files, limit)
        assert got.count() == 400
    alone = caching.evict_watermark(df.where("root = 1").drop("root"), 20_000)
    assert {r["path"] for r in alone.where("evict").collect()} == slow_evictions([f for f in files if f[0] == 1], 20_000)


def test_evict_watermark_does_not_sort(spark, monkeypatch):
    """Nothing is ranged or written but the cuts, and the files of just a cut's own time."""
    written, real = [], caching.materialize
    monkeypatch.setattr(caching, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    df = spark.createDataFrame([(k % 3, f"p{k}", k, 10) for k in range(300)], "root long, path string, mtime int, size long")
    gone = caching.evict_watermark(df.withColumn("mtime", F.date_from_unix_date("mtime")), 500, ["root"]).where("evict").count()
    assert gone == 3 * 65 and len(written) >= 2 and max(w.count() for w in written) == 3


def test_evict_protected_and_pinned(spark):
    """One by one in order, those that may not go passed over, until the rest is within the limit."""
    rng = random.Random(31)
    rows = [(f"h{k}", rng.randint(1, 50), rng.randint(0, 9), rng.random() < 0.3) for k in range(60)]
    df = spark.createDataFrame(rows, "hash string, size long, mtime int, kept boolean").withColumns({"path": F.col("hash"), "key": F.col("hash"), "pinned": F.col("kept"), "seq": F.struct("mtime", "hash")})
    for limit in (100, 900, 10_000):
        left, gone = sum(r[1] for r in rows), set()
        for name, size, _, kept in sorted(rows, key=lambda r: (r[2], r[0])):
            if left > limit and not kept:
                gone.add(name)
                left -= size
        assert {r["hash"] for r in caching.evict_protected(df, limit, df.where("kept")).where("evict").collect()} == gone
        assert {r["hash"] for r in caching.evict_pinned(df, limit).where("evict").collect()} == gone


def test_sweep_trigger(spark):
    t = P.DEFAULT.sweep_bytes
    writes = spark.createDataFrame([(1, 1, 1, t - 1), (1, 2, 2, 1), (1, 3, 3, 1), (2, 1, 4, t), (2, 2, 5, t - 1), (2, 3, 6, 1)], "root long, ts long, seq long, size long")
    assert [r["fires"] for r in caching.sweep_trigger(writes).orderBy("seq").collect()] == [False, True, False, True, False, True]


def test_serve_tiles_order(spark):
    requests = spark.createDataFrame([(1, 9, 0, 0, 0), (2, 2, 9, 0, 0), (3, 1, 3, 0, 0), (4, 1, 1, 0, 0), (5, 1, 0, 9, 0), (6, 1, 0, 1, 1)], "request_id long, image_id long, z int, tx int, ty int")
    images = spark.createDataFrame([(1, True, 2), (2, False, 2)], "image_id long, tileable boolean, max_level int")
    levels = spark.createDataFrame([(1, 0, 1000, 800, True), (1, 1, 500, 400, False), (1, 2, 250, 200, True)], "image_id long, z int, width long, height long, ready boolean")
    got = {r["request_id"]: (r["status"], r["code"]) for r in views.serve_tiles(requests, images, levels, 512).collect()}
    assert got == {1: (404, "SESSION_NOT_FOUND"), 2: (415, "TILES_UNAVAILABLE"), 3: (400, "TILE_OUT_OF_RANGE"), 4: (425, "LEVEL_NOT_READY"), 5: (400, "TILE_OUT_OF_RANGE"), 6: (200, None)}
