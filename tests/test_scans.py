"""Folds cut over ranges equal folds in one place."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import caching, views

BIG = (1 << 60) + 1
EVENTS = "session_id long, ts long, event_id long, scale double, max_level int"
WRITES = "root long, ts long, seq long, size long"


def slow_level(scale, level, most):
    """Step by step: finer while it looks too fine, coarser while too coarse."""
    scale, most = max(scale, 1e-6), max(most or 0, 0)
    if level is None or level > most:
        level = 0
        while level < most and scale * 2 ** (level + 1) <= 1:
            level += 1
        return level
    while level < most and scale * 2**level < 0.45:
        level += 1
    while level > 0 and scale * 2**level > 1.1:
        level -= 1
    return level


def slow_levels(events):
    levels, out = {}, {}
    for session, _, event, scale, most in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2])):
        if scale is None or scale != scale:
            out[event] = None
        else:
            out[event] = levels[session] = slow_level(scale, levels.get(session), most)
    return out


def view_log(rng, n, sessions):
    """Mostly small changes of scale, so that what was before matters for long."""
    out, scale = [], 1.0
    for e in range(n):
        scale = min(2.0, max(2.0**-7, scale * 2 ** rng.uniform(-0.5, 0.5) if rng.random() > 0.02 else 2 ** rng.uniform(-9, 2)))
        out.append((rng.choice(sessions), e // 3, e, scale, rng.choice([5, 5, 5, 5, 2, 7, 0])))
    return out


@pytest.mark.parametrize("sessions", [[1], [1, 2, None], [BIG, BIG - 1, None, 3]])
def test_levels_over_ranges(spark, sessions):
    rng = random.Random(len(sessions))
    events = view_log(rng, 1500, sessions) + [(sessions[0], 10**6, 2000, None, 5), (sessions[0], 10**6, 2001, float("nan"), 5), (sessions[0], 10**6 + 1, 2002, 0.3, None)]
    rng.shuffle(events)
    df = spark.createDataFrame(events, EVENTS)
    for parts in (1, 40):
        rows = views.lod_select(df, partitions=parts).collect()
        assert {r["event_id"]: r["level"] for r in rows} == slow_levels(events)
        assert {r["session_id"] for r in rows} == set(sessions)


def test_one_session_is_cut(spark):
    df = spark.createDataFrame(view_log(random.Random(9), 4000, [7]), EVENTS)
    kept = []
    from tilewright.operators import scans

    real = scans.materialize
    scans.materialize = lambda d, name: kept.append(real(d, name)) or kept[-1]
    try:
        views.lod_select(df, partitions=20).collect()
    finally:
        scans.materialize = real
    share = [r["count"] for r in kept[0].groupBy("__part").count().collect()]
    assert len(share) == 20 and max(share) < 3 * 4000 / 20
    assert kept[0].where("__cases is not null").count() > 0


def slow_sweeps(writes, threshold):
    run, out = {}, {}
    for root, _, seq, size in sorted(writes, key=lambda w: (w[0] is not None, w[0] or 0, w[1], w[2])):
        run[root] = run.get(root, 0) + max(0, size or 0)
        out[seq] = run[root] >= threshold
        if out[seq]:
            run[root] = 0
    return out


@pytest.mark.parametrize("sizes", [[1], [3], [1, 2, 50], [0, 100, 250], list(range(30)), [None, -4, 7]])
@pytest.mark.parametrize("roots", [[1], [None, 5, BIG, BIG - 1]])
def test_sweeps_over_ranges(spark, sizes, roots):
    rng = random.Random(4)
    writes = [(rng.choice(roots), k // 2, k, rng.choice(sizes)) for k in range(1200)]
    rng.shuffle(writes)
    df = spark.createDataFrame(writes, WRITES)
    for threshold, parts in ((100, 30), (1, 7), (10_000, 30)):
        rows = caching.sweep_trigger(df, threshold, partitions=parts).collect()
        assert {r["seq"]: r["fires"] for r in rows} == slow_sweeps(writes, threshold)
        assert {r["root"] for r in rows} == set(roots)


def test_null_root_gathers_its_bytes(spark):
    mb = 1 << 20
    df = spark.createDataFrame([(None, 1, 1, 60 * mb), (None, 2, 2, 60 * mb), (BIG, 1, 3, mb)], WRITES)
    assert {(r["root"], r["seq"], r["fires"]) for r in caching.sweep_trigger(df).collect()} == {(None, 1, False), (None, 2, True), (BIG, 3, False)}


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([], WRITES)
    assert caching.sweep_trigger(df).count() == 0
    rows = spark.createDataFrame([(1, 1, 1, 5)], WRITES).withColumns({"odd name": F.lit("x"), "when": F.current_timestamp(), "list": F.array(F.lit(1))})
    assert caching.sweep_trigger(rows, 5).drop("when").collect()[0].asDict() == {"root": 1, "ts": 1, "seq": 1, "size": 5, "odd name": "x", "list": [1], "fires": True}


@pytest.mark.parametrize("seed", range(3))
def test_tile_cover_equals_counting(spark, seed):
    rng = random.Random(seed)
    rects = []
    for _ in range(120):
        x, y = rng.randint(0, 12), rng.randint(0, 12)
        rects.append((rng.randint(1, 3), rng.choice([0, 1]), x, x + rng.randint(-1, 6), y, y + rng.randint(-1, 6), rng.choice([1, 1, 2, -1])))
    counts = {}
    for image, z, x0, x1, y0, y1, n in rects:
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                counts[image, z, x, y] = counts.get((image, z, x, y), 0) + n
    df = spark.createDataFrame(rects, "image_id long, z int, x0 long, x1 long, y0 long, y1 long, n long")
    found = views.tile_cover(df)
    assert {tuple(r)[:4]: r["n"] for r in found.collect()} == {k: v for k, v in counts.items() if v}
    assert views.tile_cover(df.limit(0)).count() == 0


def test_cover_makes_rows_for_ranges_not_for_their_tiles(spark):
    """A thousand views of nearly the whole of one image: far fewer rows than the tiles that they show."""
    rects = [(1, 0, k % 7, 390 - k % 5, k % 3, 390 - k % 11, 1) for k in range(1000)]
    df = spark.createDataFrame(rects, "image_id long, z int, x0 long, x1 long, y0 long, y1 long, n long")
    found = views.tile_cover(df)
    rows = found.collect()
    assert len(rows) == 391 * 391 and max(r["n"] for r in rows) == 1000
