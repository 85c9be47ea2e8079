"""File sources, JSON sources, streams and the driver contract."""

import datetime
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import kernels as K
from tilewright.operators import tiles, views
from tilewright.sources import documents, images, store
from tilewright.streaming import jobs


def test_scan_catalog(spark, tmp_path):
    (tmp_path / "img10.png").write_bytes(b"x" * 10)
    (tmp_path / "img2.JPG").write_bytes(b"xx")
    (tmp_path / "notes.txt").write_bytes(b"x")
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "img1.png").write_bytes(b"x")
    df = images.scan_catalog(spark, [str(tmp_path)])
    assert {(r["name"], r["size"], r["directory"]) for r in df.collect()} == {("img10.png", 10, str(tmp_path)), ("img2.JPG", 2, str(tmp_path))}
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_sinks(spark, tmp_path):
    block = np.zeros((4, 4, 4), dtype=np.uint8)
    rows = [(i, 0, 0, 0, 4, 4, bytearray(block.tobytes())) for i in range(3)]
    tiles.tiles_sink(spark.createDataFrame(rows, tiles.TILE), str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 3
    thumbs = spark.createDataFrame([("k", 160, bytearray(K.encode_png(block)))], "cache_key string, size int, content binary")
    images.thumbnails_sink(thumbs, str(tmp_path / "thumbs"))
    assert store.read_store(spark, str(tmp_path / "thumbs")).where("size = 160").first()["cache_key"] == "k"


def test_manifest_round_trip(spark, tmp_path):
    levels = spark.createDataFrame([("a", z, 100 >> z, 50 >> z) for z in range(3)], "hash string, z int, width int, height int")
    written = documents.write_manifest(levels).collect()
    for r in written:
        (tmp_path / r["hash"]).mkdir()
        (tmp_path / r["hash"] / "manifest.json").write_text(r["manifest"])
    read = documents.read_manifests(spark, str(tmp_path))
    assert {(r["z"], r["width"]) for r in documents.load_manifest(read, levels).collect()} == {(1, 50), (2, 25)}
    assert documents.load_manifest(read, levels.where("z < 2")).count() == 0
    assert documents.load_manifest(read, levels, version=2).count() == 0


def test_settings(spark):
    texts = ['{"largeImage": {"tileSize": 1024}, "shortcuts": {"next": "ArrowRight"}}', "{}", '{"largeImage": {"previewMaxSize": 1024}}', "not json", None]
    rows = documents.load_settings(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, json string")).orderBy("id").collect()
    assert [r["state"] for r in rows] == ["ok", "ok", "rejected", "corrupt", "corrupt"]
    assert rows[0]["tileSize"] == 1024 and rows[0]["shortcuts"] == {"next": "ArrowRight"} and rows[1]["previewMaxSize"] == 4096 and rows[3]["quarantined"] == "not json"


def test_stream_catalog(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"abc")
    (tmp_path / "in" / "b.txt").write_bytes(b"abc")
    query = jobs.stream_catalog(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["name"], r["size"]) for r in spark.sql("select * from found").collect()] == [("a.png", 3)]
    row = "path string, name string, size long, modified_ms long, scanned_at timestamp"
    scans = spark.sql("select 'p' path, 'n' name, 1L size, 5L modified_ms, timestamp'2024-01-02 00:00:00' scanned_at")
    stale = spark.sql("select 'p' path, 'n' name, 9L size, 9L modified_ms, timestamp'2024-01-01 00:00:00' scanned_at")
    assert jobs.newest_scan(stale, scans).first()["size"] == 1 and row


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def test_stream_thumbnails(spark, tmp_path):
    schema = "cache_key string, path string, px int, ts timestamp"
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = [("k1", "a", 160), ("k1", "a", 160), ("k2", "b", 160), ("old", "c", 160)]
    spark.createDataFrame(rows, "cache_key string, path string, px int").withColumn("ts", at).coalesce(1).write.parquet(str(tmp_path / "in"))
    build = lambda work: work.select("cache_key", "px", F.lit(b"png").alias("content"))
    path = str(tmp_path / "store")
    store.publish(build(spark.createDataFrame([("old", "c", 160)], "cache_key string, path string, px int")), path)
    query = jobs.stream_thumbnails(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, build, str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["cache_key"] for r in store.read_store(spark, path).collect()) == ["k1", "k2", "old"]


@pytest.fixture
def lod(spark, tmp_path):
    """Feeds batches of frames (session, event, second, scale, max_level) to the level stream; gives what it answered so far."""
    key, provider = jobs.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "session_id long, event_id long, ts timestamp, scale double, max_level int"
    name, queries = f"lod_{uuid.uuid4().hex}", []

    def run(rows, **options):
        stamped = [(s, e, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), x, m) for s, e, t, x, m in rows]
        source = feed(spark, tmp_path / "ev", stamped, schema)
        if not queries:
            made = jobs.stream_lod(source, **options).writeStream.format("memory").queryName(name).outputMode("append")
            queries.append(made.option("checkpointLocation", str(tmp_path / "ck")).start())
        queries[0].processAllAvailable()
        return {r["event_id"]: r["level"] for r in spark.sql(f"select * from {name}").collect()}

    yield run
    for q in queries:
        q.stop()
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def folded(frames):
    levels, out = {}, {}
    for s, e, _, scale, most in sorted(frames, key=lambda f: (f[2], f[1])):
        levels[s] = out[e] = views.next_level(scale, levels.get(s), most)
    return out


def test_stream_lod_keeps_state_and_order(lod):
    """A frame that comes in a later batch, but within the time that is waited for, is answered in its place."""
    first = [(1, 1, 10, 0.1, 5), (2, 2, 10, 1.0, 5), (1, 3, 30, 0.24, 5)]
    late = [(1, 4, 20, 0.9, 5), (1, 5, 40, 0.3, 5), (None, 6, 21, 0.3, 5)]
    rest = [(2, 7, 50, 0.3, 5), ((1 << 60) + 1, 8, 55, 0.2, 5), (1, 9, 200, 1.0, 5)]
    assert set(lod(first, late="15 seconds")) == {1, 2}
    got = lod(late)
    assert {1, 2, 4, 6} <= set(got) and 5 not in got
    got = lod(rest)
    assert got == {e: v for e, v in folded(first + late + rest).items() if e != 9}
    assert 9 in lod([(3, 10, 500, 1.0, 5)])


def test_stream_lod_forgets_idle_sessions(lod):
    one, two = [(1, 1, 0, 0.1, 5)], [(2, 2, 5000, 1.0, 5)]
    lod(one, idle_seconds=60)
    lod(two)
    got = lod([(1, 3, 5001, 0.13, 5), (2, 4, 5010, 0.46, 5), (9, 5, 9000, 1.0, 5)])
    assert got[3] == views.next_level(0.13, None, 5) != views.next_level(0.13, got[1], 5)
    assert got[4] == views.next_level(0.46, got[2], 5) != views.next_level(0.46, None, 5)


def test_stream_tile_demand_equals_batch(spark, tmp_path):
    schema = "session_id long, event_id long, image_id long, zoom double, ox double, oy double, vw double, vh double, rotation int, level int"
    rows = [(1, e, e % 3, 0.5 + e / 7, -30.0 * e, 12.0 * e, 640.0, 480.0, 90 * (e % 4), e % 3) for e in range(12)]
    sizes = spark.createDataFrame([(i, 2000 + 300 * i, 1500 + 77 * i) for i in range(3)], "image_id long, w int, h int")
    query = jobs.stream_tile_demand(feed(spark, tmp_path / "ev", rows, schema), sizes, 256).writeStream.format("memory").queryName("demand").start()
    query.processAllAvailable()
    query.stop()
    ranged = views.with_ranges(spark.createDataFrame(rows, schema).join(sizes, "image_id"), 256)
    want = {tuple(r)[:4] for r in views.visible_tiles(ranged).collect()}
    ring = {tuple(r)[:4] for r in views.prefetch_ring(ranged, 256).collect()}
    got = spark.sql("select * from demand").collect()
    assert {(r["image_id"], r["z"], r["tx"], r["ty"]) for r in got if not r["ring"]} == want
    assert {(r["image_id"], r["z"], r["tx"], r["ty"]) for r in got if r["ring"]} == ring


def test_contract(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 70
    df = entry.entry(spark)
    assert df.count() > 0 and "load_mode" in df.columns


def test_entry_without_optional_parts(tmp_path):
    """The entry imports, and registers the rest, where the optional subpackage is not there."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tilewright"), tmp_path / "tilewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names = json.loads(out.stdout.splitlines()[-1])
    assert "catalog_listing" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)
