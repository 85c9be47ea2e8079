"""Publication under keys, and catalogs from scans in any order."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tilewright.sources import store
from tilewright.streaming import snapshots


def keyed(spark, keys):
    return spark.createDataFrame([(k, f"content of {k}") for k in keys], "cache_key string, content string").repartition(4)


def stored(spark, path):
    rows = [r["cache_key"] for r in store.read_store(spark, path).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_each_key_once(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.latest_version(path) == 0 and store.read_store(spark, path, schema="cache_key string").count() == 0
    assert store.publish(keyed(spark, ["a", "b", "b", None]), path) == 1
    assert store.publish(keyed(spark, ["b", "c"]), path) == 2 and stored(spark, path) == {"a", "b", "c"}
    assert store.publish(keyed(spark, ["a", "c"]), path) == 2  # nothing new, no version
    assert {r["cache_key"] for r in store.read_store(spark, path, 1).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        store.read_store(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store._Writer("mock://x", 0, keyed(spark, ["a"]).schema)


def test_a_failed_write_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    store.publish(keyed(spark, ["a"]), path)

    def breaks(batches):
        for b in batches:
            yield b
            if "k7" in b.column("cache_key").to_pylist():
                raise RuntimeError("lost")

    broken = keyed(spark, [f"k{i}" for i in range(40)]).mapInArrow(breaks, "cache_key string, content string")
    with pytest.raises(Exception):
        store.publish(broken, path)
    assert stored(spark, path) == {"a"} and store.latest_version(path) == 1
    store.publish(keyed(spark, [f"k{i}" for i in range(40)]), path)
    assert len(stored(spark, path)) == 41


def test_a_writer_that_comes_late_tries_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.publish(keyed(spark, ["a", "b"]), path)
    store.publish(keyed(spark, ["c"]), path)
    real, seen = store.latest_version, []

    def stale(p):
        seen.append(1)
        return 1 if len(seen) == 1 else real(p)  # as if "c" had been published meanwhile

    monkeypatch.setattr(store, "latest_version", stale)
    assert store.publish(keyed(spark, ["b", "c", "d"]), path) == 3 and len(seen) == 3
    monkeypatch.undo()
    assert stored(spark, path) == {"a", "b", "c", "d"}
    assert store.read_store(spark, path, 3).where("cache_key = 'c'").count() == 1


def test_writers_at_once(spark, tmp_path):
    path, failed = str(tmp_path / "s"), []

    def write(k):
        try:
            store.publish(keyed(spark, [f"k{i}" for i in range(k, k + 20)]), path)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(5 * k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and stored(spark, path) == {f"k{i}" for i in range(35)}


# Catalogs


def scan(directory, token, paths):
    rows = [(directory, token, len(paths), p, p, 10 * token, token) for p in paths]
    return rows or [(directory, token, 0, None, None, None, None)]


def table_of(rows):
    return {(r["directory"], r["path"], r["token"], r["state"]) for r in rows if r["path"] is not None}


def test_scans_in_any_order(spark, tmp_path):
    """Whatever the batches, with replays: the newest complete scan is live, and what it missed of the one before is gone."""
    scans = scan("d", 1, ["a", "b", "c"]) + scan("d", 2, ["b", "c", "e"]) + scan("d", 3, ["c", "a"]) + scan("e", 1, ["x"]) + scan("e", 2, []) + scan(None, 1, ["n"])
    live = {("d", "c", 3, "live"), ("d", "a", 3, "live")}
    rng = random.Random(1)
    for trial in range(2):
        rows = scans + rng.sample(scans, 4)
        rng.shuffle(rows)
        table = snapshots.CatalogTable(spark, str(tmp_path / str(trial)), buckets=3)
        for number, a in enumerate(range(0, len(rows), 6)):
            batch = spark.createDataFrame(rows[a : a + 6], snapshots.SCANS)
            table.apply(batch, number)
            if rng.random() < 0.5:
                table.apply(batch, number)  # the batch runs again
        found = table_of(table.read().collect())
        assert {f for f in found if f[3] != "gone"} == live


def test_vanished_and_stale(spark):
    empty = spark.createDataFrame([], snapshots.STATES)
    merged = lambda known, *scans: spark.createDataFrame(snapshots.merge_scans(known, batch(*scans)).collect(), snapshots.STATES)
    batch = lambda *scans: spark.createDataFrame([r for s in scans for r in s], snapshots.SCANS)
    one = merged(empty, scan("d", 1, ["a", "b"]))
    half = merged(one, scan("d", 2, ["b", "c", "z"])[:2])
    assert table_of(half.collect()) == {("d", "a", 1, "live"), ("d", "b", 1, "live"), ("d", "b", 2, "pending"), ("d", "c", 2, "pending")}
    two = merged(half, scan("d", 2, ["b", "c", "z"])[2:])
    want = {("d", "a", 2, "gone"), ("d", "b", 2, "live"), ("d", "c", 2, "live"), ("d", "z", 2, "live")}
    assert table_of(two.collect()) == want
    assert table_of(merged(two, scan("d", 1, ["a", "q"])).collect()) == want  # a stale scan
    back = merged(two, scan("d", 3, ["a"]))
    assert table_of(back.collect()) == {("d", "a", 3, "live"), ("d", "b", 3, "gone"), ("d", "c", 3, "gone"), ("d", "z", 3, "gone")}
    none = merged(back, scan("d", 4, []))
    assert {r[3] for r in table_of(none.collect())} == {"gone"} and none.where("state = 'live'").count() == 1  # the empty scan itself


def test_version_that_was_not_logged_is_not_read(spark, tmp_path):
    table = snapshots.CatalogTable(spark, str(tmp_path), buckets=2)
    table.apply(spark.createDataFrame(scan("d", 1, ["a"]), snapshots.SCANS), 0)
    lost = spark.createDataFrame(scan("d", 9, ["zzz"]), snapshots.SCANS).withColumns({"state": F.lit("live"), "bucket": table.bucket(), "version": F.lit(1).cast("long")})
    lost.write.mode("append").partitionBy("bucket", "version").parquet(f"{tmp_path}/data")
    assert table_of(table.read().collect()) == {("d", "a", 1, "live")}
    table.apply(spark.createDataFrame(scan("d", 2, ["b"]), snapshots.SCANS), 1)
    assert table_of(table.read().collect()) == {("d", "a", 2, "gone"), ("d", "b", 2, "live")}


# The job from listing to store


def test_thumbnail_job(spark, tmp_path):
    """What is stored is not built again, what changed is, and what cannot be made is told each time."""
    import os

    import numpy as np

    from tilewright import kernels as K
    from tilewright.policy import Policy
    from tilewright.sources import thumbnails

    root, path = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    put = lambda name, value: (root / name).write_bytes(K.encode_png(np.full((6, 9, 4), value, dtype=np.uint8)))
    for k, name in enumerate(["a.png", "b [1]*?.png", "c {x}%.png"]):
        put(name, 40 * k)
    (root / "cut.png").write_bytes(K.encode_png(np.zeros((6, 9, 4), np.uint8))[:40])
    (root / "pic.svg").write_bytes(b"<svg/>")
    run = lambda **o: {r["path"].rpartition("/")[2]: r["error"] for r in thumbnails.build_thumbnails(spark, [str(root)], path, 3, **o).collect()}
    small = Policy(decode_max_side=8)
    assert set(run(policy=small).values()) == {"IMAGE_TOO_LARGE", "UNSUPPORTED_FORMAT"} and store.latest_version(path) == 0
    assert run() == {"a.png": None, "b [1]*?.png": None, "c {x}%.png": None, "cut.png": "DECODE_ERROR", "pic.svg": "UNSUPPORTED_FORMAT"}
    first = store.read_store(spark, path).collect()
    assert len(first) == 3 and all((r["width"], r["height"]) == (3, 2) for r in first)
    assert sorted(K.decode_png(bytes(r["content"]))[0, 0, 0] for r in first) == [0, 40, 80]
    assert set(run()) == {"cut.png", "pic.svg"} and store.latest_version(path) == 1
    put("a.png", 200)
    os.utime(root / "a.png", (2_000_000_000, 2_000_000_000))
    assert set(run()) == {"a.png", "cut.png", "pic.svg"} and store.read_store(spark, path).count() == 4
