"""A catalog of snapshots keeps two versions of a bucket, and no shuffle files of the batches before."""

import os

from tilewright import scratch
from tilewright.streaming import snapshots

from .test_store import scan, table_of


def test_old_versions_go(spark, tmp_path):
    table = snapshots.CatalogTable(spark, str(tmp_path), buckets=2)
    batches = [scan(d, token, ["a", f"p{token}"]) for token in range(1, 6) for d in ("d", "e", "f")]
    for number, rows in enumerate(batches):
        table.apply(spark.createDataFrame(rows, snapshots.SCANS), number)
    kept = {b: sorted(v for v in os.listdir(tmp_path / "data" / b) if v.startswith("version=")) for b in os.listdir(tmp_path / "data") if b.startswith("bucket=")}
    assert kept and all(len(v) <= 2 for v in kept.values())
    want = table_of(table.read().collect())
    assert {r for r in want if r[3] == "live"} == {(d, p, 5, "live") for d in "def" for p in ("a", "p5")}
    table.apply(spark.createDataFrame(batches[-1], snapshots.SCANS), len(batches) - 1)  # the last batch runs again
    assert table_of(table.read().collect()) == want


def test_shuffle_files_go_with_their_run(spark):
    def files():
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(1 for d in root.localDirs() for _, _, found in os.walk(d.getPath()) for f in found if f.startswith("shuffle_"))

    before = files()
    with scratch.shuffles_dropped(spark):
        spark.range(1000).repartition(3).write.format("noop").mode("overwrite").save()
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_few_and_many_directories_merge_alike(spark, monkeypatch):
    rows = spark.createDataFrame([r for k in range(4) for r in scan(f"d{k}", 1, ["a", "b"]) + scan(f"d{k}", 2, ["b"])], snapshots.SCANS)
    empty = spark.createDataFrame([], snapshots.STATES)
    few = table_of(snapshots.merge_scans(empty, rows).collect())
    monkeypatch.setattr(snapshots, "FEW", 0)
    assert table_of(snapshots.merge_scans(empty, rows).collect()) == few == {(f"d{k}", "b", 2, "live") for k in range(4)}
