"""Files are listed by tasks and decoded by names, some at a time: the driver holds no list of all files."""

import os

import numpy as np
import pytest
from pyspark.sql import DataFrameReader

from tilewright import kernels as K
from tilewright.sources import headers, images, listing, thumbnails
from tilewright.streaming import jobs

ODD = ["a b.png", "#.png", "%41.png", "[1].png", "{x}.png", "q?.png", "ü漢.png", "back\\slash.png", "star*.png"]


@pytest.fixture
def folder(tmp_path):
    for sub in ("one", "two", "one/deep"):
        (tmp_path / sub).mkdir()
    for k, name in enumerate(ODD):
        (tmp_path / ("one" if k % 2 else "two") / name).write_bytes(K.encode_png(np.full((2, 3, 4), 10 * k + 5, dtype=np.uint8)))
    for name in (".hidden.png", "_meta.png", "empty.png"):
        (tmp_path / "one" / name).write_bytes(b"" if name == "empty.png" else b"x")
    (tmp_path / "one" / "deep" / "below.png").write_bytes(b"x")
    (tmp_path / "top.png").write_bytes(b"x")
    return tmp_path


@pytest.fixture
def loads(monkeypatch):
    """Paths of each read of files by Spark."""
    seen, load = [], DataFrameReader.load

    def noted(self, path=None, *args, **kwargs):
        seen.append([path] if isinstance(path, str) else path)
        return load(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameReader, "load", noted)
    return seen


def test_listing_is_no_file_index(spark, folder, loads):
    df = images.scan_catalog(spark, [f"{folder}/*"])
    assert {os.path.relpath(r["path"], folder) for r in df.collect()} == {f"{('two', 'one')[k % 2]}/{n}" for k, n in enumerate(ODD)} | {"top.png"} and not loads
    probed = headers.probe_files(images.scan_catalog(spark, [f"file://{folder}/one"]))
    assert {os.path.basename(r["path"]) for r in probed.collect()} == set(ODD[1::2]) and not loads


@pytest.mark.parametrize(("pattern", "want"), [("t[w-x]o", ODD[::2]), ("{one,top}*", [*ODD[1::2], "top.png"]), ("o?e/\\[1\\].png", ["[1].png"]), ("*/[!a-z]*", [n for n in ODD if not "a" <= n[0] <= "z"]), ("one/", ODD[1::2]), ("none*", [])])
def test_patterns(spark, folder, pattern, want):
    found = listing.list_files(spark, [f"{folder}/{pattern}"]).collect()
    assert sorted(os.path.basename(r["path"]) for r in found) == sorted(want)
    assert all(r["size"] == os.stat(r["path"]).st_size and r["modified_ms"] == os.stat(r["path"]).st_mtime_ns // 10**6 for r in found)


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, [str(tmp_path / "none")])


@pytest.mark.parametrize("named", [2, 1000])
def test_decoding_by_names(spark, folder, loads, monkeypatch, named):
    monkeypatch.setattr(images, "NAMED", named, raising=False)
    whole = [images.decode_images(spark, [f"{folder}/*"]).collect() for _ in range(2)]
    for rows in whole:
        assert {os.path.basename(r["path"]): r["error"] or r["data"][0] for r in rows} == {n: 10 * k + 5 for k, n in enumerate(ODD)} | {"top.png": "UNSUPPORTED_FORMAT"}
    assert loads and all(os.path.isfile(p.replace("\\", "")) or "\\" in p for paths in loads for p in paths)
    assert (max(map(len, loads)) < len(ODD) + 1) == (named == 2)
    assert spark.conf.get("spark.sql.files.openCostInBytes") in ("4MB", "4194304b", "4194304")


def test_thumbnails_read_only_what_lacks(spark, folder, loads, monkeypatch, tmp_path_factory):
    """More files than are named at once, of which one is new in the second run: that one is read."""
    monkeypatch.setattr(images, "NAMED", 2, raising=False)
    monkeypatch.setattr(thumbnails, "NAMED", 2, raising=False)
    store = str(tmp_path_factory.mktemp("store"))
    assert {r["error"] for r in thumbnails.build_thumbnails(spark, [str(folder / "one"), str(folder / "two")], store, 2).collect()} == {None}
    for k in range(3):
        (folder / "two" / f"bad{k}.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\3\0\0\0\2\x08\6\0\0\0")
    loads.clear()
    again = thumbnails.build_thumbnails(spark, [str(folder / "one"), str(folder / "two")], store, 2).collect()
    assert {os.path.basename(r["path"]): r["error"] for r in again} == {f"bad{k}.png": "DECODE_ERROR" for k in range(3)}
    assert {os.path.basename(p) for paths in loads for p in paths if p.endswith(".png")} == {f"bad{k}.png" for k in range(3)}
    assert not any(os.path.isdir(p) and str(folder) in p for paths in loads for p in paths)


def test_stream_of_files(spark, folder, tmp_path_factory):
    """A file comes once, also after a restart, and again when it was changed."""
    state, out = (str(tmp_path_factory.mktemp(n)) for n in ("state", "out"))

    def run():
        rows = jobs.stream_catalog(spark, f"{folder}/*")
        assert "FileStreamSource" not in rows._jdf.queryExecution().logical().toString()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(os.path.basename(r["path"]) for r in spark.read.parquet(out).collect())

    assert run() == sorted([*ODD, "top.png"])
    (folder / "two" / "late.png").write_bytes(b"x")
    os.utime(folder / "two" / "late.png", (1, 1))  # older than all that has been seen
    (folder / "top.png").write_bytes(b"changed")
    os.utime(folder / "top.png", (10**9, 10**9))
    want = sorted([*ODD, "top.png", "top.png", "late.png"])
    assert run() == want and run() == want
