"""Files of folders, listed by tasks: the driver names folders, and holds no file of theirs."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "tilewright_arrivals"
LISTED = "path string, size long, modified_ms long"
#: Rows of one batch of a listing.
ROWS = 10_000
_KINDS = [pa.string(), pa.int64(), pa.int64()]
_NAMES = ["path", "size", "modified_ms"]
_PATTERN = re.compile(r"(?<!\\)[*?\[{]")


def place(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path or URI, the path in it, and what stands before that in URIs of its files.  Local paths are taken as
    they are, whatever marks they hold."""
    local = re.sub("^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local, ""
    scheme, _, rest = path.partition("://")
    store, at = fs.FileSystem.from_uri(f"{scheme}://{rest.partition('/')[0]}/")
    inside = "/" + rest.partition("/")[2]
    # Object stores name the bucket in their paths, others do not.
    return (store, inside, f"{scheme}://{rest.partition('/')[0]}") if at in ("", "/") else (store, rest, f"{scheme}://")


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(path, whether it is a folder, bytes, modification time) of a folder's entries, but for hidden ones; those that vanish
    meanwhile are left out."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if _hidden(e.name):
                    continue
                try:
                    if e.is_dir():
                        yield e.path, True, 0, 0
                    else:
                        s = e.stat()
                        yield e.path, False, s.st_size, s.st_mtime_ns // 1_000_000
                except FileNotFoundError:
                    continue
    else:
        for f in store.get_file_info(fs.FileSelector(folder)):
            if not _hidden(f.base_name):
                yield f.path, f.type == fs.FileType.Directory, f.size or 0, (f.mtime_ns or 0) // 1_000_000


def _hidden(name: str) -> bool:
    """Names that Spark does not list."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _matcher(pattern: str):
    """Whether a name is what one part of a path pattern (``*``, ``?``, ``[...]``, ``{a,b}``, ``\\`` before a mark) stands for."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end]
            out += f"[^{inside[1:]}]" if inside[0] in "!^" else f"[{inside}]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return re.compile(f"(?s:{out})").fullmatch


def _plain(part: str) -> str:
    return re.sub(r"\\(.)", r"\1", part)


def folders(path: str) -> list[tuple[str, str | None]]:
    """What tasks list for a path or a pattern of paths: (folder or file, pattern of its files' names or None for all).  Folders
    that a pattern stands for are looked up here; files are not."""
    store, at, before = place(path)
    parts = at.rstrip("/").split("/")
    fixed = next((i for i, p in enumerate(parts) if _PATTERN.search(p)), len(parts))
    found = ["/".join(map(_plain, parts[:fixed])) or "/"]
    asked: list[tuple[str, str | None]] = []
    for i in range(fixed, len(parts)):
        if _PATTERN.search(parts[i]):
            match = _matcher(parts[i])
            if i == len(parts) - 1:
                asked += [(f, parts[i]) for f in found]
            found = [p for f in found if store.get_file_info(f).type == fs.FileType.Directory for p, folder, _, _ in _entries(store, f) if folder and match(p.rpartition("/")[2])]
        else:
            found = [f"{f}/{_plain(parts[i])}" for f in found]
            found = [f for f in found if store.get_file_info(f).type != fs.FileType.NotFound]
    if fixed == len(parts) and store.get_file_info(found[0]).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(before + f, pattern) for f, pattern in asked + [(f, None) for f in found]]


def entries(folder: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    """The files of a folder itself (not below), or the file of that name: batches of path, size and modified_ms.  Files of no
    bytes are left out, as Spark does."""
    store, at, before = place(folder)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return
    match = _matcher(pattern) if pattern is not None else None
    if info.type == fs.FileType.File:
        found = iter([(at, False, info.size or 0, (info.mtime_ns or 0) // 1_000_000)])
    else:
        found = _entries(store, at)
    rows: list[tuple[str, int, int]] = []
    for path, below, size, modified in found:
        if not below and size and (match is None or match(path.rpartition("/")[2])):
            rows.append((before + path, size, modified))
            if len(rows) == ROWS:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, modified_ms of the files of some folders, patterns of paths or files.  A folder is one task's work, which holds
    some thousand rows at once (Arrow gives those of remote stores in one piece); the rows are then dealt evenly."""
    asked = list(dict.fromkeys(f for p in paths for f in folders(p)))
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, pattern in zip(*(batch.column(c).to_pylist() for c in ("folder", "pattern"))):
                yield from entries(folder, pattern)

    given = spark.createDataFrame(asked, "folder string, pattern string").repartition(min(parts, max(1, len(asked))))
    return given.mapInArrow(run, LISTED).repartition(parts, "path")


class _Folder(InputPartition):
    def __init__(self, folder: str, pattern: str | None) -> None:
        super().__init__(folder)
        self.folder, self.pattern = folder, pattern


class _Scans(DataSourceStreamReader):
    """Each batch is a scan of all files, by tasks; what has come before is for the reader of the stream to tell.  An offset is the
    number of files and a sum over them: the driver goes through the names to see whether anything has changed, and keeps none."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": 0, "sum": 0}

    def latestOffset(self) -> dict:
        files = total = 0
        for folder in folders(self.path):
            for batch in entries(*folder):
                files += batch.num_rows
                total += sum(xxhash.xxh64_intdigest(f"{path}\0{size}\0{modified}") for path, size, modified in zip(*(c.to_pylist() for c in batch.columns)))
        return {"files": files, "sum": total % (1 << 53)}

    def partitions(self, start: dict, end: dict) -> list[_Folder]:
        return [_Folder(*f) for f in folders(self.path)]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        yield from entries(partition.folder, partition.pattern)

    def commit(self, end: dict) -> None:
        pass


class Arrivals(DataSource):
    """Option: path, a folder or a pattern of paths."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema) -> _Scans:
        return _Scans(self.options["path"])


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified_ms of files as they come; a file that was changed comes again.  Every batch lists the folders, by tasks,
    and the state holds what has been seen: on executors, so for large folders it has to be one that need not fit memory."""
    spark.dataSource.register(Arrivals)
    return spark.readStream.format(FORMAT).option("path", path).load().dropDuplicates(["path", "modified_ms"])
