"""A table of rows under content keys, published by versions: a write is seen whole or not at all, and a key once.

Tasks write data files of their own names.  A commit names the finished ones in the file of the next version, which can be
made only once; what no version names does not exist for readers, so files of killed tasks, of second attempts and of
writers that came too late never show.  A writer that finds its version taken looks at what is stored by then and writes
what is still missing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tilewright_store"
_TAKEN = "TILEWRIGHT_VERSION_TAKEN"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(path)
    if not isinstance(store, (fs.LocalFileSystem, fs.HadoopFileSystem)):
        raise ValueError("versions need a file system where a name can be taken only once: a shared folder or HDFS")
    return store, base.rstrip("/")


def _create_once(store: fs.FileSystem, name: str, content: bytes) -> None:
    """Make a file that is not there; FileExistsError if it is."""
    store.create_dir(name.rpartition("/")[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(content)
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(draft, name)  # fails where the name is taken, on shared folders, too
        elif store.get_file_info(name).type != fs.FileType.NotFound:
            raise FileExistsError(name)
        else:
            try:
                store.move(draft, name)  # a rename onto a name that is taken is refused
                return
            except OSError as e:
                raise FileExistsError(name) from e
    finally:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)


def _versions(path: str) -> list[tuple[int, str]]:
    store, base = _place(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/versions", allow_not_found=True))
    return sorted((int(f.base_name[:-5]), f.path) for f in found if f.base_name.endswith(".json"))


def latest_version(path: str) -> int:
    """0 for a store that nothing was published to."""
    return max([0, *(v for v, _ in _versions(path))])


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, base: int, schema: StructType) -> None:
        self.path, self.base, self.schema, self.job = path, base, schema.json(), uuid.uuid4().hex
        _place(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, base = _place(self.path)
        task = TaskContext.get()
        name = f"{base}/data/{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
        writer, rows = None, 0
        try:
            for batch in iterator:
                if batch.num_rows:
                    if writer is None:
                        store.create_dir(f"{base}/data", recursive=True)
                        writer = pq.ParquetWriter(name, batch.schema, filesystem=store)
                    writer.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return _Written(name if rows else None, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        done = [m for m in messages if m is not None and m.file]
        if not done:
            return
        store, base = _place(self.path)
        told = {"files": [m.file.removeprefix(f"{base}/") for m in done], "rows": sum(m.rows for m in done), "schema": json.loads(self.schema)}
        try:
            _create_once(store, f"{base}/versions/{self.base + 1:012d}.json", json.dumps(told).encode())
        except FileExistsError as e:
            raise RuntimeError(f"{_TAKEN} {self.base + 1}") from e

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _place(self.path)
        for m in messages:
            if m is not None and m.file and store.get_file_info(m.file).type != fs.FileType.NotFound:
                store.delete_file(m.file)


class KeyedStore(DataSource):
    """Options: path, and base, the version that the writer has seen."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a store is only added to")
        return _Writer(self.options["path"], int(self.options["base"]), schema)


def read_store(spark: SparkSession, path: str, version: int | None = None, schema: StructType | str | None = None) -> DataFrame:
    """What is published up to a version (the latest).  ``schema``: for a store that may be empty."""
    store, base = _place(path)
    files, found = [], schema
    for number, name in _versions(path):
        if version is None or number <= version:
            with store.open_input_file(name) as f:
                told = json.loads(f.read())
            files += told["files"]
            found = StructType.fromJson(told["schema"])
    if found is None:
        raise ValueError(f"nothing is published in {path}")
    root = path.rstrip("/")
    return spark.read.schema(found).parquet(*[f"{root}/{f}" for f in files]) if files else spark.createDataFrame([], found)


def publish(rows: DataFrame, path: str, key: str = "cache_key", attempts: int = 20) -> int:
    """Add the rows whose key is not stored yet, each key once; returns the version that holds them all.

    Rows with a null key are left out.  Of rows with one key any stays, as keys stand for their content.  Nothing new
    makes no version.
    """
    spark = rows.sparkSession
    spark.dataSource.register(KeyedStore)
    wanted = rows.where(f"`{key}` is not null").dropDuplicates([key])
    for _ in range(attempts):
        base = latest_version(path)
        missing = wanted.join(read_store(spark, path, base).select(key), key, "left_anti").select(*rows.columns) if base else wanted
        try:
            missing.write.format(FORMAT).mode("append").option("path", path).option("base", str(base)).save()
            return latest_version(path)
        except Exception as e:
            if _TAKEN not in str(e):
                raise
    raise RuntimeError(f"{attempts} other writers came first")
