"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and executors are local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_tilewright_scratch", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.sparkContext._tilewright_scratch = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tilewright-{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


class _Scope:
    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``'s table outlives this scope (and belongs to the one around it)."""
        path = getattr(df, "_tilewright_path", None)
        if self.paths.pop(path, None) is not None:
            _note(path, df.sparkSession, self)
        return df


def _note(path: str, spark: SparkSession, below: _Scope | None = None) -> None:
    """The innermost scope (around ``below``, if given) owns the table."""
    stack = getattr(_scopes, "open", [])
    stack = stack[: stack.index(below)] if below is not None else stack
    if stack:
        stack[-1].paths[path] = spark


@contextmanager
def temporary() -> Iterator[_Scope]:
    """Tables that are materialised within are dropped at its end, but for those that the scope is told to keep.  What is
    returned from within must not read the dropped ones."""
    stack = _scopes.open = getattr(_scopes, "open", [])
    scope = _Scope()
    stack.append(scope)
    try:
        yield scope
    finally:
        stack.remove(scope)
        for path, spark in scope.paths.items():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame | None) -> None:
    """Remove a materialised table that nothing reads any more."""
    path = getattr(df, "_tilewright_path", None)
    if path is not None:
        for scope in getattr(_scopes, "open", []):
            scope.paths.pop(path, None)
        _delete(df.sparkSession, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within are removed as each run ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, so a lost executor
    costs nothing that came before.  Columnar and compressed, unlike ``checkpoint()``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return _made(spark, path, df.schema)


def materialize_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str, within: Callable[[], AbstractContextManager] = nullcontext) -> DataFrame:
    """``materialize`` of some tables of one schema, one after the other (at least one); each is asked for and written ``within``."""
    path, schema, parts = scratch_path(spark, name), None, iter(parts)
    while True:
        with within():
            part = next(parts, None)
            if part is None:
                return _made(spark, path, schema)
            part.write.mode("append").parquet(path)
            schema = part.schema


def _made(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    made = spark.read.schema(schema).parquet(path)
    made._tilewright_path = path
    _note(path, spark)
    return made
