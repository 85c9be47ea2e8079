"""The catalog as a table of snapshots: complete scans replace older ones, directory by directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize, shuffles_dropped, temporary

#: A scan's rows: each names the scan (directory, token) and how many files it has; one of no files is a row of a null path.
SCANS = "directory string, token long, files long, path string, name string, size long, modified_ms long"
STATES = f"{SCANS}, state string"
COLUMNS = [c.split()[0] for c in STATES.split(", ")]


#: Directories whose newest scans are sent to all tasks; where there are more, they are joined by a shuffle.
FEW = 100_000


def merge_scans(known: DataFrame, batch: DataFrame, deal: dict[str, Column] | None = None) -> DataFrame:
    """The table after a batch of scan rows, whatever order they come in and however often.

    ``known``: columns of STATES; ``batch``: of SCANS.  A scan counts once all its files are there; of a directory's complete
    scans that with the highest token is live.  Rows of newer scans are pending, those of older ones go.  A path that was
    live and is not in the newest complete scan is gone, with the token of the scan that missed it, until it is seen again.
    Rows without a directory or a token are left out.

    Rows are shuffled twice: a few columns to count the scans' files, all of them by ``deal``, which is a function of directory
    and path and is added to the result.
    """
    rows = known.unionByName(batch.where("directory is not null and token is not null").withColumn("state", F.lit("pending")))
    listed = rows.where("state != 'gone'").groupBy("directory", "token", "path").agg(F.max("files").alias("files"))
    complete = listed.groupBy("directory", "token").agg(F.count("path").alias("n"), F.max("files").alias("files")).where("n >= files")
    newest = materialize(complete.groupBy("directory").agg(F.max("token").alias("newest")), "newest")
    newest = newest.hint("broadcast" if newest.count() <= FEW else "merge")

    deal = deal or {"__dealt": F.xxhash64("directory", "path")}
    by = [*deal, "directory", "path"]
    dealt = rows.join(newest, "directory", "left").withColumns({**deal, "__gone": F.col("state") == "gone"}).repartition(*deal)
    seen = dealt.groupBy(*by, "token", "__gone", "newest").agg(F.max_by(F.struct("files", "name", "size", "modified_ms"), F.struct("modified_ms", "size", "state")).alias("r"), F.max(F.col("state") == "live").alias("__was"))
    live = ~F.col("__gone") & F.coalesce(F.col("token") == F.col("newest"), F.lit(False))
    pending = ~F.col("__gone") & (F.col("newest").isNull() | (F.col("token") > F.col("newest")))
    missed = F.when(F.col("__gone"), F.col("token")).when(F.col("__was") & (F.col("token") < F.col("newest")) & F.col("path").isNotNull(), F.col("newest"))
    path = Window.partitionBy(*by)
    placed = seen.withColumns({"__live": live, "__pending": pending, "__missed": missed})
    placed = placed.withColumns({"__there": F.max("__live").over(path), "__first": F.row_number().over(path.orderBy(F.asc_nulls_last("__missed")))})
    gone = F.col("__missed").isNotNull() & ~F.col("__there") & (F.col("__first") == 1)
    state = F.when(F.col("__live"), "live").when(F.col("__pending"), "pending").when(gone, "gone")
    told = placed.select(*[c for c in deal if c != "__dealt"], "directory", F.when(gone, F.col("__missed")).otherwise(F.col("token")).alias("token"), "r.files", "path", "r.name", "r.size", "r.modified_ms", state.alias("state"))
    return told.where("state is not null")


class CatalogTable:
    """Rows of STATES in buckets of directories.  A version rewrites the buckets that its batch touches; what its log does
    not name is not read, so a batch that failed half-way or runs again leaves one right table.  Of a bucket, the version before
    stays for that, and for readers who have begun; older ones are removed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("directory"), F.lit(self.buckets)).cast("int")

    def _at(self, name: str):
        """(file system, path) of something in the table's folder."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _there(self, name: str) -> bool:
        store, at = self._at(name)
        return store.exists(at)

    def _newest(self, before: int | None) -> dict[int, int]:
        """The newest version of each bucket, of those below ``before``."""
        if not self._there("log"):
            return {}
        log = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/log")
        log = log if before is None else log.where(F.col("version") < before)
        return {r["bucket"]: r["v"] for r in log.groupBy("bucket").agg(F.max("version").alias("v")).collect()}  # one row a bucket

    def _forget(self, buckets: list[int], version: int) -> None:
        """Remove what the buckets had before the version that comes before this one."""
        for bucket, last in self._newest(version).items():
            if bucket in buckets:
                store, at = self._at(f"data/bucket={bucket}")
                for found in store.listStatus(at) if store.exists(at) else ():
                    name = found.getPath().getName()
                    if name.startswith("version=") and int(name[8:]) < last:
                        store.delete(found.getPath(), True)

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The newest version of each bucket (of those below ``before``)."""
        parts = [f"(bucket = {b} and version = {v})" for b, v in sorted(self._newest(before).items()) if buckets is None or b in buckets]
        if not parts:
            return self.spark.createDataFrame([], STATES)
        data = self.spark.read.schema(f"{STATES}, bucket int, version long").parquet(f"{self.path}/data")
        return data.where(" or ".join(parts)).select(*COLUMNS)

    def apply(self, batch: DataFrame, version: int) -> None:
        """Merge a batch of SCANS rows as this version; applying it again changes nothing."""
        with shuffles_dropped(batch.sparkSession), temporary():
            batch = materialize(batch.where("directory is not null"), "batch")
            touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # as many as there are buckets
            if not touched:
                return
            deal = {"bucket": self.bucket(), "__salt": F.pmod(F.xxhash64("path"), F.lit(8))}
            merged = merge_scans(self.read(version, touched), batch, deal).drop("__salt").withColumn("version", F.lit(version).cast("long"))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{self.path}/data")
            named = self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1)
            named.write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
            self._forget(touched, version)


def stream_scans(scans: DataFrame, path: str, checkpoint: str, buckets: int = 16):
    """A writer that merges a stream of scan rows into a ``CatalogTable``; the stream's batch numbers are the versions."""

    def write(batch: DataFrame, number: int) -> None:
        CatalogTable(batch.sparkSession, path, buckets).apply(batch, number)

    return scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
