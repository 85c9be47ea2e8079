"""The streaming jobs, run over the given tables until all input is taken (available-now trigger)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..scratch import scratch_path, shuffles_dropped
from ..sources import store
from ..streaming import jobs, snapshots
from .derive import derived, table
from .library_queries import _KEYED, _STORE, _store
from .registry import query
from .view_queries import ORACLES


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files, its timestamps in UTC."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern, as a table may be one file: a stream's plain path has to be a folder.
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def _run(writer, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream into a scratch table and read that."""
    path = scratch_path(spark, name)
    started = writer.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def with_state_store(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """``run`` with state that need not fit memory."""
    key, provider = jobs.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        return run()
    finally:
        spark.conf.set(key, before)


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view log of ``derive.VIEWS``, as a stream."""
    e = F.col("event_id")
    images = table(spark, sf_dir, "part").count()
    return _stream(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("session_id"), "ts", (e % images + 1).alias("image_id"), (((e * 37) % 640 + 1).cast("double") / 256).alias("zoom"),
        ((e * 13) % 901).cast("double").alias("__x"), ((e * 29) % 701).cast("double").alias("__y"), (640 + (e % 3) * 320).cast("double").alias("vw"), (480 + (e % 2) * 240).cast("double").alias("vh"),
        ((e % 4).cast("int") * 90).alias("rotation"), (1 + e % 2).cast("int").alias("dpr"),
    ).withColumns({"ox": F.col("__x") - 450, "oy": F.col("__y") - 350}).drop("__x", "__y")


@query(ORACLES["lod_select"])
def stream_lod(spark, sf_dir):
    """Levels chosen frame by frame with each session's last level in state."""
    events = _views(spark, sf_dir).select("session_id", "event_id", "ts", (F.col("zoom") * F.col("dpr")).alias("scale"), F.lit(5).alias("max_level"))
    answered = with_state_store(spark, lambda: _run(jobs.stream_lod(events, idle_seconds=10**8).writeStream.outputMode("append"), spark, "lod"))
    return answered.select("event_id", "level")


@query(ORACLES["visible_tiles"])
def stream_tile_demand(spark, sf_dir):
    """Tiles demanded as views come in, counted afterwards."""
    events = _views(spark, sf_dir).withColumn("level", (F.col("event_id") % 4).cast("int"))
    demand = _run(jobs.stream_tile_demand(events, derived(spark, sf_dir, "view_images"), 256).writeStream, spark, "demand")
    return demand.where("not ring").groupBy("image_id", "z", "tx", "ty").agg(F.count("*").alias("views"))


@query(f"WITH {_KEYED}, {_STORE} SELECT DISTINCT cache_key, px FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM store)", "catalog", "requests")
def stream_thumbnails(spark, sf_dir):
    """Requests turned into builds: each key once, and only what the store lacks."""
    requests = _stream(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("image_id"), N.thumb_size(F.when(F.col("l_linenumber") % 4 == 0, 96).when(F.col("l_linenumber") % 4 == 1, 160).when(F.col("l_linenumber") % 4 == 2, 256).otherwise(128)).alias("px")
    )
    files = derived(spark, sf_dir, "catalog").select("image_id", "path", "size", "modified_ms")
    keyed = requests.join(files, "image_id").select(N.cache_key(F.col("path"), F.col("size"), F.col("modified_ms"), F.col("px")).alias("cache_key"), "path", "px")
    path = scratch_path(spark, "thumbnails")
    store.publish(_store(spark, sf_dir).select("cache_key", F.lit(160).alias("px"), F.lit(False).alias("built")), f"{path}/store")
    build = lambda work: work.select("cache_key", "px", F.lit(True).alias("built"))
    jobs.stream_thumbnails(keyed, f"{path}/store", build, f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return store.read_store(spark, f"{path}/store").where("built").select("cache_key", "px")


_SCANS = """s AS (SELECT '/library/' || CAST(l_suppkey % 40 AS VARCHAR) AS directory, CAST(l_linenumber % 3 AS BIGINT) AS token, CAST(l_orderkey AS VARCHAR) || '.png' AS path, max(l_partkey) AS size FROM lineitem GROUP BY ALL)"""


@query(f"WITH {_SCANS} SELECT directory, token, path, CAST(size AS BIGINT) AS size FROM s WHERE token = (SELECT max(token) FROM s AS o WHERE o.directory = s.directory)")
def catalog_upsert(spark, sf_dir):
    """Scans of directories come in pieces and out of order; the newest complete one of each directory stays."""
    li = table(spark, sf_dir, "lineitem")
    directory = F.concat(F.lit("/library/"), (F.col("l_suppkey") % 40).cast("string"))
    rows = li.groupBy(directory.alias("directory"), (F.col("l_linenumber") % 3).cast("long").alias("token"), F.concat(F.col("l_orderkey").cast("string"), F.lit(".png")).alias("path")).agg(F.max("l_partkey").cast("long").alias("size"))
    files = rows.groupBy("directory", "token").agg(F.count("*").alias("files"))  # 120 rows at most
    scans = rows.join(F.broadcast(files), ["directory", "token"]).select("directory", "token", "files", "path", F.col("path").alias("name"), "size", F.lit(0).cast("long").alias("modified_ms"))
    path = scratch_path(spark, "scans")
    with shuffles_dropped(spark):
        scans.repartition(4, "path").write.parquet(f"{path}/in")
    seen = spark.readStream.schema(snapshots.SCANS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    snapshots.stream_scans(seen, f"{path}/catalog", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return snapshots.CatalogTable(spark, f"{path}/catalog").read().where("state = 'live'").select("directory", "token", "path", "size")
