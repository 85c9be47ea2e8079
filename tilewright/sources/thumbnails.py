"""From a listing to stored thumbnails, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import caching, catalog, tiles
from ..policy import DEFAULT, Policy
from ..scratch import materialize, temporary
from . import headers, images, store


def wanted_thumbnails(listed: DataFrame, px: int, stored: DataFrame | None, policy: Policy = DEFAULT) -> DataFrame:
    """path, cache_key, error of the listed files (path, name, size, modified_ms) whose thumbnail is not stored.  A changed file
    has another key; files that cannot have one, by name, size or header, have a code."""
    keyed = listed.withColumns({"cache_key": N.cache_key(F.col("path"), F.col("size"), F.col("modified_ms"), F.lit(px)), "refused": catalog.thumbnail_error(N.extension(F.col("name")), F.col("size"), policy)})
    missing = keyed if stored is None else caching.cache_miss(keyed, stored)
    sides = headers.probe_headers(missing.where("refused is null")).select("path", "width", "height")
    unsafe = catalog.decode_safety(F.col("width"), F.col("height"), policy)["error"]
    return missing.join(sides, "path", "left").select("path", "cache_key", F.coalesce("refused", unsafe).alias("error"))


def build_thumbnails(spark: SparkSession, dirs: list[str], path: str, px: int, policy: Policy = DEFAULT) -> DataFrame:
    """List ``dirs``, decode what the store at ``path`` lacks, average, encode, and publish; returns path, cache_key and error
    of what was missing.  A job that runs again builds only what is new or has failed; one that dies has published
    nothing.  Rasters beyond the policy's bounds are not decoded (IMAGE_TOO_LARGE): tile jobs take those that are bitmaps.
    """
    with temporary() as tables:
        there = store.read_store(spark, path).select("cache_key") if store.latest_version(path) else None
        listed = materialize(images.scan_catalog(spark, dirs), "listed")
        wanted = materialize(wanted_thumbnails(listed, px, there, policy), "wanted")
        able = wanted.where("error is null").select("path", "cache_key")
        told = wanted
        if not able.isEmpty():
            small = images.decode_files(able, each=lambda rasters: tiles.raster_thumbnails(rasters, px))
            thumbs = materialize(small.join(able.hint("merge"), "path"), "thumbs")
            made = thumbs.where("error is null").select("cache_key", F.lit(px).alias("size"), "width", "height", "content")
            images.thumbnails_sink(made, path)
            failed = thumbs.where("error is not null").select("path", F.col("error").alias("failed"))
            told = wanted.join(failed, "path", "left").select("path", "cache_key", F.coalesce("error", "failed").alias("error"))
        return tables.keep(materialize(told, "built"))
