"""JSON sources: pyramid manifests, settings, timing events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P

MANIFEST = "algo_version INT, tile_size INT, levels ARRAY<STRUCT<z: INT, width: INT, height: INT>>"


def write_manifest(levels: DataFrame, tile_size: int = P.DEFAULT.tile_size, version: int = P.DEFAULT.pyramid_version) -> DataFrame:
    """(hash, manifest): JSON of each image's levels from 1 on, in order."""
    grouped = levels.where("z >= 1").groupBy("hash").agg(F.array_sort(F.collect_set(F.struct("z", "width", "height"))).alias("levels"))
    return grouped.select("hash", F.to_json(F.struct(F.lit(version).alias("algo_version"), F.lit(tile_size).alias("tile_size"), "levels")).alias("manifest"))


def load_manifest(manifests: DataFrame, level_files: DataFrame, version: int = P.DEFAULT.pyramid_version) -> DataFrame:
    """Levels (hash, z, width, height) of valid manifests (hash, manifest): version as expected, levels there,
    none of them 0, and a file (hash, z) for each."""
    parsed = manifests.select("hash", F.from_json("manifest", MANIFEST).alias("m"))
    sound = parsed.where((F.col("m.algo_version") == version) & (F.size("m.levels") > 0) & ~F.exists("m.levels", lambda x: x["z"].isNull() | (x["z"] == 0)))
    levels = sound.select("hash", F.explode("m.levels").alias("l")).select("hash", "l.z", "l.width", "l.height")
    there = levels.join(level_files.select("hash", "z").distinct().withColumn("found", F.lit(True)), ["hash", "z"], "left")
    whole = there.groupBy("hash").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("whole")).where("whole")
    return levels.join(whole, "hash", "left_semi")


#: Names and defaults of the settings file.
_LARGE = {"fileSizeThresholdMB": 300, "pixelThreshold": 50_000_000, "sideThreshold": 12_000, "previewMaxSize": 4096, "tileSize": 512, "prefetchRadius": 1, "neighborPrefetchCount": 1}
_CACHE = {"pyramidCacheLimitMB": 1024, "memoryCacheLimitMB": 512, "diskCacheLimitMB": 2048}
_PERFORMANCE = {"preloadNormalCount": 2}
_THUMBNAIL = {"thumbnailSize": P.DEFAULT_THUMB}
SETTINGS = {"largeImage": _LARGE, "cache": _CACHE, "performance": _PERFORMANCE, "thumbnail": _THUMBNAIL}


def settings_schema() -> str:
    groups = [f"{g}: STRUCT<{', '.join(f'{k}: BIGINT' for k in fields)}>" for g, fields in SETTINGS.items()]
    return f"STRUCT<{', '.join(groups)}, shortcuts: MAP<STRING, STRING>, _corrupt: STRING>"


def load_settings(texts: DataFrame) -> DataFrame:
    """(id, json) to one column per setting, missing ones by default, with shortcuts, ``state`` and
    ``quarantined``.

    state: ok, corrupt (defaults; the text is kept in ``quarantined``) or rejected (a fixed-choice setting
    has another value; defaults, and the text is kept).
    """
    parsed = texts.withColumn("s", F.from_json("json", settings_schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    corrupt = F.col("s").isNull() | F.col("s._corrupt").isNotNull()
    wrong = F.lit(False)
    for group, fields in SETTINGS.items():
        for k in fields:
            if k in P.ALLOWED:
                wrong = wrong | F.coalesce(~F.col(f"s.{group}.{k}").isin(*P.ALLOWED[k]), F.lit(False))
    state = F.when(corrupt, F.lit("corrupt")).when(wrong, F.lit("rejected")).otherwise(F.lit("ok"))
    rows = parsed.withColumn("state", state)
    value = lambda g, k, d: F.when(F.col("state") == "ok", F.coalesce(F.col(f"s.{g}.{k}"), F.lit(d))).otherwise(F.lit(d)).cast("long").alias(k)
    return rows.select("id", "state", *[value(g, k, d) for g, fields in SETTINGS.items() for k, d in fields.items()], F.when(F.col("state") == "ok", F.col("s.shortcuts")).alias("shortcuts"), F.when(F.col("state") != "ok", F.col("json")).alias("quarantined"))


TELEMETRY = "event STRING, path STRING, probeMs STRING, openMs STRING, count INT, tx0 INT, ty0 INT, tx1 INT, ty1 INT, message STRING"
TELEMETRY_EVENTS = ("probe", "open_large_image", "first_screen_tiles", "open_fallback", "error")


def parse_telemetry(lines: DataFrame) -> DataFrame:
    """(id, line) to event, probe_ms, open_ms, count and message; a line that is no known event is kept raw.
    The two times are written as text."""
    rows = lines.withColumn("t", F.from_json("line", TELEMETRY))
    known = F.coalesce(F.col("t.event").isin(*TELEMETRY_EVENTS), F.lit(False))
    of = lambda c: F.when(known, c)
    return rows.select(
        "id", of(F.col("t.event")).alias("event"), of(F.col("t.probeMs").try_cast("double")).alias("probe_ms"), of(F.col("t.openMs").try_cast("double")).alias("open_ms"), of(F.col("t.count")).alias("count"), of(F.col("t.message")).alias("message"), F.when(~known, F.col("line")).alias("raw")
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(hash, manifest) of manifest files <hash>/manifest.json below a folder, read by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/manifest\.json$", 1).alias("hash"), F.decode("content", "UTF-8").alias("manifest"))
