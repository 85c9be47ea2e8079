"""Input tables of the image jobs, derived from the given tables.

Each derivation is one SQL text that both Spark and DuckDB run (``//`` is written ``div`` for Spark), in
whole numbers, so that both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy

#: The supported formats, and three that are not.
EXTENSIONS = ",".join((*policy.SUPPORTED, "txt", "flif", "md"))
N_EXTENSIONS = EXTENSIONS.count(",") + 1

CATALOG = f"""
SELECT image_id, directory, directory || '/' || name AS path, name, ext, size, modified_ms, width, height, heif, orientation
FROM (SELECT p_partkey AS image_id, '/library/' || replace(p_brand, '#', '') AS directory,
             CASE p_partkey % 3 WHEN 0 THEN 'img' WHEN 1 THEN 'IMG' ELSE 'Photo ' END || repeat('0', CAST(p_partkey % 3 AS INT))
               || CAST(p_partkey % 700 AS STRING) || CASE p_partkey % 5 WHEN 0 THEN '_' || CAST(p_partkey AS STRING) ELSE '' END || '.'
               || CASE WHEN p_partkey % 7 = 0 THEN upper(split_part('{EXTENSIONS}', ',', CAST(p_partkey % {N_EXTENSIONS} AS INT) + 1))
                       ELSE split_part('{EXTENSIONS}', ',', CAST(p_partkey % {N_EXTENSIONS} AS INT) + 1) END AS name,
             split_part('{EXTENSIONS}', ',', CAST(p_partkey % {N_EXTENSIONS} AS INT) + 1) AS ext,
             CAST((p_partkey * 7919) % 1200 AS BIGINT) * 1048576 + p_size AS size,
             1700000000000 + p_partkey * 60007 AS modified_ms,
             CAST((p_partkey * 37) % 14000 + 1 AS INT) AS width, CAST((p_partkey * 101) % 9000 + p_size AS INT) AS height,
             p_partkey % 11 = 0 AS heif, CAST(p_partkey % 9 AS INT) AS orientation
      FROM part) AS c
"""

CACHE_FILES = """
SELECT '/cache/' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '.png' AS path,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_shipdate AS mtime, l_suppkey AS root, l_partkey, l_orderkey, l_linenumber
FROM lineitem
"""

REQUESTS = """
SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS image_id,
       CASE l_linenumber % 4 WHEN 0 THEN 96 WHEN 1 THEN 160 WHEN 2 THEN 256 ELSE 128 END AS px
FROM lineitem
"""

VIEWS = """
SELECT event_id, user_id AS session_id, ts, event_id % (SELECT count(*) FROM part) + 1 AS image_id,
       CAST(((event_id * 37) % 640 + 1) AS DOUBLE) / 256 AS zoom, CAST((event_id * 13) % 901 AS DOUBLE) - 450 AS ox, CAST((event_id * 29) % 701 AS DOUBLE) - 350 AS oy,
       CAST(640 + (event_id % 3) * 320 AS DOUBLE) AS vw, CAST(480 + (event_id % 2) * 240 AS DOUBLE) AS vh,
       CAST(event_id % 4 AS INT) * 90 AS rotation, 1 + CAST(event_id % 2 AS INT) AS dpr
FROM events
"""

#: Image sizes of the views: the catalog's, without its smallest.
VIEW_IMAGES = "SELECT p_partkey AS image_id, CAST((p_partkey * 37) % 14000 + 300 AS INT) AS w, CAST((p_partkey * 101) % 9000 + p_size + 200 AS INT) AS h FROM part"

_VALUE = "CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INT)"
_FIELDS = """CAST(vec_id AS BIGINT) AS image_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, v AS r, (v * 7 + CAST(i AS INT)) % 256 AS g, 255 - v AS b,
       CASE WHEN label % 2 = 0 THEN 255 ELSE (v * 5 + CAST(i AS INT) * 3) % 256 END AS a, label"""
SPARK_PIXELS = f"SELECT {_FIELDS} FROM (SELECT vec_id, label, i, {_VALUE} AS v FROM embeddings LATERAL VIEW posexplode(embedding) AS i, e) AS p"
DUCK_PIXELS = f"SELECT {_FIELDS} FROM (SELECT vec_id, label, i - 1 AS i, {_VALUE} AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)) AS p"

#: The same values as rasters with odd sides: 7 x 9 pixels of each vector, and what is left as a column of one.
ODD_PIXELS = """
SELECT image_id * 2 + CASE WHEN i < 63 THEN 0 ELSE 1 END AS image_id, CAST(CASE WHEN i < 63 THEN i % 7 ELSE 0 END AS INT) AS x,
       CAST(CASE WHEN i < 63 THEN i // 7 ELSE i - 63 END AS INT) AS y, r, g, b, a
FROM (SELECT *, y * 8 + x AS i FROM pixels) AS p
"""

_VIEWS = {"catalog": CATALOG, "cache_files": CACHE_FILES, "requests": REQUESTS, "views": VIEWS, "view_images": VIEW_IMAGES}


def spark_sql(sql: str) -> str:
    return sql.replace("//", " div ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, its timestamps in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; the given tables that it names are passed by reference."""
    if name == "odd_pixels":
        return spark.sql(spark_sql(ODD_PIXELS).replace("FROM pixels", "FROM {pixels}"), pixels=derived(spark, sf_dir, "pixels"))
    sql = SPARK_PIXELS if name == "pixels" else _VIEWS[name]
    sources = {t: table(spark, sf_dir, t) for t in ("part", "lineitem", "events", "embeddings") if f"FROM {t}" in sql}
    text = spark_sql(sql)
    for t in sources:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **sources)


def with_ctes(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived tables that it needs in front."""
    bodies = {**_VIEWS, "pixels": DUCK_PIXELS, "odd_pixels": ODD_PIXELS}
    ctes = ", ".join(f"{n} AS ({bodies[n].strip()})" for n in names)
    return f"WITH {ctes} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {ctes}, {sql.lstrip()[5:]}"
