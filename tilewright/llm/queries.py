"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_middle, langid, packing, periodic, quality_bayes, quality_rules, sentencepiece_codec, sharding, simhash, substring, topk, warc
from .common import documents


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("group_size")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(*wanted)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(documents(spark, sf_dir))


def op10_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which about a tenth, by the hash of their identifier, repeat their words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g, n = F.col("__h").substr(F.lit(1), F.length("__h") - 1), F.size("__words")
    g = F.coalesce(F.nullif(g, F.lit("")).cast("long"), F.lit(0))
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    taken = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("__words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    asked = docs.select("doc_id", "text", h.cast("string").alias("__h"), F.when(h % 10 == 0, words).alias("__words"))
    return asked.select("doc_id", F.when(n > 0, F.array_join(taken, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted(documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.s")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.p")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(documents(spark, sf_dir))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_middle.restored(F.col("form"), F.col("output")), 256)}
    return made.withColumns(digests).drop("output")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lexical_packing,
        op2_simhash_near_dedup,
        op3_exact_dedup,
        op4_sentencepiece,
        op5_quality_rules,
        op6_language_id,
        op7_warc,
        op8_substring_dedup,
        op9_kd_sharding,
        op10_hierarchical_quality,
        op11_periodic_runs,
        op12_threshold_top_k,
        op13_fill_in_middle,
    )
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))


def _quality_sql() -> str:
    """op10 in DuckDB: the same counts, ratios, shrinkage and odds."""
    bins = quality_bayes.BINS
    of = {"symbols": ("symbols", "chars"), "upper": ("upper", "chars"), "stops": ("stops", "n"), "repeats": ("repeats", "n"), "pipes": ("pipes", "n"), "marks": ("marks", "n"), "length": ("chars", "n")}
    binned = ", ".join(f"CASE WHEN {d} > 0 THEN {' + '.join(f'CAST(100 * {c} > {b} * {d} AS INT)' for b in bins[f])} ELSE -1 END AS {f}" for f, (c, d) in of.items())
    cells = " UNION ALL ".join(f"SELECT '{f}' AS feature, {len(bounds) + 2} AS width, {f} AS bin, y FROM known" for f, bounds in bins.items())
    evidence = " + ".join(f"coalesce((SELECT ratio FROM cells WHERE feature = '{f}' AND cells.bin = r.{f}), 0)" for f in bins)
    low, high, weight, scale = quality_bayes.MIN_STRENGTH, quality_bayes.MAX_STRENGTH, quality_bayes.WORD_WEIGHT, quality_bayes.WORD_SCALE

    def strength(sites: str) -> str:
        """Of a table (n, k, mean)."""
        return f"""(SELECT CASE WHEN labels IS NULL OR labels = 0 OR scale <= 0 OR between_ - noise <= 0 THEN {high}::DOUBLE
            ELSE least({high}::DOUBLE, greatest({low}::DOUBLE, scale / labels / ((between_ - noise) / greatest(free, 1)) - 1)) END
            FROM (SELECT sum(n * pow(k / n::DOUBLE - mean, 2)) AS between_, sum(mean * (1 - mean)) AS noise, sum(n - 1) AS free, sum(n * mean * (1 - mean)) AS scale, sum(n) AS labels FROM {sites} WHERE n > 1))"""

    return rf"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(lang, '') AS path, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
             m AS (SELECT doc_id, host, path, len(words) AS n, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS chars, length(regexp_replace(text, '[^#*$%&<>]+', '', 'g')) AS symbols,
                          length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper, len(list_filter(words, lambda w: list_contains([{_STOP}], w))) AS stops, len(words) - len(list_distinct(words)) AS repeats,
                          length(regexp_replace(text, '[^|]+', '', 'g')) AS pipes, length(regexp_replace(text, '[^!?]+', '', 'g')) AS marks,
                          list_distinct(list_transform(list_distinct(words), lambda w: CAST('0x' || substring(md5(w), 1, 3) AS INT))) AS buckets FROM d),
             r AS (SELECT doc_id, host, path, buckets, {binned} FROM m),
             known AS (SELECT r.*, quality AS y FROM r JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
             t AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(y), 0)::DOUBLE AS k, (coalesce(sum(y), 0) + 1) / (count(*) + 2)::DOUBLE AS prior FROM known),
             cells AS (SELECT feature, bin, ln(((good + 1) / (t.k + width)) / ((c.n - good + 1) / (t.n - t.k + width))) AS ratio FROM (SELECT feature, width, bin, sum(y)::DOUBLE AS good, count(*)::DOUBLE AS n FROM ({cells}) GROUP BY ALL) c, t),
             words AS (SELECT bucket, floor({scale} * ln(((good + 1) / (t.k + 2)) / ((w.n - good + 1) / (t.n - t.k + 2))) + 0.5)::INT AS ratio
                       FROM (SELECT bucket, sum(y)::DOUBLE AS good, count(*)::DOUBLE AS n FROM (SELECT y, unnest(buckets) AS bucket FROM known) GROUP BY bucket) w, t),
             said AS (SELECT key, {weight} * coalesce(sum(ratio), 0) / ({scale} * count(*))::DOUBLE AS ratio FROM (SELECT key, unnest(buckets) AS bucket FROM (SELECT DISTINCT buckets, hash(buckets) AS key FROM r)) LEFT JOIN words USING (bucket) GROUP BY key),
             h1 AS (SELECT host, count(*) AS n, sum(y) AS k, (SELECT prior FROM t) AS mean FROM known GROUP BY host),
             h2 AS (SELECT host, n AS n_host, (k + s * mean) / (n + s) AS host_mean FROM h1, (SELECT {strength('h1')} AS s)),
             p1 AS (SELECT known.host, path, count(*) AS n, sum(y) AS k, any_value(host_mean) AS mean FROM known JOIN h2 ON known.host = h2.host GROUP BY known.host, path),
             p2 AS (SELECT host, path, n AS n_path, (k + s * mean) / (n + s) AS path_mean FROM p1, (SELECT {strength('p1')} AS s)),
             e AS (SELECT r.doc_id, r.host, r.path, coalesce(n_host, 0) AS n_host, coalesce(n_path, 0) AS n_path, coalesce(host_mean, t.prior) AS host_mean, coalesce(path_mean, host_mean, t.prior) AS path_mean,
                          {evidence} + coalesce(said.ratio, 0) AS evidence
                   FROM r CROSS JOIN t LEFT JOIN said ON said.key = hash(r.buckets) LEFT JOIN h2 ON r.host = h2.host LEFT JOIN p2 ON r.host = p2.host AND r.path = p2.path)
        SELECT doc_id, host, path, CAST(n_host AS BIGINT) AS n_host, CAST(n_path AS BIGINT) AS n_path, round(host_mean, 6) AS host_mean, round(path_mean, 6) AS path_mean, round(evidence, 6) AS evidence,
               round(1 / (1 + exp(-(ln(path_mean / (1 - path_mean)) + evidence))), 6) AS score, 1 / (1 + exp(-(ln(path_mean / (1 - path_mean)) + evidence))) >= {quality_bayes.THRESHOLD} AS kept
        FROM e
    """


ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g USING (t)
    """,
    "op5_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                          list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM d),
             g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
                   FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
             c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, range(3) AS x(o) GROUP BY doc_id),
             m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                          CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                          CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                          CAST(len(lines) AS BIGINT) AS n_lines,
                          CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                          CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                          len(list_filter(words, lambda s: list_contains([{_STOP}], lower(s)))) AS n_stop_words
                   FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
             b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars <= 16 * n_words AND word_chars >= 2 * n_words AND 100 * n_symbols <= 5 * word_chars
               AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_stop_words >= 2 * n_words AS kept
        FROM b
    """,
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             h AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
             d AS (SELECT page_id, payload_bytes,
                          array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              CAST((CAST(('0x' || substring(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest
                   FROM h),
             f AS (SELECT payload_digest, payload_bytes, min(page_id) AS low FROM d GROUP BY ALL)
        SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN d.page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN d.page_id <> low THEN low END AS refers_to
        FROM d JOIN f USING (payload_digest, payload_bytes)
    """,
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
             v AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win
                   FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM w)),
             l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
             c AS (SELECT DISTINCT doc_id, i + o AS k FROM l, range(20) AS x(o)),
             e AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM w),
             s AS (SELECT e.doc_id, string_agg(e.words[e.k], ' ' ORDER BY e.k) AS kept, count(*) AS n
                   FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.k = c.k WHERE c.k IS NULL GROUP BY e.doc_id)
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(s.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(s.kept, '')) AS kept_sha256
        FROM w LEFT JOIN s USING (doc_id)
    """,
    "op10_hierarchical_quality": _quality_sql(),
    "op12_threshold_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, sha256('42:' || doc_id) AS hex FROM documents),
             h AS (SELECT doc_id, text, tokens, list_transform(range(4), lambda k: CAST('0x' || substring(hex, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM d),
             c AS (SELECT *, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
             p AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
