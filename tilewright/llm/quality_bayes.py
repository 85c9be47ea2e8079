"""Quality classifier by hierarchical empirical Bayes, in grouped aggregations.

Evidence about a document comes from its own text (naive Bayes classifiers over binned ratios and over hashed
words, fitted by counting over all labelled documents) and from where it was found: the labels of its host,
and of its path on that host.  The documents table has no addresses: ``source`` stands for the host, and
``lang`` for the path on it.  A site's posterior mean is shrunk towards its parent's (path to host, host to the global
prior) by prior strengths that are themselves estimated from how much sites differ, so a site with few
labels says little.  The site gives the prior odds, the text the likelihood ratio.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS, materialize, text_or_empty
from .quality_rules import STOP_WORDS, SYMBOLS

#: Upper bounds of each feature's bins, in percent of its denominator.
BINS = {
    "symbols": (0, 1, 3, 6, 12),
    "upper": (2, 5, 10, 30, 60),
    "stops": (1, 4, 8, 14, 20, 30),
    "repeats": (10, 30, 50, 70, 90),
    "pipes": (0, 1, 3, 6, 12),
    "marks": (0, 2, 5, 10, 20),
    "length": (300, 400, 500, 600, 700, 900),
}
SMOOTHING = 1.0
#: Words are hashed into so many buckets (three hexadecimal digits); a bucket's log ratio is a whole number of
#: thousandths.  Words depend on each other, so their mean counts, as much as so many independent ones would.
WORD_BUCKETS, WORD_SCALE, WORD_WEIGHT = 4096, 1000, 2
MIN_STRENGTH, MAX_STRENGTH = 2.0, 10_000.0
THRESHOLD = 0.5


def _features(text: Column) -> dict[str, Column]:
    """Whole-number pairs (numerator, denominator) of each feature, by built-in functions."""
    words = F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")
    return {"__words": words, "__chars": F.char_length(F.translate(text, WS, ""))}


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def _bin(name: str, numerator: Column, denominator: Column) -> Column:
    """Number of bounds that the percentage exceeds; -1 where there is nothing to measure."""
    over = sum((F.when(100 * numerator > bound * denominator, 1).otherwise(0) for bound in BINS[name]), F.lit(0))
    return F.when(denominator > 0, over).otherwise(F.lit(-1)).cast("int").alias(name)


def binned(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """One narrow row per document: id, host, path, the bin of each feature and the buckets of its different
    words, over the whole text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), text_or_empty(f"`{text_col}`").alias("__text"))
    rows = rows.withColumns(_features(F.col("__text"))).withColumn("__distinct", F.array_distinct("__words"))
    text, words, chars = F.col("__text"), F.col("__words"), F.col("__chars")
    bucket = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 3), 16, 10).cast("smallint")
    n = F.size(words)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # Numerators are columns of their own, so that each is worked out once and not for every bound.
    counted = rows.select(
        "id", "host", "path", n.alias("__n"), chars.alias("__chars"),
        _count(text, SYMBOLS.replace("|", "")).alias("__symbols"), _count(text, letters).alias("__upper"),
        F.size(F.filter(words, lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).alias("__stops"), (n - F.size("__distinct")).alias("__repeats"),
        _count(text, "|").alias("__pipes"), _count(text, "!?").alias("__marks"), F.array_distinct(F.transform("__distinct", bucket)).alias("buckets"),
    )
    n, chars = F.col("__n"), F.col("__chars")
    of = {"symbols": ("__symbols", chars), "upper": ("__upper", chars), "stops": ("__stops", n), "repeats": ("__repeats", n), "pipes": ("__pipes", n), "marks": ("__marks", n), "length": ("__chars", n)}
    return counted.select("id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "buckets", *[_bin(name, F.col(c), d) for name, (c, d) in of.items()])


def _strength(sites: DataFrame, mean: Column) -> float:
    """Prior strength by the method of moments: how far site rates spread beyond sampling noise.

    ``sites``: n labels, k of them good, and the parent's rate in ``mean``.
    """
    got = sites.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2)).alias("between"), F.sum(mean * (1 - mean)).alias("noise"), F.sum(F.col("n") - 1).alias("free"), F.sum(F.col("n") * mean * (1 - mean)).alias("scale"), F.sum("n").alias("labels")
    ).first()
    if not got["labels"] or not got["scale"] or got["scale"] <= 0:
        return MAX_STRENGTH
    # Beta-binomial: E[between - noise] = spread * sum(n - 1), with spread = mean (1 - mean) / (strength + 1)
    spread = (got["between"] - got["noise"]) / max(got["free"], 1)
    typical = got["scale"] / got["labels"]
    return float(min(MAX_STRENGTH, max(MIN_STRENGTH, typical / spread - 1))) if spread > 0 else MAX_STRENGTH


def _word_evidence(known: DataFrame, total) -> Column:
    """Log likelihood ratio of a document's buckets: the mean of their ratios, which are counted over all
    labelled documents into one row a bucket."""
    counts = known.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    ratios = [0] * WORD_BUCKETS
    for c in counts:
        good = (c["good"] + SMOOTHING) / (total["k"] + 2 * SMOOTHING)
        bad = (c["n"] - c["good"] + SMOOTHING) / (total["n"] - total["k"] + 2 * SMOOTHING)
        ratios[c["bucket"]] = math.floor(WORD_SCALE * math.log(good / bad) + 0.5)
    table = F.lit(np.array(ratios, dtype=np.int32))
    summed = F.aggregate("buckets", F.lit(0), lambda s, b: s + F.get(table, b.cast("int")))
    return F.when(F.size("buckets") > 0, WORD_WEIGHT * summed / (WORD_SCALE * F.size("buckets"))).otherwise(F.lit(0.0))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", section_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, host, path, n_host, n_path, host_mean, path_mean, evidence (log
    likelihood ratio of the text), score and kept (score at least ``threshold``).

    host: ``host_col``; path: ``section_col`` on that host.  Null hosts and sections are the empty site, and
    a null text has no measurable feature, which is a bin of its own.  Labels other than 0 and 1, and labels
    of documents that are not there, are ignored; where a document has several, each counts.  Repeated
    documents each get a row (and each counts where labelled); a null identifier has no label.  Without
    labels every score is 0.5.  An empty table gives no rows.  Whole texts count, however long.  Only the named
    columns are read, so others cannot clash.
    """
    host = F.col(f"`{host_col}`").cast("string")
    rows = materialize(binned(docs, id_col, text_col, host, F.coalesce(F.col(f"`{section_col}`").cast("string"), F.lit(""))), "bins")
    truth = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    known = materialize(rows.join(truth, "id"), "labelled")
    names = list(BINS)
    # Counts by feature, bin and label: a table of a few dozen rows, whatever the number of documents.
    cells = known.select("y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in names])).alias("c")).groupBy("c.feature", "c.bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")).first()
    prior = (total["k"] + 1.0) / (total["n"] + 2.0)
    evidence = F.lit(0.0)
    for f in names:
        ratio, width = F.lit(0.0), len(BINS[f]) + 2
        for c in sorted((c for c in cells if c["feature"] == f), key=lambda c: c["bin"]):
            good = (c["good"] + SMOOTHING) / (total["k"] + SMOOTHING * width)
            bad = (c["n"] - c["good"] + SMOOTHING) / (total["n"] - total["k"] + SMOOTHING * width)
            ratio = F.when(F.col(f) == c["bin"], F.log(F.lit(good / bad))).otherwise(ratio)
        evidence = evidence + ratio
    evidence = evidence + _word_evidence(known, total)
    by_host = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    host_strength = _strength(by_host, F.lit(prior))
    hosts = by_host.select("host", F.col("n").alias("n_host"), ((F.col("k") + F.lit(host_strength * prior)) / (F.col("n") + F.lit(host_strength))).alias("host_mean"))
    by_path = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("k")).join(hosts, "host")
    path_strength = _strength(by_path, F.col("host_mean"))
    paths = by_path.select("host", "path", F.col("n").alias("n_path"), ((F.col("k") + F.lit(path_strength) * F.col("host_mean")) / (F.col("n") + F.lit(path_strength))).alias("path_mean"))
    # The text has had its say before anything is joined, so the joined rows are narrow.  A hot site is one key of
    # a plain join with a written table, which adaptive execution splits; few sites are broadcast by size.
    sites = materialize(paths.join(hosts, "host").select("host", "path", "n_host", "host_mean", "n_path", "path_mean"), "sites")
    scored = rows.select("id", "host", "path", evidence.alias("evidence"))
    hosts = sites.groupBy("host").agg(F.first("n_host").alias("n_host"), F.first("host_mean").alias("host_mean"))
    hosts = materialize(hosts, "hosts")
    placed = scored.join(hosts, "host", "left").join(sites.select("host", "path", "n_path", "path_mean"), ["host", "path"], "left")
    evidence = F.col("evidence")
    host_mean = F.coalesce("host_mean", F.lit(prior))
    path_mean = F.coalesce("path_mean", host_mean)
    odds = F.log(path_mean / (1 - path_mean)) + evidence
    score = F.lit(1.0) / (1 + F.exp(-odds))
    return placed.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.coalesce("n_host", F.lit(0)).cast("long").alias("n_host"),
        F.coalesce("n_path", F.lit(0)).cast("long").alias("n_path"),
        F.round(host_mean, 6).alias("host_mean"),
        F.round(path_mean, 6).alias("path_mean"),
        F.round(evidence, 6).alias("evidence"),
        F.round(score, 6).alias("score"),
        (score >= threshold).alias("kept"),
    )
