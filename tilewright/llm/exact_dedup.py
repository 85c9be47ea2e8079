"""Exact deduplication by a tree-merge of sorted digest runs.

A *run* is a list of (digest, smallest identifier, rows) sorted by digest.  Each Arrow batch of documents
becomes one run.  Nodes are numbered in base ``radix``; in round *r* a node sends each part of its run to
the node whose *r*-th digit equals the *r*-th digit of the digest, and every node merges the ``radix``
runs it receives, keeping the smallest identifier of equal entries.  After the last round each node holds
all entries of its slice of the digest space.  Each round moves an entry once, and copies have already been
folded by the rounds before, so no group of copies ever meets in one task unfolded.

Equality is verified at every level: entries merge only where the 64-bit run digest, the SHA-256, and the
byte length of the normalised text all agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, id_order, materialize, text_or_empty

RADIX = 16
KEY = ["digest", "sha", "n_bytes"]


def normalized_text(text_col: str) -> Column:
    """Each run of white space becomes one space; null is empty."""
    return F.regexp_replace(text_or_empty(text_col), WS_CLASS + "+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: identifier, order, tie-breaker, digest, SHA-256 and byte length."""
    norm = docs.select(
        F.col(id_col).alias("id"),
        id_order(id_col).alias("ord"),
        F.monotonically_increasing_id().alias("line"),
        normalized_text(text_col).alias("norm"),
    )
    return norm.select(
        "id", "ord", "line", F.xxhash64("norm").alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes")
    )


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run for each batch: equal entries folded, smallest (ord, line) kept."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by([(k, "ascending") for k in (*KEY, "ord", "line")])
        folded = table.group_by(KEY, use_threads=False).aggregate([("ord", "first"), ("line", "first"), ("ord", "count")])
        folded = folded.rename_columns([*KEY, "ord", "line", "n"]).select([*KEY, "ord", "line", "n"])
        yield from folded.combine_chunks().to_batches()


def tree_merge(narrow: DataFrame, radix: int = RADIX) -> DataFrame:
    """(digest, sha, n_bytes) -> smallest (ord, line) and number of rows, by exchanging runs in rounds."""
    spark = narrow.sparkSession
    wanted = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rounds = 1
    while radix**rounds < wanted:
        rounds += 1
    base = 2
    while base**rounds < wanted:  # the smallest base that gives enough nodes in so many rounds
        base += 1
    nodes = base**rounds
    runs = narrow.select(*KEY, "ord", "line").mapInArrow(_first_runs, "digest long, sha binary, n_bytes long, ord long, line long, n long")
    runs = runs.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(nodes)))
    place = F.pmod(F.col("digest"), F.lit(nodes).cast("long")).cast("int")
    for r in range(rounds):
        unit = base**r
        digit = lambda c: F.pmod(F.floor(c / F.lit(unit)).cast("int"), F.lit(base))  # noqa: B023, E731
        runs = runs.withColumn("node", (F.col("node") + (digit(place) - digit(F.col("node"))) * unit).cast("int"))
        runs = (
            runs.repartitionById(nodes, F.col("node"))
            .sortWithinPartitions("node", *KEY)
            .groupBy("node", *KEY)
            .agg(F.min(F.struct("ord", "line")).alias("low"), F.sum("n").alias("n"))
            .select("node", *KEY, F.col("low.ord").alias("ord"), F.col("low.line").alias("line"), "n")
        )
    return runs.drop("node")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents by equal normalised text; of each group the smallest identifier stays.

    Returns one row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and is equal to other empty texts.  A null identifier sorts last, so it stays
    only where the whole group has none.  Where the smallest identifier occurs on several rows of a group
    (repeated rows), exactly one of them is kept.  An empty table gives no rows.  Only the two named
    columns are read; others, whatever their names, are ignored.
    """
    narrow = materialize(digests(docs, id_col, text_col), "digests")
    merged = tree_merge(narrow)
    won = merged.select(*KEY, F.col("ord").alias("low_ord"), F.col("line").alias("low_line"), F.col("n").alias("group_size"))
    # A group of copies is one key here: both sides are plain shuffled inputs, which adaptive execution splits.
    joined = narrow.join(won, KEY)
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("low_ord") == F.lit((1 << 63) - 1), F.when(F.col("id").isNotNull(), F.col("id"))).otherwise(F.col("low_ord")).alias("keep_id"),
        F.col("group_size"),
        ((F.col("ord") == F.col("low_ord")) & (F.col("line") == F.col("low_line"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that exact_dedup keeps; rows that repeat both identifier and
    normalised text collapse to the one whose own text has the smallest hash, however often this is worked out."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(id_order(id_col).alias("__tw_ord"), F.col("text_sha256").alias("__tw_sha"))
    keyed = docs.withColumns({"__tw_ord": id_order(id_col), "__tw_sha": F.sha2(normalized_text(text_col), 256)})
    found = keyed.join(kept.distinct(), ["__tw_ord", "__tw_sha"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return found.groupBy("__tw_ord", "__tw_sha").agg(F.min_by(row, F.xxhash64(text_or_empty(text_col))).alias("__tw_row")).select("__tw_row.*")
