"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits.  If two fingerprints differ in at most three bits,
one of their segments differs in at most one.  So each segment's ball of radius one is looked up in a table
of all segments, and the complete distance of what is found is verified.  A differing bit is 0 on one side,
so it is enough to probe with single bits *set*: about 17 keys for a segment, whatever the corpus holds.

Buckets that hold more than ``bucket_limit`` fingerprints are not compared pair by pair.  There, every
member names the points of a small ball around its *other* segment, and members that name a common point are
linked to one member that is provably within reach of all of them: exact, linear in the bucket, and a point
can be named by a bounded number of distinct fingerprints only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_LONG, Words, id_order, materialize, merged, slices, small_batches, text_or_empty
from .components import connected_components

MAX_DISTANCE = 3
SHINGLE_WORDS = 3
HASH_SEED = 42
BUCKET_LIMIT = 256
_LOW32 = (1 << 32) - 1


def simhash_batch(texts: pa.Array, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints (as signed longs) of an array of texts."""
    words = Words(texts, lower=True)
    doc = words.doc_of()
    short = np.flatnonzero((words.n > 0) & (words.n < shingle_words))
    k = shingle_words - 1
    head = np.flatnonzero(doc[: len(doc) - k] == doc[k:]) if len(doc) > k else np.zeros(0, dtype=np.int64)
    at = np.concatenate([head, words.first[short]])
    last = np.concatenate([head + k, words.first[short + 1] - 1])
    owner = doc[at] if len(at) else np.zeros(0, dtype=np.int64)
    order = np.argsort(owner, kind="stable")
    owner, starts, ends = owner[order], words.start[at[order]], words.end[last[order]]
    out = np.zeros(len(words.n), dtype=np.uint64)
    if not len(owner):
        return out.view(np.int64)
    canon, digest = words.canon.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(canon[a:b], HASH_SEED) for a, b in zip(starts.tolist(), ends.tolist())), dtype="<u8", count=len(owner))
    docs, first, count = np.unique(owner, return_index=True, return_counts=True)
    ones = np.zeros((len(docs), 64), dtype=np.int64)
    for d, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        bits = np.unpackbits(hashes[a : a + n].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, n, 255):  # sums of 255 rows fit a byte
            ones[d] += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    out[docs] = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, ord, th, fp): one row per input row; th tells apart rows that share an identifier.  Null text,
    and text without words, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "ord", "th")), pa.array(simhash_batch(batch.column("text"), shingle_words))], names=["id", "ord", "th", "fp"]
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), id_order(id_col).alias("ord"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, "id long, ord long, th long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """(seg, key, fp): each fingerprint under both of its segments; the segment's number is in the key."""
    low = F.col("fp").bitwiseAND(F.lit(_LOW32))
    high = F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))
    return fps.select(F.explode(F.array(low, high)).alias("key"), "fp")


def hamming_links(fps: DataFrame, max_distance: int = MAX_DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) that connect just what pairs of distinct fingerprints at most ``max_distance`` apart do.

    Pairs in ordinary buckets are all given; in crowded ones enough of them to connect the same
    fingerprints.  ``fps``: distinct fingerprints, column ``fp``.  ``max_distance`` is 0 to 3.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("two segments with balls of radius one serve distances up to 3")
    table = _segments(fps)
    radius = 1 if max_distance >= 2 else 0  # up to distance 1, one segment is always equal
    ball = F.concat(
        F.array(F.col("key")),
        F.expr("filter(transform(sequence(0, 31), b -> key | shiftleft(1L, b)), k -> k != key)") if radius else F.array().cast("array<long>"),
    )
    probes = table.select(F.explode(ball).alias("probe"), "key", F.col("fp").alias("from_fp"))
    counts = table.groupBy("key").agg(F.count("*").alias("n"))
    entries = table.join(merged(counts), "key").select(F.col("key").alias("to_key"), F.col("fp").alias("to_fp"), "n")
    apart = F.bit_count(F.col("from_fp").bitwiseXOR(F.col("to_fp")))
    once = (F.col("probe") != F.col("key")) | (F.col("from_fp") < F.col("to_fp"))
    near = merged(probes).join(entries, (F.col("probe") == F.col("to_key")) & (F.col("n") <= bucket_limit) & once & (apart <= max_distance))
    links = near.select(F.col("from_fp").alias("u"), F.col("to_fp").alias("v"))
    crowded = materialize(counts.where(F.col("n") > bucket_limit).select(F.col("key").alias("probe")), "crowded")
    if crowded.isEmpty():
        return links
    return links.unionByName(_crowded_links(probes.join(merged(crowded), "probe"), max_distance))


def _crowded_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links in crowded buckets.  A member either has the bucket's key itself (far = 0) or is one bit off.

    Members of the first kind name the points within 2 of their other segment, the others those within 1,
    so far as the distance that is left allows.  At each point, the smallest *anchor* (far = 0, within 1)
    is at most ``max_distance`` from everyone who named the point.
    """
    masks = [0, *(1 << b for b in range(32)), *((1 << a) | (1 << b) for a, b in combinations(range(32), 2))]
    rest = F.when(F.col("probe") >= (1 << 32), F.col("from_fp").bitwiseAND(F.lit(_LOW32))).otherwise(F.shiftrightunsigned("from_fp", 32))
    far = (F.col("probe") != F.col("key")).cast("int")
    #: Anchors reach 1 in the other segment where a pair may differ in 2 there, else 0; the rest of the distance is the others'.
    anchor = 1 if max_distance >= 2 else 0
    reach = F.when(far == 0, F.lit(max_distance - anchor)).otherwise(F.lit(max_distance - anchor - 1))
    sized = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: m.cast("long"))
    named = (
        members.select("probe", F.col("from_fp").alias("fp"), far.alias("far"), rest.alias("rest"), reach.alias("reach"))
        .where("reach >= 0")
        .select("probe", "fp", "far", "rest", F.explode(F.filter(sized, lambda m: F.bit_count(m) <= F.col("reach"))).alias("mask"))
        .select("probe", "fp", F.col("rest").bitwiseXOR(F.col("mask")).alias("point"), ((F.col("far") == 0) & (F.bit_count("mask") <= anchor)).alias("anchor"))
    )
    centre = named.where("anchor").groupBy("probe", "point").agg(F.min("fp").alias("v"))
    return named.join(merged(centre), ["probe", "point"]).select(F.col("fp").alias("u"), "v").where("u != v").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_distance: int, shingle_words: int, bucket_limit: int) -> DataFrame:
    """The fingerprinted rows with their group's size and head: its smallest (ord, th)."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min(F.struct("ord", "th")).alias("low"), F.count("*").alias("n")), "classes")
    links = hamming_links(classes.select("fp"), max_distance, bucket_limit)
    labels = connected_components(links).select(F.col("node").alias("fp"), "component")
    placed = classes.join(merged(labels), "fp", "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component"))
    heads = placed.groupBy("component").agg(F.min("low").alias("head"), F.sum("n").alias("group_size"))
    # Copies share one fingerprint: both sides are plain shuffled inputs, which adaptive execution splits.
    return marked.join(merged(placed.join(merged(heads), "component").select("fp", "head", "group_size")), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, shingle_words: int = SHINGLE_WORDS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id, group_size.

    component_id: the smallest identifier in the document's component of fingerprints linked at
    ``max_distance`` or fewer bits, itself included.  Null or wordless text has fingerprint zero and is
    linked like any other.  Repeated rows share a fingerprint, so a component.  A null identifier sorts
    last: component_id is null only where a whole component has none.  An empty table gives no rows.
    Only the two named columns are read, so other columns cannot clash.  A long text is worked on whole.
    """
    found = _grouped(docs, id_col, text_col, max_distance, shingle_words, bucket_limit)
    return found.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when((F.col("head.ord") != F.lit(MAX_LONG)) | F.col("id").isNotNull(), F.col("head.ord")).alias("component_id"),
        "group_size",
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, shingle_words: int = SHINGLE_WORDS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """The rows of ``docs``, all columns: of each near-duplicate group the row with the smallest identifier.
    Rows that repeat both identifier and text collapse to one."""
    found = _grouped(docs, id_col, text_col, max_distance, shingle_words, bucket_limit)
    heads = found.where("ord = head.ord and th = head.th").select(F.col("ord").alias("__tw_ord"), F.col("th").alias("__tw_th")).distinct()
    keyed = docs.withColumns({"__tw_ord": id_order(id_col), "__tw_th": F.xxhash64(text_or_empty(text_col))})
    return keyed.join(merged(heads), ["__tw_ord", "__tw_th"], "left_semi").dropDuplicates(["__tw_ord", "__tw_th"]).select(*[F.col(f"`{c}`") for c in docs.columns])
