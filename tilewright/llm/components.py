"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, merged


#: Edges that one task of a round takes at least.
EDGES_A_TASK = 100_000


def _low(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the edge list ``(u, v)`` of longs, the smallest node reachable.

    Every round hangs the larger neighbours of each node below its smallest neighbour, then the smaller
    ones likewise; the edge list never grows beyond its first size and settles in O(log n) rounds into
    stars.  A node's smallest neighbour is an aggregate, joined back on plain shuffles: the neighbours of a
    hub are never gathered in one place.  Each round is written to the shared folder, and the one before is dropped.  Loops and repeated
    edges are allowed; an edge with a null end is ignored; no edges give no rows.
    """
    clean = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u != v")
    state = materialize(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(merged(_low(both)), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        few = max(1, -(-mark["n"] // EDGES_A_TASK))  # a small graph does not write files for every shuffle partition
        large = large.where("u != v").coalesce(few).distinct().coalesce(few)
        low = _low(large)
        small = large.join(merged(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        before, state = state, materialize(small.coalesce(few).distinct().coalesce(few), "edges")
        drop(before)
    members = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
