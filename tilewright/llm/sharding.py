"""Sharding by a k-d tree over document metadata, built from distributed histograms.  Built-ins only.

A node that has to become *k* shards is split where its bytes reach the share of k // 2 of them, along its
widest dimension, until every leaf is one shard.  All nodes of a level are split together.  A split point is
found as a digit-by-digit weighted median: each pass sums bytes by the next twelve bits of the dimension's key,
so what reaches the driver is at most 4096 rows for each open node, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import id_order, materialize, text_or_empty

SHARDS = 24
_VALUE_BITS, _TIE_BITS, _STEP = 31, 29, 12
_KEY_BITS = _VALUE_BITS + _TIE_BITS
#: A slot block holds about so many rows.
BLOCK_ROWS = 8_000
#: A split is good enough within this share of one shard's bytes.
TOLERANCE = 0.0005


def _dimensions(docs: DataFrame, id_col: str, categories: tuple[str, ...]) -> dict[str, Column]:
    """Values of 31 bits for each metadata dimension."""
    dims = {"by_size": F.least(F.col("size"), F.lit((1 << _VALUE_BITS) - 1)), "by_id": F.pmod(F.col("ord"), F.lit(1 << _VALUE_BITS))}
    return dims | {f"by_{c}": F.crc32(F.coalesce(F.col(f"m_{c}"), F.lit(""))).bitwiseAND(F.lit((1 << _VALUE_BITS) - 1)) for c in categories}


def _narrow(docs: DataFrame, id_col: str, text_col: str, categories: tuple[str, ...]) -> DataFrame:
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        id_order(id_col).alias("ord"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        *[F.col(f"`{c}`").cast("string").alias(f"m_{c}") for c in categories],
    )
    tie = F.shiftrightunsigned(F.xxhash64("ord", "crc"), 64 - _TIE_BITS)
    keys = {name: F.shiftleft(value.cast("long"), _TIE_BITS).bitwiseOR(tie).alias(name) for name, value in _dimensions(rows, id_col, categories).items()}
    return rows.select("id", "ord", "size", "crc", F.xxhash64("ord", "crc").alias("h"), *keys.values())


def _node(tree: dict[int, tuple[str, int, int, int]], node: int = 0) -> Column:
    """The node a row reaches: nested comparisons, as many as the tree has splits."""
    if node not in tree:
        return F.lit(node)
    dim, cut, left, right = tree[node]
    return F.when(F.col(dim) <= F.lit(cut), _node(tree, left)).otherwise(_node(tree, right))


def _grow(rows: DataFrame, dims: list[str], shards: int, tolerance: float) -> Column:
    """Split until each leaf is one shard; the shard number as a column."""
    want, serial, tree = {0: shards}, 1, {}
    spread: dict[str, int] = {}
    while any(k > 1 for k in want.values()):
        open_nodes = [n for n, k in want.items() if k > 1]
        mine = rows.withColumn("node", _node(tree)).where(F.col("node").isin(open_nodes))
        ranges = mine.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(F.shiftright(d, _TIE_BITS)).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).collect()
        if not spread:
            spread = {d: max([1, *(r[f"max_{d}"] - r[f"min_{d}"] for r in ranges)]) for d in dims}
        plan = {}
        for r in sorted(ranges, key=lambda r: r["node"]):
            k = want[r["node"]]
            dim = max(dims, key=lambda d: ((r[f"max_{d}"] - r[f"min_{d}"]) / spread[d], d))
            plan[r["node"]] = {"dim": dim, "target": r["bytes"] * (k // 2) / k, "below": 0, "prefix": 0, "bits": 0, "slack": tolerance * r["bytes"] / k}
        key = F.lit(0).cast("long")
        for n, p in plan.items():
            key = F.when(F.col("node") == n, F.col(p["dim"])).otherwise(key)
        keyed = mine.select("node", "size", key.alias("key"))
        active = dict(plan)
        while active:
            inside, digit = F.lit(False), F.lit(0).cast("long")
            for n, p in active.items():
                here = F.col("node") == n
                inside = inside | (here & (F.shiftright("key", _KEY_BITS - p["bits"]) == F.lit(p["prefix"])))
                digit = F.when(here, F.shiftright("key", _KEY_BITS - p["bits"] - _STEP)).otherwise(digit)
            sums = keyed.where(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
            for n, p in list(active.items()):
                for digit_value, size, rows_in in sorted((r["digit"], r["bytes"], r["n"]) for r in sums if r["node"] == n):
                    if p["below"] + size >= p["target"]:
                        break
                    p["below"] += size
                p["prefix"], p["bits"] = digit_value, p["bits"] + _STEP
                over, under = p["below"] + size - p["target"], p["target"] - p["below"]
                if min(over, under) <= p["slack"] or rows_in == 1 or p["bits"] >= _KEY_BITS:
                    left_of = under < over  # end just below the digit, or with it
                    p["cut"] = ((digit_value if left_of else digit_value + 1) << (_KEY_BITS - p["bits"])) - 1
                    del active[n]
        for n, p in plan.items():
            k = want.pop(n)
            tree[n] = (p["dim"], p["cut"], serial, serial + 1)
            want |= {serial: k // 2, serial + 1: k - k // 2}
            serial += 2
        for n in [n for n in open_nodes if n in want]:  # no rows: nothing to split
            want[n] = 1
    number = {n: i for i, n in enumerate(sorted(want))}

    def shard(node: int) -> Column:
        if node not in tree:
            return F.lit(number[node])
        dim, cut, left, right = tree[node]
        return F.when(F.col(dim) <= F.lit(cut), shard(left)).otherwise(shard(right))

    return shard(0)


def kd_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = SHARDS, target_bytes: int | None = None, categories: tuple[str, ...] = ("source", "lang"), tolerance: float = TOLERANCE
) -> DataFrame:
    """Put every row into a shard of nearly equal bytes (text in UTF-8 plus 8).

    ``shards``: number of leaves, or None to recur until leaves reach ``target_bytes``.  ``categories``:
    metadata columns beside size and identifier.  ``tolerance``: the share of a shard's bytes by which a split
    may miss its median.  The tree is built by the driver, from at most 4096 sums for each open node, and is one
    expression, so it is meant for thousands of shards at most.  Returns one row per input row: ``id_col``, size,
    text_crc32, law ("bytes"), shard, slot (gapless from 0 in each shard) and grown_shard (null).

    Null text is empty; null metadata is a value like any other.  Equal metadata is told apart by a hash of
    identifier and text, so a hot source or group of copies is split like anything else; rows equal in
    identifier and text stay in one shard.  An empty table gives no rows.  Of a long text only size and checksum
    are taken.  Only the named columns are read, so others cannot clash.
    """
    rows = materialize(_narrow(docs, id_col, text_col, categories), "metadata")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if shards is None:
        shards = max(1, -(-total["bytes"] // (target_bytes or 1 << 30)))
    shard = _grow(rows, ["by_size", "by_id", *(f"by_{c}" for c in categories)], shards, tolerance)
    blocks = max(1, -(-total["n"] // (shards * BLOCK_ROWS)))
    placed = rows.select("id", "ord", "size", "crc", "h", shard.alias("shard"), F.pmod("h", F.lit(blocks)).cast("int").alias("block"))
    # Slots: rows before a block in its shard (a table of shards x blocks rows), plus the place in the block.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("ord", "h"))
    numbered = placed.withColumn("place", place).join(offsets, ["shard", "block"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
