"""Cache operators: hits and misses, deduplicated requests, retention within a byte budget."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..scratch import materialize
from .scans import scan

HIGH_PERCENT, LOW_PERCENT = 90, 70


def cache_hit(requests: DataFrame, store: DataFrame, key: str = "cache_key") -> DataFrame:
    return requests.join(store.select(key), key, "left_semi")


def cache_miss(requests: DataFrame, store: DataFrame, key: str = "cache_key") -> DataFrame:
    return requests.join(store.select(key), key, "left_anti")


def request_dedup(requests: DataFrame, key: str = "cache_key") -> DataFrame:
    """One unit of work for each key, with the number of requests that wait for it."""
    return requests.groupBy(key).agg(F.min("path").alias("path"), F.min("px").alias("px"), F.count("*").alias("waiting"))


def fan_out(requests: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """Every request with its unit's result or error code; a hot key is a plain join key."""
    return requests.join(results, key, "left")


def publish_levels(plan: DataFrame, manifests: DataFrame) -> DataFrame:
    """Planned levels (hash, z, width, height) with what manifests have published; those are ready."""
    published = manifests.select("hash", "z", F.col("path").alias("published_path"))
    return plan.join(published, ["hash", "z"], "left").select(
        "hash", "z", "width", "height", F.coalesce("published_path", "path").alias("path"), ((F.col("z") == 0) | F.col("published_path").isNotNull()).alias("ready")
    )


def directory_size(files: DataFrame) -> DataFrame:
    """Bytes and newest time of each pyramid directory, files at any depth."""
    return files.groupBy("hash").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))


def cache_totals(evicted: DataFrame, by: list[str]) -> DataFrame:
    """Total, freed and remaining bytes; ``evicted`` has size and evict."""
    freed = F.sum(F.when(F.col("evict"), F.col("size")).otherwise(F.lit(0)))
    return evicted.groupBy(*by).agg(F.sum("size").alias("total"), freed.alias("freed"), (F.sum("size") - freed).alias("remaining"))


def ordered_before(df: DataFrame, value: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Adds __before (sum of ``value`` over the rows before, in order) and __total, per group.

    Rows are ranged by (group, order); sums inside a range are a window over (group, range), and what the
    ranges before hold comes from one row per group and range.  So neither one group nor one order needs a
    task of its own.  Range bounds are sampled, so the ranged rows are written once and both uses read them.
    """
    group = group or []
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = df.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    sums = ranged.groupBy(*group, "__part").agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    bases = sums.select(*group, "__part", F.coalesce(F.sum("__sum").over(over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__sum").over(over).alias("__total"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = _matched(ranged.withColumn("__inside", inside), bases, [*group, "__part"]).drop(*[f"__g_{c}" for c in (*group, "__part")])
    return joined.withColumn("__before", F.col("__base") + F.col("__inside")).drop("__base", "__inside", "__part")


#: Bins of a histogram.
BINS = 1024


def evict_watermark(files: DataFrame, limit: int | Column, group: list[str] | None = None, high: int = HIGH_PERCENT, low: int = LOW_PERCENT, order: tuple[str, ...] = ("mtime", "path")) -> DataFrame:
    """Adds evict: once the total passes the high mark, the oldest go while more than the low mark is left.
    Limit 0 is no limit.

    The files are not sorted.  Each group's cut, the time at which enough bytes are older, is found by histograms of the
    first order column (a whole number, date or timestamp; null is the oldest): a pass adds up sizes in at most 1,024 bins a
    group, and the next one looks into the bin that the cut is in, until that is a single time.  Files of just that time are
    told apart by the other order columns.  Sizes are not negative; null ones count nothing.
    """
    limit = F.lit(limit).cast("long") if isinstance(limit, int) else limit
    group = group or []
    mark = lambda percent: F.call_function("div", limit * percent, F.lit(100).cast("long"))
    at = _ticks(files, order[0])
    rows = files.withColumns({"__at": at, "__bytes": F.coalesce(F.col("size"), F.lit(0)).cast("long")})
    free = F.sum("__bytes") - F.max(mark(low))  # the bytes that have to go
    totals = rows.groupBy(*group).agg(free.alias("__need"), F.min("__at").alias("__lo"), F.max("__at").alias("__hi"), ((F.max(limit) > 0) & (F.sum("__bytes") > F.max(mark(high)))).alias("__over"))
    open_ = materialize(totals.where("__over and __need > 0").select(*group, "__need", "__lo", "__hi"), "cuts")
    while open_.where("__lo < __hi").limit(1).count():
        inside = _matched(rows.select(*group, "__at", "__bytes"), open_, group).where(F.col("__at").between(F.col("__lo"), F.col("__hi")))
        # differences of 64-bit times can pass 64 bits
        width = F.greatest(F.ceil((F.col("__hi").cast("decimal(38,0)") - F.col("__lo") + 1) / BINS), F.lit(1)).cast("decimal(38,0)")
        bins = inside.withColumn("__bin", F.floor((F.col("__at").cast("decimal(38,0)") - F.col("__lo")) / width).cast("long")).groupBy(*group, "__need", "__lo", "__hi", "__bin").agg(F.sum("__bytes").alias("__sum"), F.min("__at").alias("__first"), F.max("__at").alias("__last"))
        upto = F.coalesce(F.sum("__sum").over(Window.partitionBy(*group or [F.lit(0)]).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = bins.withColumn("__upto", upto).where("__upto < __need and __need <= __upto + __sum")
        open_ = materialize(cut.select(*group, (F.col("__need") - F.col("__upto")).alias("__need"), F.col("__first").alias("__lo"), F.col("__last").alias("__hi")), "cuts")
    cuts = open_.select(*group, "__need", F.col("__lo").alias("__cut"))
    marked = _matched(rows, cuts, group, "left")
    ties = marked.where("__at = __cut").select(*files.columns, "__bytes", "__need")
    tied = ordered_before(ties, "__bytes", list(order), group).withColumn("evict", F.col("__before") < F.col("__need"))
    older = marked.where("__cut is null or __at != __cut").withColumn("evict", F.coalesce(F.col("__at") < F.col("__cut"), F.lit(False)))
    return older.select(*files.columns, "evict").unionByName(tied.select(*files.columns, "evict"))


def _ticks(files: DataFrame, name: str) -> Column:
    """A time column as a whole number; null before all others."""
    kind = files.schema[name].dataType.simpleString()
    c = F.col(name)
    number = F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(c) if kind == "date" else c
    return F.coalesce(number.cast("long"), F.lit(-(1 << 63)))


def _matched(rows: DataFrame, cuts: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """Rows with their group's cut; without groups there is one cut at most, and null groups are a group."""
    if not group:
        return rows.join(F.broadcast(cuts), F.lit(True), how)  # one row
    renamed = cuts.select(*[F.col(c).alias(f"__g_{c}") for c in group], *[c for c in cuts.columns if c not in group])
    return rows.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group]), how)


def evict_protected(dirs: DataFrame, limit: int | Column, protected: DataFrame, group: list[str] | None = None, order: tuple[str, ...] = ("mtime", "path")) -> DataFrame:
    """Adds evict: above the limit the oldest unprotected directories go until the total is within it.
    Protected bytes count, but stay."""
    limit = F.lit(limit).cast("long") if isinstance(limit, int) else limit
    marked = dirs.join(protected.select("hash").distinct().withColumn("__kept", F.lit(True)), "hash", "left")
    free = marked.withColumn("__free", F.when(F.col("__kept"), F.lit(0)).otherwise(F.col("size")).cast("long"))
    all_bytes = free.groupBy(*(group or [])).agg(F.sum("size").alias("__all"))
    rows = ordered_before(free, "__free", list(order), group)
    rows = rows.join(all_bytes, group) if group else rows.crossJoin(F.broadcast(all_bytes))  # one row
    evict = F.col("__kept").isNull() & (F.col("__all") - F.col("__before") > limit)
    return rows.withColumn("evict", evict).drop("__kept", "__free", "__all", "__before", "__total")


def evict_pinned(entries: DataFrame, limit: int | Column, group: list[str] | None = None) -> DataFrame:
    """Adds evict: in insertion order (column seq) unpinned entries go until the rest is within the limit."""
    limit = F.lit(limit).cast("long") if isinstance(limit, int) else limit
    free = entries.withColumn("__free", F.when(F.col("pinned"), F.lit(0)).otherwise(F.col("size")).cast("long"))
    all_bytes = free.groupBy(*(group or [])).agg(F.sum("size").alias("__all"))
    rows = ordered_before(free, "__free", ["seq"], group)
    rows = rows.join(all_bytes, group) if group else rows.crossJoin(F.broadcast(all_bytes))  # one row
    return rows.withColumn("evict", ~F.col("pinned") & (F.col("__all") - F.col("__before") > limit)).drop("__free", "__all", "__before", "__total")


class _Run:
    """Bytes since the last sweep."""

    def __init__(self, threshold: int, run: int = 0) -> None:
        self.threshold, self.run = threshold, run

    def step(self, size: int) -> bool:
        run = self.run + size
        fires = run >= self.threshold
        self.run = 0 if fires else run
        return fires

    def end(self) -> int:
        return self.run


class _AnyRun:
    """All numbers of bytes there can have been before: intervals of them whose sweeps last fell on the same row.

    ``quiet``: those below have not swept yet.  The others are in a queue by the bytes at their last sweep; who sweep on
    the same row are one from then on.
    """

    def __init__(self, threshold: int) -> None:
        self.threshold, self.total, self.quiet = threshold, 0, threshold
        self.swept: deque[tuple[int, list[list[int]]]] = deque()

    def step(self, size: int) -> tuple[bool | None, list | None]:
        self.total += size
        fires: list[list[int]] = []
        while self.swept and self.total - self.swept[0][0] >= self.threshold:
            fires += self.swept.popleft()[1]
        left = max(0, self.threshold - self.total)
        if left < self.quiet:
            fires.append([left, self.quiet - 1])
            self.quiet = left
        if not fires:
            return (False, None)
        self.swept.append((self.total, _joined(fires)))
        if len(self.swept) == 1 and not self.quiet:
            return (True, None)
        return (None, [tuple(x) for x in self.swept[-1][1]])

    def end(self) -> dict:
        return {"quiet": self.quiet, "total": self.total, "swept": [[self.total - at, spans] for at, spans in self.swept]}


def _joined(spans: list[list[int]]) -> list[list[int]]:
    """Intervals in order, adjacent ones as one."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low == out[-1][1] + 1:
            out[-1][1] = high
        else:
            out.append([low, high])
    return out


class _SweepFold:
    columns, answer, cases = ("size",), "boolean", "array<struct<low:bigint,high:bigint>>"

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def first(self) -> int:
        return 0

    def begin(self) -> _Run:
        return _Run(self.threshold)

    def unknown(self) -> _AnyRun:
        return _AnyRun(self.threshold)

    def resume(self, end: dict, start: int) -> int:
        if start < end["quiet"]:
            return start + end["total"]
        return next(run for run, spans in end["swept"] if any(low <= start <= high for low, high in spans))

    def pick(self, cases: Column, start: Column) -> Column:
        return F.exists(cases, lambda c: start.between(c["low"], c["high"]))

    def prepare(self, columns: list[pa.Array]) -> list[list]:
        return [[max(0, v or 0) for v in columns[0].to_pylist()]]


def sweep_trigger(writes: DataFrame, threshold: int = P.DEFAULT.sweep_bytes, group: str = "root", order: tuple[str, ...] = ("ts", "seq"), partitions: int | None = None) -> DataFrame:
    """Adds fires: bytes written since the last sweep reach the threshold; the count restarts at zero.

    Null roots are one root; a size that is null or negative counts as nothing.  A root's writes are cut over many tasks
    (``scans``): where a range begins within one, a row keeps for which numbers of bytes before it would fire.  Numbers that
    fire on the same row stay together, so there are never more kinds than rows in the last ``threshold`` bytes.
    """
    if threshold <= 0:
        return writes.withColumn("fires", F.lit(True))
    return scan(writes, _SweepFold(threshold), "fires", [group], list(order), partitions)


def preload_delta(cached: DataFrame, needed: DataFrame, key: tuple[str, ...] = ("path",)) -> DataFrame:
    """The key's columns and action of each item: keep (cached and needed), drop (only cached), add (only needed)."""
    have, want = cached.select(*key).distinct(), needed.select(*key).distinct()
    act = lambda df, name: df.withColumn("action", F.lit(name))
    return act(have.intersect(want), "keep").unionByName(act(have.subtract(want), "drop")).unionByName(act(want.subtract(have), "add"))


def protected_set(live: DataFrame, building: DataFrame) -> DataFrame:
    return live.select("hash").unionByName(building.select("hash")).distinct()


def duplicate_bindings(bindings: DataFrame) -> DataFrame:
    """Values that more than one key claims, with the keys in their fixed order; empty values do not count.
    ``bindings``: action, position, value."""
    grouped = bindings.where("value != ''").groupBy("value").agg(F.array_sort(F.collect_set(F.struct("position", "action"))).alias("claims"))
    return grouped.where(F.size("claims") > 1).select("value", F.transform("claims", lambda c: c["action"]).alias("actions"))
