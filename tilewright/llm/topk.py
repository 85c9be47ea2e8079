"""Exact top-k by inner product: the threshold algorithm over sorted lists, one for each dimension.

Candidates are laid out in blocks of rows.  For a block, each dimension has its rows in order of their
component.  A query walks all lists from the end that its own component favours: every row met is scored in full
(random access), and no row that was not met can score more than the sum of the components where the lists stand.
Once that bound is below the k-th best score, the block is done.  The blocks' best rows are merged for each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_LONG, materialize, small_batches

SCALE = 1024
#: Rows of a block of candidates and of a batch of queries; entries of each list that are read before the first bound.
BLOCK, QUERIES, FIRST_DEPTH = 4096, 128, 16
#: Batches of queries that one copy of a block serves, about.
BATCHES = 64
#: Scaled components lie within this, so that 64-bit sums hold products of up to 1,024 dimensions.
MOST = 1 << 26
#: Whole numbers up to this are exact in a double.
_EXACT = 1 << 53


class SortedLists:
    """A block of vectors (rows of whole numbers) with the rows in order of each dimension."""

    def __init__(self, ids: np.ndarray, data: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")  # among equal scores the smaller row number is the smaller identifier
        self.ids, self.data = ids[by_id], np.ascontiguousarray(data[by_id])
        self.order = np.argsort(self.data, axis=0, kind="stable").T.copy()
        self.value = np.sort(self.data, axis=0).T.copy()
        self.largest = int(np.abs(self.data).max(initial=0))
        self.scored = 0

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and scores of the k best rows but those of identifier ``own``, best first (ties: smaller
        identifier)."""
        n = len(self.ids)
        live = np.flatnonzero(query)
        weight = query[live]
        exact = self.largest * int(np.abs(query).max(initial=0)) * max(len(query), 1) < _EXACT
        factor = query.astype(np.float64) if exact else query
        up, down = live[weight > 0], live[weight < 0]
        unseen = np.ones(n, dtype=bool)
        if own is not None:
            unseen[np.searchsorted(self.ids, own) : np.searchsorted(self.ids, own, side="right")] = False
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            upto = min(n, depth + step)
            if len(live):
                met = np.zeros(n, dtype=bool)
                met[self.order[up, n - upto : n - depth]] = True
                met[self.order[down, depth:upto]] = True
                new = np.flatnonzero(met & unseen)
                bound = int((query[up] * self.value[up, n - upto]).sum() + (query[down] * self.value[down, upto - 1]).sum())
            else:  # every score is zero
                new, bound, upto = np.flatnonzero(unseen), 0, n
            unseen[new] = False
            self.scored += len(new)
            rows, scores = np.append(rows, new), np.append(scores, (self.data[new] @ factor).astype(np.int64))
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            if len(rows) == k and scores[-1] > bound:  # an equal score may still come with a smaller identifier
                break
            depth, step = upto, 2 * step
        return self.ids[rows], scores


def _pack(prefix: str, size: int):
    """Rows (id, v) of one length as blocks: number, dims, ids and the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dims: int, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            cols = [pa.array([x], type=t) for x, t in ((number, pa.int64()), (dims, pa.int32()), (ids.astype("<i8").tobytes(), pa.binary()), (data.astype("<i4").tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=[f"{prefix}{c}" for c in ("block", "dims", "ids", "data")])

        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("v")
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            lengths = np.diff(ends)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                data = flat[(ends[at, None] + np.arange(dims)).ravel()].reshape(len(at), dims)
                held.setdefault(dims, []).append((ids[at], data))
                if sum(len(x) for x, _ in held[dims]) >= size:
                    ids_, data_ = (np.concatenate(x) for x in zip(*held.pop(dims)))
                    full = len(ids_) // size * size
                    for a in range(0, full, size):
                        yield block(dims, ids_[a : a + size], data_[a : a + size])
                    if full < len(ids_):
                        held[dims] = [(ids_[full:], data_[full:])]
        for dims, parts in held.items():
            yield block(dims, *(np.concatenate(x) for x in zip(*parts)))

    return run


_BLOCK = "{0}block long, {0}dims int, {0}ids binary, {0}data binary"


def _search(k: int):
    def matrix(batch: pa.RecordBatch, at: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        dims = batch.column(f"{prefix}dims")[at].as_py()
        ids = np.frombuffer(batch.column(f"{prefix}ids")[at].as_buffer(), dtype="<i8")
        return ids, np.frombuffer(batch.column(f"{prefix}data")[at].as_buffer(), dtype="<i4").astype(np.int64).reshape(len(ids), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, lists = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                if batch.column("block")[at].as_py() != number:
                    number, lists = batch.column("block")[at].as_py(), SortedLists(*matrix(batch, at, ""))
                ids, queries = matrix(batch, at, "q")
                base = batch.column("qblock")[at].as_py()
                out: list[list] = [[], [], [], [], []]
                for row, (own, query) in enumerate(zip(ids.tolist(), queries)):
                    found, scores = lists.top(query, k, own)
                    for column, values in zip(out, (np.full(len(found), base), np.full(len(found), row), np.full(len(found), own), found, scores)):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["qblock", "row", "query", "vec", "score"])

    return run


def scaled_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): whole-number components, floor(scale * x).  Vectors that are null, or hold a component that is null, not
    finite or beyond 2^26 once scaled, are left out; a null identifier sorts last."""
    made = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double") * scale) < MOST, F.lit(False)))  # NaN is above all numbers
    rows = vectors.where(F.col(vector_col).isNotNull()).where(usable)
    return rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)).alias("id"), made.cast("array<int>").alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k best rows of ``vectors`` by inner product of
    components floor(scale * x), ties to the smaller identifier; fewer where there are no more.

    Rows with the query's own identifier are not its candidates.  Vectors that cannot be used (``scaled_vectors``)
    take no part; a query meets vectors of its own length only, and one of no candidates has no rows.  Repeated
    candidate rows each count; of queries equal in identifier and vector one counts.  A null identifier comes last
    in ties and is null again in the result.  Empty tables give no rows.  Other columns are not read.

    The blocks of both sides are written once.  A batch of queries goes to every block: each pair of them is one
    row of a join by block number, of a MB or so, and one copy of a block serves about 64 batches.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    candidates = materialize(scaled_vectors(vectors, id_col, vector_col, scale).mapInArrow(_pack("", block), _BLOCK.format("")), "blocks")
    asked = scaled_vectors(queries, id_col, vector_col, scale).dropDuplicates(["id", "v"])
    batches = materialize(asked.mapInArrow(_pack("q", QUERIES), _BLOCK.format("q")), "queries")
    # Every batch is sent to each block of its length.  Where there are many batches, copies of a block share them.
    copies = max(1, math.ceil(batches.count() / BATCHES))
    numbers = candidates.groupBy(F.col("dims").alias("qdims")).agg(F.collect_list("block").alias("blocks"))
    sent = batches.join(numbers, "qdims").select("qblock", "qids", "qdims", "qdata", F.pmod(F.xxhash64("qblock"), F.lit(copies)).alias("copy"), F.explode("blocks").alias("block"))
    held = candidates.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    met = sent.join(held, ["block", "copy"]).mapInArrow(_search(k), "qblock long, row long, query long, vec long, score long")
    place = F.row_number().over(Window.partitionBy("qblock", "row").orderBy(F.desc("score"), "vec"))
    best = met.withColumn("rank", place).where(F.col("rank") <= k)
    shown = lambda c: F.when(F.col(c) != F.lit(MAX_LONG), F.col(c))
    return best.select(shown("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), shown("vec").alias("vec_id"), "score")
