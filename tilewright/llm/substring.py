"""Substring deduplication with difference-cover anchors.

A difference cover modulo *v* is a set of residues such that for any two positions some shift below *v*
brings both onto the cover.  Two equal windows of ``window`` words therefore share an equal *anchor*, a
shorter window of ``window - v + 1`` words that starts on the cover in both documents, whatever their
alignment.  Only anchors (4 of 13 positions, for windows of 20 words) are exchanged, under a 64-bit hash that
merely proposes; where an anchor occurs again, the match is extended to the complete windows around it, whose
words are compared by a 128-bit cryptographic digest, and the first start of each stays.  Documents that are
whole copies of earlier ones are settled before, by the tree-merge of exact deduplication.

Equal anchors and windows inside one slice are settled there, and only one of each leaves it, so a passage
in every document sends one row per slice.  Everything is keyed by identifier and text hash: rows that share
an identifier, or have none, are as many keys as they have texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS_CLASS, WindowHasher, Words, id_order, materialize, mix, slices, small_batches, temporary, text_or_empty
from .exact_dedup import KEY, tree_merge

WINDOW_WORDS = 20
#: Perfect difference sets: period -> residues whose differences give each nonzero residue.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least 4 words, or a third of the window."""
    fits = [v for v in COVERS if window - v + 1 >= max(min(window, 4), window // 3)]
    return max(fits), COVERS[max(fits)]


class _Anchors:
    """Anchor positions (word numbers in the slice) and hashes."""

    def __init__(self, words: Words, hasher: WindowHasher, window: int) -> None:
        self.period, residues = cover_for(window)
        size = window - self.period + 1
        doc = words.doc_of()
        inner = np.arange(len(doc)) - words.first[:-1][doc]
        allowed = np.zeros(self.period, dtype=bool)
        allowed[list(residues)] = True
        self.at = np.flatnonzero(allowed[inner % self.period] & (inner + size <= words.n[doc]))
        self.doc = doc[self.at]
        self.hash = hasher(size, self.at)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """route, ord, th, h: one row with route = the hash for each different anchor of the slice, h null; and
        for each anchor that occurs again within the slice a row with h that only passes through."""
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            found = _Anchors(words, WindowHasher(words), window)
            order = np.argsort(found.hash, kind="stable")
            h = found.hash[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            again = ~new
            again[:-1] |= ~new[1:]
            alone = np.sort(order[new])  # in the documents' order, in which rows compress well
            passing = order[again]
            owner = found.doc[np.concatenate([alone, passing])]
            ords, ths = batch.column("ord").to_numpy()[owner], batch.column("th").to_numpy()[owner]
            passed = np.arange(len(owner)) >= len(alone)
            route = np.concatenate([found.hash[alone], mix((ords[passed] ^ ths[passed]).view(np.uint64))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(route), pa.array(ords), pa.array(ths), pa.array(np.concatenate([np.zeros(len(alone), dtype=np.int64), found.hash[passing]]), mask=~passed)],
                names=["route", "ord", "th", "h"],
            )

    return run


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, th, h) of anchors that occur in more than one row; the input is sorted by route."""
    last: tuple | None = None
    for batch in batches:
        route, o, t = (batch.column(c).to_numpy() for c in ("route", "ord", "th"))
        ready = batch.column("h").is_valid().to_numpy(zero_copy_only=False)
        out = [(o[ready], t[ready], batch.column("h").filter(pa.array(ready)).to_numpy())]
        route, o, t = route[~ready], o[~ready], t[~ready]
        if len(route):
            same = route[1:] == route[:-1]
            dup = np.zeros(len(route), dtype=bool)
            dup[1:] |= same
            dup[:-1] |= same
            if last and route[0] == last[2]:
                dup[0] = True
                if not last[3]:
                    out.append(tuple(np.array([v], dtype=np.int64) for v in last[:3]))
            out.append((o[dup], t[dup], route[dup]))
            last = (o[-1], t[-1], route[-1], dup[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["ord", "th", "h"])


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts: (doc, first, last); ``at`` ascends within ``doc``."""
    if not len(at):
        return doc, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    return doc[new], at[new], at[ends]


#: The two halves of a window's digest; the document; the start, above the last start of a run (or LAST for a
#: single window that is to be judged).
_WINDOW_ROWS = "route long, extra long, ord long, th long, span long"
LAST = (1 << 31) - 1


def _digests(words: Words, window: int, at: np.ndarray) -> np.ndarray:
    """Two longs for each window of words that begins at one of ``at``."""
    if not len(at):
        return np.zeros((0, 2), dtype=np.int64)
    canon, digest = memoryview(words.canon), hashlib.blake2b
    found = [digest(canon[a:b], digest_size=16).digest() for a, b in zip(words.start[at].tolist(), words.end[at + window - 1].tolist())]
    return np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Around repeated anchors: a row for the slice's first start of each window (last null), and runs of
        starts that the slice itself shows to be later ones."""
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            found = _Anchors(words, WindowHasher(words), window)
            lists = batch.column("hs")
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            hit = np.zeros(len(found.at), dtype=bool)
            span = np.searchsorted(found.doc, np.arange(len(words.n) + 1))
            for d in range(len(words.n)):
                hit[span[d] : span[d + 1]] = np.isin(found.hash[span[d] : span[d + 1]], flat[ends[d] : ends[d + 1]])
            anchors = found.at[hit]
            near = np.zeros(len(words.start) + 1, dtype=np.int32)
            np.add.at(near, np.maximum(anchors - found.period + 1, words.first[found.doc[hit]]), 1)
            np.add.at(near, anchors + 1, -1)
            doc = words.doc_of()
            inner = np.arange(len(doc)) - words.first[:-1][doc]
            at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (inner + window <= words.n[doc]))
            digest = _digests(words, window, at)
            d, i = doc[at], inner[at]
            ords, ths = batch.column("ord").to_numpy(), batch.column("th").to_numpy()
            order = np.lexsort((i, ths[d], ords[d], digest[:, 1], digest[:, 0]))
            digest, d, i = digest[order], d[order], i[order]
            new = np.ones(len(d), dtype=bool)
            new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
            head = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0)) if len(d) else d
            itself = (ords[d] == ords[d[head]]) & (ths[d] == ths[d[head]]) & (i == i[head])  # a repeated row is not earlier than itself
            later = ~itself
            by = np.lexsort((i[later], d[later]))
            rd, first, last = _runs(d[later][by], i[later][by])
            alone = np.flatnonzero(new)
            alone = alone[np.lexsort((i[alone], d[alone]))]  # in the documents' order, in which rows compress well
            owner, start = np.concatenate([d[alone], rd]), np.concatenate([i[alone], first])
            upto = np.concatenate([np.full(len(alone), LAST), last])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([digest[alone, 0], mix((ths[rd] + first).view(np.uint64))])),
                    pa.array(np.concatenate([digest[alone, 1], np.zeros(len(rd), dtype=np.int64)])),
                    pa.array(ords[owner]),
                    pa.array(ths[owner]),
                    pa.array((start << 32) | upto),
                ],
                names=["route", "extra", "ord", "th", "span"],
            )

    return run


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, th, start, last) of window starts that are not the first of their window; sorted input."""
    head: tuple | None = None
    for batch in batches:
        cols = {c: batch.column(c).to_numpy() for c in ("route", "extra", "ord", "th", "span")}
        cols |= {"start": cols["span"] >> 32, "last": cols["span"] & 0xFFFFFFFF}
        run = cols["last"] != LAST
        passed = {c: cols[c][run] for c in ("ord", "th", "start", "last")}
        one = {c: v[~run] for c, v in cols.items()}
        n = len(one["route"])
        if n:
            new = np.ones(n, dtype=bool)
            new[1:] = (one["route"][1:] != one["route"][:-1]) | (one["extra"][1:] != one["extra"][:-1])
            if head and head[:2] == (one["route"][0], one["extra"][0]):
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            firsts = [np.where(at >= 0, one[c][at], head[k] if head else 0) for k, c in enumerate(("ord", "th", "start"), 2)]
            later = ~((one["ord"] == firsts[0]) & (one["th"] == firsts[1]) & (one["start"] == firsts[2]))
            head = (one["route"][-1], one["extra"][-1], firsts[0][-1], firsts[1][-1], firsts[2][-1])
            by = np.lexsort((one["start"][later], one["th"][later], one["ord"][later]))
            o, t, i = (one[c][later][by] for c in ("ord", "th", "start"))
            if len(o):
                fresh = np.ones(len(o), dtype=bool)
                fresh[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
                which, first, last = _runs(np.cumsum(fresh), i)
                begin = np.flatnonzero(fresh)[which - 1]
                single = {"ord": o[begin], "th": t[begin], "start": first, "last": last}
                passed = {c: np.concatenate([passed[c], single[c]]) for c in passed}
        yield pa.RecordBatch.from_arrays([pa.array(passed[c]) for c in ("ord", "th", "start", "last")], names=["ord", "th", "start", "last"])


def _kept_rows(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            copy = batch.column("copy").to_numpy(zero_copy_only=False)
            lists = batch.column("runs")
            flat = lists.flatten()
            r_start, r_last = (flat.field(c).to_numpy() for c in ("start", "last"))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            removed, digests, kept_texts = [], [], []
            for d in range(len(words.n)):
                a, b = ends[d], ends[d + 1]
                if copy[d] and words.n[d] >= window:
                    kept = b""
                    removed.append(int(words.n[d]))
                elif b > a:
                    edge = np.zeros(words.n[d] + 1, dtype=np.int64)
                    np.add.at(edge, r_start[a:b], 1)
                    np.add.at(edge, r_last[a:b] + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    w = slice(words.first[d], words.first[d + 1])
                    length = words.end[w] - words.start[w] + 1
                    whole = words.canon[words.start[w.start] : words.end[w.stop - 1] + 1]
                    kept = whole[np.repeat(stay, length)].tobytes()[:-1]
                    removed.append(int((~stay).sum()))
                else:
                    kept = words.joined(d)
                    removed.append(0)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            out = [batch.column("rest"), pa.array(words.n.astype(np.int64)), pa.array(removed, type=pa.int64()), pa.array(digests, type=pa.string())]
            names = ["rest", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                # A document that nothing was cut from keeps its text as it was.
                texts = batch.column("text")
                out.append(pa.array([k.decode() if n else t for k, n, t in zip(kept_texts, removed, texts.to_pylist())], type=pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _later_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord, th), each once, of rows whose whole word sequence an earlier row has.

    All windows of such a row start earlier, too, and whatever repeats one of them repeats the earlier
    row's; so it needs no anchors, and loses all its words if it has a window.
    """
    text = text_or_empty(text_col)
    rows = docs.select(id_order(id_col).alias("ord"), F.xxhash64(text).alias("line"), F.trim(F.regexp_replace(text, WS_CLASS + "+", " ")).alias("norm"))
    rows = rows.select("ord", "line", F.xxhash64("norm").alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"))
    narrow = materialize(rows, "sequences")
    firsts = tree_merge(narrow).where("n > 1").select(*KEY, F.col("ord").alias("low_ord"), F.col("line").alias("low_line"))
    later = narrow.join(firsts, KEY).where("ord != low_ord or line != low_line")
    return later.select("ord", F.col("line").alias("th")).distinct()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, with_text: bool = False, keep_columns: bool = False) -> DataFrame:
    """Remove every word that a window of ``window`` words covers whose word sequence starts earlier, too
    (smaller identifier, or the same document and an earlier start).

    Returns one row per input row: ``id_col`` (or, with ``keep_columns``, a struct ``rest`` of all columns
    but the text), n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with
    ``with_text``, kept_text: the kept words joined by one space, or the unchanged text (empty where null)
    where nothing was removed.

    Null text has no words; a document with fewer words than a window loses none.  A null identifier sorts
    last.  Rows that share an identifier are ordered by a hash of their texts; rows equal in both are one
    document twice, and neither is earlier than the other.  An empty table gives no rows.  A long text is
    worked on whole, in about twenty times its size of memory.  Other columns may have any names.
    """
    if window < 1:
        raise ValueError("window must be positive")
    small_batches(docs.sparkSession)
    rest = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep_columns else [id_col]) if c != text_col])
    text = text_or_empty(text_col)
    whole = docs.select(rest.alias("rest"), id_order(id_col).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))
    row = ["ord", "th"]
    with temporary() as tables:
        copies = tables.keep(materialize(_later_copies(docs, id_col, text_col), "copies"))
    # Each join hashes the same rows on the same columns, so that the texts are shuffled once and the exchange reused.
    anchors = whole.join(copies, row, "left_anti").mapInArrow(_anchor_rows(window), "route long, ord long, th long, h long")
    repeated = anchors.repartition("route").sortWithinPartitions("route").mapInArrow(_repeated_anchors, "ord long, th long, h long")
    wanted = repeated.groupBy(*row).agg(F.collect_set("h").alias("hs"))  # as many as the document has anchors at most
    windows = whole.join(wanted, row).mapInArrow(_window_rows(window), _WINDOW_ROWS)
    later = windows.repartition("route").sortWithinPartitions("route", "extra", "ord", "th", "span").mapInArrow(_later_windows, "ord long, th long, start long, last long")
    runs = later.groupBy(*row).agg(F.collect_list(F.struct("start", "last")).alias("runs"))
    schema = T.StructType([whole.schema["rest"], *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))])
    judged = whole.join(runs, row, "left").join(copies.withColumn("copy", F.lit(True)), row, "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    marked = judged.mapInArrow(_kept_rows(window, with_text), schema)
    return marked if keep_columns else marked.select(F.col("rest")[id_col].alias(id_col), *[c for c in marked.columns if c != "rest"])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with its columns, the text without its repeated passages (and n_chars, if there, to match).
    A null text stays null.  Otherwise as ``substring_dedup``."""
    null = "__tw_null"
    found = substring_dedup(docs.withColumn(null, F.col(text_col).isNull()), id_col, text_col, window, with_text=True, keep_columns=True)

    def column(c: str):
        if c == text_col:
            return F.when(~F.col("rest")[null], F.col("kept_text")).alias(c)
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("rest")[c]).alias(c)
        return F.col("rest")[c].alias(c)

    return found.select(*[column(c) for c in docs.columns])
