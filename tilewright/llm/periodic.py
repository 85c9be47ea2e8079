"""Runs of periodic words: recursive frequency splitting, then a scan of the lags of what survives.

1. In a run of at least four periods every word occurs four times or more.  Words that are rarer within their segment
   (first: the text) join no run, so they split it; the parts are counted again, until nothing changes.  What
   is shorter than a run goes.
2. In the surviving segments each lag q is scanned.  A run of period q is a stretch of at least 3q words that equal the
   word q on, so three consecutive multiples of q lie in it: only these are probed, n / q words for lag q, then
   more and more words between them, and what is left is compared word by word.  Within a run that is known, its
   multiples are not probed again.  All segments of a slice are scanned together, lags in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, small_batches, text_or_empty

#: A run has at least so many periods and words.
PERIODS, LEAST_WORDS = 4, 6
#: Probes in one block of lags.
PROBES = 1 << 20


def word_codes(words: Words) -> np.ndarray:
    """A number for each different word of a slice: equal words only have equal ones."""
    if not len(words.end):
        return np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([[0], words.end + 1]).astype(np.int64)  # each word with the space behind it
    texts = pa.Array.from_buffers(pa.large_binary(), len(words.end), [None, pa.py_buffer(offsets), pa.py_buffer(words.canon)])
    return texts.dictionary_encode().indices.to_numpy().astype(np.int64)


def surviving_segments(codes: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Segments in which each word occurs often enough: (positions, segment numbers) of each round's stable ones."""
    at, segment, out = np.arange(len(codes)), owner, []
    while len(at):
        many = int(codes.max()) + 1
        _, which, count = np.unique(segment * many + codes[at], return_inverse=True, return_counts=True)
        rare = count[which] < PERIODS
        split = np.bincount(segment, weights=rare, minlength=int(segment.max()) + 1)[segment] > 0
        if not split.all():
            out.append((at[~split], segment[~split]))
        stays = split & ~rare
        at, segment = at[stays], segment[stays]
        if not len(at):
            break
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(segment) != 0)
        segment = np.cumsum(new) - 1
        long = np.bincount(segment)[segment] >= LEAST_WORDS
        at, segment = at[long], segment[long]
        if len(at):
            segment = np.cumsum(np.append(True, np.diff(segment) != 0)) - 1
    return out


class _Scan:
    """The lag scan over segments laid end to end, each closed by a value of its own."""

    def __init__(self, codes: np.ndarray, segments: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.found: dict[tuple[int, int], int] = {}  # (start, length): period
        parts = []
        for at, segment in segments:
            first = np.flatnonzero(np.append(True, np.diff(segment) != 0))
            size = np.diff(np.append(first, len(at)))
            whole = np.repeat(size, size)
            gaps = first[1:] if len(first) else first
            parts.append((np.insert(at, np.append(gaps, len(at)), -1), np.insert(whole, np.append(gaps, len(at)), size)))
        self.at = np.concatenate([a for a, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
        self.size = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, dtype=np.int64)
        ends = self.at < 0
        self.c = np.where(ends, -np.cumsum(ends), codes[np.maximum(self.at, 0)] if len(codes) else 0)
        self.period, self.run_end, self.run_size = (np.zeros(len(self.c), dtype=np.int64) for _ in range(3))

    def _keep(self, least: int) -> None:
        """Only segments of at least so many words go on."""
        keep = self.size >= least
        if not keep.all():
            for name in ("at", "size", "c", "period", "run_end", "run_size"):
                setattr(self, name, getattr(self, name)[keep])

    def runs(self) -> dict[tuple[int, int], int]:
        low = 1
        self._keep(LEAST_WORDS)
        while len(self.c):
            high = max(2 * low - 1, low) if low > 1 else 1  # no lag of a block is a multiple of another of its octave
            lag = low
            while lag <= high:
                upto = lag + 1
                budget = PROBES - len(self.c) // lag
                while upto <= high and budget > 0:
                    budget -= len(self.c) // upto
                    upto += 1
                self._block(np.arange(lag, upto))
                lag = upto
            low = high + 1
            self._keep(max(LEAST_WORDS, PERIODS * low))
        return self.found

    def _block(self, lags: np.ndarray) -> None:
        n = (len(self.c) - 1) // lags
        q = np.repeat(lags, n)
        if len(q) < 3:
            return
        i = (np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)) * q
        same = self.c[i] == self.c[i + q]
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & (q[2:] == q[:-2]))
        i, q = i[three], q[three]
        i, q = self._unknown(i, q)
        points = 16
        while len(i):  # between the first and the third probe, ever more words
            step = np.minimum(points, 2 * q)
            fits = np.ones(len(i), dtype=bool)
            rows = max(1, PROBES // points)
            for a in range(0, len(i), rows):
                part = slice(a, a + rows)
                offset = (2 * q[part, None] * np.arange(points)) // points
                x = i[part, None] + offset
                fits[part] = (self.c[x] == self.c[x + q[part, None]]).all(axis=1)
            i, q, step = i[fits], q[fits], step[fits]
            if points >= 1024 or not len(i) or (step == 2 * q).all():
                break
            points *= 8
        last = (0, -1)
        for start, lag in zip(i.tolist(), q.tolist()):
            if lag == last[0] and start < last[1]:
                continue
            if not len(self._unknown(np.array([start]), np.array([lag]))[0]):
                continue
            a, b = self._stretch(start, lag)
            last = (lag, b)
            length = b - a + lag
            if length >= max(LEAST_WORDS, PERIODS * lag):
                self._add(a, length, lag)

    def _unknown(self, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the probes within a run of which the lag is a multiple."""
        period = self.period[i]
        known = (period > 0) & (q % np.maximum(period, 1) == 0) & (self.at[i] + q < self.run_end[i])
        return i[~known], q[~known]

    def _stretch(self, i: int, q: int) -> tuple[int, int]:
        """The longest stretch around ``i`` of words that equal the word ``q`` on."""
        c, most = self.c, len(self.c) - q
        b, step = i, 64
        while b < most:
            upto = min(b + step, most)
            differ = np.flatnonzero(c[b:upto] != c[b + q : upto + q])
            if len(differ):
                b += int(differ[0])
                break
            b, step = upto, 2 * step
        a, step = i, 64
        while a > 0:
            down = max(a - step, 0)
            differ = np.flatnonzero(c[down:a] != c[down + q : a + q])
            if len(differ):
                a = down + int(differ[-1]) + 1
                break
            a, step = down, 2 * step
        return a, b

    def _add(self, a: int, length: int, q: int) -> None:
        start = int(self.at[a])
        self.found.setdefault((start, length), q)  # lags come in order: the first is the smallest period
        part = slice(a, a + length)
        wider = self.run_size[part] < length
        self.period[part][wider], self.run_end[part][wider], self.run_size[part][wider] = self.found[start, length], start + length, length


def find_runs(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of the texts whose words are ``codes[first[d]:first[d + 1]]``, in order of
    (text, start, period)."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = _Scan(codes, surviving_segments(codes, owner)).runs()
    rows = np.array([(start, length, q) for (start, length), q in found.items()], dtype=np.int64).reshape(-1, 3)
    of = owner[rows[:, 0]] if len(rows) else np.zeros(0, dtype=np.int64)
    rows = np.column_stack([of, rows[:, 0] - first[of], rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapse(words: Words, rows: np.ndarray) -> list[bytes]:
    """The texts without the words that repeat a run's first period."""
    first = words.first
    change = np.zeros(len(words.start) + 1, dtype=np.int64)
    begin = first[rows[:, 0]] + rows[:, 1]
    np.add.at(change, begin + rows[:, 3], 1)
    np.add.at(change, begin + rows[:, 2], -1)
    gone = np.cumsum(change[:-1]) > 0
    keep = np.repeat(~gone, words.end + 1 - words.start)  # a word goes with the space behind it
    upto = np.concatenate([[0], np.cumsum(np.where(gone, 0, words.end + 1 - words.start))])
    data = words.canon[keep].tobytes()
    return [data[a : b - 1] if b > a else b"" for a, b in zip(upto[first[:-1]].tolist(), upto[first[1:]].tolist())]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        rows = find_runs(word_codes(words), words.first)
        ends = np.searchsorted(rows[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(words.n), pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(_collapse(words, rows), type=pa.binary()).cast(pa.string())],
            names=["id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of at least four periods and six words that no neighbouring word extends; its period is its
    smallest.  ``collapsed`` has each run's first period only, words joined by one space.  Null and wordless texts
    have no runs and an empty ``collapsed``; repeated rows give equal rows; runs may overlap.  A null identifier is
    a value like any other.  A long text is worked on whole: about 25 bytes for each byte of text, and time of about
    n log n for n words.  An empty table gives no rows.  Only the two named columns are read, so others cannot clash.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(_run_rows, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
