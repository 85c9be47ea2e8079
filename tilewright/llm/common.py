"""Shared helpers: word splitting and window hashing on Arrow buffers, memory of words."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, materialize, scratch_path, temporary

__all__ = ["MAX_LONG", "WS", "WS_CLASS", "WindowHasher", "WordMemo", "Words", "byte_offsets", "documents", "drop", "gather", "id_order", "is_space", "materialize", "merged", "mix", "scratch_path", "slices", "small_batches", "temporary", "text_or_empty"]

#: ``[\x20\x09-\x0D]``: the white space that separates words.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in WS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32



def is_space(raw: np.ndarray) -> np.ndarray:
    """Which of the bytes are white space."""
    return _IS_SPACE[raw]


MAX_LONG = (1 << 63) - 1
#: Bytes of one Arrow batch of documents.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_order(id_col: str) -> Column:
    """A never-null sort key for integer identifiers; a null identifier comes last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG))


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not broadcast.  Spark guesses a table's size from its compressed files and takes
    an explode for no larger than its input; what is broadcast has to fit the driver."""
    return df.hint("merge")


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``max_bytes`` of ``column`` (a single long value may
    hold more): what NumPy allocates for a slice stays bounded whatever the batch size is."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = byte_offsets(batch.column(column))[0]
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(ends, ends[at] + max_bytes, side="left"))
                upto = min(max(upto, at + 1), batch.num_rows)
                yield batch.slice(at, upto - at)
                at = upto
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for their next task beside busy ones."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, max_bytes: int = BATCH_BYTES) -> None:
    """Bound the bytes of one Arrow batch that goes to Python (a session setting) where it is larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).rstrip("b")
    if size.isdigit() and int(size) > max_bytes:
        spark.conf.set(key, str(max_bytes))


def byte_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from the start of the returned bytes) and bytes of a string or binary array; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return ends - ends[0], raw


class Words:
    """The words of a slice of texts.

    ``canon``: all words, each followed by one space.  ``start[k]``, ``end[k]``: word ``k`` in ``canon``.
    ``first[d]:first[d + 1]``: the words of text ``d``.  Takes about 5 bytes for each byte of text and 24 for
    each word, so a long text costs about ten times its size.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        offsets, raw = byte_offsets(texts)
        raw = np.insert(raw, offsets[1:], 0x20)  # a text's last word ends with it
        offsets = offsets + np.arange(len(offsets))
        black = ~_IS_SPACE[raw]
        begins = black.copy()
        begins[1:] &= ~black[:-1]
        self.first = np.searchsorted(np.flatnonzero(begins), offsets)
        stays = np.logical_or(black[1:], black[:-1], out=begins[1:])
        begins[:1] = black[:1]
        self.canon = raw[begins]
        del stays
        space = ~black[begins]
        self.canon[space] = 0x20
        if lower:
            self.canon = _LOWER[self.canon]
        self.end = np.flatnonzero(space)
        self.start = np.append(0, self.end[:-1] + 1) if len(self.end) else self.end
        self.n = np.diff(self.first)

    def joined(self, d: int) -> bytes:
        """The words of text ``d`` joined by one space."""
        a, b = self.first[d], self.first[d + 1]
        return self.canon[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


class WordMemo:
    """What a Python worker has worked out for words, in two generations of ``limit`` words: the words in
    use move on to the new one, the rest is forgotten with the old."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def fetch(self, words: list[str], learn: Callable[[list[str]], Iterable]) -> list:
        """The words' values; ``learn`` gives those of unknown words, in order."""
        new = self.new
        found = list(map(new.get, words))
        missing = [k for k, v in enumerate(found) if v is None]
        if missing:
            old = list(map(self.old.get, map(words.__getitem__, missing)))
            unknown = [k for k, v in zip(missing, old) if v is None]
            learned = iter(learn([words[k] for k in unknown])) if unknown else iter(())
            for k, v in zip(missing, old):
                found[k] = new[words[k]] = next(learned) if v is None else v
        if len(new) > self.limit:
            self.new, self.old = {}, new
        return found


def gather(pieces: list[bytes], codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate int32 pieces in the order of ``codes``; ``ends`` (offsets into codes) become offsets into
    the result."""
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) >> 2
    begin = np.cumsum(length) - length
    of = length[codes]
    upto = np.concatenate([[0], np.cumsum(of)])
    flat = np.frombuffer(b"".join(pieces), dtype=np.int32)
    return flat[np.repeat(begin[codes] - upto[:-1], of) + np.arange(upto[-1])], upto[ends]


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word: its bytes, mixed, up to 16 bytes; XXH64 of longer words."""
    size = words.end - words.start
    padded = np.append(words.canon, np.zeros(16, dtype=np.uint8))
    eights = np.ndarray(len(words.canon) + 8, dtype="<u8", buffer=padded, strides=(1,))
    full = np.uint64((1 << 64) - 1)
    shift = np.uint64(64) - np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
    h = eights[words.start] & (full >> shift)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    more = np.flatnonzero(size > 8)
    shift = np.uint64(64) - np.minimum(size[more] - 8, 8).astype(np.uint64) * np.uint64(8)
    h[more] += eights[words.start[more] + 8] & (full >> shift)
    h += size.astype(np.uint64) << np.uint64(56)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    for k in np.flatnonzero(size > 16).tolist():
        h[k] = xxhash.xxh64_intdigest(words.canon[words.start[k] : words.end[k]])
    return h


class WindowHasher:
    """64-bit hashes of runs of consecutive words.  Windows are put together from halves by mixing steps that
    are not linear, so that no rearrangement of words cancels out."""

    def __init__(self, words: Words) -> None:
        self.spans = {1: word_hashes(words)}

    def _span(self, size: int) -> np.ndarray:
        if size not in self.spans:
            left = 1 << (size - 1).bit_length() - 1  # the largest power of two below size
            a, b = self._span(left), self._span(size - left)
            n = max(len(self.spans[1]) - size + 1, 0)
            x = (a[:n] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x += b[left : left + n]
            x *= np.uint64(0xC2B2AE3D27D4EB4F)
            x ^= x >> np.uint64(29)
            self.spans[size] = x
        return self.spans[size]

    def __call__(self, size: int, at: np.ndarray) -> np.ndarray:
        """Signed hashes of the windows of ``size`` words that begin at the words ``at``."""
        return mix(self._span(size)[at])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits (a multiply-and-shift finaliser); returned as signed."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)
