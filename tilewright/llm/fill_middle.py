"""Fill-in-the-middle: texts cut in two places at token ends and put together again around sentinels.

Each byte of a slice of texts has a class: white space or part of a word, the lead of a character or what
follows it, and whether a token ends with it.  The classes are held in a wavelet matrix.  Ranks of the classes
that end a token add up to the number of tokens before any position, and bisection on these sums finds both cuts
of all texts of the slice at once; ranks of the leading classes give the same places in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_offsets, is_space, slices, small_batches, text_or_empty

SEED = 42
#: Of a hundred texts, so many are rearranged, and of a hundred of those, so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bits of a class.
_ENDS, _WORD, _FOLLOWS = 1, 2, 4
_LEVELS = 3
#: Classes that end a token, and those that begin a character.
ENDING = (_ENDS, _WORD | _ENDS, _FOLLOWS | _WORD | _ENDS)
LEADING = (0, _ENDS, _WORD, _WORD | _ENDS)


class WaveletMatrix:
    """Ranks of small symbols in a sequence: one bit vector a level, each with counts before every 64 bits.
    Takes about an eighth more than ``levels`` bits a symbol."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.size, self.levels = len(symbols), []
        for bit in reversed(range(levels)):
            ones = ((symbols >> bit) & 1).astype(bool)
            packed = np.zeros(-(-(self.size + 1) // 64) * 8, dtype=np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((bit, words, before, self.size - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, upto: np.ndarray) -> np.ndarray:
        block, rest = upto >> 6, (upto & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: int, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each of the positions ``upto``."""
        low, high = np.zeros(1, dtype=np.int64), np.asarray(upto, dtype=np.int64)
        for bit, words, before, zeros in self.levels:
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            low, high = (zeros + a, zeros + b) if symbol >> bit & 1 else (low - a, high - b)
        return high - low

    def count(self, symbols: tuple[int, ...], upto: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, upto) for s in symbols)


def byte_classes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that end at ``ends``.  A token is white space and the word after it, or white
    space that ends a text."""
    white = is_space(raw)
    last = np.zeros(len(raw) + 1, dtype=bool)
    last[ends] = True  # where a text ends, the next byte is another's
    stops = last[1:].copy()
    inner = ~stops[:-1] & white[1:]
    done = stops
    done[:-1] |= inner & ~white[:-1]
    out = done.astype(np.uint8)
    out[~white] |= _WORD
    out[(raw & 0xC0) == 0x80] |= _FOLLOWS
    return out


def cut_positions(matrix: WaveletMatrix, begin: np.ndarray, end: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Of each text (bytes ``begin`` to ``end``): the position up to which ``units`` of its tokens have ended."""
    goal = matrix.count(ENDING, begin) + units
    low, high = begin.copy(), end.copy()
    while np.any(low < high):
        middle = (low + high) >> 1
        enough = matrix.count(ENDING, middle) >= goal
        high = np.where(enough, middle, high)
        low = np.where(enough, low, np.minimum(middle + 1, high))
    return low


def _arrange(sentinels: tuple[str, str, str]):
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ends, raw = byte_offsets(batch.column("text"))
            matrix = WaveletMatrix(byte_classes(raw, ends[1:]), _LEVELS)
            tokens = np.diff(matrix.count(ENDING, ends))
            forms = batch.column("form").to_pylist()
            at = np.flatnonzero([f != "plain" for f in forms])
            one, two = (batch.column(c).to_numpy()[at] % (tokens[at] + 1) for c in ("one", "two"))
            first = cut_positions(matrix, ends[at], ends[at + 1], np.minimum(one, two))
            second = cut_positions(matrix, ends[at], ends[at + 1], np.maximum(one, two))
            begins, before, upto = (matrix.count(LEADING, x) for x in (ends[at], first, second))
            data = raw.tobytes()
            outputs = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            for d, a, b, c, e in zip(at.tolist(), ends[at].tolist(), first.tolist(), second.tolist(), ends[at + 1].tolist()):
                head, mid, tail = data[a:b], data[b:c], data[c:e]
                outputs[d] = b"".join((s, tail, p, head, m, mid) if forms[d] == "spm" else (p, head, s, tail, m, mid))
            chars = np.zeros((2, batch.num_rows), dtype=np.int64)
            chars[0, at], chars[1, at] = before - begins, upto - before
            plain = np.ones(batch.num_rows, dtype=bool)
            plain[at] = False
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(tokens), batch.column("form"), *(pa.array(c, mask=plain) for c in chars), pa.array(outputs, type=pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
) -> DataFrame:
    """One row per input row: ``id_col``, n (tokens), form, prefix_chars, middle_chars, output.

    Both cuts, whether a text is rearranged and how come from the SHA-256 of seed and identifier, so a run that
    is repeated gives the same.  Null text is empty; empty texts and such as hold a sentinel stay as they are
    (form plain, no counts).  A null identifier is hashed like an empty one.  Repeated rows are rearranged alike.
    A cut may fall at either end or both in one place: parts may be empty.  A long text is worked on whole, in about
    ten times its size.  An empty table gives no rows.  Only the two named columns are read, so others cannot clash.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", digest)
    holds = F.lit(False)
    for sentinel in sentinels:
        holds = holds | F.contains("text", F.lit(sentinel))
    form = F.when((F.col("text") == "") | holds | (draw(2) % 100 >= rate), "plain").when(draw(3) % 100 < suffix_first, "spm").otherwise("psm")
    asked = rows.select("id", "text", form.alias("form"), draw(0).alias("one"), draw(1).alias("two"))
    made = asked.mapInArrow(_arrange(sentinels), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``fill_in_middle`` rearranged: built-in functions on its form and output only."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels))
    part = lambda k: F.get(parts, F.lit(k))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
