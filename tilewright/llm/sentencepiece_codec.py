"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton of all pieces reads a segment once.  At each position it reports, through its output links,
every piece that ends there, longest first; each relaxes the best score of the position from the best score
of the piece's start.  A character that no path covers costs more than any piece and becomes byte pieces.

No piece crosses from another character into the word mark (checked when a model is loaded), so a text's
best path is made of the best paths of its segments; equal segments are encoded once and remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, gather, slices, small_batches, text_or_empty

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Set between segments where no text of the slice holds it.
CUT = "\x00"
_BOUNDARY = re.compile(f"(?<=[^{MARK}])(?={MARK})")
MEMO_SEGMENTS = 150_000

_LOADED: dict[str, "PieceModel"] = {}


class PieceModel:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.unk = model.unk_id()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.automaton = ahocorasick.Automaton()
        lowest = 0.0
        for i, piece in enumerate(self.pieces):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} holds the word mark after another character")
            score = model.get_score(i)
            lowest = min(lowest, score)
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.as_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.memo = WordMemo(MEMO_SEGMENTS)

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def viterbi(self, segment: str) -> list[int]:
        """Identifiers of the best path; of equal paths the one with the longer last piece."""
        n = len(segment)
        best = [0.0] + [-1e300] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        done = 0
        for last, (piece, length, score) in self.automaton.iter(segment):
            end = last + 1
            while done < end - 1:  # positions where no piece ended
                done += 1
                self._unknown(best, back, done)
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (end - length, piece)
            if length == 1:
                done = end  # covered by its own character: no unknown is cheaper
        while done < n:
            done += 1
            self._unknown(best, back, done)
        out: list[int] = []
        while n:
            start, piece = back[n]
            if piece >= 0:
                out.append(piece)
            else:
                data = segment[start:n].encode("utf-8", "replace")
                out.extend(self.byte_ids[b] for b in reversed(data)) if self.byte_ids else out.append(self.unk)
            n = start
        return out[::-1]

    def _unknown(self, best: list[float], back: list, end: int) -> None:
        total = best[end - 1] + self.unknown_score
        if total > best[end]:
            best[end], back[end] = total, (end - 1, -1)

    def _learn(self, segments: list[str]) -> list[bytes]:
        return [np.array(self.viterbi(s), dtype=np.int32).tobytes() for s in segments]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers in one array, and the offsets of the texts in it."""
        texts = texts.fill_null("") if texts.null_count else texts
        # A mark before the first word as well as for each space; a run of marks stays with the word after it.
        marked = pc.replace_substring(texts, " ", MARK)
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(MARK, marked, ""))
        if pc.any(pc.match_substring(texts, CUT)).as_py():
            lists = pa.array([_BOUNDARY.split(t) for t in marked.to_pylist()], type=pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{MARK}])({MARK})", f"\\1{CUT}\\2"), CUT)
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        segments = coded.dictionary.to_pylist()
        if not segments:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        return gather(self.memo.fetch(segments, self._learn), coded.indices.to_numpy(), ends)

    def decode(self, ids: list[int]) -> str:
        """The text of identifiers: pieces joined, marks become spaces, the leading one goes."""
        raw = b"".join(map(self.as_bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids (array of int), one row per input row.

    ``model``: path of a SentencePiece model that every executor can open.  Null and empty texts have no
    identifiers; repeated rows and null identifiers are encoded like any other row; an empty table gives no
    rows.  Only the two named columns are read.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, ends = PieceModel.load(path).encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text of identifier arrays, one row per input row; a null array gives an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [PieceModel.load(path).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, type=pa.string())], names=["id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``id_col``, n_tokens, n_byte_tokens, ids_crc32 (little-endian unsigned
    32-bit identifiers), decoded_sha256 and exact (the decoded text is the input).

    ``exact`` holds for every text without U+2581, which this kind of model writes spaces with: as in the
    library, it comes back as a space.  Null text is empty and has no identifiers.  Where two paths have equal
    scores, the longer last piece wins.  A long text is worked on whole.  Repeated rows give equal rows, null
    identifiers stay null, an empty table gives no rows.  Only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceModel.load(path)
        is_byte = np.zeros(len(codec.pieces), dtype=bool)
        is_byte[list(codec.byte_ids.values())] = True
        for batch in slices(batches, "text"):
            ids, ends = codec.encode(batch.column("text"))
            crc, sha, same = [], [], []
            for text, a, b in zip(batch.column("text").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                own = ids[a:b]
                crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                back = codec.decode(own.tolist())
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            upto = np.concatenate([[0], np.cumsum(is_byte[ids])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(ends)), pa.array(upto[ends[1:]] - upto[ends[:-1]]), pa.array(crc, type=pa.int64()), pa.array(sha, type=pa.string()), pa.array(same, type=pa.bool_())],
                names=["id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "exact"],
            )

    schema = "id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, exact boolean"
    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
