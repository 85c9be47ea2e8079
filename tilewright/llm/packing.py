"""Sequence packing by lexical retrieval: a sharded BM25 index finds what goes with each seed document.

1. Every document is tokenised once; identifiers go to a table in the shared folder, with a MinHash
   signature of its token set and, once a batch, the batch's document frequencies.
2. Document frequencies, number and mean length are summed over all documents.  Terms are token
   identifiers, so this table is never longer than the tokeniser's vocabulary.
3. Documents are ranged by signature, which brings lexically similar ones together, and cut into shards of
   ``shard_docs`` documents; each shard builds its own inverted index with the global statistics.  The leading
   full windows of a long document are sequences as they are; its terms and its last tokens go on.
4. Per window: the seed's terms query the shard's postings; the unused neighbours, best first, are placed while
   they fit whole, and the best of the rest is cut to fill the window and seeds the next one.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, byte_offsets, gather, materialize, slices, small_batches, text_or_empty

WINDOW_TOKENS = 4096
END_ID = 2
K1, B = 1.2, 0.75
SHARD_DOCS = 2048
MEMO_WORDS = 150_000
#: Bytes of identifiers in one packing task.
TASK_BYTES = 8 << 20
#: What the tokeniser's own added tokens begin with: they are matched before letters are lower-cased.
ADDED = "<|"

#: Combining marks that compose with Latin letters, and the bytes they begin with.
MARKS, MARK_LEADS = "[\u0300-\u036f]", (0xCC, 0xCD)
#: Up to this letter, letters are composed already and have one lower case (but for U+0130).
LAST_LATIN = "\u024f"

_LOADED: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Identifiers of whole texts by the ``tokenizers`` library, from one call for each different word.

    White space is dropped by this kind of tokeniser and nothing merges across it, so a text's identifiers
    are those of its words in order.  Words of Latin letters skip normalising and splitting, which would only
    lower their case, and go to the library's BPE model directly, in its alphabet of bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        added = json.load(open(path))["added_tokens"]
        if any(not t["content"].startswith(ADDED) or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"added tokens that begin with {ADDED} and take no white space are needed")

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") != "Sequence" or not str(spec["model"].get("end_of_word_suffix")):
            raise ValueError("a tokeniser that drops white space and marks word ends is needed")
        self.vocab_size = self.whole.get_vocab_size()
        self.memo = WordMemo(MEMO_WORDS)
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet: dict[str, str] = {}
        self.plain = Tokenizer(self.whole.model)  # words already in the model's alphabet, parted by spaces
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(self.vocab_size, dtype=bool)
        self.ends_word[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _in_bytes(self, letter: str) -> str:
        if letter not in self.alphabet:
            self.alphabet[letter] = self.to_bytes(letter)[0][0]
        return self.alphabet[letter]

    def _learn(self, words: list[str]) -> list[bytes]:
        found: dict[str, bytes] = {}
        rest, simple, coded = [], [], []
        for w in words:
            if w.isascii() and w.isalpha():  # lower-cased before
                simple.append(w)
                coded.append(w)
            elif w.isalpha() and max(w) <= LAST_LATIN and "\u0130" not in w:
                simple.append(w)
                coded.append("".join(map(self._in_bytes, w.lower())))
            else:
                rest.append(w)
        if simple:
            ids = np.array(self.plain.encode_batch_fast([" ".join(coded)], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != len(simple):
                raise ValueError("a word without a final piece")
            raw = ids.tobytes()
            found.update(zip(simple, (raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))))
        for w, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False)):
            found[w] = np.array(e.ids, dtype=np.int32).tobytes()
        return [found[w] for w in words]

    @staticmethod
    def _lowered(texts: pa.Array) -> pa.Array:
        """ASCII letters lower-cased, but not in words that may hold an added token, nor in words with other letters where
        there are combining marks: the library composes before it lower-cases, and some marks compose with the small letter
        only."""
        texts = texts.fill_null("") if texts.null_count else texts
        lowered = pc.ascii_lower(texts)
        special = pc.match_substring(texts, ADDED)
        if np.isin(byte_offsets(texts)[1], MARK_LEADS).any():
            special = pc.or_(special, pc.match_substring_regex(texts, MARKS))
        if not pc.any(special).as_py():
            return lowered
        kept = [re.sub(r"[^ \t\n\x0b\x0c\r]+", lambda m: m[0].lower() if m[0].isascii() and ADDED not in m[0] else m[0], t) for t in texts.filter(special).to_pylist()]
        return pc.replace_with_mask(lowered, special, pa.array(kept, type=lowered.type))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers in one array, and the offsets of the texts in it."""
        lowered = self._lowered(texts)
        # A letter followed by final marks: two tokens whatever comes between, so the words are fewer.  Not the
        # marks that added tokens are made of.
        parted = pc.replace_substring_regex(lowered, r"([a-zß-öø-ÿ])([!-;=?@\[-`{}~]+)(\s|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(parted)
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        return gather(self.memo.fetch(words, self._learn), coded.indices.to_numpy(), ends)


def _unique_terms(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted (document << 32 | term) of a slice, each once."""
    owner = np.repeat(np.arange(len(ends) - 1, dtype=np.int64), np.diff(ends))
    keys = np.sort((owner << 32) | ids)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _encode_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(path)
        size = max(tokenizer.vocab_size, end_id + 1)
        salt = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rank = ((salt ^ (salt >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)
        for batch in slices(batches, "text"):
            n = batch.num_rows
            ids, ends = tokenizer.encode(batch.column("text"))
            # each document's final identifier
            full = np.insert(ids, ends[1:], end_id).astype(np.int32)
            full_ends = ends + np.arange(n + 1)
            terms = _unique_terms(full, full_ends)
            sig = np.minimum.reduceat(rank[terms & 0xFFFFFFFF], np.searchsorted(terms, np.arange(n, dtype=np.int64) << 32))
            found, freq = np.unique(terms & 0xFFFFFFFF, return_counts=True)
            df = np.stack([found, freq]).astype("<i4").tobytes()
            raw = full.astype("<u2" if size <= 1 << 16 else "<u4")
            ids_column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((full_ends * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sig), pa.array(np.diff(full_ends)), ids_column, pa.array([df] + [None] * (n - 1), type=pa.binary())],
                names=["id", "sig", "n", "ids", "df"],
            )

    return run


def _sum_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        for raw in batch.column("df").to_pylist():
            found, freq = np.frombuffer(raw, dtype="<i4").reshape(2, -1)
            for t, f in zip(found.tolist(), freq.tolist()):
                total[t] = total.get(t, 0) + f
    yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array(list(total.values()), type=pa.int64())], names=["term", "df"])


class _Shard:
    """A bounded set of documents with its BM25 postings.  ``docs``: what is to be packed of each; ``whole``:
    term identifiers and counts of those documents (by number) of which that is not all."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, whole: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, query_terms: int | None = None) -> None:
        self.docs, self.query_terms, whole = docs, query_terms, whole or {}
        self.length = np.array([len(d) for d in docs], dtype=np.int64)
        indexed = [d for k, d in enumerate(docs) if k not in whole]
        owner = np.repeat(np.array([k for k in range(len(docs)) if k not in whole], dtype=np.int64), [len(d) for d in indexed])
        keys = np.sort((owner << 32) | np.concatenate([*indexed, np.zeros(0, dtype=np.int64)]).astype(np.int64))
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        tf, keys = np.diff(np.append(at, len(keys))), keys[at]
        if whole:
            keys = np.concatenate([keys, *((np.int64(k) << 32) | terms.astype(np.int64) for k, (terms, _) in whole.items())])
            tf = np.concatenate([tf, *(counts for _, counts in whole.values())])
            order = np.argsort(keys)
            keys, tf = keys[order], tf[order]
        self.doc, self.term = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)
        full = np.bincount(self.doc, weights=tf, minlength=len(docs))
        norm = K1 * (1 - B + B * full[self.doc] / max(mean_length, 1.0))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm)
        self.of_doc = np.searchsorted(self.doc, np.arange(len(docs) + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = self.doc[by_term], self.weight[by_term]
        self.of_term = np.searchsorted(self.term[by_term], np.arange(len(idf) + 1))
        # Terms of many documents are columns of a matrix; the others' postings are short.
        self.column = np.full(len(idf), -1, dtype=np.int64)
        common = np.flatnonzero(np.diff(self.of_term) > max(len(docs) // 16, 64))
        self.column[common] = np.arange(len(common))
        column = self.column[self.term]
        self.matrix = np.zeros((len(docs), len(common)), dtype=np.float32)
        self.matrix[self.doc[column >= 0], column[column >= 0]] = self.weight[column >= 0]
        self.free = np.ones(len(docs), dtype=bool)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents of the shard for the seed's terms."""
        own = slice(self.of_doc[seed], self.of_doc[seed + 1])
        terms, weight = self.term[own], self.weight[own]
        if self.query_terms is not None and len(terms) > self.query_terms:
            terms = terms[np.argpartition(-weight, self.query_terms)[: self.query_terms]]
        column = self.column[terms]
        asked = np.zeros(self.matrix.shape[1], dtype=np.float32)
        asked[column[column >= 0]] = 1
        terms = terms[column < 0]
        begin, end = self.of_term[terms], self.of_term[terms + 1]
        n = end - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.post_doc[at], weights=self.post_weight[at], minlength=len(self.docs)) + self.matrix @ asked

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a term with the seed, best first (ties: shard order)."""
        score = self.scores(seed)
        found = np.flatnonzero((score > 0) & self.free)
        return found[np.argsort(-score[found], kind="stable")]


def _pack(shard: _Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each identifier of the shard once."""
    sequences: list[list[tuple[int, int, int]]] = []
    n, next_free = len(shard.docs), 0
    rest: tuple[int, int] | None = None  # a document that was cut: (document, position)
    while True:
        current: list[tuple[int, int, int]] = []
        room = window

        def place(d: int, at: int) -> tuple[int, int] | None:
            nonlocal room
            shard.free[d] = False
            take = min(room, int(shard.length[d]) - at)
            current.append((d, at, take))
            room -= take
            return (d, at + take) if at + take < shard.length[d] else None

        while next_free < n and not shard.free[next_free]:
            next_free += 1
        if rest is None and next_free == n:
            return sequences
        seed = rest[0] if rest else next_free
        rest = place(*(rest or (seed, 0)))
        score = shard.scores(seed) if room else np.zeros(n)
        while room and rest is None:
            # the best unused neighbour that fits whole, or else the best there is, which is cut
            unused = np.where(shard.free, score, 0.0)
            best = int(np.argmax(np.where(shard.length <= room, unused, 0.0)))
            if not unused[best] or shard.length[best] > room:
                best = int(np.argmax(unused))
            if unused[best]:
                rest = place(best, 0)
                continue
            while next_free < n and not shard.free[next_free]:
                next_free += 1
            if next_free == n:
                break
            rest = place(next_free, 0)
        sequences.append(current)


def _split_tail(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut an unfilled sequence into ones whose lengths are powers of two, so that it needs no padding."""
    left = sum(p[2] for p in sequence)
    out: list[list[tuple[int, int, int]]] = []
    queue = list(sequence)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        current: list[tuple[int, int, int]] = []
        while room:
            d, at, n = queue.pop(0)
            take = min(room, n)
            current.append((d, at, take))
            room -= take
            if take < n:
                queue.insert(0, (d, at + take, n - take))
        out.append(current)
    return out


_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_rows(idf: np.ndarray, mean_length: float, window: int, wide: bool, with_ids: bool, shard_docs: int, query_terms: int | None):
    kind = "<u4" if wide else "<u2"
    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        """Pieces (id, start, part, document's length, sequence, offset) as rows."""
        parts = [p[2].astype("<u4") for p in pieces]
        cols = [[p[0] for p in pieces], [p[1] for p in pieces], list(map(len, parts)), [zlib.crc32(x.tobytes()) for x in parts], *([p[k] for p in pieces] for k in (3, 4, 5))]
        made = [pa.array(c, type=pa.int64()) for c in cols]
        if with_ids:
            made.append(pa.array([x.astype(np.int32) for x in parts], type=pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(made, names=names)

    def emit(shard: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        """``shard``: (id, position of the rest, rest, document's length, terms with counts or None)."""
        whole = {k: terms for k, (*_, terms) in enumerate(shard) if terms is not None}
        sequences = _pack(_Shard([rest for _, _, rest, _, _ in shard], idf, mean_length, whole, query_terms), window)
        if sequences and sum(p[2] for p in sequences[-1]) < window:
            sequences[-1:] = _split_tail(sequences[-1])
        pieces = []
        for number, sequence in enumerate(sequences, first):
            offset = 0
            for d, at, n in sequence:
                i, start, rest, total, _ = shard[d]
                pieces.append((i, start + at, rest[at : at + n], total, number, offset))
                offset += n
        return batch_of(pieces), first + len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        shard: list[tuple] = []
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("ids")):
                ids, terms = np.frombuffer(raw.as_buffer(), dtype=kind), None
                over = len(ids) // window * window  # tokens that fill windows of their own
                for a in range(0, over, window * 256):
                    cuts = range(a, min(a + window * 256, over), window)
                    yield batch_of([(i, c, ids[c : c + window], len(ids), number + k, 0) for k, c in enumerate(cuts)])
                    number += len(cuts)
                if over == len(ids):
                    continue
                if over:
                    terms = np.unique(ids, return_counts=True)
                shard.append((i, over, ids[over:].copy(), len(ids), terms))
                if len(shard) == shard_docs:
                    out, number = emit(shard, number)
                    yield out
                    shard = []
        if shard:
            yield emit(shard, number)[0]

    return run


def pack(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_TOKENS, end_id: int = END_ID,
    with_ids: bool = False, shard_docs: int = SHARD_DOCS, query_terms: int | None = None,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    ``tokenizer``: path of a ``tokenizers`` file that every executor can open; by default the public
    word-level BPE.  ``shard_docs``: documents of one index.  ``query_terms``: how many of the seed's strongest
    terms query it; by default all.  Returns one row per piece: ``id_col``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the identifiers.  Pieces of a document cover it exactly
    once; sequences are full, but for the last of a shard, which is cut into lengths that are powers of two.

    Null and empty texts are one piece: the end identifier.  Documents longer than a window are cut: their
    leading windows are sequences, so a shard holds at most ``shard_docs * window`` tokens however long a text
    is.  A text is encoded whole, in about 20 times its size of memory.  Repeated rows and null identifiers are
    packed like any other row; neighbours of equal score come in shard order.  An empty table gives no rows.
    Only the two named columns are read, so others cannot clash.
    """
    small_batches(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    vocab = max(WordTokenizer.load(tokenizer).vocab_size, end_id + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    coded = materialize(rows.mapInArrow(_encode_rows(tokenizer, end_id), "id long, sig long, n long, ids binary, df binary"), "ids")
    total = coded.agg(F.count("*").alias("docs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    counted = coded.where("df is not null").select("df").mapInArrow(_sum_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(vocab)
    for term, n in counted.collect():  # at most one row for each term of the vocabulary
        df[term] = n
    idf = np.log(1 + (total["docs"] - df + 0.5) / (df + 0.5))
    tasks = max(1, math.ceil(total["tokens"] * (4 if vocab > 1 << 16 else 2) / TASK_BYTES))
    ranged = coded.select("sig", "id", "ids", F.xxhash64("id", "ids").alias("h")).repartitionByRange(tasks, "sig", "h").sortWithinPartitions("sig", "h", "id")
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    pieces = ranged.select("id", "ids").mapInArrow(_pack_rows(idf, total["mean"], window, vocab > 1 << 16, with_ids, shard_docs, query_terms), schema)
    return pieces.withColumnRenamed("id", id_col)
