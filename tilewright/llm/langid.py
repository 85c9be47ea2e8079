"""Language identification with a linear-chain conditional random field over the words of a text.

A word's features are itself, its affixes, its character n-grams and the lexicons (frequent words of a
language in the training sample) that hold it; transitions between the labels of neighbouring words are
learned with them.  Training sequences are spliced from documents of several languages, so the transitions
know how seldom a text switches.  Forward-backward gives each word's label probabilities; a document's
language is the label with the largest total.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordMemo, slices, small_batches

UNKNOWN = "und"
FOLDS = 5
#: Bounds of the training sample: documents and words of each language.
SAMPLE_DOCS = 400
SAMPLE_WORDS = 60_000
DIMENSIONS = 1 << 16
SEQUENCE_WORDS, EPOCHS, BATCH, RATE, DECAY = 24, 5, 128, 0.25, 1e-6
LEXICON_WORDS = 200
MEMO_WORDS = 300_000
_PUNCTUATION = ".,;:!?|\"'()[]{}<>*#%&$-_/\\"


@dataclass
class CrfModel:
    labels: list[str]
    weights: np.ndarray  # DIMENSIONS x labels
    transitions: np.ndarray  # labels x labels
    lexicon: dict[str, list[int]]


def word_features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Hashed features of a lower-case word: lexicons, word, prefixes, suffixes, 2- and 3-grams."""
    raw = ("\x02" + word + "\x03").encode()
    grams = [raw[i : i + n] for n in (2, 3) for i in range(len(raw) - n + 1)]
    body = raw[1:-1]
    grams += [b"w" + body, *(b"p" + body[:n] for n in (1, 2, 3)), *(b"s" + body[-n:] for n in (1, 2, 3, 4))]
    mask = DIMENSIONS - 1
    return [crc32(g) & mask for g in grams] + [crc32(b"l%d" % label) & mask for label in lexicon.get(word, ())]


def forward_backward(emissions: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word.

    ``emissions``: time x sequences x labels, sequences by falling length; ``counts[t]``: sequences that have
    a word ``t``.  Messages are scaled at each step, so long texts neither overflow nor vanish.
    """
    steps, _, labels = emissions.shape
    local = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    pass_on = np.exp(transitions - transitions.max())
    alpha = np.zeros_like(local)
    for t in range(steps):
        n = counts[t]
        a = local[t, :n] if t == 0 else local[t, :n] * (alpha[t - 1, :n] @ pass_on)
        alpha[t, :n] = a / a.sum(axis=1, keepdims=True)
    beta = np.full_like(local, 1.0 / labels)
    for t in range(steps - 2, -1, -1):
        n = counts[t + 1]
        b = (local[t + 1, :n] * beta[t + 1, :n]) @ pass_on.T
        beta[t, :n] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    total = gamma.sum(axis=2, keepdims=True)
    return np.divide(gamma, total, out=np.zeros_like(gamma), where=total > 0)


def _pair_expectation(local: np.ndarray, gamma: np.ndarray, pass_on: np.ndarray) -> np.ndarray:
    """Expected transitions of equally long sequences, from scaled messages."""
    steps = len(local)
    alpha, beta = np.zeros_like(local), np.ones_like(local)
    for t in range(steps):
        a = local[t] if t == 0 else local[t] * (alpha[t - 1] @ pass_on)
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (local[t + 1] * beta[t + 1]) @ pass_on.T
        beta[t] = b / b.sum(axis=1, keepdims=True)
    out = np.zeros_like(pass_on)
    for t in range(1, steps):
        joint = alpha[t - 1][:, :, None] * pass_on[None] * (local[t] * beta[t])[:, None, :]
        out += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out


def clean_word(token: str) -> str:
    """The letters of a token in lower case; empty if it has none."""
    return token if token.isalpha() and token.islower() else "".join(c for c in token if c.isalpha()).lower()


def train(samples: dict[str, list[str]], seed: int = 7) -> CrfModel | None:
    """Fit the field by stochastic gradients of its log-likelihood (AdaGrad); None without training text."""
    labels = sorted(samples)
    words = {k: [w for text in samples[k] for w in map(clean_word, text.split()) if w][:SAMPLE_WORDS] for k in labels}
    labels = [k for k in labels if words[k]]
    if not labels:
        return None
    lexicon: dict[str, list[int]] = {}
    for i, k in enumerate(labels):
        for w, _ in sorted(Counter(words[k]).items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            lexicon.setdefault(w, []).append(i)
    rng = np.random.default_rng(seed)
    number, sizes = len(labels), [len(words[k]) for k in labels]
    lines: list[list[tuple[int, str]]] = []
    for _ in range(max(1, sum(sizes) // SEQUENCE_WORDS)):
        cuts = sorted(rng.integers(1, SEQUENCE_WORDS, size=rng.integers(0, 3)).tolist()) if number > 1 else []
        line: list[tuple[int, str]] = []
        for a, b in zip([0, *cuts], [*cuts, SEQUENCE_WORDS]):
            k = int(rng.integers(number))
            at = int(rng.integers(sizes[k]))
            line += [(k, words[labels[k]][(at + j) % sizes[k]]) for j in range(b - a)]
        lines.append(line)
    cache: dict[str, list[int]] = {}
    weights, trans = np.zeros((DIMENSIONS, number)), np.zeros((number, number))
    squares, trans_squares = np.full((DIMENSIONS, number), 1e-4), np.full((number, number), 1e-4)
    for _ in range(EPOCHS):
        for at in range(0, len(lines), BATCH):
            part = lines[at : at + BATCH]
            feats = [cache[w] if w in cache else cache.setdefault(w, word_features(w, lexicon)) for line in part for _, w in line]
            size = np.fromiter(map(len, feats), dtype=np.int64, count=len(feats))
            flat = np.concatenate([np.asarray(f) for f in feats])
            starts = np.cumsum(size) - size
            scores = np.add.reduceat(weights[flat], starts, axis=0).reshape(len(part), SEQUENCE_WORDS, number).transpose(1, 0, 2)
            truth = np.array([[k for k, _ in line] for line in part]).T
            local, pass_on = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(trans - trans.max())
            gamma = forward_backward(scores, np.full(SEQUENCE_WORDS, len(part)), trans)
            error = (np.eye(number)[truth] - gamma).transpose(1, 0, 2).reshape(-1, number)
            spread = np.repeat(error, size, axis=0)
            grad = np.stack([np.bincount(flat, weights=spread[:, k], minlength=DIMENSIONS) for k in range(number)], axis=1) / len(part)
            grad -= DECAY * weights
            squares += grad**2
            weights += RATE * grad / np.sqrt(squares)
            seen = np.zeros((number, number))
            np.add.at(seen, (truth[:-1].ravel(), truth[1:].ravel()), 1)
            tgrad = (seen - _pair_expectation(local, gamma, pass_on)) / len(part)
            trans_squares += tgrad**2
            trans += RATE * tgrad / np.sqrt(trans_squares)
    return CrfModel(labels, weights.astype(np.float32), trans, lexicon)


def predict(model: CrfModel, texts: pa.Array, memo: WordMemo) -> tuple[list[str], list[float]]:
    """Language and score of every text; words' emissions are remembered in ``memo``."""
    lowered = pc.ascii_lower(texts.fill_null("") if texts.null_count else texts)
    lists = pc.ascii_split_whitespace(lowered)
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    coded = pc.utf8_trim(lists.flatten(), characters=_PUNCTUATION).dictionary_encode()
    tokens = coded.dictionary.to_pylist()

    def learn(unknown: list[str]) -> list[np.ndarray]:
        cleaned = [clean_word(t) for t in unknown]
        feats = [word_features(w, model.lexicon) for w in cleaned if w]
        out = np.full((len(unknown), len(model.labels)), np.nan)
        if feats:
            size = np.fromiter(map(len, feats), dtype=np.int64, count=len(feats))
            flat = np.fromiter((x for f in feats for x in f), dtype=np.int64, count=int(size.sum()))
            out[[k for k, w in enumerate(cleaned) if w]] = np.add.reduceat(model.weights[flat], np.cumsum(size) - size, axis=0)
        return list(out.astype(np.float32))

    table = np.array(memo.fetch(tokens, learn), dtype=np.float64).reshape(len(tokens), len(model.labels))
    codes = coded.indices.to_numpy()
    good = ~np.isnan(table[codes, 0]) if len(codes) else np.zeros(0, dtype=bool)
    upto = np.concatenate([[0], np.cumsum(good)])[ends]
    codes = codes[good]
    length = np.diff(upto)
    langs, scores = [UNKNOWN] * len(length), [0.0] * len(length)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    at = 0
    while at < len(order):
        steps = int(length[order[at]])
        part = order[at : at + max(1, min(512, 400_000 // steps))]
        at += len(part)
        emissions = np.zeros((steps, len(part), len(model.labels)))
        for j, d in enumerate(part):
            emissions[: length[d], j] = table[codes[upto[d] : upto[d + 1]]]
        counts = np.searchsorted(-length[part], -np.arange(steps), side="left")
        mass = forward_backward(emissions, counts, model.transitions).sum(axis=0) / length[part][:, None]
        for j, d in enumerate(part):
            k = int(mass[j].argmax())
            langs[d], scores[d] = model.labels[k], float(min(1.0, max(0.0, mass[j, k])))
    return langs, scores


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """``per_language`` different (identifier, text) rows of each language from the training folds, or all where
    there are fewer: those with the smallest hashes, whatever the tables' size and order."""
    usable = docs.where(~_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.shiftrightunsigned(F.xxhash64(id_col, text_col), 1).alias("h"))
    # First a draw that is very likely wide enough and never much wider, then the smallest of it.
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # the model has a column for each
    if not sizes:
        return {}
    below = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], float(1 << 63) * (1.5 * per_language + 50) / r["n"])])
    drawn = usable.where(F.col("h") < below[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = drawn.dropDuplicates(["lang", "h"]).withColumn("place", place).where(F.col("place") <= per_language)
    out: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "h").collect():  # a bounded number of each language
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: CrfModel | None = None) -> DataFrame:
    """One row per input row: ``id_col``, held_out, lang_pred, score.

    Unless a model is given, one is learned from texts and non-null languages of documents outside the
    held-out fold.  Null texts, texts without letters, and everything where there is nothing to learn from,
    are ``und`` with score 0.  A row with a null identifier is held out.  Repeated rows give equal rows; an
    empty table gives no rows.  Of languages with equal mass the first in alphabetical order wins.  A long text
    is worked on whole.  The model takes 65,536 numbers a language.  Only the three named columns are read, so
    others cannot clash, and the language only to train.
    """
    small_batches(docs.sparkSession)
    model = model or train(training_sample(docs, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: dimensions x labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, memo = shared.value, WordMemo(MEMO_WORDS)
        for batch in slices(batches, "text"):
            if field is None:
                langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            else:
                langs, scores = predict(field, batch.column("text"), memo)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), _held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
