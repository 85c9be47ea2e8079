"""Packing, SentencePiece, quality rules, language, WARC, sharding and quality classifier."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.llm import langid, packing, quality_bayes, quality_rules, sentencepiece_codec, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["<|ENDOFTEXT|> x", "X<|EndOfText|>Y. <|StartOfText|>! a<|endoftext|>B, <|startoftext|>..", "E\u0301t\u00e9\u0301! o\u0301'' A.\u0301 na\u00efve?!)", "<||> a<| |>b. <|endoftext|", "Ünïcödé WORDS, don't stop! it's 3rd... (a)b.c d", "İstanbul ŒUVRE étude", "<|endoftext|> x", "a\x00b", "ß ſ ǅ ª", "漢字 かな 😀😀", "x" * 300, "a.b,c;d. e, f.", "'s 're it'll"]


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def token_ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


def test_word_tokenizer_equals_library(tokenizer, corpus):
    texts = ODD + corpus
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for limit in (300_000, 3):  # with room, and forgetting all the time
        own.memo.limit = limit
        for _ in range(2):
            ids, ends = own.encode(pa.array(texts, type=pa.string()))
            for t, a, b in zip(texts, ends[:-1], ends[1:]):
                assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_word_tokenizer_on_combining_marks(tokenizer):
    """Capital and small letters before marks of all kinds, some of which compose with one of the two only."""
    rng = random.Random(9)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["\u0308", "\u0331", "\u030a", "\u030c", "\u0327", "\u05b0", "\u3099", "\u0345"]
    letters = [chr(c) for c in range(65, 91)] + [chr(c) for c in range(97, 123)] + list("HJTWYhjtwy") * 3 + ["É", "ß", "İ", "Ω", "и"]
    piece = lambda: rng.choice(letters) + "".join(rng.choice(marks) for _ in range(rng.choice([0, 0, 1, 1, 2, 3])))
    texts = ["".join(piece() + rng.choice(["", "", "", " ", ". ", "!\n", "-", "<|endoftext|>"]) for _ in range(rng.randint(1, 8))) for _ in range(100_000)]
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for part in (texts[a : a + 5000] for a in range(0, len(texts), 5000)):
        ids, ends = own.encode(pa.array(part, type=pa.string()))
        for t, e, a, b in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), ends[:-1], ends[1:]):
            assert ids[a:b].tolist() == e.ids, t
            at += 1
    assert at == 100_000 and own.encode(pa.array(["T\u0308", "t\u0308"]))[0].tolist() == tokenizer.encode("T\u0308", add_special_tokens=False).ids + tokenizer.encode("t\u0308", add_special_tokens=False).ids


def test_word_tokenizer_on_random_texts(tokenizer):
    rng = random.Random(8)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "the", "The", "ÉCOLE", "straße", "İx", "3", "42", "'s", "'LL", ".", ",!", "***", "&&&", "-", "é", "e\u0301", "\u00a0", "漢", "😀", "\x00", "_", "ß", "ǅ"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n", "\t "]) for _ in range(rng.randint(0, 12))) for _ in range(30_000)]
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids, ends = own.encode(pa.array(texts, type=pa.string()))
    for t, e, a, b in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == e.ids, t


@pytest.mark.parametrize("window", [16, 256])
def test_pack(make_docs, corpus, tokenizer, window):
    rows = packing.pack(make_docs(corpus), window=window, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(range(len(corpus)))
    for d, own in pieces.items():
        ids, at = token_ids(tokenizer, corpus[d]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids) and r["ids"] == part.tolist()
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or at < window and at & (at - 1) == 0


def test_shard_ranks_by_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, size=rng.integers(5, 30)) for _ in range(40)]
    df = np.zeros(60)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    mean = float(np.mean([len(d) for d in docs]))
    shard = packing._Shard(docs, idf, mean)
    for seed in range(5):
        tf = [Counter(d.tolist()) for d in docs]
        weight = lambda i, t: idf[t] * tf[i][t] * 2.2 / (tf[i][t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))  # noqa: B023, E731
        score = [sum(weight(i, t) for t in tf[seed] if t in tf[i]) for i in range(len(docs))]
        ranked = shard.neighbours(seed)
        assert np.allclose([score[i] for i in ranked], sorted((x for x in score if x > 0), reverse=True))
    shard.free[:39] = False
    assert set(shard.neighbours(0)) <= {39}


def test_shard_of_long_documents():
    """A document of which only the end is left to pack is still ranked by all its terms."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 60, size=rng.integers(5, 90)) for _ in range(30)]
    idf = np.linspace(1, 3, 60)
    plain = packing._Shard(docs, idf, 40.0)
    whole = {k: np.unique(d, return_counts=True) for k, d in enumerate(docs) if len(d) > 32}
    cut = packing._Shard([d[len(d) // 32 * 32 :] if k in whole else d for k, d in enumerate(docs)], idf, 40.0, whole)
    assert len(whole) > 5 and all(plain.neighbours(k).tolist() == cut.neighbours(k).tolist() for k in range(30))
    few = packing._Shard(docs, idf, 40.0, query_terms=1)
    assert set(few.neighbours(3)) < set(plain.neighbours(3))


def test_pack_one_long_text(make_docs, tokenizer):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = packing.pack(make_docs(["a b", long, None]).withColumn("ids", F.lit(1)).withColumn("n", F.lit(2)), shard_docs=2).collect()
    pieces = sorted((r["start"], r["length"], r["offset"], r["ids_crc32"]) for r in rows if r["doc_id"] == 1)
    ids = token_ids(tokenizer, long)
    assert sum(p[1] for p in pieces) == len(ids) and all(p[1:3] == (4096, 0) for p in pieces[: len(ids) // 4096])
    assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, _, c in pieces)


def test_pack_empty_and_repeated(make_docs):
    assert packing.pack(make_docs([])).count() == 0
    rows = packing.pack(make_docs(["a b", "a b", None], ids=[1, 1, None])).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in rows} == {(None, 1), (1, 3)}
    assert sum(r["length"] for r in rows) == 7


# SentencePiece


def test_viterbi_is_best_path_and_equals_library(tmp_path):
    """Against the library itself, told that the model is a unigram model."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        proto.trainer_spec.model_type = 1
        library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    except ImportError:
        pytest.skip("no model description")
    codec = sentencepiece_codec.PieceModel(path)
    texts = ["hello world", "an unlikely sequence of strange words", "émigré naïve 漢字 😀", "x", "tab\tand\nline", "aaaa bbbb"]
    ids, ends = codec.encode(pa.array(texts))
    for t, a, b in zip(texts, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == library.encode(t), t


def test_viterbi_brute_force():
    codec = sentencepiece_codec.PieceModel(sentencepiece_codec.default_model())
    score = {p: v for p, v in ((p, codec.automaton.get(p)[2]) for p in codec.pieces if p in codec.automaton)}

    def best(s):
        table = [0.0] + [None] * len(s)
        for e in range(1, len(s) + 1):
            cands = [table[b] + score[s[b:e]] for b in range(e) if s[b:e] in score] + [table[e - 1] + codec.unknown_score]
            table[e] = max(cands)
        return table[-1]

    for s in ("▁hello", "▁unbelievable", "▁▁▁x", "qzxj", "▁don't", "▁漢字é"):
        ids = codec.viterbi(s)
        total, k = 0.0, 0
        while k < len(ids):
            piece = codec.pieces[ids[k]]
            if ids[k] in codec.byte_ids.values():
                first = codec.as_bytes[ids[k]][0]
                total += codec.unknown_score
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            else:
                total += score[piece]
                k += 1
        assert total == best(s)


def test_sentencepiece_round_trip(make_docs, corpus):
    texts = ODD + ["  lead", "trail  ", "a  b   c", " ", "▁mark"[1:], "a\x00 b"] + corpus
    docs = make_docs(texts)
    rows = {r["doc_id"]: r for r in sentencepiece_codec.round_trip(docs).collect()}
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["exact"] and back[i] == (t or "")
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert sentencepiece_codec.round_trip(make_docs([])).count() == 0


# Quality rules


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(make_docs, corpus):
    texts = corpus + ODD + ["a b a b a b a", "a b c d a b c", "x\nx\n\n\nx\ny", "# | $ <b> & 100%*", "w " * 200, " ".join(f"#w{i} |" for i in range(60))]
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(make_docs([])).count() == 0
    kept = quality_rules.keep_good(make_docs(texts).withColumnRenamed("source", "n_words").withColumnRenamed("lang", "kept"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}
    plan = quality_rules.quality_rules(make_docs(texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Language identification


def test_forward_backward_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    lengths, labels = [5, 3, 1], 3
    emissions, trans = rng.normal(size=(5, 3, labels)), rng.normal(size=(labels, labels))
    got = langid.forward_backward(emissions, np.array([3, 2, 2, 1, 1]), trans)
    for j, n in enumerate(lengths):
        mass = np.zeros((n, labels))
        for path in product(range(labels), repeat=n):
            p = np.exp(sum(emissions[t, j, k] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            mass[np.arange(n), path] += p
        assert np.allclose(got[:n, j], mass / mass.sum(axis=1, keepdims=True))


def test_language_id(spark, make_docs):
    english, french = "the cat and the dog of this house were with that friend", "le chat et les chiens dans cette maison avec des amis pour vous"
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice((english if i % 2 else french).split(), size=30)), "en" if i % 2 else "fr") for i in range(120)]
    rows += [(1000, None, None), (1001, "123 !!", "en"), (1002, "", "fr"), (None, english, None), (1003, english + " " + french + " " + english, None)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in out.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert all(got[i]["held_out"] == held(i) for i in range(120))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[None]["lang_pred"] == "en" and got[1003]["lang_pred"] == "en" and 0.5 < got[1003]["score"] < 0.9
    wrong = sum(r["lang_pred"] != lang for i, _, lang in rows[:120] for r in [got[i]] if r["held_out"])
    assert wrong == 0
    untrained = langid.identify(spark.createDataFrame(rows[:3], "doc_id long, text string, lang string").withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in untrained.collect()} == {"und"}


def test_training_sample_is_bounded_and_whole(spark):
    """Each language has its share, however few or many rows it has, and whether identifiers or rows repeat."""
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(7, f"repeat {i}", "fr") for i in range(300)] + [(9, "copy", "de")] * 500 + [(11, "one", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = docs.where(~langid._held_out("doc_id"))
    got = {k: len(v) for k, v in langid.training_sample(docs, "doc_id", "text", "lang", per_language=50).items()}
    there = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count_distinct("doc_id", "text").alias("n")).collect()}
    assert got == {k: min(50, n) for k, n in there.items()} and got["en"] == 50
    again = langid.training_sample(docs.repartition(7), "doc_id", "text", "lang", per_language=50)
    assert again == langid.training_sample(docs, "doc_id", "text", "lang", per_language=50)


def test_training_follows_the_gradient():
    """One step of the field's log-likelihood against differences of it, by enumerating all label paths."""
    from itertools import product

    rng = np.random.default_rng(5)
    scores, trans = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))

    def mass(s, t):
        return {p: np.exp(sum(s[i, 0, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))) for p in product(range(3), repeat=4)}

    gamma = langid.forward_backward(scores, np.full(4, 1), trans)
    weights = mass(scores, trans)
    total = sum(weights.values())
    for i in range(4):
        for k in range(3):
            assert abs(gamma[i, 0, k] - sum(w for p, w in weights.items() if p[i] == k) / total) < 1e-9
            moved = scores.copy()
            moved[i, 0, k] += 1e-6
            assert abs((np.log(sum(mass(moved, trans).values())) - np.log(total)) / 1e-6 - gamma[i, 0, k]) < 1e-5
    pairs = langid._pair_expectation(np.exp(scores - scores.max(axis=2, keepdims=True)), gamma, np.exp(trans - trans.max()))
    for a, b in product(range(3), repeat=2):
        want = sum(w * sum(x == a and y == b for x, y in zip(p, p[1:])) for p, w in weights.items()) / total
        assert abs(pairs[a, b] - want) < 1e-6


def test_word_features_by_hand():
    """Affixes, n-grams and lexicon entries are features; words that share them share features."""
    lexicon = {"maison": [0], "haus": [1]}
    f = {w: set(langid.word_features(w, lexicon)) for w in ("maison", "maisons", "haus", "hausen", "q")}
    assert len(f["maison"] & f["maisons"]) > len(f["maison"] & f["haus"]) and len(f["haus"] & f["hausen"]) >= 3
    assert f["maison"] - set(langid.word_features("maison", {})) and all(0 <= x < langid.DIMENSIONS for v in f.values() for x in v)


# WARC

PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i % 7}", f"<p>{i % 4}</p>\r\n\r\nWARC/1.1\r\n é") for i in range(20)] + [(30, None, None), (31, "a\nb", ""), (32, "u", "x"), (32, "u", "x"), (None, "n", "x")]
    rows = warc.round_trip(spark.createDataFrame(pages, PAGES).repartition(3)).collect()
    assert len(rows) == len(pages)
    payloads = {p: (h or "").encode() for p, _, h in pages}
    for r in rows:
        body = payloads[r["page_id"]]
        low = min(p for p, b in payloads.items() if p is not None and b == body)
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == low else ("revisit", low))
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_small_payloads_are_responses(spark):
    rows = warc.round_trip(spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long payload"), (4, "d", "long payload")], PAGES), min_revisit_bytes=5).collect()
    assert {r["page_id"]: r["record_type"] for r in rows} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_assemble_links_in_either_direction(spark):
    schema = "type string, record_id string, concurrent_to string, refers_to string, target string, page long, payload_bytes long, payload_digest string"
    rows = [
        ("response", "r1", None, None, "t", None, 1, "d"), ("request", "q1", "r1", None, "t", None, None, None), ("metadata", "m1", "q1", None, "t", 7, None, None),
        ("revisit", "r2", "q2", "r1", "t", None, 1, "d"), ("request", "q2", None, None, "t", None, None, None), ("metadata", "m2", "r2", None, "t", 8, None, None),
        ("request", "q3", None, None, "t", None, None, None), ("request", None, None, None, None, None, None, None),
    ]
    got = {r["transaction"]: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"r1", "q2", "q3"}
    assert got["r1"]["metadata"]["page"] == 7 and got["r1"]["request"]["record_id"] == "q1"
    assert got["q2"]["response"]["type"] == "revisit" and got["q2"]["revisited_page"] == 7 and got["q2"]["metadata"]["page"] == 8
    assert got["q3"]["response"] is None


def test_reader_takes_gzip_members(spark, tmp_path):
    import gzip

    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i, f"HTTP/1.1 200 OK\r\n\r\n{'z' * i}")) for i in range(3)))
    (tmp_path / "b.warc").write_bytes(record(9, "HTTP/1.1 200 OK\r\n\r\nq"))
    rows = warc.read_records(spark, str(tmp_path), with_payload=True).collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in rows) == [("<0>", b""), ("<1>", b"z"), ("<2>", b"zz"), ("<9>", b"q")]


# Sharding


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_kd_shards(make_docs, shards):
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) for n in rng.integers(0, 60, size=1500)] + ["same copy of a text"] * 900
    docs = make_docs(texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise((F.col("doc_id") % 50).cast("string")))
    rows = sharding.kd_shards(docs, shards=shards).collect()
    total = sum(len(t) + 8 for t in texts)
    by = {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(shards)) and len(rows) == len(texts)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 0.02 * total / shards + 70


def brute_tree(rows, dims, shards):
    """Leaves of the k-d tree as sets of identifiers: exact weighted medians along the widest dimension."""
    value = lambda r, d: r[d] >> sharding._TIE_BITS
    width = lambda part, d: max(value(r, d) for r in part) - min(value(r, d) for r in part)
    spread = {d: max(1, width(rows, d)) for d in dims}

    def split(part, k):
        if k == 1 or not part:
            return [frozenset(r["id"] for r in part)]
        dim = max(dims, key=lambda d: (width(part, d) / spread[d], d))
        target, below = sum(r["size"] for r in part) * (k // 2) / k, 0
        for key in sorted({r[dim] for r in part}):
            size = sum(r["size"] for r in part if r[dim] == key)
            if below + size >= target:
                break
            below += size
        last = key - 1 if target - below < below + size - target else key
        return split([r for r in part if r[dim] <= last], k // 2) + split([r for r in part if r[dim] > last], k - k // 2)

    return split(rows, shards)


@pytest.mark.parametrize("shards", [2, 7, 24])
def test_kd_shards_are_the_tree_leaves(make_docs, shards):
    rng = np.random.default_rng(6)
    docs = make_docs(["x" * int(n) for n in rng.integers(0, 400, size=600)]).withColumn("source", (F.col("doc_id") % 9 % 4).cast("string")).withColumn("shard", F.lit(1))
    dims = ["by_size", "by_id", "by_source", "by_lang"]
    rows = sharding._narrow(docs, "doc_id", "text", ("source", "lang")).collect()
    got = {}
    for r in sharding.kd_shards(docs, shards=shards, tolerance=0.0).collect():
        got.setdefault(r["shard"], set()).add(r["doc_id"])
    assert set(map(frozenset, got.values())) == set(brute_tree(rows, dims, shards))


def test_kd_shards_odd_rows(make_docs):
    rows = sharding.kd_shards(make_docs([None, "", "a", "a", "a"], ids=[1, None, 2, 2, 3])).collect()
    assert sorted(r["size"] for r in rows) == [8, 8, 9, 9, 9] and all(0 <= r["shard"] < 24 for r in rows)
    assert sharding.kd_shards(make_docs([])).count() == 0
    grown = sharding.kd_shards(make_docs(["y" * 100] * 50), shards=None, target_bytes=1000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(grown) == 6 and max(r["b"] for r in grown) <= 1000 + 108


# Quality classifier


def test_hierarchical_quality(spark):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice("the of and to in was time people house water".split(), size=80))
    bad = lambda: " ".join(rng.choice("BUY | NOW!! | $$$ CHEAP ### |".split(), size=80))
    docs = [(i, good() if i % 3 else bad(), "en", f"h{i % 5}") for i in range(300)] + [(500, None, None, None), (None, "x", "en", "h0"), (501, good(), "en", "new")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(9999, 1, 0), (3, None, 0)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_bayes.classify(d, y).collect()}
    assert len(rows) == len(docs) and all(rows[i]["kept"] == (i % 3 > 0) for i in range(300)) and rows[501]["kept"]
    known = [(i, k) for i, k, _ in labels if i < 300 and k is not None]
    prior = (sum(k for _, k in known) + 1) / (len(known) + 2)
    assert rows[501]["host_mean"] == rows[501]["path_mean"] == round(prior, 6) and rows[501]["n_host"] == 0
    n = Counter(f"h{i % 5}" for i, _ in known)
    k = Counter(f"h{i % 5}" for i, y in known if y)
    for i in range(5):
        raw, mean = k[f"h{i}"] / n[f"h{i}"], rows[i]["host_mean"]
        assert rows[i]["n_host"] == n[f"h{i}"] and min(raw, prior) - 1e-6 <= mean <= max(raw, prior) + 1e-6
    assert quality_bayes.classify(d.limit(0), y).count() == 0
    assert {r["score"] for r in quality_bayes.classify(d, y.limit(0)).collect()} == {0.5}


def test_held_out_quality(spark):
    """On documents whose labels were kept back, the given tables: better than the more frequent label."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null")
    back = labels.where("pmod(crc32(cast(doc_id as string)), 5) = 0")
    scored = quality_bayes.classify(docs, labels.join(back.select("doc_id"), "doc_id", "left_anti")).join(back, "doc_id")
    got = scored.agg(F.count("*").alias("n"), F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("right"), F.avg("quality").alias("base")).first()
    print(got)
    assert got["n"] > 50 and got["right"] > 0.95 > got["base"]


def test_word_evidence_alone(spark):
    """Documents alike in every ratio, told apart by their words only."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i:03d}" for i in range(400)]
    text = lambda good: " ".join(rng.choice(vocabulary[:250] if good else vocabulary[150:], size=60))
    docs = [(i, text(i % 2), "en", "h") for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    y = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    rows = [r for r in quality_bayes.classify(d.withColumn("buckets", F.lit(1)), y).collect() if r["doc_id"] >= 300]
    assert sum(r["kept"] == (r["doc_id"] % 2 == 1) for r in rows) >= 95


# Pipeline


def test_pipeline(spark, make_docs, corpus, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import brute_substring
    from tests.llm.test_near import brute_survivors

    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(rng.choice([*"the of and to in it was".split() * 6, *(f"word{i}" for i in range(400))], size=n))
    base = [prose(120) for _ in range(8)]
    shared = prose(40)
    texts = base + [base[0], base[1] + " ", base[2] + " tail", f"{prose(60)} {shared} {prose(30)}", f"{prose(70)} {shared}", "short one", "# | " * 100, None] + corpus
    docs = make_docs(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, str(tmp_path))
    kept = sorted(r["doc_id"] for r in good.collect())
    assert {texts.index("short one"), texts.index("# | " * 100)}.isdisjoint(kept) and set(range(8)) <= set(kept)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]) for i in kept}
    exact = [i for i in kept if i == min(j for j in kept if norm[j] == norm[i])]
    near = [exact[k] for k in sorted(brute_survivors([texts[i] for i in exact])[1])]
    want = brute_substring([texts[i] for i in near])
    current = good
    for name in ("exact_dedup", "simhash_near_dedup", "substring_dedup"):
        current = stages[name](spark, current, str(tmp_path))
        assert current.columns == docs.columns
    out = {r["doc_id"]: r["text"] for r in current.collect()}
    assert sorted(out) == near
    assert {i: WORD.findall(t) for i, t in out.items()} == {i: want[k] for k, i in enumerate(near)}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert sorted(r["doc_id"] for r in pieces) == near and all(r["n"] == r["m"] for r in pieces)
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["quality_rules", "exact_dedup", "simhash_near_dedup", "substring_dedup", "packing"]'
