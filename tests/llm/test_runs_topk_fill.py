"""Periodic runs, exact top-k and fill-in-the-middle against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilewright.llm import fill_middle, periodic, queries, topk
from tilewright.llm.common import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# Periodic runs


def slow_runs(words):
    """Every lag over the whole text; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def own_runs(texts):
    words = Words(pa.array(texts, type=pa.string()))
    rows = periodic.find_runs(periodic.word_codes(words), words.first)
    return [[tuple(r[1:]) for r in rows.tolist() if r[0] == d] for d in range(len(texts))]


def periodic_texts(rng, n):
    """Words of small vocabularies with planted runs, nested ones and ones that overlap."""
    out = []
    for _ in range(n):
        letters = [chr(97 + k) for k in range(rng.choice([1, 2, 3, 5, 26]))]
        words = []
        while len(words) < rng.choice([0, 5, 30, 80, 200]):
            kind = rng.random()
            if kind < 0.4:
                words += [rng.choice(letters) for _ in range(rng.randint(1, 20))]
            else:
                part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
                if kind > 0.8:  # a period that is itself repetitive
                    part = part * 4 + [rng.choice(letters)]
                times = rng.randint(2, 7)
                words += (part * times)[: len(part) * times - rng.randint(0, len(part) - 1)]
        out.append(" ".join(words))
    return out


def test_runs_equal_brute_force():
    rng = random.Random(11)
    texts = periodic_texts(rng, 1500)
    for a in range(0, len(texts), 100):  # many texts in one scan
        for text, own in zip(texts[a : a + 100], own_runs(texts[a : a + 100])):
            assert own == slow_runs(text.split()), text
    assert own_runs(["", None, "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b"]) == [[], [], [], [], [(0, 6, 1)], [], [(0, 8, 2)]]


def test_runs_in_small_blocks_of_lags(monkeypatch):
    monkeypatch.setattr(periodic, "PROBES", 50)
    for text in periodic_texts(random.Random(12), 200):
        assert own_runs([text])[0] == slow_runs(text.split()), text


def test_splitting_keeps_what_can_be_in_runs():
    words = Words(pa.array(["x a b a b a b a b y a z"]))
    codes = periodic.word_codes(words)
    (at, segment), = periodic.surviving_segments(codes, np.zeros(len(codes), dtype=np.int64))
    assert at.tolist() == list(range(1, 9)) and set(segment.tolist()) == {0}


def test_long_texts_of_few_words():
    """A text of one word, and one without a run, both long: no lag is compared with all words."""
    rng = random.Random(13)
    n = 200_000
    assert own_runs(["a " * n]) == [[(0, n, 1)]]
    loose = [rng.choice(["of", "the", "and", "in", "to"]) for _ in range(n)]
    at = n // 2
    loose[at : at + 40_000] = loose[at : at + 10_000] * 4
    runs = own_runs([" ".join(loose)])[0]
    assert any(q == 10_000 and start <= at and start + length >= at + 40_000 for start, length, q in runs)


def slow_op11(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * longest[1] // longest[2] if runs else None
    return (doc_id, len(runs), *longest, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_on_documents(spark, make_docs, corpus, tmp_path):
    texts = corpus + periodic_texts(random.Random(14), 300) + ["é é é é é é é é é é é é é", "a\ta\na\x0ba\x0ca\ra"]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == sorted(slow_op11(i, t) for i, t in enumerate(texts))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 20


def test_collapsed_texts(make_docs):
    rows = periodic.periodic_runs(make_docs(["go on and on and on and on and on then stop", "la la la la la la", None, " "], ids=[5, 5, None, 7])).collect()
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows] == [
        (5, 12, [(1, 9, 2)], "go on and then stop"), (5, 6, [(0, 6, 1)], "la"), (None, 0, [], ""), (7, 0, [], "")
    ]


# Exact top-k

VECTORS = "vec_id long, embedding array<float>, label int"


def slow_top(rows, k, is_query):
    fits = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if fits(v)]
    out = []
    for own, q in usable:
        if is_query(own):
            scored = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != own and len(v) == len(q)]
            out += [(own, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    few = lambda: [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) for _ in range(6)]  # noqa: E731  many ties
    smooth = lambda: [rng.gauss(0, 1) / (1 + k) for k in range(6)]
    rows = [(i, few() if i % 2 else smooth(), 0) for i in range(700)]
    rows += [(1000 + i, [1.0] * 6, 0) for i in range(90)] + [(1100, [0.0] * 6, 0), (1200, None, 0), (1300, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1400, [float("nan")] * 6, 0), (1500, [float("inf")] + [0.0] * 5, 0)]
    rows += [(1600, [1.0, 2.0], 0), (1601, [3.0, -1.0], 0), (1700, [], 0), (1800, [1.0, 2.0, 3.0], 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    for block in (7, 64, topk.BLOCK):
        found = topk.top_k(df, df.where("vec_id % 100 = 0"), block=block)
        assert sorted(map(tuple, found.collect())) == slow_top(rows, 10, lambda i: i % 100 == 0)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_top_k_many_batches(spark, monkeypatch):
    monkeypatch.setattr(topk, "BATCHES", 1)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], 0) for i in range(120)]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted(map(tuple, topk.top_k(df, df, k=3, block=50).collect())) == slow_top(rows, 3, lambda i: True)


def test_top_k_edges(spark):
    rows = [(None, [2.0, 0.0], 0), (0, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (7, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("id", "v", "block", "score", "rank", "copy")})
    found = topk.top_k(df, df.where("vec_id = 0"), k=9)
    assert [tuple(r)[2:] for r in found.orderBy("rank").collect()] == [(7, 2 * 1024 * 1024), (None, 2 * 1024 * 1024), (5, 1024 * 1024), (5, 1024 * 1024)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df, df.where("vec_id = 5")).count() == 3  # equal query rows are one


def test_bound_stops_before_all_rows():
    """Where a few dimensions hold most of a vector, most rows are never scored."""
    rng = np.random.default_rng(5)
    data = np.floor(1024 * rng.normal(size=(4000, 16)) * 0.5 ** np.arange(16)).astype(np.int64)
    lists = topk.SortedLists(np.arange(4000), data)
    for q in range(20):
        ids, scores = lists.top(data[q], 10, q)
        every = data @ data[q]
        every[q] = -(1 << 62)
        want = np.lexsort((np.arange(4000), -every))[:10]
        assert ids.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    assert lists.scored < 0.5 * 20 * 4000


# Fill-in-the-middle


def slow_fill(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def odd_texts(rng, n):
    parts = ["a", "word", "é", "漢字", "😀", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "<", "<P", ">", "S>", "<M>", "é", "x\x00y", "\\E", "|"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_fill_in_middle(make_docs, corpus):
    texts = corpus + odd_texts(random.Random(6), 600) + [" \n", "a", " a", "a ", "<P>", "one <S> two"]
    docs = make_docs(texts).withColumns({c: F.lit(1) for c in ("id", "n", "form", "output", "digest", "one")})
    made = fill_middle.fill_in_middle(docs)
    rows = made.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert sorted(tuple(r)[:6] for r in rows) == sorted(slow_fill(i, t) for i, t in enumerate(texts))
    assert all(r["back"] == (texts[r["doc_id"]] or "") for r in rows)
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_of_nulls_repeats_and_one_long_text(make_docs):
    long = "слово " * 300_000
    docs = make_docs([long, "a b c", "a b c", None, "x y z"], ids=[1, 8, 8, 9, None])
    made = fill_middle.fill_in_middle(docs, rate=100).collect()
    assert len(made) == 5
    by_id = {r["doc_id"]: r for r in made}
    assert by_id[1]["n"] == 300_001 and len(by_id[1]["output"]) == len(long) + 9 and by_id[9]["form"] == "plain" and by_id[None]["form"] != "plain"
    assert len({tuple(r) for r in made if r["doc_id"] == 8}) == 1


def test_ranks_equal_counts():
    rng = np.random.default_rng(7)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size=n).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols, 3)
        at = np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]
