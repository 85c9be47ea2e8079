"""Exact, near and substring deduplication against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import components, exact_dedup, simhash, substring
from tilewright.llm.common import WindowHasher, Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, distance=3):
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in points:
        for b in points:
            if bin(a ^ b).count("1") <= distance:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in points}


def brute_substring(texts, window=20):
    first, covered = {}, {}
    for d, text in enumerate(texts):
        w = words(text)
        covered[d] = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in first:
                covered[d][i : i + window] = [True] * window
            else:
                first[key] = (d, i)
    return {d: [x for x, gone in zip(words(t), covered[d]) if not gone] for d, t in enumerate(texts)}


def test_words_and_window_hashes():
    texts = ["", "a  b", " x", None, "y ", "é\tz"]
    w = Words(pa.array(texts))
    assert [w.joined(d).decode() for d in range(6)] == ["", "a b", "x", "", "y", "é z"]
    same = Words(pa.array(["q a b c r", "a\n b c"]))
    h = WindowHasher(same)
    single = h(1, np.arange(8))
    assert single[1] == single[5] and len(set(single.tolist())) == 5
    assert h(3, np.array([1]))[0] == h(3, np.array([5]))[0] != h(3, np.array([0]))[0]
    sizes = Words(pa.array([" ".join("abcdefgh"[:n] * k for n in range(1, 9) for k in (1, 2, 3, 9)), "abcdefgh" * 2 + "i"]))
    got = {}
    for k, v in enumerate(WindowHasher(sizes)(1, np.arange(len(sizes.start))).tolist()):
        got.setdefault(v, set()).add(sizes.canon[sizes.start[k] : sizes.end[k]].tobytes())
    assert all(len(w) == 1 for w in got.values())


def test_exact_dedup(make_docs, corpus):
    out = {r["doc_id"]: r for r in exact_dedup.exact_dedup(make_docs(corpus)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in corpus]
    for i, n in enumerate(norm):
        low = norm.index(n)
        assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (low, norm.count(n), i == low)
        assert out[i]["text_sha256"] == hashlib.sha256(n.encode()).hexdigest()


def test_exact_dedup_odd_rows(spark, make_docs):
    docs = make_docs(["a", "a", "a", "b", "a", None], ids=[None, 5, 5, None, 7, 9])
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r["keep_id"] if r["keep_id"] is not None else -1, r["group_size"]) for r in rows) == [(-1, 1), (5, 4), (5, 4), (5, 4), (5, 4), (9, 1)]
    assert sum(r["kept"] for r in rows if r["doc_id"] == 5) == 1
    kept = exact_dedup.drop_copies(docs.withColumn("sha", F.lit(1)).withColumn("ord", F.lit(2))).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept if r["text"]) == [(-1, "b"), (5, "a")]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_tree_merge_keeps_rounds_exact(spark, make_docs):
    docs = make_docs([f"t{i % 37}" for i in range(400)]).repartition(16)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == 400 and sum(r["kept"] for r in rows) == 37
    assert all(r["keep_id"] == r["doc_id"] % 37 for r in rows)


def test_fingerprints(corpus):
    got = simhash.simhash_batch(pa.array(corpus, type=pa.string())).view(np.uint64)
    assert [int(x) for x in got] == [fingerprint(t) for t in corpus]


def test_near_duplicates(make_docs, corpus):
    points = [fingerprint(t) for t in corpus]
    label = brute_components(sorted(set(points)))
    lowest = {}
    for i, p in enumerate(points):
        lowest.setdefault(label[p], i)
    out = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs(corpus)).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == {i: lowest[label[p]] for i, p in enumerate(points)}
    assert all(out[i]["fingerprint"] == f"{p:016x}" for i, p in enumerate(points))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(make_docs(corpus)).collect()}
    assert kept == set(lowest.values())


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("limit", [1, 10_000])
def test_links_in_crowded_buckets(spark, distance, limit):
    """Dense clusters: the star links of crowded buckets connect what all pairs do."""
    rng = np.random.default_rng(distance)
    points = set()
    for centre in rng.integers(0, 1 << 63, size=6, dtype=np.uint64).tolist():
        for _ in range(25):
            p = centre
            for b in rng.integers(0, 64, size=rng.integers(0, 6)):
                p ^= 1 << int(b)
            points.add(p)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in points]
    edges = simhash.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance, limit)
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    want = brute_components(sorted(points), distance)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    mine = {p: got.get(s, s) % (1 << 64) for p, s in zip(points, signed)}
    assert groups(mine) == groups(want)


def test_near_duplicates_odd_rows(make_docs):
    rows = simhash.near_duplicates(make_docs(["", None, "a b c d", "a b c d", "q"], ids=[4, None, 9, 9, None])).collect()
    by = [(r["doc_id"] or -1, r["component_id"]) for r in rows]
    assert by.count((9, 9)) == 2 and (4, 4) in by and {c for i, c in by if i == -1} == {4, None}
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_cover():
    for v, residues in substring.COVERS.items():
        assert all(any((p + s) % v in residues and (q + s) % v in residues for s in range(v)) for p in range(v) for q in range(v))


@pytest.mark.parametrize("window", [1, 8, 20])
def test_substring_dedup(make_docs, corpus, window):
    want = brute_substring(corpus, window)
    out = substring.substring_dedup(make_docs(corpus), window=window, with_text=True).collect()
    assert len(out) == len(corpus)
    for r in out:
        kept = want[r["doc_id"]]
        assert r["n_words"] == len(words(corpus[r["doc_id"]])) and r["n_removed"] == r["n_words"] - len(kept)
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert words(r["kept_text"]) == kept


def test_substring_across_batches(spark, make_docs, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        want = brute_substring(corpus)
        out = substring.substring_dedup(make_docs(corpus).repartition(5)).collect()
        assert {r["doc_id"]: r["n_words"] - r["n_removed"] for r in out} == {d: len(k) for d, k in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_odd_rows(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = substring.substring_dedup(make_docs([text, text, text, None], ids=[3, 3, None, 1])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 30), (1, 0), (3, 0), (3, 0)]
    cut = substring.cut_repeats(make_docs([text, "x " + text, None]).withColumnRenamed("source", "kept_text")).orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"], r["kept_text"]) for r in cut] == [(text, len(text), "s"), ("x", 1, "s"), (None, None, "s")]
    assert substring.substring_dedup(make_docs([])).count() == 0


def test_substring_compares_words(make_docs):
    """Words that collide under any polynomial hash modulo a power of two stay apart."""
    thue_morse = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    tail = " ".join(f"w{i}" for i in range(19))
    texts = [f"{thue_morse} {tail}", f"{thue_morse.translate(str.maketrans('ab', 'ba'))} {tail}"]
    assert [r["n_removed"] for r in substring.substring_dedup(make_docs(texts)).collect()] == [0, 0]


def test_substring_many_null_identifiers(make_docs):
    """Rows without an identifier are as many keys as texts: nothing is gathered for all of them together."""
    texts = [" ".join(f"w{d}x{i}" for i in range(200)) + f" last{k}" for d in range(2000) for k in range(2)]
    rows = substring.substring_dedup(make_docs(texts, ids=[None] * len(texts))).collect()
    # of each two, the one with the smaller text hash keeps its words, the other loses all but its last
    assert sorted(r["n_removed"] for r in rows) == [0] * 2000 + [200] * 2000


def test_substring_one_long_text(make_docs):
    long = " ".join(f"w{i % 70000}" for i in range(200_000))
    rows = substring.substring_dedup(make_docs(["short", long, "before " + long])).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in rows] == [0, 130_000, 200_000]
