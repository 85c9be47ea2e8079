"""Every operator on columns with clashing names, on a long text, and on nothing."""

import pytest
from pyspark.sql import functions as F

from tilewright.llm import exact_dedup, fill_middle, langid, near, packing, periodic, quality_bayes, quality_rules, sentencepiece_codec, sharding, simhash, substring, warc

#: Names that operators use inside.
TAKEN = (
    "id ord th h key node n own weak component size line digest sha n_bytes norm keep_id kept fp fingerprint copy runs hs ids sig df words lines text_sha256 n_words base_failed held_out lang_pred score "
    "page payload first low capture shard slot block crc by_size m_source host path buckets evidence y k length start end_ canon value place"
).split()


def documents(make_docs):
    prose = " ".join("the house of words and the river in a town".split() * 9)
    return make_docs([prose, prose + " end", prose.upper(), "", None, "one two", prose, " ".join(f"w{i}" for i in range(90))], ids=[1, 2, 3, 4, 5, 6, 7, None])


OPERATORS = {
    "op1": lambda d: packing.pack(d, window=64, shard_docs=3),
    "op2": simhash.near_duplicates,
    "op3": exact_dedup.exact_dedup,
    "op4": sentencepiece_codec.round_trip,
    "op5": lambda d: quality_rules.quality_rules(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "op6": langid.identify,
    "op7": lambda d: warc.round_trip(d.withColumn("url", F.lit("http://h/x")), "doc_id", "url", "text"),
    "op8": substring.substring_dedup,
    "op9": sharding.kd_shards,
    "op10": lambda d: quality_bayes.classify(d, d.sparkSession.range(1, 5).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))),
    "op11": lambda d: periodic.periodic_runs(d).select("doc_id", "n_words", F.col("runs").cast("string"), "collapsed"),
    "op13": lambda d: fill_middle.fill_in_middle(d, rate=100),
    "near": lambda d: near.drop_similar(d).select("doc_id", "text"),
    "copies": lambda d: exact_dedup.drop_copies(d).select("doc_id", "text"),
    "repeats": lambda d: substring.cut_repeats(d).select("doc_id", "text"),
    "good": lambda d: quality_rules.keep_good(d).select("doc_id", "text"),
}
CONTENT = {"op1": 7, "near": None, "copies": None, "repeats": 8, "good": None}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(make_docs, name):
    docs = documents(make_docs)
    clash = docs.withColumns({c: F.lit(-1) for c in TAKEN if c not in docs.columns})
    run = OPERATORS[name]
    if name == "op6":  # one training run is enough
        model = langid.train({"en": ["the house of words and the river"], "fr": ["la maison des mots et la rivière"]})
        run = lambda d: langid.identify(d, model=model)
    want = rows(run(docs))
    assert rows(run(clash)) == want and (len(want) == 8 or name in CONTENT)
    assert run(docs.limit(0)).count() == 0


def test_one_long_text_through_all(spark, make_docs):
    """A text of two megabytes beside short ones: whole, and counted whole."""
    n = 300_000
    long = " ".join(f"w{i % 40_011}" for i in range(n))
    docs = make_docs(["a short text of some words", long, long + " more", None])
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}[2] == 1
    assert {r["doc_id"] for r in near.drop_similar(docs).collect()} == {0, 1, 3}
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.quality_rules(docs).collect()} == {0: 6, 1: n, 2: n + 1, 3: 0}
    model = langid.train({"en": ["the house of words and the river"], "fr": ["la maison des mots et la rivière"]})
    assert all(0 <= r["score"] <= 1 for r in langid.identify(docs, model=model).collect())
    assert all(r["exact"] for r in sentencepiece_codec.round_trip(docs.where("doc_id != 2")).collect())
    assert {r["doc_id"]: r["payload_bytes"] for r in warc.round_trip(docs.withColumn("url", F.lit("u")), "doc_id", "url", "text").collect()}[1] == len(long)
    assert {r["doc_id"]: r["size"] for r in sharding.kd_shards(docs).collect()}[1] == len(long) + 8
    assert {r["doc_id"]: r["n_words"] for r in periodic.periodic_runs(docs).collect()} == {0: 6, 1: n, 2: n + 1, 3: 0}
    assert {r["doc_id"]: r["n"] for r in fill_middle.fill_in_middle(docs).collect()} == {0: 6, 1: n, 2: n + 1, 3: 0}
    assert quality_bayes.classify(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).count() == 4
    assert [r["n_removed"] for r in substring.substring_dedup(docs.where("doc_id < 2")).orderBy("doc_id").collect()] == [0, n - 40_011]
