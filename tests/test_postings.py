"""The stored inverted index against the scan of all documents."""

import random

import pytest
from pyspark.sql import functions as F

from searchloom.operators import ranking as R
from searchloom.operators.postings import PostingIndex
from searchloom.plans.fixtures import fx
from searchloom.session import scratch

SCHEMA = "doc_id string, title string, text string"


def rows(df):
    return sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 7)) for r in df.collect())


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 8))) for _ in range(500)]
    docs = [(f"d{i:04d}", rng.choice((None, "a title")), " ".join(rng.choice(own) for _ in range(rng.choice((0, 3, 10, 40, 400))))) for i in range(900)]
    return rng, own, [*docs, ("none", None, None)]


@pytest.mark.parametrize("size, k", [(1024, 10), (64, 3), (7, 50)])
def test_equal_to_the_scan(spark, words, size, k):
    rng, own, docs = words
    corpus = spark.createDataFrame(docs, SCHEMA)
    queries = [(i, " ".join(rng.choice(own) for _ in range(rng.choice((1, 2, 5))))) for i in range(30)] + [(99, ""), (98, "no 쿼리"), (97, None)]
    queries = spark.createDataFrame(queries, "query_id bigint, text string")
    index = PostingIndex.write(corpus, scratch(spark, "postings"), size=size)
    want = rows(R.bm25_top_k(queries, corpus, k))
    assert rows(index.search(queries, k)) == want and want
    stats = lambda df: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in df.collect())
    assert stats(index.statistics()) == stats(R.bm25_statistics(corpus)[0])


def test_given_documents(spark):
    d = "/root/testdata/sf0.001"
    queries, corpus = fx(spark, d, "fx_queries"), fx(spark, d, "fx_corpus")
    index = PostingIndex.write(corpus, scratch(spark, "postings"), size=20)
    assert rows(index.search(queries, 10)) == rows(R.bm25_top_k(queries, corpus, 10))


def test_fewer_terms_read_less_and_low_ranges_are_left_out(spark, words):
    from .test_vectors import scanned_bytes

    _, _, docs = words
    index = PostingIndex.write(spark.createDataFrame(docs, SCHEMA), scratch(spark, "pages"), size=50)
    asked = lambda text: spark.createDataFrame([(1, text)], "query_id bigint, text string")
    weights = [index.weights(asked(t)) for t in ("ab", "ab cd ef", " ".join(w for *_, t in docs[:40] for w in t.split()))]
    read = [scanned_bytes(index._blocks(w)) for w in weights]
    print(read)
    assert 0 < read[0] < read[1] < read[2] and read[0] < read[2] / 10
    # one short document has the rare word: ranges of long documents cannot reach the floor
    rare = [*docs, *[(f"r{i}", None, "zqxj") for i in range(3)], ("long", None, "zqxj " + docs[4][2] * 30)]
    index = PostingIndex.write(spark.createDataFrame(rare, SCHEMA), scratch(spark, "postings"), size=50)
    found, bounds = index.search(asked("zqxj"), 2, first=1), []
    for r in index.table("blocks").join(index.weights(asked("zqxj")), "term").groupBy("range").agg(F.sum(F.col("weight") * F.col("most")).alias("b")).collect():
        bounds.append(r["b"])
    best = found.collect()
    assert [r["doc_id"] for r in sorted(best, key=lambda r: r["rank"])] == ["r0", "r1"]
    assert sum(b >= best[-1]["score"] for b in bounds) < len(bounds) / 2


def test_empty(spark):
    index = PostingIndex.write(spark.createDataFrame([], SCHEMA), scratch(spark, "postings"))
    assert index.search(spark.createDataFrame([(1, "ab")], "query_id bigint, text string"), 5).collect() == []
