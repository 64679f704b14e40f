"""Metrics, rankings and statistics on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from searchloom.functions import text as T
from searchloom.operators import metrics as M
from searchloom.operators import ranking as R


def ranking(spark, rows):
    return spark.createDataFrame([(q, d, i + 1) for q, ds in rows.items() for i, d in enumerate(ds)], "query_id string, doc_id string, rank int")


def qrels(spark, rows):
    return spark.createDataFrame([(q, d, float(g)) for q, ds in rows.items() for d, g in ds.items()], "query_id string, doc_id string, gain double")


def table(df):
    return {(r["query_id"], r["metric"]): r["value"] for r in df.collect()}


def test_per_query(spark):
    runs = ranking(spark, {"q1": ["a", "b", "c", "d"], "q2": ["x", "a"], "q3": ["a"]})
    judged = qrels(spark, {"q1": {"a": 1, "d": 1}, "q2": {"a": 1}, "q4": {"a": 1}})
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "query_id string")
    got = table(M.per_query(runs, judged, queries, cutoffs=(2, 10)))
    assert got["q1", "recall@2"] == 0.5 and got["q1", "mrr@10"] == 1.0
    assert got["q2", "ndcg@10"] == pytest.approx(1 / math.log2(3))
    assert ("q3", "mrr@10") not in got  # no judgments
    assert got["q4", "recall@10"] == got["q4", "ndcg@10"] == 0.0  # judged, nothing found


def test_graded_and_deep(spark):
    runs = ranking(spark, {"q": [f"d{i}" for i in range(60)]})
    got = table(M.per_query(runs, qrels(spark, {"q": {"d40": 1}}), cutoffs=(10, 50)))
    assert got["q", "recall@10"] == 0 and got["q", "recall@50"] == 1
    got = table(M.per_query(ranking(spark, {"q": ["b", "a"]}), qrels(spark, {"q": {"a": 3, "b": 1}})))
    ideal = 3 + 1 / math.log2(3)
    assert got["q", "ndcg@10"] == pytest.approx((1 + 3 / math.log2(3)) / ideal)


def test_slices(spark):
    scores = spark.createDataFrame([("a", "m", 0.9), ("b", "m", 1.0), ("c", "m", 0.1), ("d", "m", 0.5)], "query_id string, metric string, value double")
    tags = spark.createDataFrame([("a", "standard"), ("b", "standard"), ("c", "jargon"), ("d", None)], "query_id string, slice string")
    got = {r["slice"]: (round(r["mean"], 6), r["n"]) for r in M.means_with_slices(scores, tags).collect()}
    assert got == {None: (0.625, 4), "standard": (0.95, 2), "jargon": (0.1, 1)}
    one = M.means_with_slices(scores, tags.filter("slice <> 'jargon'")).collect()
    assert [r["slice"] for r in one] == [None]


def test_bootstrap(spark):
    scores = spark.createDataFrame([(f"q{i}", "m", float(i % 2)) for i in range(40)], "query_id string, metric string, value double")
    one, two = M.bootstrap(scores, 200).first(), M.bootstrap(scores, 200).first()
    assert 0 < one["lo"] <= 0.5 <= one["hi"] < 1 and one == two
    assert M.bootstrap(scores.limit(0), 50).count() == 0


def deltas(spark, values):
    return spark.createDataFrame([(f"q{i}", "m", 0.0, v, v) for i, v in enumerate(values)], "query_id string, metric string, a double, b double, delta double")


def test_permutation(spark):
    p = lambda values: M.permutation_test(deltas(spark, values), 500).first()["p"]
    assert p([0.0, 0.0]) == 1.0
    assert p([0.1] * 20) < 0.01
    assert p([0.1, -0.1] * 10) > 0.5
    assert M.permutation_test(deltas(spark, [1.0]).limit(0), 10).count() == 0


def test_comparison(spark):
    score = lambda v: spark.createDataFrame([(f"q{i}", "m", x) for i, x in enumerate(v)], "query_id string, metric string, value double")
    r = M.comparison(score([0.1, 0.2, 0.9, 0.5]), score([0.5, 0.6, 0.1, 0.5]), 100).first()
    assert (r["wins"], r["losses"], r["ties"], r["n"]) == (2, 1, 1, 4)


def test_union(spark):
    a, b = ranking(spark, {"q": ["x", "r1"]}), ranking(spark, {"q": ["r2", "r1"]})
    r = M.complementarity(a, b, qrels(spark, {"q": {"r1": 1, "r2": 1, "r3": 1}}), 10).first()
    assert [round(r[c], 4) for c in ("recall_a", "recall_b", "recall_union", "marginal_b")] == [0.3333, 0.6667, 0.6667, 0.3333]


def test_fusion(spark):
    a, b = ranking(spark, {"q": ["x", "y", "z"]}), ranking(spark, {"q": ["y", "w"], "p": ["v"]})
    got = R.rrf([(a, 1.0), (b, 1.0)], k=1).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got][:2] == [("p", "v"), ("q", "y")]
    alone = R.rrf([(a, 1.0), (b, 0.0)]).orderBy("rank").collect()
    assert [r["doc_id"] for r in alone] == ["x", "y", "z"]
    assert R.rrf([(a, 1.0), (b, 1.0)], depth=1).count() == 2


def test_bigrams_and_bm25(spark):
    one = spark.sql("SELECT 'VPN 설치' AS t UNION ALL SELECT 'a'").select("t", T.bigrams(F.col("t")).alias("b"))
    assert {r["t"]: r["b"] for r in one.collect()} == {"VPN 설치": ["vp", "pn", "설치"], "a": ["a"]}
    corpus = spark.createDataFrame([("d1", None, "VPN 설치 안내"), ("d2", None, "식당 메뉴"), ("d3", None, "휴가 신청")], "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q1", "VPN 설치"), ("q2", "zzz")], "query_id string, text string")
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in R.bm25_top_k(queries, corpus, 5).collect()] == [("q1", "d1", 1)]


def test_dense(spark):
    corpus = spark.createDataFrame([("a", [10.0, 1.0]), ("b", [0.1, 0.0]), ("c", [0.0, 1.0])], "doc_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    found = R.dense_top_k(queries, corpus, 2)
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == ["b", "a"]  # direction, not length
    assert R.dense_top_k(queries, corpus, 50).count() == 3
    plan = found._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    pairs = spark.createDataFrame([("q", "a")], "query_id string, doc_id string")
    assert R.own_rank(pairs, queries, corpus).first()["own_rank"] == 2


def test_profiles(spark):
    rows = spark.createDataFrame([("x/Nemotron-qwen", "", None, None), ("m", None, None, "Qwen3"), ("m", "plain", None, None), ("m", "", None, None)], "model string, override string, recorded string, base_model string")
    got = [(r["profile"], r["guessed"]) for r in T.resolved_profiles(rows).collect()]
    assert got == [("nemotron3", False), ("qwen3", False), ("plain", False), ("qwen3", True)]
    with pytest.raises(Exception, match="unknown profile"):
        T.resolved_profiles(rows.withColumn("override", F.lit("nope"))).collect()
    text = T.with_templates(spark.createDataFrame([("qwen3", "{query} {x}")], "profile string, q string"))
    assert text.select(T.formatted_query(F.col("q"), F.lit("Do {query}"))).first()[0] == "Instruct: Do {query}\nQuery: {query} {x}"


def test_ids(spark):
    import uuid

    row = spark.sql("SELECT 'https://a/b?c=1' AS u").select(T.uuid5(F.col("u")), T.slug(F.lit("--")), T.slug(F.lit("A/b 1")), T.topic(F.lit("q-3-1")), T.topic(F.lit("q-3")))
    assert list(row.first()) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a/b?c=1")), "model", "a-b-1", "3", None]


def test_forward_index_has_the_terms_of_bigrams(spark):
    from searchloom.functions.text import bigrams

    texts = ["VPN 설치 a", "", None, "x", "ab1-한 é한국Z", "aaa  aa\U0001f600b", "İß 9", "a" * 50_000]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").selectExpr("*", "CASE WHEN doc_id = 3 THEN 'T2' END AS title")
    want = {}
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    for r in corpus.select("doc_id", bigrams(whole).alias("terms")).collect():
        want[r["doc_id"]] = (len(r["terms"]), {t: r["terms"].count(t) for t in set(r["terms"])})
    got = {r["doc_id"]: (r["doc_len"], dict(zip(r["terms"], r["tfs"], strict=True))) for r in R.forward_index(corpus).collect()}
    assert got == want
