"""Registered queries: text, ranking, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.draws import draw_sql
from ..operators import metrics as M
from ..operators import ranking as R
from .base import query, rounded
from .fixtures import fx, oracle
from .indexes import posting_index

TOKENS = """list_transform(regexp_extract_all(lower({}), '[0-9a-z가-힣]+'), lambda r: CASE WHEN length(r) < 2 THEN [r]
 ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)"""

POSTINGS = f"""
doc_terms AS (SELECT doc_id, flatten({TOKENS.format("concat(coalesce(title, ''), ' ', text)")}) AS terms FROM fx_corpus),
lens AS (SELECT doc_id, len(terms) AS doc_len FROM doc_terms),
totals AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM postings CROSS JOIN totals GROUP BY term)"""

BM25 = POSTINGS + f""",
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(flatten({TOKENS.format("text")})) AS term FROM fx_queries) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score
 FROM asked JOIN postings USING (term) JOIN idf USING (term) JOIN lens USING (doc_id) CROSS JOIN totals GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 10)"""


def dense_sql(name: str, dim: int, k: int = 50) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT q.query_id, d.doc_id, list_cosine_similarity(q.embedding[1:{dim}]::DOUBLE[], d.embedding[1:{dim}]::DOUBLE[]) AS score
 FROM fx_vec_queries q CROSS JOIN fx_vec_corpus d) QUALIFY rank <= {k})"""


def metrics_sql(name: str, ranking: str, qrels: str, asked: str, by: str = "") -> str:
    """The per-query metric table of ``ranking``, as CTEs; ``by`` is another key of it."""
    also = f"{by}, " if by else ""
    on = f"a.{by} = h.{by} AND a.query_id = h.query_id" if by else "a.query_id = h.query_id"
    recalls = " UNION ALL ".join(
        f"SELECT {also}query_id, 'recall@{c}' AS metric, coalesce(hits_{c} / relevant, 0) AS value FROM {name}_whole" for c in M.CUTOFFS
    )
    a_also = f"a.{by}, " if by else ""
    return f"""{name}_ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN place <= 10 THEN gain / log2(place + 1) END) AS ideal
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS place FROM {qrels}) GROUP BY query_id),
{name}_hits AS (SELECT {also}query_id, {", ".join(f"count(*) FILTER (rank <= {c}) AS hits_{c}" for c in M.CUTOFFS)},
 min(rank) FILTER (rank <= 10) AS first, sum(gain / log2(rank + 1)) FILTER (rank <= 10) AS dcg
 FROM {ranking} JOIN {qrels} USING (query_id, doc_id) GROUP BY {also}query_id),
{name}_whole AS (SELECT {a_also}a.query_id, i.relevant, i.ideal, h.* EXCLUDE ({also}query_id) FROM (SELECT DISTINCT {also}query_id FROM {asked}) a
 JOIN {name}_ideal i ON a.query_id = i.query_id LEFT JOIN {name}_hits h ON {on}),
{name} AS ({recalls} UNION ALL SELECT {also}query_id, 'mrr@10', coalesce(1 / first, 0) FROM {name}_whole
 UNION ALL SELECT {also}query_id, 'ndcg@10', coalesce(dcg / nullif(ideal, 0), 0) FROM {name}_whole)"""


VEC = "fx_vec_queries fx_vec_corpus fx_vec_qrels"
RUN_A, RUN_B = dense_sql("run_a", 64), dense_sql("run_b", 16)
SCORES = f"{RUN_A}, {RUN_B}, {metrics_sql('a', 'run_a', 'fx_vec_qrels', 'run_a')}, {metrics_sql('b', 'run_b', 'fx_vec_qrels', 'run_b')}"


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fx(spark, d, "fx_vec_queries"), fx(spark, d, "fx_vec_corpus"), fx(spark, d, "fx_vec_qrels")


def dense(spark: SparkSession, d: str, dim: int, k: int = 50) -> DataFrame:
    q, c, _ = vectors(spark, d)
    cut = lambda x: x.withColumn("embedding", T.truncated(F.col("embedding"), dim))
    return R.dense_top_k(cut(q), cut(c), k)


def two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rankings at 64 and at 16 dimensions and their per-query scores."""
    qrels = fx(spark, d, "fx_vec_qrels")
    a, b = dense(spark, d, 64), dense(spark, d, 16)
    return a, b, M.per_query(a, qrels), M.per_query(b, qrels)


@query(
    "bigram_tokens",
    oracle("fx_corpus", f"t AS (SELECT doc_id, flatten({TOKENS.format('text')}) AS terms FROM fx_corpus) "
    "SELECT doc_id, len(terms) AS n_terms, md5(array_to_string(terms, ' ')) AS terms_md5 FROM t"),
)
def bigram_tokens(spark, d):
    terms = fx(spark, d, "fx_corpus").select("doc_id", T.bigrams(F.col("text")).alias("terms"))
    return terms.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


@query("bm25_statistics", oracle("fx_corpus", POSTINGS + " SELECT term, df, round(idf, 6) AS idf FROM idf"))
def bm25_statistics(spark, d):
    return rounded(posting_index(spark, d).statistics())


@query("bm25_top_k", oracle("fx_queries fx_corpus", BM25 + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm25"))
def bm25_top_k(spark, d):
    return rounded(posting_index(spark, d).search(fx(spark, d, "fx_queries"), 10))


@query(
    "bm25_evaluation",
    oracle("fx_queries fx_corpus fx_qrels", BM25 + ", " + metrics_sql("m", "bm25", "fx_qrels", "fx_queries")
    + " SELECT metric, round(avg(value), 6) AS mean, count(*) AS n FROM m GROUP BY metric"),
)
def bm25_evaluation(spark, d):
    qrels, queries = fx(spark, d, "fx_qrels"), fx(spark, d, "fx_queries")
    judged = M.restricted(queries, qrels)
    ranked = posting_index(spark, d).search(judged, 10)
    return rounded(M.means(M.per_query(ranked, qrels, judged)))


@query("dense_top_k", oracle(VEC, RUN_A + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM run_a"))
def dense_top_k(spark, d):
    return rounded(dense(spark, d, 64))


@query(
    "unit_vectors",
    "SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square, "
    "round(embedding[1]::DOUBLE / (sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))) + 1e-12), 6) AS first FROM embeddings",
)
def unit_vectors(spark, d):
    v = F.col("embedding")
    n = T.norm(F.slice(v, 1, 16))
    return rounded(fx(spark, d, "embeddings").select("vec_id", (n * n).alias("square"), T.truncated(v, 16)[0].alias("first")))


DIMS = (64, 32, 16)


@query(
    "dimension_curve",
    oracle(VEC, ", ".join(dense_sql(f"r{n}", n) for n in DIMS) + ", r AS (" + " UNION ALL ".join(f"SELECT {n} AS dim, * FROM r{n}" for n in DIMS) + "), "
    + metrics_sql("m", "r", "fx_vec_qrels", "r", by="dim") + " SELECT CAST(dim AS INTEGER) AS dim, metric, round(avg(value), 6) AS mean, count(*) AS n FROM m GROUP BY dim, metric"),
)
def dimension_curve(spark, d):
    """Quality by the number of dimensions kept; every dimension is a run of one job."""
    runs = None
    for n in DIMS:
        one = dense(spark, d, n).withColumn("dim", F.lit(n))
        runs = one if runs is None else runs.unionByName(one)
    return rounded(M.means(M.per_query(runs, fx(spark, d, "fx_vec_qrels"), by=("dim",)), "dim"))


@query(
    "model_survey",
    oracle(VEC, ", ".join(dense_sql(f"r{n}", n) for n in DIMS) + ", r AS (" + " UNION ALL ".join(f"SELECT 'model-{n}' AS model, * FROM r{n}" for n in DIMS) + "), "
    + metrics_sql("m", "r", "fx_vec_qrels", "r", by="model") + " SELECT model, round(avg(value) FILTER (metric = 'ndcg@10'), 6) AS ndcg, "
    "round(avg(value) FILTER (metric = 'recall@10'), 6) AS recall, round(avg(value) FILTER (metric = 'ndcg@10' AND slice = 'odd'), 6) AS odd_ndcg "
    "FROM m JOIN fx_vec_queries USING (query_id) GROUP BY model"),
)
def model_survey(spark, d):
    """One row per model over the same judgments, with one slice beside the whole."""
    runs = None
    for n in DIMS:
        one = dense(spark, d, n).withColumn("model", F.lit(f"model-{n}"))
        runs = one if runs is None else runs.unionByName(one)
    scores = M.per_query(runs, fx(spark, d, "fx_vec_qrels"), by=("model",)).join(
        fx(spark, d, "fx_vec_queries").select("query_id", "slice"), "query_id"
    )
    of = lambda m, c=F.lit(True): F.avg(F.when((F.col("metric") == m) & c, F.col("value")))
    return rounded(scores.groupBy("model").agg(
        of("ndcg@10").alias("ndcg"), of("recall@10").alias("recall"), of("ndcg@10", F.col("slice") == "odd").alias("odd_ndcg")
    ))


def fused_sql(name: str, weights: str, source: str, by: str = "") -> str:
    also = f"{by}, " if by else ""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY {also}query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT {also}query_id, doc_id, round(sum({weights} / (60 + rank)), 12) AS score FROM {source} WHERE {weights} > 0 GROUP BY ALL) QUALIFY rank <= 50)"""


BOTH = "both_runs AS (SELECT query_id, doc_id, rank, true AS is_dense FROM run_a UNION ALL SELECT query_id, doc_id, rank, false FROM run_b)"


@query(
    "rank_fusion",
    oracle(VEC, f"{RUN_A}, {RUN_B}, {BOTH}, {fused_sql('fused', '(CASE WHEN is_dense THEN 0.7 ELSE 0.3 END)::DOUBLE', 'both_runs')} "
    "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fused"),
)
def rank_fusion(spark, d):
    return rounded(R.rrf([(dense(spark, d, 64), 0.7), (dense(spark, d, 16), 0.3)]))


PAIRED = "paired AS (SELECT query_id, metric, a.value AS a, b.value AS b, b.value - a.value AS delta FROM a JOIN b USING (query_id, metric))"
FLIPS = 2000
PVALUES = f"""flipped AS (SELECT metric, b.range AS b, abs(sum(CASE WHEN {draw_sql("'0'", "b.range", "query_id")} % 2 = 0 THEN delta ELSE -delta END)) AS f
 FROM paired CROSS JOIN range({FLIPS}) b WHERE delta <> 0 GROUP BY ALL),
observed AS (SELECT metric, abs(sum(delta)) AS o FROM paired WHERE delta <> 0 GROUP BY metric),
extreme AS (SELECT metric, count(*) FILTER (f >= o - 1e-12) AS e FROM flipped JOIN observed USING (metric) GROUP BY metric),
p AS (SELECT metric, coalesce((e + 1) / ({FLIPS} + 1), 1.0) AS p FROM (SELECT DISTINCT metric FROM paired) LEFT JOIN extreme USING (metric))"""


SWEEP = (
    f"{RUN_A}, {RUN_B}, {BOTH}, grid AS (SELECT range / 10 AS alpha FROM range(11)), spread AS (SELECT * FROM both_runs CROSS JOIN grid), "
    + fused_sql("fused", "(CASE WHEN is_dense THEN alpha ELSE 1 - alpha END)", "spread", by="alpha") + ", "
    + metrics_sql("m", "fused", "fx_vec_qrels", "fused", by="alpha")
)


@query(
    "fusion_sweep",
    oracle(VEC, SWEEP + ", w AS (SELECT alpha, avg(value) FILTER (metric = 'ndcg@10') AS ndcg, avg(value) FILTER (metric = 'recall@10') AS recall FROM m GROUP BY alpha) "
    "SELECT alpha, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, row_number() OVER (ORDER BY round(ndcg, 9) DESC, alpha) = 1 AS best FROM w"),
)
def fusion_sweep(spark, d):
    fused = R.fusion_sweep(dense(spark, d, 64), dense(spark, d, 16))
    scores = M.per_query(fused, fx(spark, d, "fx_vec_qrels"), by=("alpha",))
    of = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value")))
    by = scores.groupBy("alpha").agg(of("ndcg@10").alias("ndcg"), of("recall@10").alias("recall"))
    top = by.agg(F.max_by("alpha", F.struct(F.round("ndcg", 9), -F.col("alpha"))).alias("top"))
    return rounded(by.crossJoin(top).select("alpha", "ndcg", "recall", (F.col("alpha") == F.col("top")).alias("best")))


@query(
    "fusion_sweep_test",
    oracle(VEC, SWEEP + f""", w AS (SELECT alpha, round(avg(value), 9) AS mean FROM m WHERE metric = 'ndcg@10' GROUP BY alpha),
 best AS (SELECT alpha FROM w ORDER BY mean DESC, alpha LIMIT 1),
 paired AS (SELECT x.query_id, x.metric, x.value AS a, y.value AS b, y.value - x.value AS delta FROM m x JOIN m y USING (query_id, metric) WHERE metric = 'ndcg@10' AND x.alpha = 1 AND y.alpha = (SELECT alpha FROM best)),
 {{PVALUES}} SELECT (SELECT alpha FROM best) AS best, count(*) AS n, round(avg(a), 6) AS dense, round(avg(b), 6) AS fused, round(avg(delta), 6) AS delta, count(*) FILTER (delta > 0) AS wins,
 count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, round(any_value(p), 6) AS p FROM paired JOIN p USING (metric)""".replace("{PVALUES}", PVALUES)),
)
def fusion_sweep_test(spark, d):
    """The best weight of the sweep against the dense run alone."""
    fused = R.fusion_sweep(dense(spark, d, 64), dense(spark, d, 16))
    return rounded(M.sweep_test(M.per_query(fused, fx(spark, d, "fx_vec_qrels"), by=("alpha",)), FLIPS))


@query("per_query_metrics", oracle(VEC, SCORES + " SELECT query_id, metric, round(value, 6) AS value FROM a"))
def per_query_metrics(spark, d):
    return rounded(M.per_query(dense(spark, d, 64), fx(spark, d, "fx_vec_qrels")))


@query("mean_metrics", oracle(VEC, SCORES + " SELECT metric, round(avg(value), 6) AS mean, count(*) AS n FROM b GROUP BY metric"))
def mean_metrics(spark, d):
    return rounded(M.means(M.per_query(dense(spark, d, 16), fx(spark, d, "fx_vec_qrels"))))


@query(
    "slice_means",
    oracle(VEC, SCORES + ", s AS (SELECT * FROM a JOIN fx_vec_queries USING (query_id)) SELECT metric, CAST(NULL AS VARCHAR) AS slice, round(avg(value), 6) AS mean, count(*) AS n FROM a GROUP BY metric "
    "UNION ALL SELECT metric, slice, round(avg(value), 6), count(*) FROM s WHERE (SELECT count(DISTINCT slice) FROM s) >= 2 GROUP BY metric, slice"),
)
def slice_means(spark, d):
    q, _, qrels = vectors(spark, d)
    return rounded(M.means_with_slices(M.per_query(dense(spark, d, 64), qrels), q))


@query(
    "bootstrap_ci",
    oracle(VEC, SCORES + f""", placed AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS place FROM (SELECT DISTINCT query_id FROM a)),
 n AS (SELECT count(*) AS n FROM placed),
 draws AS (SELECT b.range AS b, {draw_sql("'0'", "b.range", "p.place")} % n AS place FROM placed p CROSS JOIN range(1000) b CROSS JOIN n),
 avgs AS (SELECT b, metric, avg(value) AS mean FROM draws JOIN placed USING (place) JOIN a USING (query_id) GROUP BY b, metric)
 SELECT metric, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM avgs GROUP BY metric"""),
)
def bootstrap_ci(spark, d):
    return rounded(M.bootstrap(M.per_query(dense(spark, d, 64), fx(spark, d, "fx_vec_qrels"))))


@query("permutation_test", oracle(VEC, f"{SCORES}, {PAIRED}, {PVALUES} SELECT metric, round(p, 6) AS p FROM p"))
def permutation_test(spark, d):
    *_, a, b = two_runs(spark, d)
    return rounded(M.permutation_test(M.paired(a, b), FLIPS))


@query(
    "run_comparison",
    oracle(VEC, f"{SCORES}, {PAIRED}, {PVALUES} SELECT metric, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(delta), 6) AS delta, "
    "count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, round(any_value(p), 6) AS p FROM paired JOIN p USING (metric) GROUP BY metric"),
)
def run_comparison(spark, d):
    *_, a, b = two_runs(spark, d)
    return rounded(M.comparison(a, b, FLIPS))


@query("paired_queries", oracle(VEC, f"{SCORES}, {PAIRED} SELECT query_id, metric, round(a, 6) AS a, round(b, 6) AS b, round(delta, 6) AS delta FROM paired"))
def paired_queries(spark, d):
    *_, a, b = two_runs(spark, d)
    return rounded(M.paired(a, b))


@query(
    "slice_deltas",
    oracle(VEC, f"{SCORES}, {PAIRED}, s AS (SELECT * FROM paired JOIN fx_vec_queries USING (query_id)) SELECT slice, metric, count(*) AS n, round(avg(a), 6) AS mean_a, "
    "round(avg(b), 6) AS mean_b, round(avg(delta), 6) AS delta FROM s WHERE (SELECT count(DISTINCT slice) FROM s) >= 2 GROUP BY slice, metric"),
)
def slice_deltas(spark, d):
    *_, a, b = two_runs(spark, d)
    return rounded(M.group_deltas(M.paired(a, b), fx(spark, d, "fx_vec_queries")))


@query(
    "complementarity",
    oracle(VEC, f"""{RUN_A}, {RUN_B}, u AS (SELECT query_id, doc_id, bool_or(s) AS in_a, bool_or(NOT s) AS in_b FROM (SELECT query_id, doc_id, true AS s FROM run_a WHERE rank <= 10
 UNION ALL SELECT query_id, doc_id, false FROM run_b WHERE rank <= 10) GROUP BY ALL),
 one AS (SELECT r.query_id, any_value(slice) AS slice, avg(coalesce(in_a, false)::INT) AS ra, avg(coalesce(in_b, false)::INT) AS rb, avg((u.doc_id IS NOT NULL)::INT) AS ru
 FROM fx_vec_qrels r JOIN fx_vec_queries q ON r.query_id = q.query_id LEFT JOIN u ON r.query_id = u.query_id AND r.doc_id = u.doc_id GROUP BY r.query_id)
 SELECT slice, count(*) AS n, round(avg(ra), 6) AS recall_a, round(avg(rb), 6) AS recall_b, round(avg(ru), 6) AS recall_union,
 round(avg(ru - rb), 6) AS marginal_a, round(avg(ru - ra), 6) AS marginal_b FROM one GROUP BY GROUPING SETS ((), (slice))"""),
)
def complementarity(spark, d):
    q, _, qrels = vectors(spark, d)
    return rounded(M.complementarity(dense(spark, d, 64), dense(spark, d, 16), qrels, 10, q))


@query(
    "candidate_union",
    oracle(VEC, f"{RUN_A}, {RUN_B} SELECT query_id, doc_id FROM run_a WHERE rank <= 10 UNION SELECT query_id, doc_id FROM run_b WHERE rank <= 10"),
)
def candidate_union(spark, d):
    of = lambda n: dense(spark, d, n).filter("rank <= 10").select("query_id", "doc_id")
    return of(64).union(of(16)).distinct()


@query(
    "diff_details",
    oracle(VEC, f"""{SCORES}, {PAIRED}, t AS (SELECT 'a' AS run, * FROM run_a WHERE rank <= 5 UNION ALL SELECT 'b', * FROM run_b WHERE rank <= 5),
 l AS (SELECT run, t.query_id, string_agg(CAST(t.doc_id AS VARCHAR) || CASE WHEN r.doc_id IS NULL THEN '' ELSE '+' END, ' ' ORDER BY rank) AS docs
 FROM t LEFT JOIN fx_vec_qrels r ON t.query_id = r.query_id AND t.doc_id = r.doc_id GROUP BY ALL)
 SELECT p.query_id, round(delta, 6) AS delta, concat('vector ', q.label) AS text, x.docs AS top_a, y.docs AS top_b FROM paired p JOIN fx_vec_queries q USING (query_id)
 JOIN l x ON x.run = 'a' AND x.query_id = p.query_id JOIN l y ON y.run = 'b' AND y.query_id = p.query_id WHERE metric = 'ndcg@10'"""),
)
def diff_details(spark, d):
    q, c, qrels = vectors(spark, d)
    a, b, sa, sb = two_runs(spark, d)
    pairs = M.paired(sa, sb).filter("metric = 'ndcg@10'").select("query_id", "delta")
    texts = q.select("query_id", F.concat(F.lit("vector "), F.col("label")).alias("text"))
    out = M.diff_details(pairs, a, b, texts, c.select("doc_id", F.lit(None).cast("string").alias("title")), qrels)
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["title"], F.when(x["relevant"], "+").otherwise(""))), " ")
    return rounded(out.select("query_id", "delta", "text", line("top_a").alias("top_a"), line("top_b").alias("top_b")))


@query(
    "query_topics",
    oracle("fx_vec_corpus", "SELECT doc_id AS query_id, CASE WHEN doc_id % 20 IN (0, 5, 7) THEN CAST(label AS VARCHAR) END AS topic FROM fx_vec_corpus"),
)
def query_topics(spark, d):
    """Ids of three parts, of four and five, of two, and of another first part."""
    n = F.col("doc_id") % 20
    tail = F.when(n == 5, "1-2").when(n == 7, "1-2-3").when(n != 9, F.col("doc_id").cast("string"))
    named = F.concat_ws("-", F.when(n.isin(0, 5, 7, 9), "q").otherwise("x"), F.col("label"), tail)
    return fx(spark, d, "fx_vec_corpus").select(F.col("doc_id").alias("query_id"), T.topic(named).alias("topic"))


PROFILED = """rows AS (SELECT query_id, text, slice, CASE WHEN CAST(query_id AS INTEGER) % 5 = 0 THEN 'my-Nemotron-qwen' WHEN CAST(query_id AS INTEGER) % 5 = 1 THEN 'Qwen/Embed' ELSE 'other' END AS model,
 CASE WHEN CAST(query_id AS INTEGER) % 7 = 0 THEN 'plain' ELSE '' END AS override, CASE WHEN CAST(query_id AS INTEGER) % 5 = 3 THEN 'nemotron-base' END AS base_model FROM fx_queries),
p AS (SELECT *, CASE WHEN override <> '' THEN override WHEN contains(lower(base_model), 'nemotron') THEN 'nemotron3' WHEN contains(lower(model), 'nemotron') THEN 'nemotron3'
 WHEN contains(lower(model), 'qwen') THEN 'qwen3' END AS found FROM rows)"""


@query(
    "profiles_and_formatting",
    oracle("fx_queries", PROFILED + """ SELECT query_id, coalesce(found, 'qwen3') AS profile, found IS NULL AS guessed,
 CASE coalesce(found, 'qwen3') WHEN 'qwen3' THEN concat('Instruct: Find it\\nQuery: ', text) WHEN 'nemotron3' THEN concat('query: ', text) ELSE text END AS query_input,
 concat(CASE WHEN coalesce(found, 'qwen3') = 'nemotron3' THEN 'passage: ' ELSE '' END, CASE WHEN slice = 'even' THEN 'Even\\n\\n' ELSE '' END, text) AS doc_input FROM p""".replace("\\n", "' || chr(10) || '")),
)
def profiles_and_formatting(spark, d):
    n = F.col("query_id").cast("int")
    rows = fx(spark, d, "fx_queries").select(
        "query_id", "text", "slice",
        F.when(n % 5 == 0, "my-Nemotron-qwen").when(n % 5 == 1, "Qwen/Embed").otherwise("other").alias("model"),
        F.when(n % 7 == 0, "plain").otherwise("").alias("override"),
        F.lit(None).cast("string").alias("recorded"),
        F.when(n % 5 == 3, "nemotron-base").alias("base_model"),
    )
    rows = T.with_templates(T.resolved_profiles(rows))
    title = F.when(F.col("slice") == "even", "Even").otherwise("")
    return rows.select(
        "query_id", "profile", "guessed",
        T.formatted_query(F.col("text"), F.lit("Find it")).alias("query_input"),
        T.formatted_document(title, F.col("text")).alias("doc_input"),
    )
