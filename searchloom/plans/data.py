"""Registered queries: mining, vectors, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import uuid5
from ..operators import mining as N
from ..operators import vectors as V
from ..operators.cells import recall_by_share
from ..session import prepared, scratch, stored
from ..sources import files as S
from ..sources.lines import refiled
from ..streaming import jobs as X
from . import building, search, tables  # noqa: F401
from .base import ORACLES, query, rounded
from .fixtures import fx, oracle
from .indexes import cell_index, posting_index

#: Share of the cells that a search probes; these vectors have hardly any clusters (``probe_recall``).
PROBED = 0.75
VEC = "fx_vec_queries fx_vec_corpus fx_vec_pairs"
SIMS = """sims AS (SELECT q.query_id, d.doc_id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS s FROM fx_vec_queries q CROSS JOIN fx_vec_corpus d),
own AS (SELECT p.query_id, p.doc_id, s AS own FROM fx_vec_pairs p JOIN sims USING (query_id, doc_id))"""


def trio(spark, d):
    return fx(spark, d, "fx_vec_pairs"), fx(spark, d, "fx_vec_queries"), fx(spark, d, "fx_vec_corpus")


@query(
    "round_trip_filter",
    oracle(VEC, SIMS + """ SELECT o.query_id, o.doc_id FROM own o WHERE (SELECT count(*) FROM sims s WHERE s.query_id = o.query_id AND s.doc_id <> o.doc_id
 AND (s.s > o.own + 1e-12 OR (abs(s.s - o.own) < 1e-12 AND s.doc_id < o.doc_id))) < 200"""),
)
def round_trip_filter(spark, d):
    return N.round_trip(*trio(spark, d), k=200)


@query(
    "guarded_negatives",
    oracle(VEC, SIMS + """, c AS (SELECT o.query_id, o.doc_id, s.doc_id AS neg, row_number() OVER (PARTITION BY o.query_id, o.doc_id ORDER BY s.s DESC, s.doc_id) AS n FROM own o JOIN sims s ON s.query_id = o.query_id
 AND s.doc_id <> o.doc_id AND s.s <= CASE WHEN o.own > 0 THEN o.own * 0.95 ELSE o.own END)
 SELECT o.query_id, o.doc_id, coalesce((SELECT string_agg(CAST(neg AS VARCHAR), ' ' ORDER BY n) FROM c WHERE c.query_id = o.query_id AND c.doc_id = o.doc_id AND n <= 4), '') AS negatives FROM own o"""),
)
def guarded_negatives(spark, d):
    out = N.mined(*trio(spark, d), n=4)
    return out.withColumn("negatives", F.array_join(F.transform("negatives", lambda x: x.cast("string")), " "))


@query(
    "padded_negatives",
    oracle("fx_pairs", "SELECT seq, 'doc-' || seq AS positive, CAST(3 AS INTEGER) AS n, CAST(3 AS INTEGER) AS different, seq % 4 < 3 AS padded, false AS own FROM fx_pairs"),
)
def padded_negatives(spark, d):
    """Which documents are borrowed is a draw; how many, and that none is the row's own, is not."""
    key = lambda c: F.concat(F.lit("doc-"), c.cast("string"))
    rows = fx(spark, d, "fx_pairs").select(
        "seq", key(F.col("seq")).alias("positive"),
        F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, (F.col("seq") % 4).cast("int")), lambda i: key(F.col("seq") + i)).alias("negatives"),
    )
    out = N.padded(rows)
    return out.select("seq", "positive", F.size("negatives").alias("n"), F.size(F.array_distinct("negatives")).alias("different"), "padded", F.array_contains("negatives", F.col("positive")).alias("own"))


@query(
    "contrastive_table",
    oracle(VEC, SIMS + """, c AS (SELECT o.query_id, o.doc_id, s.doc_id AS neg, row_number() OVER (PARTITION BY o.query_id, o.doc_id ORDER BY s.s DESC, s.doc_id) AS n FROM own o JOIN sims s ON s.query_id = o.query_id
 AND s.doc_id <> o.doc_id AND s.s <= CASE WHEN o.own > 0 THEN o.own * 0.95 ELSE o.own END)
 SELECT o.query_id AS seq, 'query: ' || o.query_id AS anchor, 'passage: ' || o.doc_id AS positive, (SELECT 'passage: ' || neg FROM c WHERE c.query_id = o.query_id AND n = 1) AS negative,
 (SELECT 'passage: ' || neg FROM c WHERE c.query_id = o.query_id AND n = 2) AS negative_2 FROM own o"""),
)
def contrastive_table(spark, d):
    mined = N.mined(*trio(spark, d), n=2)
    passage = lambda c: F.concat(F.lit("passage: "), c.cast("string"))
    rows = mined.select(
        F.col("query_id").alias("seq"), F.concat(F.lit("query: "), F.col("query_id").cast("string")).alias("anchor"),
        passage(F.col("doc_id")).alias("positive"), F.transform("negatives", passage).alias("negatives"),
    )
    return N.contrastive(rows, 2)


EVAL = """both_parts AS (SELECT (seq % 4 > 0)::INT AS part, * FROM fx_pairs), firsts AS (SELECT content, min(part * 1000000000000 + seq) AS place FROM both_parts GROUP BY content),
docs AS (SELECT content, 'd-' || (row_number() OVER (ORDER BY place) - 1) AS doc_id FROM firsts)"""


@query("training_eval_documents", oracle("fx_pairs", EVAL + " SELECT doc_id, md5(content) AS content FROM docs"))
def training_eval_documents(spark, d):
    pairs = fx(spark, d, "fx_pairs").select("seq", "query", "title", "content")
    docs, _ = N.training_eval(pairs.filter("seq % 4 = 0"), pairs.filter("seq % 4 > 0"))
    return docs.select("doc_id", F.md5("content").alias("content"))


@query("training_eval_queries", oracle("fx_pairs", EVAL + " SELECT 'q-' || (row_number() OVER (ORDER BY seq) - 1) AS query_id, query, docs.doc_id FROM both_parts JOIN docs USING (content) WHERE part = 0"))
def training_eval_queries(spark, d):
    pairs = fx(spark, d, "fx_pairs").select("seq", "query", "title", "content")
    return N.training_eval(pairs.filter("seq % 4 = 0"), pairs.filter("seq % 4 > 0"))[1]


@query(
    "default_queries",
    oracle("fx_corpus", f"""t AS (SELECT doc_id, unnest(flatten({search.TOKENS.format('text')})) AS term FROM fx_corpus), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT doc_id, term, round(tf * ln(((SELECT count(*) FROM fx_corpus) + 1) / df), 9) AS weight FROM tf JOIN df USING (term))
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INTEGER) AS i, term AS query FROM w QUALIFY i <= 3"""),
)
def default_queries(spark, d):
    return N.default_queries(fx(spark, d, "fx_corpus"))


def lines_of(title: str | None, text: str) -> list[str]:
    """A generator: the lines of a text. It fails on texts of one line."""
    found = text.split("\n")
    if len(found) < 2:
        raise ValueError("one line")
    return found


@query(
    "synthesized_queries",
    oracle("fx_corpus", """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS query, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM fx_corpus WHERE contains(text, chr(10)))
 SELECT doc_id, CAST(i AS INTEGER) AS i, query FROM l WHERE i < 3"""),
)
def synthesized_queries(spark, d):
    """The first three that a generator gives for each document."""
    return N.synthesized(fx(spark, d, "fx_corpus"), lines_of, 3)[0]


@query("failed_generations", oracle("fx_corpus", "SELECT doc_id, 'ValueError: one line' AS error FROM fx_corpus WHERE NOT contains(text, chr(10))"))
def failed_generations(spark, d):
    return N.synthesized(fx(spark, d, "fx_corpus"), lines_of, 3, retries=1)[1]


@query(
    "embedded_documents",
    oracle("fx_corpus", """b AS (SELECT doc_id, hex(encode(' ' || lower(text) || ' ')) AS x FROM fx_corpus),
 t AS (SELECT doc_id, ('0x' || substr(x, 2 * i + 1, 6))::BIGINT * 2654435761 % 4294967296 AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 2)) AS i FROM b)),
 c AS (SELECT doc_id, (h // 256) % 64 AS slot, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS n FROM t GROUP BY ALL),
 s AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM c GROUP BY doc_id)
 SELECT doc_id, CAST(64 AS INTEGER) AS dim, 1.0::DOUBLE AS norm, round(coalesce(sum(n) FILTER (slot = 0), 0) / any_value(size), 3) AS first, round(coalesce(sum(n) FILTER (slot = 63), 0) / any_value(size), 3) AS last
 FROM c JOIN s USING (doc_id) GROUP BY doc_id"""),
)
def embedded_documents(spark, d):
    """Hashed trigrams of whole texts."""
    rows = N.embedded(fx(spark, d, "fx_corpus").select("doc_id", "text"), N.hashed_encoder, 64)
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return rounded(rows.select("doc_id", F.size("embedding").alias("dim"), V.norm(F.col("embedding")).alias("norm"), at(0).alias("first"), at(63).alias("last")), 3)


@query("version_names", oracle("fx_runs", """SELECT DISTINCT 'site__' || lower(regexp_replace(config, '[^A-Za-z0-9]+', '-', 'g')) || '__' || (seed * 64) || 'd__' || fingerprint AS name,
 'site' AS prefix, lower(regexp_replace(config, '[^A-Za-z0-9]+', '-', 'g')) AS model_slug, CAST(seed * 64 AS INTEGER) AS dim, fingerprint FROM fx_runs"""))
def version_names(spark, d):
    from ..functions.text import slug

    rows = fx(spark, d, "fx_runs").select("config", "seed", "fingerprint").distinct()
    name = F.concat(F.lit("site__"), slug(F.col("config")), F.lit("__"), (F.col("seed") * 64).cast("string"), F.lit("d__"), "fingerprint")
    return V.parsed_names(rows.select(name.alias("name")))


def points(spark, d):
    """Vectors as points; every seventh comes twice, and the later one stays."""
    e = fx(spark, d, "embeddings").select(uuid5(F.col("vec_id").cast("string")).alias("point_id"), F.col("vec_id").alias("seq"), "label", "embedding")
    again = e.filter("seq % 7 = 0").withColumn("label", F.lit(-1)).withColumn("seq", F.col("seq") + 1_000_000)
    return e.withColumn("label", F.col("label").cast("int")).unionByName(again)


@query("upserted_points", "SELECT CASE WHEN vec_id % 7 = 0 THEN vec_id + 1000000 ELSE vec_id END AS seq, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE CAST(label AS INTEGER) END AS label FROM embeddings")
def upserted_points(spark, d):
    store = V.VectorStore(spark, scratch(spark, "store"))
    store.upsert("v", points(spark, d))
    return store.scan("v").select("seq", "label")


@query(
    "published_versions",
    """SELECT 'site__model-' || m || '__64d__aaaa' AS name, count(*) AS points, CAST(64 AS INTEGER) AS dim, m = 'a' AS live, true AS dim_matches, m = 'a' AS model_matches, false AS written_again
 FROM embeddings CROSS JOIN (VALUES ('a'), ('b')) AS t(m) GROUP BY m""",
)
def published_versions(spark, d):
    """Publish two versions, the second twice; roll back, list the family."""
    store, pts = V.VectorStore(spark, scratch(spark, "store")), points(spark, d)
    n = fx(spark, d, "embeddings").count()
    first, _ = store.publish("site", "Model A", 64, "aaaa", lambda: pts, n)
    store.publish("site", "Model B", 64, "aaaa", lambda: pts, n)
    _, again = store.publish("site", "Model B", 64, "aaaa", lambda: pts, n)
    store.point("site", first)
    return store.status("site", 64, "Model A").withColumn("written_again", F.lit(again))


@query("vector_parity", "SELECT vec_id AS key, round(list_cosine_similarity(embedding::DOUBLE[], list_concat(embedding[1:60], [0.0, 0.0, 0.0, 0.0])::DOUBLE[]), 6) AS cosine, list_cosine_similarity(embedding::DOUBLE[], list_concat(embedding[1:60], [0.0, 0.0, 0.0, 0.0])::DOUBLE[]) >= 0.95 AS agrees FROM embeddings")
def vector_parity(spark, d):
    e = fx(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    zeros = F.array(*[F.lit(0.0).cast("float")] * 4)
    return rounded(V.parity(e, e.withColumn("embedding", F.concat(F.slice("embedding", 1, 60), zeros)), 0.95))


@query("approximate_top_k")
def approximate_top_k(spark, d):
    """Rows-only: what the cells leave out depends on their fit."""
    return rounded(cell_index(spark, d).search(fx(spark, d, "fx_vec_queries"), 10, PROBED))


@query("exact_by_cells", oracle(search.VEC, search.dense_sql("run", 64, 10) + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM run"))
def exact_by_cells(spark, d):
    """All cells of the same index."""
    return rounded(cell_index(spark, d).search(fx(spark, d, "fx_vec_queries"), 10, 1.0))


@query("approximation_loss")
def approximation_loss(spark, d):
    exact = search.dense(spark, d, 64, 10)
    near = cell_index(spark, d).search(fx(spark, d, "fx_vec_queries"), 10, PROBED)
    return rounded(V.approximation_loss(exact, near, fx(spark, d, "fx_vec_qrels")))


@query("probe_recall")
def probe_recall(spark, d):
    """What each share of the cells finds, and how many vectors it meets."""
    return rounded(recall_by_share(cell_index(spark, d), fx(spark, d, "fx_vec_queries"), search.dense(spark, d, 64, 10), 10, (0.05, 0.1, 0.25, 0.5, PROBED, 1.0)))


@query("judging_list", oracle("fx_queries fx_corpus", search.BM25 + " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text FROM bm25 JOIN fx_corpus USING (doc_id)"))
def judging_list(spark, d):
    return rounded(V.judging_list(posting_index(spark, d).search(fx(spark, d, "fx_queries"), 10), fx(spark, d, "fx_corpus")))


@query(
    "judging_search",
    oracle("fx_vec_queries fx_corpus", """s AS (SELECT q.query_id, v.vec_id, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, 'p' || lpad(CAST(v.vec_id AS VARCHAR), 9, '0')) AS place
 FROM fx_vec_queries q CROSS JOIN embeddings v QUALIFY place <= 30), last AS (SELECT text, arg_max(doc_id, seq) AS doc_id FROM fx_corpus GROUP BY text),
 b AS (SELECT query_id, l.doc_id, min(place) AS place FROM s JOIN documents d ON d.doc_id = s.vec_id JOIN last l ON l.text = d.text GROUP BY ALL),
 r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM b QUALIFY rank <= 10)
 SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text FROM r JOIN fx_corpus USING (doc_id)"""),
)
def judging_search(spark, d):
    """Through the live version, whose payloads lead to the corpus by content."""
    store, n = V.VectorStore(spark, scratch(spark, "store")), F.col("vec_id").cast("string")
    none = F.lit(None).cast("string")
    texts = fx(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), none.alias("title"), F.col("text").alias("content"))
    held = fx(spark, d, "embeddings").join(texts, "vec_id", "left").select(
        F.concat(F.lit("p"), F.lpad(n, 9, "0")).alias("point_id"), F.col("vec_id").alias("seq"), "title", "content", "embedding"
    )
    store.publish("site", "encoder", 64, "aaaa", lambda: held, held.count())
    out = V.judging_search(fx(spark, d, "fx_vec_queries"), held, fx(spark, d, "fx_corpus"), store=store, prefix="site", model="encoder", dim=64)
    return out.select("query_id", "doc_id", "rank", "text")


@query("jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "jsonl")
    S.write_jsonl(fx(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return S.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("beir_corpus", oracle("", "r AS (SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN turn % 2 = 0 THEN role END AS title, text, turn FROM conversations) SELECT id AS doc_id, arg_max_null(title, turn) AS title, arg_max(text, turn) AS text FROM r GROUP BY id"))
def beir_corpus(spark, d):
    title = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    return S.corpus(fx(spark, d, "conversations").select(F.col("conv_id").alias("_id"), title.alias("title"), "text", F.col("turn").alias("seq")))


@query("beir_queries", "SELECT CAST(item_id AS VARCHAR) AS query_id, text, CASE WHEN item_id % 3 > 0 THEN 's' || (item_id % 3) END AS slice FROM benchmark")
def beir_queries(spark, d):
    slice_ = F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("s"), F.col("item_id") % 3)).otherwise("")
    return S.queries(fx(spark, d, "benchmark").select(F.col("item_id").alias("_id"), "text", slice_.alias("slice")))


@query("qrels_scan", oracle("", """l AS (SELECT o_orderkey AS n, o_custkey % 50 AS q, o_orderkey % 20 AS d, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 3 END AS g FROM orders)
 SELECT CAST(q AS VARCHAR) AS query_id, CAST(d AS VARCHAR) AS doc_id, CAST(arg_max(g, n) AS DOUBLE) AS gain FROM l WHERE g > 0 GROUP BY q, d"""))
def qrels_scan(spark, d):
    o = F.col("o_orderkey")
    gain = F.when(o % 9 == 0, "score").otherwise((o % 3).cast("string"))
    lines = fx(spark, d, "orders").select(o.alias("line_no"), F.concat_ws("\t", F.col("o_custkey") % 50, o % 20, gain).alias("value"))
    return S.qrels(refiled(lines))


TREC = """l AS (SELECT o_orderkey AS n, 'q' || (o_custkey % 30) AS q, 'd' || (o_orderkey % 40) AS d, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 100 END AS g FROM orders)"""


def trec_lines(spark, d):
    o = F.col("o_orderkey")
    given = F.when(o % 11 == 0, "x").otherwise(F.concat((o % 100).cast("string"), F.lit(".0")))
    value = F.concat(F.lit("q"), F.col("o_custkey") % 30, F.lit(" Q0\td"), o % 40, F.lit("  "), given, F.lit(" 0.5 tag"))
    return fx(spark, d, "orders").select(o.alias("line_no"), value.alias("value"))


@query("trec_ranking", oracle("", TREC + ", b AS (SELECT q, d, min(g * 1000000000 + n) AS place FROM l WHERE g IS NOT NULL GROUP BY q, d) SELECT q AS query_id, d AS doc_id, CAST(row_number() OVER (PARTITION BY q ORDER BY place) AS INTEGER) AS rank FROM b"))
def trec_ranking(spark, d):
    return S.trec_run(refiled(trec_lines(spark, d)))[0]


@query("trec_errors", oracle("", TREC + " SELECT n AS line_no FROM l WHERE g IS NULL"))
def trec_errors(spark, d):
    return S.trec_run(trec_lines(spark, d))[1].select("line_no")


def json_lines(spark, d):
    """Records as JSON lines; some are broken, some are no objects, some have no query."""
    n = F.col("seq") % 13
    row = F.to_json(F.struct(F.when(n != 7, F.col("query")).alias("query"), "doc_id", "content"))
    value = F.when(n == 5, "{broken").when(n == 6, '["a"]').when(n == 8, '{"query":"a"} {"query":"b"}').otherwise(row)
    return fx(spark, d, "fx_records").select(F.col("seq").alias("line_no"), value.alias("value"))


@query("log_records_json", oracle("fx_records", "SELECT seq AS line_no, CASE WHEN seq % 13 <> 7 THEN query END AS query, doc_id, content FROM fx_records WHERE seq % 13 NOT IN (5, 6, 8)"))
def log_records_json(spark, d):
    return S.log_records(json_lines(spark, d))[0].select("line_no", "query", "doc_id", "content")


@query("log_errors_json", oracle("fx_records", "SELECT seq AS line_no FROM fx_records WHERE seq % 13 IN (5, 6, 8)"))
def log_errors_json(spark, d):
    return S.log_records(json_lines(spark, d))[1].select("line_no")


def csv_lines(spark, d, head: str | None):
    """Records as CSV: quoted cells, some over two lines, some with a quote inside, some without a query,
    some without anything."""
    n, q = F.col("seq") % 13, F.coalesce(F.col("query"), F.lit(""))
    row = F.concat(F.lit('" '), q, F.lit('"" said"  , '), F.coalesce("doc_id", F.lit("")), F.lit(" "))
    first = F.when(n == 5, " ,nothing").when(n == 6, ' ," "').when(n == 7, F.concat(F.lit('"two,'), q)).when(
        n == 9, F.concat(F.lit('5" '), q, F.lit(',"d"9" ,more'))
    ).otherwise(row)
    lines = fx(spark, d, "fx_records").select((F.col("seq") * 2).alias("line_no"), first.alias("value"))
    more = fx(spark, d, "fx_records").filter("seq % 13 = 7").select((F.col("seq") * 2 + 1).alias("line_no"), F.lit('lines",d7').alias("value"))
    lines = lines.unionByName(more)
    if head:
        lines = lines.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("line_no"), F.lit(head).alias("value")))
    return lines


def csv_sql(where: str) -> str:
    return oracle("fx_records", f"""SELECT seq * 2 AS line_no, CASE WHEN seq % 13 = 7 THEN trim('two,' || query || chr(10) || 'lines') WHEN seq % 13 = 9 THEN trim('5" ' || query) ELSE trim(' ' || query || '" said') END AS query,
 CASE WHEN seq % 13 = 7 THEN 'd7' WHEN seq % 13 = 9 THEN 'd9"' ELSE coalesce(doc_id, '') END AS doc_id FROM fx_records WHERE {where}""")


@query("log_records_csv", csv_sql("seq % 13 NOT IN (5, 6)"))
def log_records_csv(spark, d):
    return S.log_records(csv_lines(spark, d, ' Query , doc_id'))[0].select("line_no", "query", "doc_id")


@query("log_records_csv_without_header", csv_sql("seq % 13 NOT IN (5, 6)"))
def log_records_csv_without_header(spark, d):
    return S.log_records(csv_lines(spark, d, None))[0].select("line_no", "query", "doc_id")


@query("log_errors_csv", oracle("fx_records", "SELECT seq * 2 AS line_no FROM fx_records WHERE seq % 13 = 5"))
def log_errors_csv(spark, d):
    return S.log_records(csv_lines(spark, d, "query,doc_id"))[1].select("line_no")


@query("judgment_splits", oracle("fx_vec_qrels", "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, gain FROM fx_vec_qrels WHERE query_id % 100 = 0"))
def judgment_splits(spark, d):
    """Written as a BEIR-like folder, read again, and asked for ``dev``, which it calls ``test``."""
    rows = fx(spark, d, "fx_vec_qrels").withColumn("split", F.when(F.col("query_id") % 100 == 0, "test").otherwise("final"))
    path = scratch(spark, "beir")
    S.write_beir(path, fx(spark, d, "fx_corpus"), fx(spark, d, "fx_queries"), rows)
    return S.split_rows(S.read_judgments(spark, path), "dev").drop("split")


@query("kept_splits", oracle("fx_vec_qrels", "SELECT CASE WHEN query_id % 100 = 0 THEN 'dev' ELSE 'final' END AS split, count(*) AS n FROM fx_vec_qrels WHERE query_id % 200 <> 50 GROUP BY 1"))
def kept_splits(spark, d):
    stale = F.when(F.col("query_id") % 100 == 0, "dev").when(F.col("query_id") % 200 == 50, "old").otherwise("final")
    rows = S.kept_splits(fx(spark, d, "fx_vec_qrels").withColumn("split", stale), ["dev", "final"])
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("bench_registry", oracle("fx_latency", "SELECT phase, count(*) AS n, round(max(ms), 6) AS slowest FROM fx_latency WHERE hardware_key = 'click' GROUP BY phase"))
def bench_registry(spark, d):
    """Appended in two parts; one hardware's records are read."""
    path, rows = scratch(spark, "bench"), fx(spark, d, "fx_latency")
    S.append_bench(rows.filter("phase = 'embed'"), path)
    S.append_bench(rows.filter("phase = 'search'"), path)
    return rounded(S.load_bench(spark, path, "click").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("slowest")))


@query("dimension_ladders", oracle("", """r AS (SELECT DISTINCT o_custkey % 700 AS dim, o_orderkey % 3 AS k FROM orders),
 l AS (SELECT dim, k, CASE WHEN k > 0 THEN list_reverse_sort(list_distinct(list_filter([300, k * 100, 32], lambda d: d <= dim))) ELSE [] END AS usable FROM r)
 SELECT CAST(dim AS INTEGER) AS dim, k, array_to_string(CASE WHEN len(usable) > 0 THEN usable ELSE list_filter(list_transform(range(0, 31), lambda i: CAST(floor(dim / pow(2, i)) AS INTEGER)), lambda d: d >= 64) END, ' ') AS ladder FROM l"""))
def dimension_ladders(spark, d):
    from ..functions.text import dimension_ladder

    rows = fx(spark, d, "orders").select((F.col("o_custkey") % 700).cast("int").alias("dim"), (F.col("o_orderkey") % 3).alias("k")).distinct()
    asked = F.when(F.col("k") > 0, F.array(F.lit(300), (F.col("k") * 100).cast("int"), F.lit(32)))
    return rows.select("dim", "k", F.array_join(F.transform(dimension_ladder(asked, F.col("dim")), lambda x: x.cast("string")), " ").alias("ladder"))


REGISTRY = "id string, created_at string, model string, label string, ndcg double, seq bigint"


def registry(spark, d):
    """Runs appended in two parts beside lines that are no records; one run is deleted, two come after."""
    runs = fx(spark, d, "fx_runs").select(
        F.col("run_id").cast("string").alias("id"), F.col("created_at").cast("string").alias("created_at"), F.col("config").alias("model"),
        F.when(F.col("seed") == 0, "").otherwise(F.concat(F.lit("seed "), "seed")).alias("label"), "ndcg", F.col("run_id").alias("seq"),
    )
    out = S.RunRegistry(spark, scratch(spark, "runs"), REGISTRY)
    out.append(runs.filter("id % 2 = 0"))
    out.append(runs.filter("id % 2 = 1 AND id > 5"))
    runs.limit(3).select(F.lit("{not a record").alias("value")).write.mode("append").text(out.folders()[1])
    out.delete("7")
    out.append(runs.filter("id IN (1, 3)"))
    return out


RUN_ROWS = """SELECT CAST(run_id AS VARCHAR) AS id, config AS model, CASE WHEN seed = 0 THEN config ELSE 'seed ' || seed END AS label, round(ndcg, 6) AS ndcg,
 CASE WHEN run_id IN (1, 3) THEN 2 ELSE run_id % 2 END AS batch, run_id FROM fx_runs WHERE run_id NOT IN (5, 7)"""


@query("run_registry", oracle("fx_runs", f"r AS ({RUN_ROWS}) SELECT id, model, label, ndcg, batch FROM r"))
def run_registry(spark, d):
    return rounded(registry(spark, d).scan().select("id", "model", "label", "ndcg", "batch"))


@query("last_appended_runs", oracle("fx_runs", f"r AS ({RUN_ROWS}) SELECT id FROM r ORDER BY batch DESC, run_id DESC LIMIT 6"))
def last_appended_runs(spark, d):
    return registry(spark, d).newest().limit(6).select("id")


def training_log(spark, d):
    """A training log with a line for each event."""
    n, v = F.col("event_id"), F.col("value")
    loss = F.concat(F.lit("{'loss': '"), v.cast("string"), F.when(n % 3 == 0, F.lit("'}")).otherwise(F.concat(F.lit("', 'epoch': "), (n / 100).cast("string"), F.lit("}"))))
    epoch = F.concat(F.lit("10%|#\r[epoch] "), (n % 9 + 1).cast("string"), F.lit("/12 eval_loss="), F.when(n % 20 == 1, "-").otherwise(v.cast("string")), F.lit(" ndcg@10="), (v / 500).cast("string"), F.lit(" best=3"))
    score = F.concat(F.lit("ndcg@10 = "), F.round(v / 500, 4).cast("string"))
    line = F.when(n == 4, "baseline eval").when(n == 400, "after fine-tuning").when(n % 5 == 0, loss).when(n % 5 == 1, epoch).when(n % 5 == 2, score).otherwise("noise")
    return fx(spark, d, "events").select(n.alias("line_no"), S.last_redraw(line).alias("value"))


@query("loss_points", oracle("", "l AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS step FROM events WHERE event_id % 5 = 0 AND event_id NOT IN (4, 400)) SELECT CAST(step AS INTEGER) AS step, round(CASE WHEN event_id % 3 = 0 THEN step ELSE event_id / 100 END, 6)::DOUBLE AS epoch, round(value, 6) AS loss FROM l"))
def loss_points(spark, d):
    return rounded(S.loss_points(refiled(training_log(spark, d))))


@query("epoch_points", "SELECT event_id AS line_no, CAST(event_id % 9 + 1 AS INTEGER) AS epoch, CAST(12 AS INTEGER) AS max_epochs, CASE WHEN event_id % 20 <> 1 THEN round(value, 6) END AS eval_loss, round(value / 500, 6) AS ndcg, CAST(3 AS INTEGER) AS best_epoch FROM events WHERE event_id % 5 = 1")
def epoch_points(spark, d):
    return rounded(S.epoch_points(training_log(spark, d)))


@query("log_outcome", oracle("", """s AS (SELECT event_id AS n, CASE WHEN event_id % 5 = 2 THEN round(value / 500, 4) ELSE value / 500 END AS ndcg FROM events WHERE event_id % 5 IN (1, 2))
 SELECT (SELECT round(arg_min(ndcg, n), 6) FROM s WHERE n > 4 AND n < 400) AS before, (SELECT round(arg_max(ndcg, n), 6) FROM s WHERE n > 400) AS after"""))
def log_outcome(spark, d):
    return rounded(S.log_outcome(refiled(training_log(spark, d))).select("before", "after"))


@query("failure_kinds", oracle("", """t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
 r AS (SELECT user_id, min(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 END) AS rule FROM t WHERE back <= 25 GROUP BY user_id)
 SELECT user_id AS run_id, CASE rule WHEN 1 THEN 'memory' WHEN 4 THEN 'service' WHEN 5 THEN 'disk' END AS kind FROM r"""))
def failure_kinds(spark, d):
    said = F.when(F.col("event_type") == "error", "CUDA out of memory").when(F.col("event_type") == "purchase", "Connection refused").when(F.col("event_type") == "signup", "No space left").otherwise("fine")
    return S.failure_kinds(fx(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), said.alias("value")))


@query("dataset_overview", oracle("fx_pairs", "SELECT count(*) AS pairs, max(seq % 5) > 0 AS has_negatives FROM fx_pairs"))
def dataset_overview(spark, d):
    rows = fx(spark, d, "fx_pairs").withColumn("negatives", F.slice(F.array(F.lit("n")), 1, F.least(F.col("seq") % 5, F.lit(1)).cast("int")))
    return S.overview(rows, 10, 50)[0]


@query("sample_corpora", oracle("fx_corpus", "SELECT name, is_sample, (SELECT count(*) FROM fx_corpus) AS docs FROM (VALUES ('documents', false), ('gold', true)) AS t(name, is_sample)"))
def sample_corpora(spark, d):
    """Whether the corpus, and the same with a sample's ids, look like a bundled sample."""
    docs = fx(spark, d, "fx_corpus")
    gold = docs.withColumn("doc_id", F.concat(F.lit("gold-"), "doc_id"))
    flag = lambda name, df: docs.agg(F.count(F.lit(1)).alias("docs")).select(F.lit(name).alias("name"), F.lit(S.is_sample(df)).alias("is_sample"), "docs")
    return flag("documents", docs).unionByName(flag("gold", gold))


@query("dataset_preview", oracle("fx_pairs", "SELECT seq, query, CASE WHEN length(content) > 50 THEN substr(content, 1, 50) || '…' ELSE content END AS content FROM fx_pairs ORDER BY seq LIMIT 10"))
def dataset_preview(spark, d):
    return S.overview(fx(spark, d, "fx_pairs").withColumn("negatives", F.array().cast("array<string>")), 10, 50)[1]


def stream_of(spark, d, df):
    """``df`` as a stream of files."""
    path = scratch(prepared(spark), "feed")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


STREAMED = """keyed AS (SELECT f.*, e.ts, coalesce(nullif(f.session, ''), 'solo-' || f.seq) AS own FROM fx_searches f JOIN events e ON e.event_id = f.seq),
gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY own ORDER BY ts, seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM keyed),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY own ORDER BY ts, seq) AS island FROM gaps),
ended AS (SELECT own, island FROM islands GROUP BY ALL HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
streamed AS (SELECT seq, own || '@' || island AS session, query FROM islands JOIN ended USING (own, island)), """


@query("stream_clicklog", oracle(building.LOG_VIEWS, STREAMED + building.LOG.replace("FROM fx_searches", "FROM streamed") + " SELECT seq, CAST(kind AS INTEGER) AS kind, query, doc_id FROM labels"))
def stream_clicklog(spark, d):
    """Labels of the sessions that the watermark closed."""
    ts = fx(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    rows = building.events(spark, d).join(ts, "seq").select("ts", "session", "seq", "query", "results", "clicks")
    return X.stream_labels(spark, stream_of(spark, d, rows)).select("seq", "kind", "query", "doc_id")


@query(
    "stream_late_events",
    oracle(building.LOG_VIEWS, STREAMED + building.LOG.replace("FROM fx_searches", "FROM streamed") + """ SELECT seq, CAST(kind AS INTEGER) AS kind, query, doc_id,
 (SELECT count(*) FROM fx_searches f JOIN events e ON e.event_id = f.seq WHERE f.seq % 50 = 0 AND e.ts <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)) AS late FROM labels"""),
)
def stream_late_events(spark, d):
    """The same, when some events come once more after the watermark has passed them; how many those are."""
    ts = fx(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    rows = building.events(spark, d).join(ts, "seq").select("ts", "session", "seq", "query", "results", "clicks")
    newest = ts.agg(F.max("ts").alias("newest"))
    last = rows.join(newest, F.col("ts") == F.col("newest")).limit(1).drop("newest").withColumn("session", F.lit("another"))
    again = rows.filter("seq % 50 = 0").join(newest, F.col("ts") <= F.col("newest") - F.expr("INTERVAL 2 HOURS")).drop("newest").withColumn("session", F.lit("late"))
    path, out, late = scratch(prepared(spark), "feed"), scratch(spark, "labels"), 0
    for batch in (rows, last, again):  # a run each, as what is late is told by the batch before
        batch.write.mode("append").parquet(path)
        labels, dropped = X.stream_labels_counted(spark, spark.readStream.schema(rows.schema).parquet(path), out)
        late += dropped
    return labels.select("seq", "kind", "query", "doc_id").withColumn("late", F.lit(late).cast("bigint"))


@query("stream_appended_pairs", ORACLES["appended_pairs"])
def stream_appended_pairs(spark, d):
    rows = fx(spark, d, "fx_records").filter("content IS NOT NULL").select("seq", "query", "content")
    return X.stream_appended(spark, stream_of(spark, d, rows.filter("seq % 2 = 0")), rows.filter("seq % 10 = 1"))


@query("stream_distinct_pairs", oracle("fx_records", "SELECT DISTINCT query, content FROM fx_records WHERE content IS NOT NULL"))
def stream_distinct_pairs(spark, d):
    """Equal pairs once within the watermark."""
    ts = fx(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    rows = fx(spark, d, "fx_records").filter("content IS NOT NULL").join(ts, "seq").select("ts", "query", "content")
    path = scratch(spark, "distinct")
    X.finished(X.deduplicated(stream_of(spark, d, rows)), path)
    return spark.read.schema(rows.schema).parquet(path).select("query", "content")


@query("stream_leaderboard", oracle("fx_runs", "SELECT config, count(*) AS n, round(avg(ndcg), 6) AS mean, round(max(ndcg), 6) AS best FROM fx_runs GROUP BY config"))
def stream_leaderboard(spark, d):
    return rounded(X.stream_leaderboard(spark, stream_of(spark, d, fx(spark, d, "fx_runs").select("config", "ndcg"))))


@query("stream_vectors", oracle("fx_corpus", "SELECT sha256(text) AS content, min(CAST(doc_id AS BIGINT)) AS doc_id, CAST(32 AS INTEGER) AS dim FROM fx_corpus GROUP BY text"))
def stream_vectors(spark, d):
    docs = fx(spark, d, "documents").select("doc_id", "text")
    return X.stream_vectors(spark, stream_of(spark, d, docs)).select("content", "doc_id", F.size("embedding").alias("dim"))


@query("stream_prune_verdicts", f"SELECT CAST(run_idx AS BIGINT) AS run_idx, CAST(epoch AS INTEGER) AS epoch, best, median, prune FROM ({ORACLES['prune_verdicts']}) WHERE run_idx = 7")
def stream_prune_verdicts(spark, d):
    epochs = stored(fx(spark, d, "fx_epochs"), "epochs")
    live = epochs.filter("status = 'running'").select(
        "run_idx", F.col("epoch").alias("line_no"),
        F.concat(F.lit("[epoch] "), "epoch", F.lit("/12 eval_loss="), "eval_loss", F.lit(" ndcg@10="), "ndcg", F.lit(" best=1")).alias("value"),
    )
    done = epochs.filter("status <> 'running'").withColumn("epoch", F.col("epoch").cast("int"))
    return rounded(X.stream_verdicts(spark, stream_of(spark, d, live), done))
