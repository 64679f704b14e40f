"""Views over the given tables that look like search data, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import containing
from ..session import prepared

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Table names stand in braces.
VIEWS = {
    "fx_queries": "SELECT CAST(item_id AS STRING) AS query_id, text, "
    "CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS slice FROM {benchmark}",
    "fx_corpus": "SELECT CAST(doc_id AS STRING) AS doc_id, CAST(NULL AS STRING) AS title, text, doc_id AS seq FROM {documents}",
    "fx_qrels": "SELECT q.query_id, d.doc_id, 1.0E0 AS gain FROM {fx_queries} q JOIN {fx_corpus} d ON contains(d.text, q.text)",
    "fx_vec_queries": "SELECT vec_id AS query_id, embedding, label, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS slice "
    "FROM {embeddings} WHERE vec_id % 50 = 0",
    "fx_vec_corpus": "SELECT vec_id AS doc_id, embedding, label FROM {embeddings}",
    "fx_vec_qrels": "SELECT q.query_id, d.doc_id, 1.0E0 AS gain FROM {fx_vec_queries} q JOIN {fx_vec_corpus} d "
    "ON q.label = d.label AND q.query_id - q.query_id % 200 = d.doc_id - d.doc_id % 200",
    # some queries are blank or have blanks around them, some sessions are empty or null
    "fx_searches": "SELECT event_id AS seq, CASE WHEN event_id % 37 = 4 THEN '' WHEN event_id % 37 <> 9 THEN "
    "concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) END AS session, "
    "CASE WHEN event_id % 41 = 3 THEN '   ' WHEN event_id % 43 = 5 THEN '' ELSE concat(CASE WHEN event_id % 7 = 1 THEN '  ' ELSE '' END, "
    "CASE WHEN event_id % 3 = 0 THEN 'Query ' ELSE 'query ' END, regexp_extract(props, '[0-9]+', 0), "
    "CASE WHEN event_id % 50 = 7 THEN ' a.b@example.com' ELSE '' END, CASE WHEN event_id % 11 = 2 THEN ' ' ELSE '' END) END AS query, event_type, value FROM {events}",
    "fx_impressions": "SELECT s.seq, p.pos, concat('d', CAST((s.seq * 7 + p.pos * 3) % 40 AS STRING)) AS doc_id "
    "FROM {fx_searches} s CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS p(pos)",
    "fx_clicks": "SELECT i.seq, i.pos AS rnk, i.doc_id, s.value / 20 AS dwell_sec FROM {fx_impressions} i JOIN {fx_searches} s ON i.seq = s.seq "
    "WHERE i.pos = 1 AND s.event_type IN ('error','signup') UNION ALL "
    "SELECT i.seq, i.pos AS rnk, i.doc_id, s.value AS dwell_sec FROM {fx_impressions} i JOIN {fx_searches} s ON i.seq = s.seq "
    "WHERE i.pos = 2 + s.seq % 4 AND s.event_type IN ('click','purchase','signup')",
    "fx_epochs": "SELECT run_idx, epoch, ndcg, 1 - ndcg AS eval_loss, CASE WHEN run_idx = 7 THEN 'running' ELSE 'evaluated' END AS status FROM "
    "(SELECT user_id % 8 AS run_idx, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS epoch, value / 500 AS ndcg FROM {events}) t",
    "fx_latency": "SELECT event_type AS hardware_key, CASE WHEN event_id % 2 = 0 THEN 'embed' ELSE 'search' END AS phase, value AS ms FROM {events}",
    "fx_pages": "SELECT page_id AS seq, url, html, CASE WHEN page_id % 7 = 0 THEN 'Shared site description' "
    "ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS description FROM {pages}",
    "fx_runs": "SELECT o_orderkey AS run_id, o_orderpriority AS config, o_orderkey % 5 AS seed, CAST(o_totalprice AS DOUBLE) / 1000000 AS ndcg, "
    "o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN 'fpA' ELSE 'fpB' END AS fingerprint FROM {orders}",
    # search records to ingest: some name a document, some carry a text, some neither
    "fx_records": "SELECT seq, query, CASE WHEN seq % 3 = 0 THEN CAST(seq % 1500 AS STRING) END AS doc_id, CAST(NULL AS STRING) AS title, "
    "CASE WHEN seq % 3 = 1 THEN concat('page ', CAST(seq % 17 AS STRING)) END AS content FROM {fx_searches}",
    # training pairs: a text as the query and the document it is about
    "fx_pairs": "SELECT doc_id AS seq, concat(CASE WHEN doc_id % 2 = 0 THEN 'Find  ' ELSE 'find ' END, text) AS query, "
    "CAST(doc_id - doc_id % 3 AS STRING) AS doc_id, CAST(NULL AS STRING) AS title, text AS content FROM {documents}",
}
VIEWS["fx_vec_pairs"] = "SELECT query_id, query_id + 1 AS doc_id FROM {fx_vec_queries} WHERE query_id + 1 IN (SELECT doc_id FROM {fx_vec_corpus})"


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, or a view over its tables.

    Judgments are found with the library's search for strings, as SQL would compare all with all.
    """
    prepared(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "fx_qrels":
        queries = fx(spark, sf_dir, "fx_queries").select("query_id", F.col("text").alias("needle"))
        found = containing(queries, fx(spark, sf_dir, "fx_corpus")).join(queries, "needle")
        return found.select("query_id", "doc_id", F.lit(1.0).alias("gain"))
    sql = VIEWS[name]
    return spark.sql(sql, **{n: fx(spark, sf_dir, n) for n in _needs(sql)})


def oracle(names: str, body: str) -> str:
    """SQL with the named views (and those they need) before ``body``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in done:
            for n in _needs(VIEWS[name]):
                add(n)
            done[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for n in names.split():
        add(n)
    views = ",\n".join(f"{n} AS ({sql})" for n, sql in done.items())
    body = body.strip()
    if not views:
        return body if body.upper().startswith("SELECT") else "WITH " + body
    return f"WITH {views}" + ("\n" if body.upper().startswith("SELECT") else ",\n") + body
