"""Registered queries: click logs, ingest and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.draws import draw_sql
from ..operators import clicklog as C
from ..operators import ingest as I
from .base import query, rounded
from .fixtures import fx, oracle

PII = r"(regexp_matches(query, '[\w.+-]+@[\w-]+\.[\w.]+') OR regexp_matches(query, '0\d{1,2}[ -]?\d{3,4}[ -]?\d{4}') OR regexp_matches(query, '\d{6}[ -]\d{7}'))"

LOG = f"""asked AS (SELECT * REPLACE (trim(query) AS query, coalesce(nullif(session, ''), 'solo-' || seq) AS session) FROM fx_searches WHERE trim(query) <> ''),
kept AS (SELECT * FROM asked WHERE NOT {PII}),
sat AS (SELECT seq, doc_id, rnk, row_number() OVER (PARTITION BY seq ORDER BY rnk DESC) AS n FROM fx_clicks WHERE dwell_sec >= 20),
ev AS (SELECT k.*, s.doc_id AS last_doc, s.rnk AS last_rank FROM kept k LEFT JOIN sat s ON s.seq = k.seq AND s.n = 1),
ses AS (SELECT session, min(seq) AS first_seq, max_by(last_doc, seq) FILTER (last_doc IS NOT NULL) AS final FROM ev GROUP BY session),
direct AS (SELECT first_seq, 0 AS kind, seq, query, last_doc AS doc_id, last_rank FROM ev JOIN ses USING (session) WHERE last_doc IS NOT NULL),
moved AS (SELECT first_seq, 1 AS kind, seq, query, final AS doc_id, NULL AS last_rank FROM ev JOIN ses USING (session) WHERE last_doc IS NULL AND final IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.session = ev.session AND lower(o.query) = lower(ev.query) AND o.last_doc IS NOT NULL)),
labels AS (SELECT * FROM direct UNION ALL SELECT * FROM moved),
negs AS (SELECT l.seq, l.first_seq, l.kind, l.query, l.doc_id, i.doc_id AS negative, i.pos, row_number() OVER (PARTITION BY l.seq ORDER BY i.pos DESC) AS back
 FROM labels l JOIN fx_impressions i ON i.seq = l.seq AND i.pos < l.last_rank AND i.doc_id <> l.doc_id WHERE l.kind = 0 QUALIFY back <= 2),
grouped AS (SELECT lower(query) AS key, doc_id, arg_min(query, [first_seq, kind, seq]) AS query, count(*) AS count FROM labels GROUP BY 1, 2),
seen AS (SELECT lower(query) AS key, doc_id, negative, min([first_seq, kind, seq, pos]) AS place FROM negs WHERE negative <> doc_id GROUP BY 1, 2, 3),
ordered AS (SELECT key, doc_id, string_agg(negative, ' ' ORDER BY place) AS negatives FROM seen GROUP BY 1, 2)"""

LOG_VIEWS = "fx_searches fx_impressions fx_clicks"


def events(spark, d):
    """Searches with their results and clicks as arrays."""
    shown = fx(spark, d, "fx_impressions").groupBy("seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("results")
    )
    clicks = fx(spark, d, "fx_clicks").groupBy("seq").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rnk", "doc_id", "dwell_sec"))),
            lambda x: F.struct(x["doc_id"].alias("doc_id"), x["rnk"].alias("rank"), x["dwell_sec"].alias("dwell_sec")),
        ).alias("clicks")
    )
    searches = fx(spark, d, "fx_searches").select("seq", "session", "query")
    return searches.join(shown, "seq", "left").join(clicks, "seq", "left")


@query(
    "clicklog_pairs",
    oracle(LOG_VIEWS, LOG + " SELECT query, doc_id, count, coalesce(negatives, '') AS negatives FROM grouped LEFT JOIN ordered USING (key, doc_id)"),
)
def clicklog_pairs(spark, d):
    out = C.pairs(C.labels(events(spark, d)))
    return out.select("query", "doc_id", "count", F.array_join("negatives", " ").alias("negatives"))


@query(
    "clicklog_pairs_min_count",
    oracle(LOG_VIEWS, LOG + " SELECT query, doc_id, count, coalesce(negatives, '') AS negatives FROM grouped LEFT JOIN ordered USING (key, doc_id) WHERE count >= 2"),
)
def clicklog_pairs_min_count(spark, d):
    out = C.pairs(C.labels(events(spark, d)), min_count=2)
    return out.select("query", "doc_id", "count", F.array_join("negatives", " ").alias("negatives"))


@query(
    "clicklog_report",
    oracle(LOG_VIEWS, LOG + f""" SELECT (SELECT count(*) FROM fx_searches) AS events, (SELECT count(*) FROM asked WHERE {PII}) AS dropped_pii,
 (SELECT count(*) FROM fx_clicks SEMI JOIN kept USING (seq)) - (SELECT count(*) FROM sat SEMI JOIN kept USING (seq)) AS bounces_ignored,
 (SELECT count(*) FROM ses WHERE final IS NULL) AS abandoned_sessions, (SELECT count(*) FROM ses) AS sessions, (SELECT count(*) FROM direct) AS direct_pairs,
 (SELECT count(*) FROM moved) AS transferred_pairs, (SELECT count(*) FROM negs) AS hard_negatives,
 (SELECT count(*) FROM grouped WHERE count < 2) AS below_min_count, (SELECT count(*) FROM grouped WHERE count >= 2) AS pairs"""),
)
def clicklog_report(spark, d):
    return C.report(events(spark, d), min_count=2)


@query("naive_click_pairs", oracle(LOG_VIEWS, "SELECT c.seq, trim(s.query) AS query, c.doc_id FROM fx_clicks c JOIN fx_searches s USING (seq) WHERE trim(s.query) <> ''"))
def naive_click_pairs(spark, d):
    return C.naive_pairs(events(spark, d)).select("seq", "query", "doc_id")


TRUTH = "truth AS (SELECT DISTINCT lower(trim(query)) AS query, concat('d', seq % 40) AS doc_id, CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS slice FROM fx_searches)"


@query(
    "label_quality",
    oracle(LOG_VIEWS, LOG + f""", {TRUTH}, got AS (SELECT g.key AS query, g.doc_id, t.slice, t.query IS NOT NULL AS ok FROM grouped g LEFT JOIN truth t ON g.key = t.query AND g.doc_id = t.doc_id),
 w AS (SELECT DISTINCT query FROM truth WHERE slice = 'odd')
 SELECT (SELECT round(avg(ok::INT), 6) FROM got) AS precision, (SELECT round(avg((h.query IS NOT NULL)::INT), 6) FROM w LEFT JOIN (SELECT DISTINCT query FROM got WHERE ok AND slice = 'odd') h USING (query)) AS recall"""),
)
def label_quality(spark, d):
    truth = fx(spark, d, "fx_searches").select(
        F.trim("query").alias("query"), F.concat(F.lit("d"), F.col("seq") % 40).alias("doc_id"), F.when(F.col("seq") % 2 == 0, "even").otherwise("odd").alias("slice")
    )
    return rounded(C.label_quality(C.pairs(C.labels(events(spark, d))), truth, "odd"))


@query("pii_queries", oracle("fx_searches", f"SELECT seq, {PII} AS pii FROM fx_searches"))
def pii_queries(spark, d):
    return fx(spark, d, "fx_searches").select("seq", T.has_pii(F.col("query")).alias("pii"))


@query(
    "records_to_pairs",
    oracle("fx_records fx_corpus", """SELECT r.seq, CASE WHEN trim(query) = '' THEN 'no query' WHEN r.doc_id <> '' AND c.doc_id IS NULL THEN 'unknown document' WHEN coalesce(r.doc_id, '') = '' AND coalesce(content, '') = '' THEN 'no document' END AS reason,
 md5(CASE WHEN trim(query) = '' THEN NULL WHEN r.doc_id <> '' THEN c.text ELSE content END) AS positive FROM fx_records r LEFT JOIN fx_corpus c ON r.doc_id = c.doc_id"""),
)
def records_to_pairs(spark, d):
    out = I.resolved_pairs(fx(spark, d, "fx_records"), fx(spark, d, "fx_corpus"))
    return out.select("seq", "reason", F.md5("positive.content").alias("positive"))


@query(
    "known_negatives",
    oracle("fx_searches", """n AS (SELECT seq, i, CAST((seq * 7 + i * 31) % 1300 AS VARCHAR) AS doc_id FROM fx_searches CROSS JOIN (VALUES (0), (1), (2), (3)) t(i))
 SELECT seq, string_agg(n.doc_id, ' ' ORDER BY i) AS negatives FROM n JOIN documents c ON n.doc_id = CAST(c.doc_id AS VARCHAR) GROUP BY seq"""),
)
def known_negatives(spark, d):
    ids = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("seq") * 7 + i * 31) % 1300).cast("string"))
    rows = fx(spark, d, "fx_searches").select("seq", ids.alias("negatives"))
    return I.known_negatives(rows, fx(spark, d, "fx_corpus")).select("seq", F.array_join("negatives", " ").alias("negatives"))


TAKEN = "taken AS (SELECT CAST(event_id AS BIGINT) AS id FROM events WHERE event_id % 3 = 1)"
NEWQ = f"""{TAKEN}, good AS (SELECT r.seq, trim(query) AS query, r.doc_id FROM fx_records r JOIN documents c ON r.doc_id = CAST(c.doc_id AS VARCHAR) WHERE trim(query) <> ''),
firsts AS (SELECT min(seq) AS seq, arg_min(query, seq) AS text FROM good GROUP BY lower(query)),
nums AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM firsts),
free AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT range AS id FROM range(1, 1 + (SELECT count(*) FROM firsts) + (SELECT count(*) FROM taken))) WHERE id NOT IN (SELECT id FROM taken)),
newq AS (SELECT concat('q-user-', id) AS query_id, text, seq FROM nums JOIN free USING (n))"""


def taken_ids(spark, d):
    return fx(spark, d, "events").filter("event_id % 3 = 1").select(F.concat(F.lit("q-user-"), F.col("event_id")).alias("query_id"))


@query("new_query_ids", oracle("fx_records", NEWQ + " SELECT query_id, text, seq FROM newq"))
def new_query_ids(spark, d):
    return I.new_queries(I.judgable(fx(spark, d, "fx_records"), fx(spark, d, "fx_corpus")), taken_ids(spark, d))


@query(
    "records_to_judgments",
    oracle("fx_records", NEWQ + " SELECT DISTINCT query_id, doc_id, 1.0::DOUBLE AS gain FROM good r JOIN newq n ON lower(r.query) = lower(n.text)"),
)
def records_to_judgments(spark, d):
    records = I.judgable(fx(spark, d, "fx_records"), fx(spark, d, "fx_corpus"))
    return I.judged(records, I.new_queries(records, taken_ids(spark, d)))


OLD = "old AS (SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, 2.0::DOUBLE AS gain FROM fx_vec_qrels WHERE doc_id % 2 = 0)"
NEW = "new AS (SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, 1.0::DOUBLE AS gain FROM fx_vec_qrels WHERE doc_id % 3 = 0)"


@query("merged_judgments", oracle("fx_vec_qrels", f"{OLD}, {NEW} SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (query_id, doc_id)"))
def merged_judgments(spark, d):
    qrels = fx(spark, d, "fx_vec_qrels").select(F.col("query_id").cast("string"), F.col("doc_id").cast("string"), "gain")
    old = qrels.filter("doc_id % 2 = 0").withColumn("gain", F.lit(2.0))
    return I.merged_judgments(old, qrels.filter("doc_id % 3 = 0"))


@query(
    "committed_judgments",
    oracle("fx_records fx_corpus", """SELECT query, CASE WHEN count(*) FILTER (c.doc_id IS NULL) = 0 THEN count(*) ELSE 0 END AS committed, count(*) FILTER (c.doc_id IS NULL) AS unknown
 FROM fx_records r LEFT JOIN fx_corpus c ON r.doc_id = c.doc_id WHERE r.doc_id <> '' GROUP BY query"""),
)
def committed_judgments(spark, d):
    chosen = fx(spark, d, "fx_records").filter("doc_id <> ''").select("query", "doc_id")
    return I.committed_judgments(chosen, fx(spark, d, "fx_corpus"))


CHOSEN = f"""chosen AS (SELECT seq, query, doc_id FROM fx_records WHERE doc_id <> '' AND seq % 5 < 2),
whole AS (SELECT query FROM chosen c LEFT JOIN fx_corpus d USING (doc_id) GROUP BY query HAVING count(*) FILTER (d.doc_id IS NULL) = 0),
good AS (SELECT seq, trim(query) AS query, doc_id FROM chosen WHERE query IN (SELECT query FROM whole) AND trim(query) <> ''),
{NEWQ.split("firsts AS", 1)[0].split("good AS", 1)[0].rstrip().rstrip(",")}, firsts AS {NEWQ.split("firsts AS", 1)[1]},
added AS (SELECT DISTINCT query_id, doc_id FROM good g JOIN newq n ON lower(g.query) = lower(n.text)),
old AS (SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, 2.0::DOUBLE AS gain FROM fx_vec_qrels)"""


def committed(spark, d):
    rows = fx(spark, d, "fx_records")
    chosen = rows.filter("doc_id <> '' AND seq % 5 < 2").select("seq", "query", "doc_id")
    qrels = fx(spark, d, "fx_vec_qrels").select(F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.lit(2.0).alias("gain"))
    there = rows.filter("content IS NOT NULL").select("seq", "query", "content")
    return I.commit(chosen, fx(spark, d, "fx_corpus"), taken_ids(spark, d), qrels, there)


@query("committed_rows", oracle("fx_records fx_corpus fx_vec_qrels", CHOSEN + " SELECT * FROM old UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE AS gain FROM added"))
def committed_rows(spark, d):
    """All judgments after a batch of choices."""
    return committed(spark, d)[1]


@query(
    "committed_pairs",
    oracle("fx_records fx_corpus fx_vec_qrels", CHOSEN + """ SELECT min(g.seq) AS seq, lower(g.query) AS query, md5(trim(c.text)) AS content FROM good g JOIN fx_corpus c ON c.doc_id = g.doc_id
 WHERE NOT EXISTS (SELECT 1 FROM fx_records o WHERE o.content IS NOT NULL AND lower(trim(o.query)) = lower(g.query) AND trim(o.content) = trim(c.text)) GROUP BY lower(g.query), trim(c.text)"""),
)
def committed_pairs(spark, d):
    """Training pairs that a batch of choices adds."""
    return committed(spark, d)[2].select("seq", F.lower("query").alias("query"), F.md5(F.trim("content")).alias("content"))


@query(
    "appended_pairs",
    oracle("fx_records", """new AS (SELECT * FROM fx_records WHERE seq % 2 = 0 AND content IS NOT NULL), old AS (SELECT * FROM fx_records WHERE seq % 10 = 1 AND content IS NOT NULL)
 SELECT min(seq) AS seq, arg_min(query, seq) AS query, arg_min(content, seq) AS content FROM new
 WHERE NOT EXISTS (SELECT 1 FROM old WHERE trim(lower(old.query)) = trim(lower(new.query)) AND trim(old.content) = trim(new.content)) GROUP BY trim(lower(query)), trim(content)"""),
)
def appended_pairs(spark, d):
    rows = fx(spark, d, "fx_records").filter("content IS NOT NULL").select("seq", "query", "content")
    return I.appended(rows.filter("seq % 10 = 1"), rows.filter("seq % 2 = 0"))


LAST = "last AS (SELECT text, arg_max(doc_id, seq) AS found_id FROM fx_corpus GROUP BY text)"


@query("pairs_by_content", oracle("fx_pairs fx_corpus", f"{LAST} SELECT seq, doc_id, found_id FROM fx_pairs p LEFT JOIN last ON p.content = last.text"))
def pairs_by_content(spark, d):
    return I.by_content(fx(spark, d, "fx_pairs"), fx(spark, d, "fx_corpus")).select("seq", "doc_id", "found_id")


@query(
    "hits_to_ids",
    oracle("fx_pairs fx_corpus", f"""{LAST}, h AS (SELECT seq % 50 AS query_id, seq // 50 AS rank, content FROM fx_pairs),
 b AS (SELECT query_id, found_id AS doc_id, min(rank) AS place FROM h JOIN last ON h.content = last.text GROUP BY 1, 2)
 SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS rank FROM b QUALIFY rank <= 10"""),
)
def hits_to_ids(spark, d):
    hits = fx(spark, d, "fx_pairs").selectExpr("seq % 50 AS query_id", "seq div 50 AS rank", "title", "content")
    return I.hits_to_ids(hits, fx(spark, d, "fx_corpus"), 10)


@query("distinct_queries", oracle("fx_pairs", r"SELECT min(seq) AS seq, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS key FROM fx_pairs GROUP BY 2"))
def distinct_queries(spark, d):
    return I.distinct_queries(fx(spark, d, "fx_pairs")).select("seq", T.normal_query(F.col("query")).alias("key"))


@query(
    "generated_lines",
    oracle("", r"""l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
 c AS (SELECT conv_id, turn, i, trim(line) AS line FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM c WHERE length(line) > 3)
 SELECT conv_id, turn, n, line FROM k WHERE n <= 3"""),
)
def generated_lines(spark, d):
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit('. "'), x, F.lit('" ')))
    clean = F.filter(F.transform(marked, T.clean_line), lambda x: F.length(x) > 3)
    rows = fx(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.slice(clean, 1, 3)).alias("i", "line"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).cast("bigint").alias("n"), "line")


@query(
    "split_by_document",
    oracle("fx_pairs", f"""docs AS (SELECT DISTINCT doc_id FROM fx_pairs), r AS (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql("'7'", "doc_id")}, doc_id) AS n FROM docs)
 SELECT seq, p.doc_id, n <= round_even((SELECT count(*) FROM docs) * 0.25, 0) AS test FROM fx_pairs p JOIN r USING (doc_id)"""),
)
def split_by_document(spark, d):
    return I.split_by_document(fx(spark, d, "fx_pairs"), seed=7).select("seq", "doc_id", "test")


@query(
    "split_pairs",
    oracle("fx_pairs", f"""SELECT seq, row_number() OVER (ORDER BY {draw_sql("'3'", "seq")}, seq) <= greatest(1, round_even((SELECT count(*) FROM fx_pairs) * 0.2, 0)) AS test FROM fx_pairs"""),
)
def split_pairs(spark, d):
    return I.split_pairs(fx(spark, d, "fx_pairs"), seed=3).select("seq", "test")


SPLIT = f"""marked AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY {draw_sql("'5'", "doc_id", "query_id")}, query_id) AS place FROM fx_vec_qrels),
final AS (SELECT DISTINCT query_id FROM marked WHERE n > 1 AND place <= greatest(1, round_even(n * 0.3, 0))),
splitted AS (SELECT q.query_id, q.doc_id, CASE WHEN f.query_id IS NULL THEN 'dev' ELSE 'final' END AS split FROM fx_vec_qrels q LEFT JOIN final f USING (query_id))"""


@query("split_judgments", oracle("fx_vec_qrels", SPLIT + " SELECT * FROM splitted"))
def split_judgments(spark, d):
    return I.split_judgments(fx(spark, d, "fx_vec_qrels"), fraction=0.3, seed=5).select("query_id", "doc_id", "split")


@query(
    "haystack",
    oracle("fx_corpus fx_qrels", f"""gold AS (SELECT DISTINCT doc_id FROM fx_qrels) SELECT doc_id FROM gold UNION ALL
 (SELECT doc_id FROM fx_corpus ANTI JOIN gold USING (doc_id) ORDER BY {draw_sql("'1'", "doc_id")}, doc_id LIMIT 50)"""),
)
def haystack(spark, d):
    return I.haystack(fx(spark, d, "fx_corpus").select("doc_id"), fx(spark, d, "fx_qrels"), 50, seed=1)


@query(
    "eval_set",
    oracle("fx_pairs fx_corpus", """pages AS (SELECT text, max_by(concat('page-', n), n) AS doc_id FROM (SELECT text, row_number() OVER (ORDER BY seq) AS n FROM fx_corpus) GROUP BY text)
 SELECT concat('q-test-', row_number() OVER (ORDER BY p.seq)) AS query_id, query, pages.doc_id FROM fx_pairs p LEFT JOIN pages ON p.content = pages.text"""),
)
def eval_set(spark, d):
    return I.eval_set(fx(spark, d, "fx_pairs"), fx(spark, d, "fx_corpus"))


@query(
    "alias_leaks",
    oracle("fx_corpus", "SELECT q.alias, d.doc_id FROM (SELECT DISTINCT text AS alias FROM benchmark) q JOIN fx_corpus d ON contains(lower(d.text), lower(q.alias))"),
)
def alias_leaks(spark, d):
    return I.leaks(fx(spark, d, "benchmark").select(F.col("text").alias("alias")), fx(spark, d, "fx_corpus"))


@query(
    "query_overlap",
    oracle("fx_pairs", r"""k AS (SELECT seq, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS query FROM fx_pairs) SELECT query FROM k WHERE seq % 2 = 0 INTERSECT SELECT query FROM k WHERE seq % 2 = 1"""),
)
def query_overlap(spark, d):
    pairs = fx(spark, d, "fx_pairs")
    return I.overlap(pairs.filter("seq % 2 = 0"), pairs.filter("seq % 2 = 1"))
