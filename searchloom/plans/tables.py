"""Registered queries: pages, run registry, latency, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..operators import runs as G
from .base import query, rounded
from .fixtures import fx, oracle

CANONICAL = "regexp_replace({0}, '#.*$', '')"
CANON_SQL = "(lower(regexp_extract(regexp_replace(trim({0}), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || substr(regexp_replace(trim({0}), '#.*$', ''), length(regexp_extract(regexp_replace(trim({0}), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1))"
HOST_SQL = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query("canonical_urls", oracle("fx_pages", f"SELECT seq, {CANON_SQL.format('url')} AS url, {HOST_SQL.format('url')} AS host FROM fx_pages"))
def canonical_urls(spark, d):
    return fx(spark, d, "fx_pages").select("seq", T.canonical_url(F.col("url")).alias("url"), T.host(F.col("url")).alias("host"))


@query(
    "page_links",
    oracle("fx_pages", r"""h AS (SELECT seq, url, unnest(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]*)"', 1), 1) - 1 AS i FROM fx_pages),
 a AS (SELECT seq, i, url, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END AS t FROM h
 WHERE NOT (starts_with(href, '#') OR starts_with(href, 'javascript:') OR starts_with(href, 'mailto:') OR starts_with(href, 'tel:')))
 SELECT seq, CAST(i AS INTEGER) AS i, """ + CANON_SQL.format("t") + r""" AS target FROM a WHERE regexp_matches(t, '^https?://')
 AND NOT regexp_matches(lower(regexp_replace(t, '[?#].*$', '')), '\.(pdf|hwp|hwpx|doc|docx|xls|xlsx|zip|jpg|jpeg|png|gif|svg|mp4|mp3|css|js)$') AND """ + HOST_SQL.format("t") + " = " + HOST_SQL.format("url")),
)
def page_links(spark, d):
    return P.links(fx(spark, d, "fx_pages"))


@query(
    "sitemap_entries",
    oracle("fx_pages", f"""SELECT seq, 'urlset' AS kind, url AS loc FROM fx_pages WHERE seq % 5 <> 0 AND url NOT IN (SELECT url FROM fx_pages WHERE seq % 4 = 0)"""),
)
def sitemap_entries(spark, d):
    pages = fx(spark, d, "fx_pages")
    kind = F.when(F.col("seq") % 5 == 0, "<html>").otherwise("<urlset>")
    bodies = pages.select("seq", F.concat(kind, F.lit("<url><loc> "), "url", F.lit(" </loc></url>")).alias("body"))
    return P.sitemap_entries(bodies, pages.filter("seq % 4 = 0"))


UNESCAPE = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
EXTRACT = r"""bare AS (SELECT seq, url, html, regexp_replace(html, '(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|form|noscript)\b.*?</(script|style|nav|header|footer|aside|form|noscript)>|<div class="ad">.*?</div>', '', 'g') AS b FROM fx_pages),
arts AS (SELECT *, regexp_extract(b, '(?is)<article\b[^>]*>(.*)</article>', 1) AS a FROM bare),
lines AS (SELECT *, """ + UNESCAPE.format(r"regexp_replace(regexp_replace(a, '(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|br|section)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')") + r""" AS t FROM arts),
texts AS (SELECT seq, url, trim(""" + UNESCAPE.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)") + r""") AS title,
 array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS content FROM lines)"""


@query(
    "page_extraction",
    oracle("fx_pages", EXTRACT + " SELECT seq, title, CASE WHEN length(content) >= 200 THEN md5(content) END AS content, length(content) >= 200 AS long_enough FROM texts"),
)
def page_extraction(spark, d):
    out = P.extracted(fx(spark, d, "fx_pages"))
    return out.select("seq", "title", F.md5("content").alias("content"), F.col("content").isNotNull().alias("long_enough"))


@query(
    "deduplicated_pages",
    oracle("fx_pages", EXTRACT + ", u AS (SELECT *, " + CANON_SQL.format("url") + """ AS c FROM texts), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY c ORDER BY seq) = 1),
 g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY content ORDER BY seq) = 1) SELECT seq, url FROM g ORDER BY seq LIMIT 300"""),
)
def deduplicated_pages(spark, d):
    pages = P.extracted(fx(spark, d, "fx_pages"), min_chars=0)
    return P.deduplicated(pages, 300).select("seq", "url")


@query(
    "finalized_pages",
    oracle("fx_pages", r"""c AS (SELECT description, count(*) AS n FROM fx_pages GROUP BY 1), t AS (SELECT count(*) AS n FROM fx_pages),
 p AS (SELECT seq, html AS body, CASE WHEN description NOT IN (SELECT description FROM c, t WHERE t.n >= 10 AND c.n > 0.1 * t.n) THEN description END AS description FROM fx_pages)
 SELECT seq, description, md5(regexp_replace(substr(CASE WHEN description <> '' AND NOT starts_with(body, substr(description, 1, 40)) THEN description || chr(10) || chr(10) || body ELSE body END, 1, 2000), '\s+$', '')) AS content FROM p"""),
)
def finalized_pages(spark, d):
    pages = fx(spark, d, "fx_pages").select("seq", "description", F.col("html").alias("content"))
    return P.finalized(pages, 2000).select("seq", "description", F.md5("content").alias("content"))


POINT = """(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""


@query("point_ids", oracle("fx_pages", f"s AS (SELECT seq, sha1(unhex('{T.NAMESPACE_URL}') || encode(url)) AS h FROM fx_pages) SELECT seq, {POINT} AS point_id FROM s"))
def point_ids(spark, d):
    none = F.lit(None).cast("string")
    return fx(spark, d, "fx_pages").select("seq", T.uuid5(T.document_key(F.col("url"), none, none, none)).alias("point_id"))


@query(
    "best_per_metric",
    oracle("fx_runs", "SELECT 'ndcg' AS metric, round(max(ndcg), 6) AS best FROM fx_runs WHERE fingerprint = 'fpA' UNION ALL SELECT 'recall', round(max(ndcg * 2), 6) FROM fx_runs WHERE fingerprint = 'fpA'"),
)
def best_per_metric(spark, d):
    runs = fx(spark, d, "fx_runs").withColumn("metrics", F.create_map(F.lit("ndcg"), F.col("ndcg"), F.lit("recall"), F.col("ndcg") * 2))
    return rounded(G.best_per_metric(runs, "fpA"))


RUNS = "r AS (SELECT *, CASE WHEN run_id % 1000 = 7 THEN 'base' ELSE config END AS label FROM fx_runs)"


@query(
    "leaderboard",
    oracle("fx_runs", RUNS + """ SELECT run_id, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY ndcg DESC, run_id) AS INTEGER) AS place,
 round(ndcg - first_value(ndcg) OVER (PARTITION BY fingerprint ORDER BY CASE WHEN label = 'base' THEN 0 ELSE 1 END, created_at, run_id), 8) AS delta,
 round(ndcg - lag(ndcg) OVER (PARTITION BY fingerprint ORDER BY created_at, run_id), 8) AS trend,
 ndcg >= max(ndcg) OVER (PARTITION BY fingerprint) - 1e-9 AS champion FROM r"""),
)
def leaderboard(spark, d):
    runs = fx(spark, d, "fx_runs").withColumn("label", F.when(F.col("run_id") % 1000 == 7, "base").otherwise(F.col("config")))
    return rounded(G.leaderboard(runs).select("run_id", "place", "delta", "trend", "champion"), 8)


@query("seed_aggregates", oracle("fx_runs", "SELECT config, count(*) AS n, round(avg(ndcg), 6) AS mean, round(coalesce(stddev_samp(ndcg), 0), 6) AS std, round(avg(ndcg * 2), 6) AS recall FROM fx_runs GROUP BY config"))
def seed_aggregates(spark, d):
    return rounded(G.by_seed(fx(spark, d, "fx_runs").withColumn("recall", F.col("ndcg") * 2)))


@query("newest_runs", oracle("fx_runs", "SELECT run_id, round(ndcg, 6) AS ndcg FROM fx_runs ORDER BY created_at DESC, run_id DESC LIMIT 6"))
def newest_runs(spark, d):
    return rounded(G.newest(fx(spark, d, "fx_runs"), 6).select("run_id", "ndcg"))


@query("kept_runs", oracle("fx_runs", "SELECT run_id, row_number() OVER (ORDER BY ndcg DESC, run_id) <= 20 AS kept FROM fx_runs"))
def kept_runs(spark, d):
    return G.kept_and_flagged(fx(spark, d, "fx_runs"), 20).select("run_id", "kept")


BEST = "b AS (SELECT *, max(ndcg) OVER w AS best_ndcg, min(eval_loss) OVER w AS best_loss FROM fx_epochs WINDOW w AS (PARTITION BY run_idx ORDER BY epoch))"


@query("best_so_far", oracle("fx_epochs", BEST + " SELECT run_idx, epoch, round(best_ndcg, 6) AS best_ndcg, round(best_loss, 6) AS best_loss FROM b"))
def best_so_far(spark, d):
    return rounded(G.best_so_far(fx(spark, d, "fx_epochs")).select("run_idx", "epoch", "best_ndcg", "best_loss").withColumn("epoch", F.col("epoch").cast("bigint")))


def verdict_sql(value: str, agg: str, trails: str) -> str:
    return oracle("fx_epochs", BEST + f""", p AS (SELECT x.run_idx, x.epoch, y.run_idx AS peer, {agg}(y.{value}) AS v FROM b x JOIN b y ON y.epoch <= x.epoch AND y.run_idx <> x.run_idx
 WHERE y.status IN ('trained', 'evaluated') GROUP BY ALL), m AS (SELECT run_idx, epoch, count(v) AS peers, quantile_cont(v, 0.5) AS median FROM p GROUP BY ALL)
 SELECT run_idx, epoch, round({value}, 6) AS best, round(median, 6) AS median, coalesce(epoch >= 2 AND peers >= 3 AND {value} {trails}, false) AS prune FROM b LEFT JOIN m USING (run_idx, epoch)""")


@query("prune_verdicts", verdict_sql("best_ndcg", "max", "< median - 1e-4"))
def prune_verdicts(spark, d):
    return rounded(G.prune_verdicts(fx(spark, d, "fx_epochs")).withColumn("epoch", F.col("epoch").cast("bigint")))


@query("prune_verdicts_by_loss", verdict_sql("best_loss", "min", "> median + 1e-4"))
def prune_verdicts_by_loss(spark, d):
    return rounded(G.prune_verdicts(fx(spark, d, "fx_epochs"), "loss").withColumn("epoch", F.col("epoch").cast("bigint")))


@query(
    "latency_by_hardware",
    oracle("fx_latency", """SELECT hardware_key, phase, count(*) AS n, round(avg(ms), 2) AS mean, round(quantile_cont(ms, 0.5), 2) AS p50, round(quantile_cont(ms, 0.95), 2) AS p95,
 round(quantile_cont(ms, 0.99), 2) AS p99, round(min(ms), 2) AS min, round(max(ms), 2) AS max FROM fx_latency GROUP BY hardware_key, phase"""),
)
def latency_by_hardware(spark, d):
    """Timings are never averaged across hardware."""
    return G.latency_summary(fx(spark, d, "fx_latency"), "hardware_key", "phase")


@query("latency_by_sketch", oracle("fx_latency", "SELECT hardware_key, count(*) AS n, true AS p50_near, true AS p95_near, true AS p99_near FROM fx_latency WHERE ms IS NOT NULL GROUP BY hardware_key"))
def latency_by_sketch(spark, d):
    """Sketches of each phase merged to those of the hardware, and whether their percentiles have the
    ranks that they should: sketches of 2,000 stay within the error of those of 800, which the bound of
    99 cases in 100 alone would not warrant."""
    rows = fx(spark, d, "fx_latency").filter("ms IS NOT NULL")
    found = G.latency_quantiles(G.merged_sketches(G.latency_sketches(rows, "hardware_key", "phase", k=2000), "hardware_key"), "hardware_key")
    near = []
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below, upto = F.avg((F.col("ms") < F.col(name)).cast("double")), F.avg((F.col("ms") <= F.col(name)).cast("double"))
        near.append(((below - G.rank_error(800) <= q) & (upto + G.rank_error(800) >= q)).alias(f"{name}_near"))
    return rows.join(found, "hardware_key").groupBy("hardware_key").agg(F.count(F.lit(1)).alias("n"), *near)


@query(
    "hardware_keys",
    oracle("fx_latency", f"s AS (SELECT DISTINCT hardware_key, phase, sha1(unhex('{T.NAMESPACE_OID}') || encode(hardware_key || '|' || phase || '|linux|none')) AS h FROM fx_latency) "
    f"SELECT hardware_key, phase, substr(replace({POINT}, '-', ''), 1, 8) AS key FROM s"),
)
def hardware_keys(spark, d):
    rows = fx(spark, d, "fx_latency").select("hardware_key", "phase").distinct()
    return rows.withColumn("key", G.hardware_key(F.col("hardware_key"), F.col("phase"), F.lit("linux"), F.lit("none")))


@query(
    "footprint",
    "SELECT concat('class-', label) AS name, count(*) * 64 * 4 AS vector_bytes, 256000000::BIGINT AS bytes_per_million, round(count(*) / (label + 2.0), 1) AS docs_per_second FROM embeddings GROUP BY label",
)
def footprint(spark, d):
    stats = fx(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).alias("dim"))
    return G.footprint(stats.select(F.concat(F.lit("class-"), "label").alias("name"), "points", "dim", (F.col("label") + 2.0).alias("seconds")))


def sums(table: str, columns: str) -> str:
    parts = " || ',' || ".join(f"coalesce(CAST(sum(('0x' || substr(h, {1 + 15 * i}, 15))::UBIGINT::HUGEINT) AS VARCHAR), '0')" for i in range(4))
    return f"SELECT '{table}' AS name, {parts} AS s, count(*) AS rows FROM (SELECT sha256(concat_ws(chr(31), '{table}', {columns})) AS h FROM {table})"


@query(
    "content_fingerprint",
    oracle("", f"x AS ({sums('benchmark', 'item_id, text')} UNION ALL {sums('documents', 'doc_id, text')}) "
    "SELECT CASE WHEN min(rows) > 0 THEN substr(sha256(string_agg(name || ':' || s, ';' ORDER BY name)), 1, 12) END AS fingerprint FROM x"),
)
def content_fingerprint(spark, d):
    return G.fingerprint(documents=fx(spark, d, "documents").select("doc_id", "text"), benchmark=fx(spark, d, "benchmark").select("item_id", "text"))


@query(
    "model_shelf",
    oracle("fx_runs", """r AS (SELECT *, config AS model, CASE WHEN seed = 0 THEN 'final' WHEN seed = 1 THEN NULL ELSE 'dev' END AS split, (fingerprint = 'fpA')::INT AS cur FROM fx_runs),
 m AS (SELECT config AS model, count(*) * 10 AS bytes FROM fx_runs GROUP BY config UNION ALL SELECT 'unused', 5)
 SELECT m.model, CAST(m.bytes AS BIGINT) AS bytes, (SELECT run_id FROM r WHERE r.model = m.model AND coalesce(split, '') <> 'final' ORDER BY cur DESC, ndcg DESC, run_id DESC LIMIT 1) AS dev_run,
 (SELECT run_id FROM r WHERE r.model = m.model AND split = 'final' ORDER BY cur DESC, created_at DESC, run_id DESC LIMIT 1) AS final_run, CAST((SELECT sum(bytes) FROM m) AS BIGINT) AS total_bytes FROM m"""),
)
def model_shelf(spark, d):
    split = F.when(F.col("seed") == 0, "final").when(F.col("seed") == 1, None).otherwise("dev")
    runs = fx(spark, d, "fx_runs").withColumn("model", F.col("config")).withColumn("split", split)
    models = runs.groupBy("model").agg((F.count(F.lit(1)) * 10).alias("bytes"))
    models = models.unionByName(spark.range(1).select(F.lit("unused").alias("model"), F.lit(5).cast("bigint").alias("bytes")))
    return G.shelf(models, runs, "fpA")
