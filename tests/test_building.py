"""Click logs, ingest, pages, registries, stores and streams on small cases."""

import pytest
from pyspark.sql import functions as F

from searchloom.operators import clicklog as C
from searchloom.operators import ingest as I
from searchloom.operators import mining as N
from searchloom.operators import pages as P
from searchloom.operators import runs as G
from searchloom.operators import vectors as V
from searchloom.plans import building
from searchloom.session import scratch
from searchloom.sources import files as S
from searchloom.streaming import jobs as X

EVENT = "seq bigint, session string, query string, results array<string>, clicks array<struct<doc_id:string,rank:int,dwell_sec:double>>"


def events(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT)


def got(df):
    return {(r["query"], r["doc_id"]): (r["count"], r["negatives"]) for r in df.collect()}


def test_clicklog_rules(spark):
    log = events(
        spark,
        ("s", "me a@b.co", ["x"], [("x", 1, 99.0)]),  # personal data
        ("s", "Printer", ["a", "b", "c", "d"], [("a", 1, 3.0)]),  # a bounce
        ("s", "printer fix", ["s1", "s2", "s3", "d"], [("d", 4, 60.0)]),
        ("t", "lost", ["a"], []),  # abandoned
        (None, "Printer Fix", ["d"], [("d", 1, 30.0)]),  # a session of its own
        ("u", "", ["d"], [("d", 1, 30.0)]),
    )
    assert got(C.pairs(C.labels(log))) == {("printer fix", "d"): (2, ["s2", "s3"]), ("Printer", "d"): (1, [])}
    assert got(C.pairs(C.labels(log, transfer=False))) == {("printer fix", "d"): (2, ["s2", "s3"])}
    assert set(got(C.pairs(C.labels(log), min_count=2))) == {("printer fix", "d")}
    r = C.report(log).first()
    assert (r["events"], r["dropped_pii"], r["bounces_ignored"], r["abandoned_sessions"], r["direct_pairs"], r["transferred_pairs"]) == (6, 1, 1, 1, 2, 1)
    assert C.naive_pairs(log).count() == 4


def test_ingest(spark):
    corpus = spark.createDataFrame([("d1", "T", "one", 1), ("d2", None, "two", 2)], "doc_id string, title string, text string, seq bigint")
    records = spark.createDataFrame(
        [(1, "A", "d1", None, None), (2, "b", None, None, "own"), (3, "c", "nope", None, "own"), (4, "a", "d2", None, None), (5, "d", None, None, None)],
        "seq bigint, query string, doc_id string, title string, content string",
    )
    out = {r["seq"]: (r["positive"], r["reason"]) for r in I.resolved_pairs(records, corpus).collect()}
    assert out[1][0]["content"] == "one" and out[2][0]["content"] == "own"
    assert out[3][1] == "unknown document" and out[5][1] == "no document"
    taken = spark.createDataFrame([("q-user-1",), ("q-7",)], "query_id string")
    new = I.new_queries(records, taken)
    assert [(r["query_id"], r["text"]) for r in new.orderBy("seq").collect()][:2] == [("q-user-2", "A"), ("q-user-3", "b")]
    assert {(r["query_id"], r["doc_id"]) for r in I.judged(records, new).collect()} == {("q-user-2", "d1"), ("q-user-2", "d2"), ("q-user-4", "nope")}


def test_lines(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "line_no int, value string")
    ranked, bad = S.trec_run(lines("q1 Q0 d1 1 9 t", "q1 Q0 d2 2 8 t", "q1 Q0 d1 3 7 t", "q1 Q0"))
    assert [(r["doc_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [("d1", 1), ("d2", 2)] and bad.count() == 1
    good, bad = S.log_records(lines('{"query":"a","doc_id":"d"}', "", "{oops", '{"doc_id":"d"}'))
    assert [(r["line_no"], r["query"]) for r in good.orderBy("line_no").collect()] == [(1, "a"), (4, None)] and [r["line_no"] for r in bad.collect()] == [3]
    good, bad = S.log_records(lines(" query ,doc_id", '"two', 'lines, ""x""",d1', "  b , d2 ,more", ",d3", " , ", "c"))
    assert [tuple(r)[:3] for r in good.orderBy("line_no").collect()] == [(2, 'two\nlines, "x"', "d1"), (4, "b", "d2"), (7, "c", "")]
    assert [r["line_no"] for r in bad.collect()] == [5]
    good, bad = S.log_records(lines("a,d1", "b,d2"))
    assert [(r["query"], r["doc_id"]) for r in good.orderBy("line_no").collect()] == [("a", "d1"), ("b", "d2")]
    log = lines("{'loss': '0.5', 'epoch': 1.0}", "{'loss': 0.25}", "[epoch] 1/3 eval_loss=- ndcg@10=0.5 best=1", "[train] summary best_epoch=2 ran=3 early_stopped=yes", "saved fine-tuned model to out/x-e2 ")
    assert [tuple(r) for r in S.loss_points(log).orderBy("step").collect()] == [(1, 1.0, 0.5), (2, 2.0, 0.25)]
    e = S.epoch_points(log).first()
    assert e["eval_loss"] is None and e["ndcg"] == 0.5
    o = S.log_outcome(log).first()
    assert (o["best_epoch"], o["early_stopped"], o["saved"]) == (2, "yes", "out/x-e2")


def test_pages(spark):
    page = lambda u, h: spark.createDataFrame([(1, u, h)], "seq bigint, url string, html string")
    html = '<a href="/x?b=1#f"></a><a href="y.html"></a><a href="../z"></a><a href="mailto:a@b"></a><a href="/f.hwp"></a><a href="http://o.com/"></a><a href="HTTP://S.com/q"></a>'
    found = [r["target"] for r in P.links(page("http://s.com/a/b", html)).orderBy("i").collect()]
    assert found == ["http://s.com/x?b=1", "http://s.com/a/y.html", "http://s.com/z", "http://s.com/q"]
    html = "".join(f"<a class='k' href='{h}'>" for h in ("../../../../x", "../../e/../f/./g?h=../i#j", "./", "..", "d/e/../../.."))
    found = [r["target"] for r in P.links(page("http://s.com/a/b/c/d.html", html)).orderBy("i").collect()]
    assert found == ["http://s.com/x", "http://s.com/a/f/g?h=../i", "http://s.com/a/b/c/", "http://s.com/a/b/", "http://s.com/a/b/"]
    rows = [(i, "shared" if i < 12 else "unique", f"body {i} " + "x" * 200) for i in range(13)]
    out = {r["seq"]: r for r in P.finalized(spark.createDataFrame(rows, "seq bigint, description string, content string"), 100).collect()}
    assert out[0]["description"] is None and out[12]["content"].startswith("unique\n\nbody") and len(out[12]["content"]) == 100


def test_pruning(spark):
    rows = [(i, e, 0.1 * i + 0.01 * e, 1.0, "evaluated") for i in range(4) for e in (1, 2, 3)] + [(9, e, 0.01, 1.0, "running") for e in (1, 2, 3)]
    v = {(r["run_idx"], r["epoch"]): r["prune"] for r in G.prune_verdicts(spark.createDataFrame(rows, "run_idx int, epoch int, ndcg double, eval_loss double, status string")).collect()}
    assert not v[9, 1] and v[9, 2] and v[9, 3] and not v[3, 3]


def test_negatives(spark):
    rows = spark.createDataFrame([(1, "p1", ["a", "b", "c"]), (2, "p2", []), (3, "p3", ["a"])], "seq int, positive string, negatives array<string>")
    out = {r["seq"]: r for r in N.padded(rows).collect()}
    assert all(len(r["negatives"]) == 3 and r["positive"] not in r["negatives"] for r in out.values())
    assert out[3]["negatives"][0] == "a" and out[2]["padded"] and not out[1]["padded"]
    assert all(len(r["negatives"]) == 1 for r in N.padded(rows, cap=1).collect())
    assert all(r["negatives"] == [] for r in N.padded(rows.withColumn("negatives", F.slice("negatives", 1, 0))).collect())


def test_store(spark):
    pts = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 3, [1.0, 1.0])], "point_id string, seq int, embedding array<float>")
    store = V.VectorStore(spark, scratch(spark, "store"))
    with pytest.raises(ValueError):
        store.searchable("p", 2)
    name, written = store.publish("p", "M 1", 2, None, lambda: pts, 2)
    assert name == "p__m-1__2d__nofp" and written and not store.publish("p", "M 1", 2, None, lambda: pts, 2)[1]
    other, _ = store.publish("p", "M 2", 2, None, lambda: pts, 2)
    assert store.live("p") == other
    store.point("p", name)
    with pytest.raises(ValueError):
        store.point("p", "q__m__2d__x")
    with pytest.raises(ValueError):
        store.searchable("p", 3)
    assert store.prune("p") == [other] and store.versions() == [name]
    with pytest.raises(RuntimeError):
        store.publish("p", "M 3", 2, None, lambda: pts, 5)
    assert store.live("p") == name


def test_stream_is_batch(spark):
    d = "/root/testdata/sf0.001"
    ts = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    rows = building.events(spark, d).join(ts, "seq").select("ts", "session", "seq", "query", "results", "clicks")
    path = scratch(spark, "feed")
    rows.write.parquet(path)
    streamed = X.stream_labels(spark, spark.readStream.schema(rows.schema).parquet(path))
    have = sorted((r["seq"], r["kind"], r["query"], r["doc_id"]) for r in streamed.collect())
    gap = F.session_window("ts", "30 minutes")
    whole = rows.groupBy("session", gap.alias("w")).agg(F.collect_list(F.struct("seq", "query", "results", "clicks")).alias("events"))
    # the watermark is an hour behind the last event; sessions that end by then are closed
    end = rows.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    closed = whole.filter(F.col("w.end") <= F.lit(end))
    assert 0 < closed.count() < whole.count()
    batch = X.session_labels(closed.select(F.concat_ws("@", "session", F.col("w.start").cast("string")).alias("session"), "events"))
    assert have == sorted((r["seq"], r["kind"], r["query"], r["doc_id"]) for r in batch.collect())


def test_splits(spark):
    pairs = spark.createDataFrame([(i, f"d{i % 8}") for i in range(40)], "seq int, doc_id string")
    out = I.split_by_document(pairs).collect()
    assert len({r["doc_id"] for r in out if r["test"]}) == 2
    assert not {r["doc_id"] for r in out if r["test"]} & {r["doc_id"] for r in out if not r["test"]}
    q = spark.createDataFrame([(f"q{i}", f"d{i % 3}", 1.0) for i in range(12)], "query_id string, doc_id string, gain double")
    s = I.split_judgments(q).collect()
    assert {r["doc_id"] for r in s if r["split"] == "final"} == {r["doc_id"] for r in s if r["split"] == "dev"} == {"d0", "d1", "d2"}


def test_blank_queries_and_sessions(spark):
    log = events(
        spark,
        ("s", "   ", ["a"], [("a", 1, 99.0)]),
        ("s", "VPN ", ["d"], [("d", 1, 60.0)]),
        ("s", " vpn", ["d"], [("d", 1, 60.0)]),
        ("", "alone", ["x"], []),
        ("", "other", ["y"], [("y", 1, 60.0)]),
        (None, "third", ["y"], []),
    )
    assert got(C.pairs(C.labels(log))) == {("VPN", "d"): (2, []), ("other", "y"): (1, [])}
    r = C.report(log).first()
    assert (r["events"], r["sessions"], r["abandoned_sessions"]) == (6, 4, 2)
    assert sorted(x["query"] for x in C.naive_pairs(log).collect()) == ["VPN", "other", "vpn"]


def test_committing(spark):
    corpus = spark.createDataFrame([("d1", None, "one", 1), ("d2", None, "two", 2)], "doc_id string, title string, text string, seq bigint")
    chosen = spark.createDataFrame([(1, "Ask ", "d1"), (2, "Ask ", "d2"), (3, "bad", "d1"), (4, "bad", "gone"), (5, "  ", "d1")], "seq bigint, query string, doc_id string")
    queries = spark.createDataFrame([("q-user-1",)], "query_id string")
    qrels = spark.createDataFrame([("q-user-1", "d1", 3.0)], "query_id string, doc_id string, gain double")
    pairs = spark.createDataFrame([(9, "ask", " one")], "seq bigint, query string, content string")
    fresh, judged, added = I.commit(chosen, corpus, queries, qrels, pairs)
    assert [(r["query_id"], r["text"]) for r in fresh.collect()] == [("q-user-2", "Ask")]
    assert {tuple(r) for r in judged.collect()} == {("q-user-1", "d1", 3.0), ("q-user-2", "d1", 1.0), ("q-user-2", "d2", 1.0)}
    assert [(r["query"], r["content"]) for r in added.collect()] == [("Ask", "two")]


def test_borrowing_until_the_pool_is_empty(spark):
    rows = [(0, "p0", [f"n{i}" for i in range(30)])] + [(i, f"p{i}", ["n1"]) for i in range(1, 6)]
    out = {r["seq"]: r["negatives"] for r in N.padded(spark.createDataFrame(rows, "seq int, positive string, negatives array<string>")).collect()}
    pool = {f"n{i}" for i in range(30)} | {f"p{i}" for i in range(6)}
    for i in range(1, 6):
        assert len(set(out[i])) == 30 and out[i][0] == "n1" and set(out[i]) <= pool - {f"p{i}"}
    few = [(0, "a", ["b", "c", "d", "e", "f"]), (1, "b", ["c"])]
    out = {r["seq"]: r["negatives"] for r in N.padded(spark.createDataFrame(few, "seq int, positive string, negatives array<string>")).collect()}
    assert set(out[1]) == {"a", "c", "d", "e", "f"}
    tiny = [(0, "a", ["b", "b", "b"]), (1, "b", ["a"])]
    out = {r["seq"]: r["negatives"] for r in N.padded(spark.createDataFrame(tiny, "seq int, positive string, negatives array<string>")).collect()}
    assert out[1] == ["a", "a", "a"]  # nothing left to borrow


def test_store_is_whole_at_any_time(spark):
    pts = lambda *x: spark.createDataFrame(list(x), "point_id string, seq int, embedding array<float>")
    store = V.VectorStore(spark, scratch(spark, "store"))
    store.publish("p", "m", 1, "f", lambda: pts(("a", 1, [1.0]), ("b", 1, [2.0])), 2)
    name = store.live("p")
    before = store.scan(name)
    store.upsert(name, pts(("b", 2, [3.0]), ("c", 1, [4.0])))
    assert {(r[0], r[2][0]) for r in store.scan(name).collect()} == {("a", 1.0), ("b", 3.0), ("c", 4.0)}
    assert before.count() == 2  # a reader keeps what it began with
    other = store.publish("p", "m2", 1, "f", lambda: pts(("z", 1, [1.0])), 1)[0]
    # what was begun and never committed does not count
    pts(("y", 1, [9.0])).write.parquet(store._log(other).fresh())
    spark.createDataFrame([("{}",)], "value string").write.text(f"{store.root}/live/p/tried/x")
    assert store.live("p") == other and store.scan(other).count() == 1
    store.point("p", name)
    assert store.live("p") == name and store.prune("p") == [other] and store.live("p") == name and store.scan(name).count() == 3
    shown = store.status("p", 1, "m").collect()
    assert [(r["points"], r["live"], r["dim_matches"], r["model_matches"]) for r in shown] == [(3, True, True, True)]


def test_registry_survives_a_crash(spark):
    run = lambda *ids: spark.createDataFrame([(i, "t", "m", "", 0.5, n) for n, i in enumerate(ids)], "id string, created_at string, model string, label string, ndcg double, seq bigint")
    reg = S.RunRegistry(spark, scratch(spark, "reg"), "id string, created_at string, model string, label string, ndcg double, seq bigint")
    assert reg.scan().count() == 0
    reg.append(run("a", "b"))
    reg.append(run("c"))
    assert [r["id"] for r in reg.newest().collect()] == ["c", "b", "a"] and reg.get("b").count() == 1
    assert reg.delete("b") == 2 and reg.delete("nowhere") == 2
    reg.append(run("d"))
    run("x").write.json(reg.log.fresh())  # never committed
    assert [r["id"] for r in reg.newest().collect()] == ["d", "c", "a"] and reg.scan().first()["label"] == "m"


def test_many_splits(spark):
    rows = spark.range(3000).selectExpr("concat('q', id) AS query_id", "'d' AS doc_id", "1.0D AS gain", "concat('s', id % 300) AS split")
    assert S.split_rows(rows, "s299").count() == 10
    with pytest.raises(ValueError):
        S.split_rows(rows, "final")
    with pytest.raises(ValueError):
        S.split_rows(rows, "dev")
    assert S.split_rows(rows.withColumn("split", F.lit("test")), "dev").count() == 3000


def test_topics(spark):
    from searchloom.functions.text import topic

    ids = {"q-3-1": "3", "q-3-1-2": "3", "q-3": None, "x-3-1": None, "q": None}
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r[0]: r[1] for r in df.select("id", topic(F.col("id"))).collect()} == ids


def brute_verdicts(rows, metric):
    """The pruning rule, run by run."""
    pick, index = (max, 2) if metric == "ndcg" else (min, 3)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)

    def best(run, epoch):
        seen = [r[index] for r in by[run] if r[1] <= epoch and r[index] is not None]
        return pick(seen) if seen else None

    out = {}
    for run, epoch, *_ in rows:
        peers = sorted(v for p in by if p != run and by[p][0][4] in ("trained", "evaluated") and (v := best(p, epoch)) is not None)
        n = len(peers)
        median = None if not n else peers[n // 2] if n % 2 else (peers[n // 2 - 1] + peers[n // 2]) / 2
        own = best(run, epoch)
        trails = own is not None and n >= 3 and epoch >= 2 and (own < median - 1e-4 if metric == "ndcg" else own > median + 1e-4)
        out[run, epoch] = (own, median, trails)
    return out


@pytest.mark.parametrize("metric", ["ndcg", "loss"])
def test_verdicts_of_ragged_runs(spark, metric):
    import random

    rng, rows = random.Random(7), []
    for run in range(9):
        status = "running" if run in (2, 5) else rng.choice(("trained", "evaluated"))
        for epoch in sorted(rng.sample(range(1, 40), rng.randint(1, 12))):
            rows.append((run, epoch, rng.choice((None, rng.random())), rng.choice((None, rng.random(), 0.5)), status))
    df = spark.createDataFrame(rows, "run_idx int, epoch int, ndcg double, eval_loss double, status string")
    got_ = {(r["run_idx"], r["epoch"]): (r["best"], r["median"], r["prune"]) for r in G.prune_verdicts(df, metric).collect()}
    want = brute_verdicts(rows, metric)
    assert got_.keys() == want.keys()
    for k, (own, median, prune) in want.items():
        assert got_[k][0] == own and got_[k][2] == prune and (median is None) == (got_[k][1] is None)
        assert median is None or abs(median - got_[k][1]) < 1e-12


def test_stream_verdicts_are_the_batch_ones(spark):
    from searchloom.plans import data
    from searchloom.plans.fixtures import fx

    d = "/root/testdata/sf0.001"
    epochs = fx(spark, d, "fx_epochs")
    live = {(r["run_idx"], r["epoch"]) for r in epochs.filter("status = 'running'").collect()}
    want = {(r["run_idx"], r["epoch"], r["prune"]) for r in G.prune_verdicts(epochs).collect() if (r["run_idx"], r["epoch"]) in live}
    assert {(r["run_idx"], r["epoch"], r["prune"]) for r in data.stream_prune_verdicts(spark, d).collect()} == want and want


def test_streams_keep_the_first_of_each(spark):
    """In several batches, with keys that come again in the same batch and in later ones."""
    path = scratch(spark, "feed")
    rows = [(i, ("A " if i % 2 else "a") + str(i % 7), f"t{i % 5}") for i in range(200)]
    for at in range(0, 200, 50):
        spark.createDataFrame(rows[at : at + 50], "seq bigint, query string, content string").repartition(2).write.mode("append").parquet(path)
    old = spark.createDataFrame([(0, " A3", "t1 ")], "seq bigint, query string, content string")
    stream = spark.readStream.schema(old.schema).option("maxFilesPerTrigger", 2).parquet(path)
    got_ = {tuple(r) for r in X.stream_appended(spark, stream, old).collect()}
    assert len({(q.strip().lower(), c) for _, q, c in got_}) == len(got_)
    want = {tuple(r) for r in I.appended(old, spark.createDataFrame(rows, old.schema)).collect()}
    assert {(q.strip().lower(), c) for _, q, c in got_} == {(q.strip().lower(), c) for _, q, c in want}


def test_encoder(spark):
    encode = N.hashed_encoder(32)
    a, b, c = encode(["the same text", "the same text", "another thing"])
    assert (a == b).all() and abs(a @ a - 1) < 1e-6 and abs(a @ c) < 0.9
    rows = spark.createDataFrame([(1, "the same text"), (2, None)], "doc_id int, text string")
    out = {r["doc_id"]: r["embedding"] for r in N.embedded(rows, lambda: N.hashed_encoder(32), 32).collect()}
    assert max(abs(x - y) for x, y in zip(out[1], a, strict=True)) < 1e-6 and not any(out[2])
    with pytest.raises(Exception, match="dimensions"):
        N.embedded(rows, lambda: N.hashed_encoder(16), 32).collect()


def test_running_values(spark):
    import random

    from searchloom.operators import ordering as O

    rng = random.Random(1)
    rows = [(i * 1000, rng.choice((None, None, f"v{i}")), rng.randint(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "line_no bigint, v string, n bigint").repartition(5)
    out = O.summed_before(O.carried(df, "last", F.col("v")), "sum", F.col("n")).orderBy("line_no").collect()
    last, total = None, 0
    for (_, v, n), r in zip(rows, out, strict=True):
        last = v or last
        assert (r["last"], r["sum"]) == (last, total)
        total += n
    hot = spark.range(5000).selectExpr("id % 2 AS k", "id").repartition(7)
    got_ = [(r["n"], r["id"]) for r in O.numbered(hot, "n", F.desc("k"), "id").orderBy("n").collect()]
    assert got_ == [(i + 1, x) for i, x in enumerate([*range(1, 5000, 2), *range(0, 5000, 2)])]
    assert O.numbered(hot.limit(0), "n", "id").count() == 0


def test_containing(spark, monkeypatch):
    texts = ["abcabc", "xabc", "", None, "ABC bc", "a\nb"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    needles = ["abc", "bc", "c a", "a\nb", "", "nowhere", "abc"]
    want = {(n, i) for n in needles if n for i, t in enumerate(texts) if t and n in t}
    df = spark.createDataFrame([(n,) for n in needles], "needle string")
    for size in (1 << 20, 4):
        monkeypatch.setattr(I, "NEEDLES", size)
        found = [tuple(r) for r in I.containing(df, corpus).collect()]
        assert set(found) == want and len(found) == len(want)


def test_sketches_merge(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 24).alias("hour"), F.xxhash64("id").cast("double").alias("ms"))
    hours = G.latency_sketches(rows, "hour", k=2000)  # six times the deviation that the bound for 800 allows
    day = G.latency_quantiles(G.merged_sketches(hours)).first()
    assert day["n"] == 1_000_000 and hours.agg(F.max(F.length("sketch"))).first()[0] < 100_000
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below = rows.filter(F.col("ms") < day[name]).count() / 1_000_000
        assert abs(below - q) <= G.rank_error(800)


def test_flips_are_vectors(spark):
    """Each task gives one vector for each metric; sums are those of all rows times all flips."""
    from searchloom.functions.draws import draw
    from searchloom.operators import metrics as M

    rows = spark.createDataFrame([(m, f"q{i % 23}", (i * 7 % 11) / 10 - 0.5) for i in range(60) for m in ("a", "b")], "metric string, query_id string, delta double").repartition(3)
    got = {(r["metric"], r["b"]): r["flipped"] for r in M.flipped_sums(rows, 50, 3).collect()}
    sign = F.when(draw(3, F.col("b"), F.col("query_id")) % 2 == 0, 1).otherwise(-1)
    plain = rows.crossJoin(spark.range(50).withColumnRenamed("id", "b")).groupBy("metric", "b").agg(F.abs(F.sum(sign * F.col("delta"))).alias("s"))
    want = {(r["metric"], r["b"]): r["s"] for r in plain.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "BroadcastNestedLoopJoin" not in M.permutation_test(rows, 50)._jdf.queryExecution().toString()


def test_bootstrap_in_blocks_is_that_in_rows(spark):
    from searchloom.operators import metrics as M

    rows = [(f"q{i}", m, ((i * 37 + k) % 11) / 10) for i in range(60) for k, m in enumerate(("a", "b", "c")) if not (m == "c" and i % 4)]
    scores = spark.createDataFrame(rows, "query_id string, metric string, value double").repartition(3)
    found = [{r["metric"]: (r["lo"], r["hi"]) for r in M.bootstrap(scores, 200, 3, block).collect()} for block in (1 << 20, 0)]
    assert found[0].keys() == found[1].keys() == {"a", "b", "c"}
    assert all(abs(x - y) < 1e-9 for m in found[0] for x, y in zip(found[0][m], found[1][m], strict=True))
    assert M.bootstrap(scores.limit(0), 10).collect() == []
