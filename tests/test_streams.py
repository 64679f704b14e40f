"""Streams in several batches: late events, state that ends, batches that come again, verdicts."""

import bisect
import time
from datetime import timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from searchloom.operators import runs as G
from searchloom.session import scratch
from searchloom.sources import commits
from searchloom.streaming import jobs as X

EVENT = "ts timestamp, session string, seq bigint, query string, results array<string>, clicks array<struct<doc_id:string,rank:int,dwell_sec:double>>"
PAIR = "seq bigint, query string, content string"


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # files are taken in order of their times


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_events_are_counted(spark):
    path, base = scratch(spark, "events"), 1_700_000_000
    event = lambda n, minute, who="a": (base + 60 * minute, who, n, f"q{n}", ["d1", "d2"], [("d2", 2, 60.0)])
    cast = lambda rows: spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts bigint")).withColumn("ts", F.timestamp_seconds("ts"))
    # what is late is told by the watermark with which the batch before began
    for rows in ([event(1, 0), event(2, 5)], [event(3, 600, "b")], [event(8, 600, "b")], [event(4, 3, "c"), event(5, 20, "d"), event(6, 590, "e")], [event(7, 1200, "f")]):
        cast(rows).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    labels, late = X.stream_labels_counted(spark, stream(spark, path, EVENT))
    assert late == 2 and sorted(r["seq"] for r in labels.collect()) == [1, 2, 3, 6, 8]


def test_state_ends_and_nothing_comes_twice(spark, monkeypatch):
    path, root = scratch(spark, "feed"), scratch(spark, "store")
    none = spark.createDataFrame([], PAIR)
    feed(spark, path, [(i, f"q{i}", "t") for i in range(40)], PAIR)
    ttl = timedelta(hours=1)
    store = X.BatchStore(spark, root)
    rows = lambda: stream(spark, path, PAIR)
    store.run(rows(), store.keep_first(["query"], "seq", ttl))
    assert store.scan(PAIR).count() == 40 and len(store.recent(ttl)) == 1
    monkeypatch.setattr(X, "time", SimpleNamespace(time=lambda: time.time() + 4000))
    assert store.recent(ttl) == []  # its keys are read no more
    monkeypatch.setattr(commits, "time", X.time)
    feed(spark, path, [(100, "q1", "t"), (101, "new", "t"), (99, "new", "t")], PAIR)
    store.run(rows(), store.keep_first(["query"], "seq", ttl))
    feed(spark, path, [(200, "new", "t")], PAIR)
    store.run(rows(), store.keep_first(["query"], "seq", ttl))
    assert sorted(r["seq"] for r in store.scan(PAIR).collect()) == [*range(40), 99, 100]  # q1 was forgotten, new was not
    # for ever: what the stream has had never comes again
    kept = X.stream_appended(spark, stream(spark, path, PAIR), none, ttl=None)
    assert sorted(r["seq"] for r in kept.collect()) == [*range(40), 99]


def test_a_batch_that_comes_again_writes_nothing(spark):
    store = X.BatchStore(spark, scratch(spark, "store"))
    rows = spark.createDataFrame([(1, "a", "t")], PAIR)
    store.keep(rows, 0)
    store.keep(rows, 0)
    assert store.scan(PAIR).count() == 1
    # a restart: the stream forgets that it finished the batch, and brings it again
    path, root = scratch(spark, "feed"), scratch(spark, "store")
    feed(spark, path, [(1, "a", "t")], PAIR)
    X.BatchStore(spark, root).run(stream(spark, path, PAIR))
    feed(spark, path, [(2, "b", "t")], PAIR)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    commit = fs.Path(f"{root}-state/commits/0")
    assert commit.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(commit, False)
    X.BatchStore(spark, root).run(stream(spark, path, PAIR))
    assert sorted(r["seq"] for r in X.BatchStore(spark, root).scan(PAIR).collect()) == [1, 2]


def test_verdicts_batch_by_batch(spark):
    """A run's best so far goes on over batches, and verdicts are those of the whole table."""
    rows = [(r, e, 0.5 + 0.01 * r - 0.001 * e * (r % 3), None, "trained") for r in range(5) for e in range(1, 9) if e <= 4 + r]
    live = [(20, e, v, None, "running") for e, v in enumerate((0.7, 0.1, 0.2, 0.6, 0.1), 1)] + [(21, e, 0.3, None, "running") for e in range(1, 12)]
    schema = "run_idx bigint, epoch int, ndcg double, eval_loss double, status string"
    done = spark.createDataFrame(rows, schema)
    want = {(r["run_idx"], r["epoch"]): (r["best"], r["median"], r["prune"]) for r in G.prune_verdicts(done.unionByName(spark.createDataFrame(live, schema))).collect() if r["run_idx"] >= 20}
    path, lines = scratch(spark, "lines"), "run_idx bigint, line_no bigint, value string"
    for n, (run, epoch, value, *_) in enumerate(live):
        feed(spark, path, [(run, n, f"[epoch] {epoch}/12 eval_loss=- ndcg@10={value} best=1")], lines)
    found = X.stream_verdicts(spark, stream(spark, path, lines), done)
    assert {(r["run_idx"], r["epoch"]): (r["best"], r["median"], r["prune"]) for r in found.collect()} == want
    assert any(w[2] for w in want.values()) and want[20, 5][0] == 0.7


def test_each_live_epoch_meets_one_median(spark):
    """The last one at or before it, over gaps and blocks, found without comparing all with all."""
    at = list(range(3, 130_000, 7))
    peers = spark.createDataFrame([(e, 4 + e % 2, e / 130_000) for e in at], "epoch int, n bigint, median double")
    asked = [None, 0, 2, 3, 4, 9, 10, 49_999, 50_000, 50_001, 99_999, 100_000, 129_999, 500_000]
    live = spark.createDataFrame([(r, e, 0.4) for r in (1, 2) for e in asked], "run_idx bigint, epoch int, v double")
    judged = G.judged_by(live, peers)
    assert "NestedLoop" not in judged._jdf.queryExecution().executedPlan().toString()
    median = lambda e: None if e is None or e < 3 else at[bisect.bisect_right(at, e) - 1] / 130_000
    want = [(r, e, 0.4, median(e), e is not None and e >= 3 and 0.4 < median(e) - 1e-4) for r in (1, 2) for e in asked]
    assert sorted(map(str, (tuple(r) for r in judged.collect()))) == sorted(map(str, want))


def test_verdicts_on_lines_numbered_by_run(spark):
    done = spark.createDataFrame([(r, e, 0.5, None, "trained") for r in range(4) for e in (1, 2, 3)], "run_idx bigint, epoch int, ndcg double, eval_loss double, status string")
    path, lines = scratch(spark, "lines"), "run_idx bigint, line_no bigint, value string"
    feed(spark, path, [(run, e, f"[epoch] {e}/12 eval_loss=- ndcg@10={value} best=1") for run, value in ((20, 0.2), (21, 0.9)) for e in (1, 2, 3)], lines)
    found = X.stream_verdicts(spark, stream(spark, path, lines), done)
    assert sorted(tuple(r) for r in found.collect()) == [(run, e, v, 0.5, run == 20 and e >= 2) for run, v in ((20, 0.2), (21, 0.9)) for e in (1, 2, 3)]
