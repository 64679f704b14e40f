"""Writers that meet, writes that die, and upserts that write what they bring."""

from pyspark.sql import functions as F

from searchloom.operators import vectors as V
from searchloom.session import scratch
from searchloom.sources import files as S
from searchloom.sources.commits import CommitLog

RUN = "id string, created_at string, model string, label string, ndcg double, seq bigint"


def runs(spark, *ids):
    return spark.createDataFrame([(i, "t", "m", "", 0.5, n) for n, i in enumerate(ids)], RUN)


def points(spark, rows):
    return spark.createDataFrame(rows, "point_id string, seq int, embedding array<float>")


def test_a_number_is_taken_once(spark):
    log = CommitLog(spark, scratch(spark, "log"))
    assert log.put(0, kind="a") and not log.put(0, kind="b") and [e["kind"] for e in log.entries()] == ["a"]
    seen = []

    def slow(entries):
        seen.append(len(entries))
        if len(seen) == 1:
            log.put(1, kind="faster")  # another writer gets in between
        return {"kind": "slow"}

    assert log.commit(slow) == 2 and seen == [1, 2]
    assert [e["kind"] for e in log.entries()] == ["a", "faster", "slow"]


def test_two_appends_keep_both(spark, monkeypatch):
    root = scratch(spark, "runs")
    one, two = S.RunRegistry(spark, root, RUN), S.RunRegistry(spark, root, RUN)
    one.append(runs(spark, "a"))
    stale = two.log.entries()
    once = iter([stale])
    real = two.log.entries
    one.append(runs(spark, "b"))
    monkeypatch.setattr(two.log, "entries", lambda: next(once, None) or real())  # it read the log before b came
    assert two.append(runs(spark, "c")) == 2
    assert [(r["id"], r["batch"]) for r in one.newest().collect()] == [("c", 2), ("b", 1), ("a", 0)]


def test_a_deleted_run_stays_deleted(spark):
    reg = S.RunRegistry(spark, scratch(spark, "runs"), RUN)
    reg.append(runs(spark, "a"))
    assert reg.delete("a") == 0 and reg.scan().count() == 0
    runs(spark, "b").write.json(reg.log.fresh())  # an append that dies before its commit
    assert reg.scan().count() == 0
    assert reg.append(runs(spark, "b")) == 1 and [r["id"] for r in reg.scan().collect()] == ["b"]


def test_a_deletion_loses_no_append(spark, monkeypatch):
    root = scratch(spark, "runs")
    one, two = S.RunRegistry(spark, root, RUN), S.RunRegistry(spark, root, RUN)
    one.append(runs(spark, "a", "b"))
    real, first = one._rows, []

    def meanwhile(entries):
        if not first:
            first.append(two.append(runs(spark, "c")))
        return real(entries)

    monkeypatch.setattr(one, "_rows", meanwhile)
    assert one.delete("a") == 2 and sorted(r["id"] for r in two.scan().collect()) == ["b", "c"]


def test_an_upsert_writes_what_it_brings(spark):
    store = V.VectorStore(spark, scratch(spark, "store"))
    whole = spark.range(20_000).select(F.col("id").cast("string").alias("point_id"), F.lit(0).alias("seq"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (F.rand(1) + i).cast("float")).alias("embedding"))
    store.upsert("v", whole)
    some = whole.filter("point_id % 100 = 0").withColumn("seq", F.lit(1))
    store.upsert("v", some)
    fs, path = store._fs()
    size = [fs.getContentSummary(path(e["path"])).getLength() for e in store._log("v").entries()]
    print(size)
    assert size[1] < size[0] / 50  # one in a hundred, and the head of a file
    rows = store.scan("v")
    assert rows.count() == 20_000 and rows.filter("seq = 1").count() == 200


def test_two_upserts_keep_both_and_compaction_loses_none(spark, monkeypatch):
    root = scratch(spark, "store")
    one, two = V.VectorStore(spark, root), V.VectorStore(spark, root)
    one.upsert("v", points(spark, [("a", 1, [1.0]), ("b", 1, [1.0])]))
    real, first = one._rows, []

    def meanwhile(entries):
        if not first:
            first.append(two.upsert("v", points(spark, [("b", 1, [2.0]), ("c", 1, [2.0])])))
        return real(entries)

    monkeypatch.setattr(one, "_rows", meanwhile)
    one.compact("v")
    one.upsert("v", points(spark, [("c", 0, [3.0])]))
    assert {(r[0], r[2][0]) for r in two.scan("v").collect()} == {("a", 1.0), ("b", 2.0), ("c", 3.0)}
    for n in range(V.DELTAS + 2):
        two.upsert("v", points(spark, [("d", n, [float(n)])]))
    assert len(two._current(two._log("v").entries())) <= V.DELTAS + 1
    assert {r[0]: r[2][0] for r in two.scan("v").collect()}["d"] == V.DELTAS + 1
