"""Approximate search against the exact one; the grid join against the broadcast one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchloom.operators import cells
from searchloom.operators import ranking as R
from searchloom.operators import vectors as V
from searchloom.operators.cells import CellIndex
from searchloom.plans import registry
from searchloom.plans.fixtures import fx
from searchloom.session import scratch


def scanned_bytes(df):
    """Bytes of the files that the scans of ``df`` have read, after it ran, of files in ``pages``."""
    df.collect()
    total = 0

    def walk(plan):
        nonlocal total
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == "FileSourceScanExec" and "/pages" in plan.relation().location().rootPaths().mkString():
            total += plan.metrics().apply("filesSize").value()
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total


def broadcast(df):
    """The columns of each broadcast of a plan, after it ran."""
    df.collect()
    found = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == "BroadcastExchangeExec":
            found.append([x.split("#")[0] for x in plan.output().mkString(" ").split()])
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("table, k", [("sf0.01", 10), ("sf0.1", 10), ("sf0.1", 50)])
def test_recall(spark, table, k):
    d = f"/root/testdata/{table}"
    queries, corpus = fx(spark, d, "fx_vec_queries"), fx(spark, d, "fx_vec_corpus")
    exact = {(r["query_id"], r["doc_id"]): r["score"] for r in R.dense_top_k(queries, corpus, k).collect()}
    near = {(r["query_id"], r["doc_id"]): r["score"] for r in V.approximate_top_k(queries, corpus, k).collect()}
    recall = len(exact.keys() & near.keys()) / len(exact)
    print(table, k, recall)
    assert len(near) <= len(exact) and all(abs(near[x] - exact[x]) < 1e-6 for x in near.keys() & exact.keys())
    assert recall >= 0.9


def planted(spark, n=6000, clusters=40, dim=16, hot=0.34):
    """Vectors around clusters, the first of which has a third of all."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(clusters, dim))
    own = np.where(rng.random(n) < hot, 0, rng.integers(0, clusters, n))
    x = centres[own] + rng.normal(size=(n, dim)) * 0.15
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, embedding array<float>")
    return corpus.filter("doc_id % 60 = 7").withColumnRenamed("doc_id", "query_id"), corpus


def test_cells_are_an_index(spark):
    queries, corpus = planted(spark)
    index = CellIndex.write(corpus, scratch(spark, "cells"), 40)
    exact = {(r["query_id"], r["doc_id"]) for r in R.dense_top_k(queries, corpus, 10).collect()}
    few = index.search(queries, 10, 0.1)
    assert len(exact & {(r["query_id"], r["doc_id"]) for r in few.collect()}) >= 0.9 * len(exact)
    assert exact == {(r["query_id"], r["doc_id"]) for r in index.search(queries, 10, 1.0).collect()}
    one = queries.filter("query_id = 67")
    read, all_ = scanned_bytes(index.search(one, 10, 0.1)), scanned_bytes(index.search(one, 10, 1.0))
    print(read, all_)
    assert 0 < read < all_ / 3
    assert "dynamicpruning" in index.search(one, 10, 0.1)._jdf.queryExecution().toString().lower()
    pages = spark.read.parquet(f"{index.path}/pages")
    assert pages.agg(F.max(F.size("ids"))).first()[0] <= 1024 and pages.agg(F.sum(F.size("ids"))).first()[0] == 6000


def test_numbers_of_cells_are_all_that_is_broadcast(spark):
    """With all cells, a query's vector is there once for each: that grows faster than the table."""
    queries, corpus = planted(spark)
    index = CellIndex.write(corpus, scratch(spark, "cells"), 40)
    for share in (0.1, 1.0):
        assert broadcast(index.search(queries, 10, share)) == [["cell"]]


def test_recall_of_shares_is_that_of_searches(spark, monkeypatch):
    """Counts and recall of each share, from places of cells: no vector is stored for a cell or broadcast."""
    queries, corpus = planted(spark)
    index, shares = CellIndex.write(corpus, scratch(spark, "cells"), 40), (0.03, 0.1, 1.0)
    pairs = lambda df: {(r["query_id"], r["doc_id"]) for r in df.collect()}
    exact = R.dense_top_k(queries, corpus, 30)
    want = pairs(exact.filter("rank <= 10"))
    found = {s: len(want & pairs(index.search(queries, 10, s))) / len(want) for s in shares}
    made, kept = [], cells.stored
    monkeypatch.setattr(cells, "stored", lambda df, name: made.append(df.columns) or kept(df, name))
    table = cells.recall_by_share(index, queries, exact, 10, shares)
    got = {r["share"]: r for r in table.collect()}
    assert made == [["query_id", "cell", "place"], ["query_id", "doc_id"]]
    assert {"asked", "embedding"}.isdisjoint(sum(broadcast(table), []))
    assert {s: r["recall"] for s, r in got.items()} == found and found[0.03] < found[1.0] == 1
    sizes = {r["cell"]: r["n"] for r in spark.read.parquet(f"{index.path}/pages").groupBy("cell").agg(F.sum(F.size("ids")).alias("n")).collect()}
    for s in shares:
        probed = [r["cell"] for r in index.probes(queries, s).collect() if r["cell"] in sizes]
        assert (got[s]["cells"], got[s]["vectors"]) == (len(probed), sum(sizes[c] for c in probed))
    none = cells.recall_by_share(index, queries.limit(0), exact.limit(0), 10, (0.1,)).collect()
    assert [tuple(r) for r in none] == [(0.1, 0, 0, None)]


def test_cells_are_fitted_by_many_tasks(spark, monkeypatch):
    _, corpus = planted(spark, 900)
    held, kept = [], cells.stored
    monkeypatch.setattr(cells, "stored", lambda df, name: held.append((df, kept(df, name))) or held[-1][1])
    for most in (100, 900):
        monkeypatch.setattr(cells, "FIT_ROWS", most)
        assert cells.fitted_centres(corpus, 4).shape == (4, 16)
        made, read = held.pop()
        assert read.count() == most and made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(cells, "FIT_ROWS", 100)
    assert np.allclose(cells.fitted_centres(corpus, 4), cells.fitted_centres(corpus.repartition(7), 4))  # whatever the rows' order
    first = {tuple(r["embedding"]) for r in corpus.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()}
    cells.fitted_centres(corpus, 4)
    lengths = [np.linalg.norm(x) for x in first]
    want = sorted(tuple(np.round(np.array(x) / n, 4)) for x, n in zip(first, lengths, strict=True))
    assert sorted(tuple(np.round(r["v"].toArray(), 4)) for r in held[-1][1].collect()) == want


@pytest.mark.parametrize("block", [300, 2000])
def test_grid(spark, block):
    """Many blocks of either side give what one block gives, and no query passes through the driver."""
    rng = np.random.default_rng(4)
    corpus = spark.createDataFrame([(f"d{i:03d}", rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(200)], "doc_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(70)], "query_id bigint, embedding array<float>").repartition(2)
    pairs = spark.createDataFrame([(i, f"d{i + 5:03d}") for i in range(60)], "query_id bigint, doc_id string")
    rows = lambda df: sorted(str(tuple(r)) for r in df.select([F.round(c, 9) if t == "double" else c for c, t in df.dtypes]).collect())
    for f in (
        lambda **b: R.dense_top_k(queries, corpus, 7, **b),
        lambda **b: R.own_rank(pairs, queries, corpus, **b),
        lambda **b: R.guarded_negatives(pairs, queries, corpus, 3, **b),
    ):
        assert rows(f(block=block)) == rows(f())
    plan = R.dense_top_k(queries, corpus, 7, block=block)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan
    assert R.dense_top_k(queries.limit(0), corpus, 7, block=block).collect() == []


def test_queries_share_one_index(spark):
    d = "/root/testdata/sf0.001"
    found = {r["share"]: r for r in registry.queries()["probe_recall"](spark, d).collect()}
    assert found[1.0]["recall"] == 1 and found[0.05]["vectors"] < found[0.5]["vectors"] < found[1.0]["vectors"]
    assert all(r["recall"] >= 0.9 for s, r in found.items() if s >= 0.75)
