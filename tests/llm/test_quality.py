"""Held-out accuracy of the quality classifier."""

import zlib

import numpy as np

from searchloom.llm import quality


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in quality.quality_scores(docs, model).collect()}
    assert len(rows) == docs.count()
    right = [[], []]
    for r in labels.collect():
        got = rows[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert got["predicted"] == int(got["score"] >= 0.5)
        if got["held_out"]:
            right[r["quality"]].append(got["predicted"] == r["quality"])
    print([np.mean(x) for x in right])
    assert np.mean(right[1]) > 0.97 and np.mean(right[0]) > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "Some words", "c"), (2, "Some words", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 1)], "doc_id long, quality int")
    assert quality.quality_scores(docs, quality.fit(docs, labels)).count() == 4
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), none).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns


def test_the_solver_is_at_the_optimum():
    """Dual coordinate descent against the optimality conditions of the hinge-loss dual."""
    rng = np.random.default_rng(5)
    size, n, c = 30, 80, 1.0
    y = rng.integers(0, 2, n)
    x = [np.unique(rng.integers(0, size, rng.integers(1, 9))) for _ in range(n)]
    values = [rng.normal(size=len(f)) / 3 for f in x]
    w = quality.dual_coordinate_descent(x, values, y, size, c, epochs=3000)
    sign = np.where(y == 1, 1.0, -1.0)
    most = c * 0.5 / np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    a = np.zeros((n, size + 1))
    for i, (f, v) in enumerate(zip(x, values, strict=True)):
        a[i, f], a[i, -1] = v, 1.0
    a *= sign[:, None]
    primal = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - a @ w)).sum()
    # the largest dual value, by projected gradient ascent
    alpha = np.zeros(n)
    step = 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(40_000):
        alpha = np.clip(alpha + step * (1 - a @ (a.T @ alpha)), 0, most)
    dual = alpha.sum() - 0.5 * (alpha @ a) @ (alpha @ a)
    assert primal(w) - dual < 5e-3 * (1 + abs(dual))


def test_ratios():
    x = [np.array([0, 2]), np.array([0]), np.array([1, 2])]
    got = quality.log_count_ratios(x, np.array([1, 1, 0]), 3)
    one, zero = np.array([3, 1, 2]) / 6, np.array([1, 2, 2]) / 5
    assert np.allclose(got, np.log(one / zero))


def test_long_words_and_ties(spark):
    assert quality.shape("a-" * 40 + "9") == "a-" * 40 + "9" and quality.shape("ABCdef12") != quality.shape("abc")
    long = "x-" * 200_000 + " word" * 200_000
    docs = spark.createDataFrame([(1, long), (1, "other"), (2, "z z"), (2, "z z"), (3, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert quality.training_rows(docs, labels).count() <= 3
    out = quality.quality_scores(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    half = quality.Model(np.zeros(1 << 18), np.zeros(1 << 18), 0.0, 1.0, 0.0, 18)
    assert {(r["score"], r["predicted"]) for r in quality.quality_scores(docs, half).collect()} == {(0.5, 1)}
