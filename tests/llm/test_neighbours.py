"""Recall against brute force, exact scores, copies, hubs and odd rows."""

import numpy as np
import pytest

from searchloom.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<double>, label int, node string, id int"


def brute(rows, k=20, every=20):
    """(score, vec_id) of each query's best, nearest first."""
    rows = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in rows:
        if i is not None and i % every == 0:
            scored = [(-float(sum(a * b for a, b in zip(v, w, strict=True))), j is None, j or 0) for j, w in rows if j != i]
            out[i] = [(-s, None if none else j) for s, none, j in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall(spark, table):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = found(N.op11_neighbours(spark, f"/root/testdata/{table}")), brute(rows)
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 and i != q for q, own in got.items() for s, i in own)
    assert all(own == sorted(own, key=lambda x: (-x[0], x[1])) for own in got.values())
    print(table, recall(got, want))
    assert recall(got, want) >= 0.98


def test_few_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(9)] + [(40, rng.normal(size=5).tolist())]
    got = found(N.nearest(spark.createDataFrame([(*r, 1, "x", 1) for r in rows], SCHEMA)))
    want = brute(rows)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()} and len(got[0]) == 9


def test_copies_hubs_and_norms(spark):
    """A third of the rows are copies of one vector, a third lie around another; lengths differ."""
    rng = np.random.default_rng(2)
    one, two = rng.normal(size=(2, 12))
    rows = [(3 * i, one.tolist()) for i in range(400)]
    rows += [(3 * i + 1, (two + rng.normal(size=12) * 0.01).tolist()) for i in range(400)] + [(5002, two.tolist())]
    rows += [(3 * i + 2, (rng.normal(size=12) * rng.choice((0.3, 1, 4))).tolist()) for i in range(400)]
    got = found(N.nearest(spark.createDataFrame([(*r, 1, "x", 1) for r in rows], SCHEMA).repartition(6)))
    want = brute(rows)
    assert got.keys() == want.keys()
    copies = [q for q in want if q % 3 == 0]
    assert all([i for _, i in got[q]] == [i for _, i in want[q]] for q in copies)  # ties by id
    assert recall(got, want) >= 0.95


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (20, [0.0] * 4), (40, None), (80, [1.0, None, 2.0, 3.0]), (100, [float("nan")] * 4), (120, [float("inf")] * 4)]
    got = found(N.nearest(spark.createDataFrame([(*r, 1, "x", 1) for r in rows], SCHEMA)))
    want = brute(rows)
    assert got.keys() == want.keys() == {0, 20, 40}
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_empty_and_wrong(spark):
    assert N.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.nearest(spark.createDataFrame([(0, [1.0, 2.0], 1, "", 1)], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="one length"):
        N.nearest(spark.createDataFrame([(0, [1.0, 2.0], 1, "", 1), (1, [1.0], 1, "", 1)], SCHEMA))
