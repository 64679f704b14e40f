"""Product codes against a full search, and odd rows."""

import hashlib

import duckdb
import numpy as np
import pytest

from searchloom.llm import vector_codes as V

D = "/root/testdata/sf0.01"


def plain(vectors, rounds=4, entries=256):
    """Codes and errors by full search over rows in order of their ids."""
    x = np.floor(np.asarray(vectors, dtype=np.float64) * 1024).astype(np.int64)
    x = x.reshape(len(x), 4, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda p: ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        code = np.stack([near(p).argmin(axis=1) for p in range(4)], axis=1)
        for p in range(4):
            for e in range(len(books[p])):
                if (own := code[:, p] == e).any():
                    books[p, e] = x[own, p].sum(axis=0) // own.sum()
    d = [near(p) for p in range(4)]
    code = np.stack([y.argmin(axis=1) for y in d], axis=1)
    return ["".join(f"{c:02x}" for c in r) for r in code], sum(y.min(axis=1) for y in d).tolist(), books


def test_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{D}/embeddings.parquet'")
    df = V.op12_vector_codes(spark, D)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({V.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == 500


def test_bounds_skip_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 3000
    x = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 200).astype(np.int64)
    history, code, low, stamp, measured = [x[:256].copy()], None, None, None, []
    for r in range(5):
        own = V.Assigner(history)
        code, best, low, stamp = own.first(x) if r == 0 else own.again(x, code, low, stamp)
        d = ((x[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        measured.append(own.measured)
        books = history[-1].copy()
        for e in np.unique(code):
            books[e] = x[code == e].sum(axis=0) // (code == e).sum()
        history.append(books)
    assert max(measured[2:]) < measured[0] / 2  # most groups are left out


def test_net_displacement_is_what_counts():
    """An entry that goes away and comes back has not moved: its bound holds in full."""
    a = np.zeros((64, 4), np.int64)
    a[:, 0] = np.arange(64) * 1000
    b = a + 5000
    assert V.Assigner([a, b, a]).moved[0].max() == 0 and V.Assigner([a, b, a]).moved[1].max() >= 10000


SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, x int"


@pytest.mark.parametrize("big", [1.0, 30000.0])
def test_odd_rows(spark, big):
    rng = np.random.default_rng(2)
    rows = [(i if i != 7 else None, (rng.normal(size=8) * big).astype(np.float32).tolist(), i % 3 or None, "clash", 1) for i in range(300)]
    rows += [(5, rows[5][1], 2, "again", 1)]
    odd = [(1000, None, 1, "", 1), (1001, [1.0] * 7 + [None], 1, "", 1), (1002, [float("nan")] * 8, 1, "", 1), (1003, [float("inf")] * 8, 1, "", 1)]
    found, books = V.compressed(spark.createDataFrame(rows + odd, SCHEMA).repartition(5))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, errors, want = plain([r[1] for r in order])
    key = lambda r: (r[0] is None, r[0] or 0, r[2] or 0, r[1])
    got = [(r["vec_id"], r["code"], r["label"], r["error"]) for r in found.collect()]
    assert sorted(got, key=key) == sorted([(r[0], c, r[2], e) for r, c, e in zip(order, codes, errors, strict=True)], key=key)
    assert (books == want).all()


def test_few_empty_and_wrong(spark, tmp_path):
    few, books = V.compressed(spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.25] * 4, None)], "vec_id bigint, embedding array<float>, label int"))
    assert sorted(r["code"] for r in few.collect()) == ["00000000", "01010101"] and books.shape == (4, 2, 1)
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert V.op12_vector_codes(spark, str(tmp_path)).collect() == []
    for bad in ([[1.0] * 5], [[1.0] * 4, [1.0] * 8], [[1e30] * 4]):
        with pytest.raises(Exception, match="vectors must|too large"):
            V.compressed(spark.createDataFrame([(i, v, 1) for i, v in enumerate(bad)], "vec_id bigint, embedding array<double>, label int"))[0].collect()


def test_digest_is_of_all_entries(spark):
    df = V.op12_vector_codes(spark, "/root/testdata/sf0.001")
    vectors = [r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()]
    _, _, books = plain(vectors)
    assert {r[0] for r in df.select("codebooks_sha256").distinct().collect()} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}
