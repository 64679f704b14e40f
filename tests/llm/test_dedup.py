"""Exact and near deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from searchloom.llm import components, exact_dedup, minhash


def test_exact(spark):
    long = "word " * 5000
    rows = [(5, "a  b", 1), (3, "a b", 2), (4, None, 3), (9, "", 4), (None, "a\tb", 5), (7, long, 6), (2, long.replace(" ", "\n"), 7), (8, long + "x", 8), (3, "a b", 9), (None, "a b c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    for size, hashed in ((2048, exact_dedup.route), (7, exact_dedup.route), (7, lambda v, salt: exact_dedup.route(v, 0) if salt else F.struct((F.length(v) % 3).alias("a"), F.lit(0).alias("b")))):
        got = exact_dedup.exact_duplicates(docs, size, hashed).collect()
        groups = defaultdict(list)
        for i, t, _ in rows:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        want = []
        for text, ids in groups.items():
            known = [i for i in ids if i is not None]
            keep = min(known) if known else None
            want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got)
        assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 50)]
    pairs += [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in nodes}


def sets_of(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    ids = [i for i, _ in rows]
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            where[x].append(n)
    for n, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for m in where[x]:
                if m < n:
                    shared[m] += 1
        for m, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(sets[m]) - c):
                parent[root(n)] = root(m)
    least = {}
    for n, i in enumerate(ids):
        least[root(n)] = min(least.get(root(n), i), i)
    return {i: (len(sets[n]), least[root(n)] if sets[n] else i) for n, i in enumerate(ids)}


def near_copies(rng, n_groups=12, copies=25):
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return rows


def test_near(spark):
    rng = random.Random(5)
    texts = [None, "", "one", "ONE", "two words", "a b c d", "A B\nC\tD"] + near_copies(rng)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(4)
    for chunk in (minhash.CHUNK, 500):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, words=4, chunk=chunk).collect()}
        want = brute(rows, 4)
        wrong = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
        assert not wrong, list(wrong.items())[:5]
    kept = minhash.drop_near_duplicates(docs, words=4)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for _, c in want.values()})
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, words=4).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 4)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "x y z u v"), (None, "x y z u v")], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 5
    assert sorted((r["doc_id"] is None, r["text"]) for r in minhash.drop_near_duplicates(docs).collect()) == [(False, "a b c d e"), (True, "x y z u v")]


def test_sketch_estimates(spark):
    own = minhash.Shingler(4)
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8):
        got = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
            common = int(400 * 2 * share / (1 + share))
            y = np.unique(np.concatenate((x[:common], rng.integers(0, 1 << 63, 400 - common, dtype=np.uint64))))
            got.append((own.sketch(x) == own.sketch(y)).mean())
        assert abs(np.mean(got) - share) < 0.02


def test_long_texts_and_a_hot_class(spark, monkeypatch):
    """One class that most others link to, sets larger than a chunk, and small parts of checks."""
    monkeypatch.setattr(minhash, "PAIRS", 7)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    long = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    rows += [(100, " ".join(long)), (101, " ".join(long[:-3])), (102, "y" * 400_000), (103, "y" * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 5, chunk=20_000).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 5).items()}


def test_look_alikes_below_the_threshold_are_cheap():
    """Templated texts: three quarters in common, all in one chain of buckets, none linked; and links among
    them are found all the same."""
    import time

    import numpy as np
    import pandas as pd

    from searchloom.llm import minhash as M

    rng = np.random.default_rng(1)
    template = rng.integers(0, 2**63, 340).astype(np.uint64)

    def cell(n, linked):
        sets = [np.sort(np.concatenate((template, rng.integers(0, 2**63, 60).astype(np.uint64)))) for _ in range(n)]
        for i in range(linked):
            sets[n - 1 - i] = np.sort(np.concatenate((sets[i][5:], rng.integers(0, 2**63, 5).astype(np.uint64))))
        return pd.DataFrame({"cid": range(n), "set": [s.view(np.int64) for s in sets], "component": range(n), "chunk": 1})

    took = []
    for n in (500, 2000):
        began = time.perf_counter()
        links = M.cell_links(cell(n, 20))
        took.append(time.perf_counter() - began)
        assert {tuple(sorted(r)) for r in links.itertuples(index=False)} == {(i, n - 1 - i) for i in range(20)}
    print(took)
    assert took[1] < 5
    some = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    count = M.shared_counts(some)
    assert all(count[i, j] == len(set(a) & set(b)) for i, a in enumerate(some) for j, b in enumerate(some) if i != j)
