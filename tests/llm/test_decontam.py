"""Decontamination against brute force over the whole table, and paraphrases."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from searchloom.llm import decontam


def words(text):
    return " ".join(re.findall(r"\w+", text.lower()))


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontam.common_subsequence(a, b) == t[-1, -1]


def test_whole_table(spark):
    d = "/root/testdata/sf0.1"
    docs, benchmark = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    began = time.time()
    rows = decontam.contaminated(docs, benchmark).collect()
    print(time.time() - began)
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: words(r["text"]) for r in benchmark.collect()}
    want = {(d, i) for i, x in items.items() for d, t in texts.items() if x in t}
    print(len(got), len(want), sorted(got - want)[:10], sorted(want - got)[:10])
    assert want <= got and len(got - want) <= 2


def test_space_is_fitted_on_all_passages(spark):
    """A matrix with right singular vectors over singular values has orthonormal columns, if they are its own."""
    rng = random.Random(7)
    pool = [f"w{n}" for n in range(3_000)]
    rows = [(n, " ".join(rng.choices(pool, k=rng.choice([1, 39, 40, 41, 90])))) for n in range(1_500)]
    rows += [(1_500, " ".join(rng.choices(pool, k=4_000))), (1_500, rows[0][1]), (None, None), (1_501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    benchmark = spark.createDataFrame([(n, " ".join(rng.choices(pool, k=50))) for n in range(20)], "item_id long, text string")
    words = decontam.worded(docs)
    idf = decontam.inverse_frequencies(words)
    vectors = decontam.randomised_svd(decontam.fitted_passages(words, benchmark), idf).astype(float)
    gram = np.zeros((vectors.shape[1],) * 2)
    for text in [t for _, t in rows if t] + [r["text"] for r in benchmark.collect()]:
        own = decontam.Words().of(text)
        for at in range(0, len(own), 40):
            f, n = np.unique(decontam.hashed(own[at : at + 40]), return_counts=True)
            v = n * idf[f]
            v = v / np.sqrt(v @ v) @ vectors[f]
            gram += np.outer(v, v)
    print(np.abs(gram - np.eye(len(gram))).max())
    assert np.abs(gram - np.eye(len(gram))).max() < 1e-3


def test_fit_does_not_depend_on_chunks(spark, monkeypatch):
    """Chunks of one passage to several, texts cut between passages, tasks of one part or several."""
    d = "/root/testdata/sf0.001"
    words = decontam.worded(spark.read.parquet(f"{d}/documents.parquet").repartition(30))
    idf, benchmark = decontam.inverse_frequencies(words), spark.read.parquet(f"{d}/benchmark.parquet")
    once = decontam.randomised_svd(decontam.fitted_passages(words, benchmark), idf)
    monkeypatch.setattr(decontam, "FIT_WORDS", 3 * decontam.SPAN)
    monkeypatch.setattr(decontam, "PARTS", 1)
    again = decontam.randomised_svd(decontam.fitted_passages(words, benchmark), idf)
    # the space, whatever the signs and order of its dimensions
    assert np.allclose(once @ once[:200].T, again @ again[:200].T, rtol=1e-2, atol=1e-3 * np.abs(once @ once[:200].T).max())


def test_paraphrases_and_edges(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rng = random.Random(4)
    texts = {r["item_id"]: r["text"] for r in benchmark.collect()}
    filler = [r["text"] for r in base.limit(60).collect()]
    rows = []
    for i, text in texts.items():
        w = text.split()
        for n in rng.sample(range(len(w)), len(w) // 8):
            w[n] = rng.choice(filler).split()[0]
        around = rng.choice(filler).split()
        rows.append((10_000 + i, " ".join(around[:90] + w + around[90:180])))
    rows += [(None, None), (1, ""), (2, "of")]
    docs = base.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 AS item_id")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()}
    found = sum((10_000 + i, i) in got for i in texts)
    print(found, len(texts))
    assert found >= 0.9 * len(texts)
    clean = decontam.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in got})
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0


def test_odd_items_and_rows(spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta eta theta iota. kappa lambda mu"), (3, "one two"), (3, "one two"), (4, "!!! ...")], "item_id long, text string").selectExpr("*", "1 AS digest", "2 AS words")
    item = "Alpha, beta gamma delta epsilon zeta eta theta iota. Kappa lambda mu"
    long = "filler word " * 300_000 + item + " more text" * 200_000
    docs = spark.createDataFrame([(1, item), (1, item), (2, "one two"), (3, long), (4, "one three two"), (None, item), (5, None)], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()), key=repr)
    assert got == sorted([(1, None), (1, None), (2, 3), (2, 3), (3, None), (None, None)], key=repr)
    left = decontam.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 5]


def test_blocks_of_items_do_not_change_hits(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, benchmark = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    once = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontam, "ITEMS", 7)
    monkeypatch.setattr(decontam, "TILE", 64)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()} == once and once


def test_many_partitions(spark):
    """More partitions than there are slices or rows, so that many are empty."""
    d = "/root/testdata/sf0.001"
    docs, benchmark = spark.read.parquet(f"{d}/documents.parquet").repartition(90), spark.read.parquet(f"{d}/benchmark.parquet")
    once = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()}
    held = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()} == once and once
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_packed_words_are_those_of_single_texts(monkeypatch):
    """White space, punctuation, case and letters of any script; words of any length; blocks of words."""
    rng = random.Random(3)
    alphabet = list("abzAZ019") * 3 + list(".,;!?'\"()-_=") + ["\x00", "\x1f", "\x7f", "é", "É", "ß", "×", "÷", "ÿ", "Ÿ", "İ", "Σ", "ς", "µ", "¿", "«", "“", "字", "😀", "̈", "ﬁ", "­", "¼"]
    spaces = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", "\r\n"]
    texts = ["", " ", "...", "-" * 500, "a" * 63, "a" * 64, "a" * 65 + ".", "'" * 70 + "a", "ΟΔΥΣΣΕΥΣ ΑΣ. Σ", "É", "Über-ÄÖÜ!"]
    texts += ["".join("".join(rng.choices(alphabet, k=rng.randint(0, 12))) + rng.choice(spaces) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    want = [decontam.Words().of(t).tobytes() for t in texts]
    assert decontam.packed_words(pa.array(texts)).to_pylist() == want
    assert decontam.packed_words(pa.array(texts, pa.large_string()).slice(5)).to_pylist() == want[5:]
    monkeypatch.setattr(decontam, "HASHED", 7)
    assert decontam.packed_words(pa.array(texts)).to_pylist() == want
    assert decontam.packed_words(pa.array([], pa.string())).to_pylist() == []


def test_few_candidates_are_compared(spark, monkeypatch):
    """Most are left out by the words around them, and none that would have been found."""
    d = "/root/testdata/sf0.01"
    docs, benchmark = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    texts = [decontam.Words().of(r["text"] or "") for r in docs.collect()]
    items = [decontam.Item(r["item_id"], r["text"]) for r in benchmark.collect()]
    items += [decontam.Item(-n, " ".join(f"w{i}" for i in range(n))) for n in (3, 70, 300, 900)]
    texts += [np.array(x.words, np.uint32) for x in items]
    vectors = np.random.default_rng(5).standard_normal((1 << decontam.BITS, decontam.RANK)).astype(np.float32)
    calls, found = [], decontam.Item.found
    monkeypatch.setattr(decontam.Item, "found", lambda self, words: calls.append(1) or found(self, words))
    monkeypatch.setattr(decontam, "COSINE", 0.2)
    monkeypatch.setattr(decontam, "LEAST", 0.2)
    monkeypatch.setattr(decontam, "LOOKED", 5_000)
    search = decontam.Search(items, vectors)
    hits, few = search.hits(texts), len(calls)
    monkeypatch.setattr(search, "_possible", lambda words, n, items, first, last: np.ones(len(items), bool))
    calls.clear()
    assert search.hits(texts) == hits and sum(map(len, hits)) >= len(items)
    print(few, len(calls))
    assert few < 0.1 * len(calls)
