"""Recall of decontamination by threshold, by the items' length and by how much of them is replaced."""

import random

import numpy as np
import pytest

from searchloom.llm import decontam

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def held(spark):
    docs, benchmark = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    words = decontam.worded(docs)
    idf = decontam.inverse_frequencies(words)
    vectors = decontam.randomised_svd(decontam.fitted_passages(words, benchmark), idf) * idf[:, None].astype(np.float32)
    texts = [r["text"] for r in docs.filter("text IS NOT NULL").orderBy("doc_id").collect()]
    items = [r["text"] for r in benchmark.orderBy("item_id").collect()]
    return vectors, sorted({w for t in texts for w in t.split()}), [t.split() for t in texts], [t.split() for t in items]


def changed(rng, words, share, pool):
    out = list(words)
    for n in rng.sample(range(len(out)), int(share * len(out))):
        out[n] = rng.choice(pool)
    return out


def recall(vectors, pairs):
    """Shares of the pairs that brute force finds, at each threshold; the pairs are item and text."""
    items = [decontam.Item(n, " ".join(x)) for n, (x, _) in enumerate(pairs)]
    texts = [decontam.Words().of(" ".join(t)) for _, t in pairs]
    want = {n for n, (x, t) in enumerate(zip(items, texts, strict=True)) if x.found(t.tolist())}
    out, before = {}, decontam.COSINE
    for cosine in (0.4, 0.45, 0.5, 0.55, 0.58):
        decontam.COSINE = cosine
        search = decontam.Search(items, vectors)
        found = {n for n, hits in enumerate(search.hits(texts)) if n in {h[0] for h in hits}}
        out[cosine] = len(found & want) / max(1, len(want))
    decontam.COSINE = before
    return len(want), out


def test_replaced_words(held):
    vectors, pool, texts, items = held
    rng, around = random.Random(5), [t for t in texts if len(t) > 200]
    for share in (0.0, 0.0625, 0.125, 0.1875, 0.25):
        pairs = []
        for x in items * 4:
            t, at = rng.choice(around), rng.randrange(20, 100)
            pairs.append((x, t[:at] + changed(rng, x, share, pool) + t[at : at + 100]))
        n, got = recall(vectors, pairs)
        print(share, n, {k: round(v, 4) for k, v in got.items()})
        assert got[decontam.COSINE] >= (0.975 if share == 0.25 else 0.99)


@pytest.mark.parametrize("length", [3, 5, 7, 8, 10, 16, 30, 60, 120, 200, 300, 400])
def test_lengths(held, length):
    vectors, pool, texts, _ = held
    rng, around = random.Random(length), [t for t in texts if len(t) > 200]
    for share in (0.0, 0.125):
        if share and length < 16:
            continue
        pairs = []
        for _ in range(100):
            x, t, at = [rng.choice(pool) for _ in range(length)], rng.choice(around), rng.randrange(20, 100)
            pairs.append((x, t[:at] + changed(rng, x, share, pool) + t[at : at + 100]))
        n, got = recall(vectors, pairs)
        print(length, share, n, {k: round(v, 4) for k, v in got.items()})
        assert n >= 90 and got[decontam.COSINE] >= (0.95 if share else 1.0)
