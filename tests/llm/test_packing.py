"""Packing: an exact round trip of the ids, and how full the sequences are."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from searchloom.llm import packing

TEXTS = [None, "", " ", "Hello, World! it's", "naïve café İstanbul ΣΑΣ", "áb \x1c\x85\xa0x", "<|endoftext|> is text", "don't we'll 12 3.5 %%% a###", "日本語 テキスト", "word " * 9000, "x"]
#: Beyond those: words that mix letters, digits, marks and foreign letters, and letters of late Unicode versions.
WORDS = ["a'sb't", "O'Brien's,", "x1y22z", "(918)", "“Quoted”", "ß.ẞ", "e\u0301té", "\u0301x", "ǅabc", "\U0001e4d0\U00016d40", "a\u200bb", "tab\x0bx", "DEL\x7f", "a<|startoftext|>b", "é<|endoftext|>", "𝒳𝒴", "½", "٣٤", "ﬁn", "İ", "''s", "<|", "|>"]


def test_ids_are_those_of_the_tokenizer(spark):
    own = packing.WordTokenizer(packing.default_tokenizer())
    whole = Tokenizer.from_file(packing.default_tokenizer())
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [t or "" for t in TEXTS] + WORDS + [" ".join(WORDS)] + docs
    few = packing.WordTokenizer(packing.default_tokenizer(), cached=10_000)
    want = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    for part in (slice(30), slice(30, None), slice(None)):
        for tokenizer in (own, few):
            for got, ids, text in zip(tokenizer.encoded(texts[part]), want[part], texts[part], strict=True):
                assert np.frombuffer(got, "<u4").tolist() == ids, text[:50]


def test_ids_of_random_words():
    """Words of random code points, one by one and all in one batch."""
    rng = random.Random(5)
    alphabets = ["aé'", "abc123.,'", "äßÉñ", "αΣς", "日本語x", "\u0301\u0308ae", "".join(map(chr, range(1, 0x250)))]
    words = ["".join(rng.choice(a) for _ in range(rng.randint(1, 9))) for a in alphabets for _ in range(300)]
    words += [chr(c) for c in range(0x250, 0x30000, 37) if not 0xD800 <= c < 0xE000]
    words += [x for c in range(1, 0x250) for x in (chr(c), f"a{chr(c)}b", f"{chr(c)}'s.")]
    own, whole = packing.WordTokenizer(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    for got, word in zip(own.encoded(words), words, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(word, add_special_tokens=False).ids, repr(word)


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (1, "y")], "doc_id long, text string")
    rows = packing.pack_documents(docs, ids=True).collect()
    whole = Tokenizer.from_file(packing.default_tokenizer())
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 4096
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    for i, text in enumerate(TEXTS):
        if i != 1:
            got = sorted(by_doc[i], key=lambda r: r["piece"])
            assert sum((r["ids"] for r in got), []) == whole.encode(text or "", add_special_tokens=False).ids + [1]
            assert all(r["length"] == 4096 for r in got[:-1])
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_plan_is_tight():
    rng = random.Random(3)
    for draw in (lambda: rng.randint(1, 4096), lambda: min(4096, int(rng.lognormvariate(6, 1)) + 1), lambda: 1500, lambda: rng.choice((4000, 97))):
        histogram = {}
        for _ in range(3000):
            n = draw()
            histogram[n] = histogram.get(n, 0) + 1
        groups = packing.plan(histogram)
        held = {}
        for parts, times in groups:
            assert sum(a * b for a, b in parts) <= 4096
            for a, b in parts:
                held[a] = held.get(a, 0) + b * times
        assert held == histogram
        plain = packing._Plan(np.array([histogram.get(n, 0) for n in range(4097)]), 4096)
        plain.best_fit()
        assert sum(n for _, n in groups) <= 1.001 * sum(n for _, n in plain.groups()) + 1


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((20, 30)), np.maximum(rng.normal(size=30), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-6


def test_extra_columns_and_small_optima(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None)], "doc_id long, text string")
    docs = docs.selectExpr("*", "5 AS row", "'x' AS piece", "7 AS length", "8 AS rank", "9 AS offset")
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3 and len({r["sequence_id"] for r in rows}) == 1

    def optimum(lengths, capacity):
        best = [len(lengths)]

        def grow(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(rooms)
                return
            for k in {r: n for n, r in enumerate(rooms) if r >= lengths[i]}.values():
                grow(i + 1, [r - lengths[i] if n == k else r for n, r in enumerate(rooms)])
            grow(i + 1, [*rooms, capacity - lengths[i]])

        grow(0, [])
        return best[0]

    rng, more = random.Random(9), 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 40) for _ in range(9)), reverse=True)
        histogram = {n: lengths.count(n) for n in lengths}
        used = sum(n for _, n in packing.plan(histogram, 40, ((40, 3), (10, 2))))
        least = optimum(lengths, 40)
        assert used <= least + 1
        more += used - least
    assert more <= 6
