"""Near-duplicate detection: MinHash with tensored banding.

Sets. A text's set holds its distinct shingles of ``words`` words. Documents with equal sets form
a class; from there on only classes count.

Tensored banding. ``2 * SIDE`` short bands of ``ROWS`` minhashes are made, in two collections. Each
pair of one band from either collection is the key of a table, so ``SIDE ** 2`` tables of
``2 * ROWS`` minhashes each cost no more than ``2 * SIDE * ROWS`` minhashes. A pair with similarity
s meets in some table unless all bands of a collection miss it, which at s = 0.8 happens with a
probability below ``2 * (1 - 0.8 ** 4) ** 20``, 6 in 100,000. A band that only one class has can be
in no shared key, so such bands go before the pairs are formed.

Verification, without all pairs of a bucket.
1. Every class is checked against the first class of the bucket it shares with it most often: one
   pair for each class. Links make components.
2. Buckets that still hold several components are checked exactly: classes that share
   buckets are gathered in chunks of a bounded number of shingles, and chunks that share a bucket
   meet in cells. A cell compares, class by class, the members of different components that agree
   in a band of either collection, and returns only links that join components.
All links are confirmed on the full sets.

Edge cases. A text with fewer words has its whole sequence as one shingle; without words or text
the set is empty and linked with nothing. A null ``doc_id`` sorts after all others; a component of
such rows alone has a null name. Repeated rows are copies like any others. Texts and words may have
any length; a set larger than a chunk is a chunk of its own. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, keep_one, materialize, read, small_batches, text_of
from .components import connected_components

SIDE, ROWS = 20, 4
#: Shingles of a chunk, about, and what a class weighs besides its shingles; pairs of one class that
#: one task checks, about.
CHUNK, CLASS, PAIRS = 1_000_000, 1_000, 500
CACHED = 250_000

SPACES = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted 64-bit shingle hashes and minhashes of texts."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[str, int] = {}
        rng = np.random.default_rng(20240229)
        n = 2 * SIDE * ROWS
        self.times = rng.integers(1 << 20, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.held = np.empty((256, n), np.uint32)  # small enough for a core's cache

    def _learn(self, word: str) -> int:
        if len(self.known) >= CACHED:
            self.known.clear()
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        got = self.known[word] = int.from_bytes(digest, "little")
        return got

    def shingles(self, text: str) -> np.ndarray:
        known, learn = self.known, self._learn
        lower = text.lower() if text.isascii() else text.translate(_LOWER)
        ids = [known.get(w) or learn(w) for w in SPACES.split(lower) if w]
        if not ids:
            return np.zeros(0, np.uint64)
        x = np.array(ids, np.uint64)
        n = min(self.words, len(x))
        gram = np.full(len(x) - n + 1, n, np.uint64)
        for i in range(n):
            gram = (gram ^ x[i : len(x) - n + 1 + i]) * _MIX
            gram ^= gram >> np.uint64(29)
        return np.unique(gram)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        out = np.full(len(self.times), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), len(self.held)):
            part = x[at : at + len(self.held)]
            hashes = self.held[: len(part)]
            np.multiply(part[:, None], self.times, out=hashes)
            hashes += self.plus
            np.minimum(out, hashes.min(axis=0), out)
        return out


def _shingler(words: int) -> Shingler:
    return held(("shingler", words), lambda: Shingler(words))


def bands(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band; the first ``SIDE`` are of one collection."""
    parts = sketch.reshape(2 * SIDE, ROWS).astype(np.uint64)
    out = np.arange(1, 2 * SIDE + 1, dtype=np.uint64) * _MIX
    for i in range(ROWS):
        out = (out ^ parts[:, i]) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def described(docs: DataFrame, words: int) -> DataFrame:
    """``row, doc_id, n_shingles, h1, h2, bands`` and a digest of the text, of each row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _shingler(words)
        for batch in batches:
            n, h1, h2, b = [], [], [], []
            for text in batch["text"]:
                s = own.shingles(text)
                n.append(len(s))
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                b.append(bands(own.sketch(s)) if len(s) else np.zeros(0, np.int64))
            yield pd.DataFrame(
                {"row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "n_shingles": n, "h1": h1, "h2": h2, "bands": b}
            )

    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.xxhash64(text_of()).alias("digest"),
        text_of().alias("text"),
    ).mapInPandas(
        rows, "row long, doc_id long, digest long, n_shingles long, h1 long, h2 long, bands array<long>"
    )


def buckets(classes: DataFrame) -> DataFrame:
    """``key, cid, first, size``: classes that share a key, in buckets of two or more."""
    own = classes.select("cid", F.posexplode("bands").alias("t", "band"))
    shared = materialize(own.groupBy("band").count().filter("count > 1").select("band"), "shared_bands")
    alive = own.join(shared, "band").groupBy("cid").agg(
        F.collect_list(F.when(F.col("t") < SIDE, F.col("band"))).alias("left"),
        F.collect_list(F.when(F.col("t") >= SIDE, F.col("band"))).alias("right"),
    )
    alive = materialize(alive.filter("size(left) > 0 AND size(right) > 0"), "alive")
    keys = alive.select("cid", F.explode("left").alias("l"), "right").select(
        "cid", F.explode(F.transform("right", lambda r: F.xxhash64("l", r))).alias("key")
    )
    sizes = keys.groupBy("key").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return materialize(keys.join(materialize(sizes, "bucket_sizes"), "key"), "buckets")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``cid, set, sketch`` of the classes in ``wanted`` (``cid, doc_id, digest``)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _shingler(words)
        for batch in batches:
            sets = [own.shingles(t) for t in batch["text"]]
            sketches = [own.sketch(s).view(np.int32) for s in sets]
            yield pd.DataFrame({"cid": batch["cid"], "set": [s.view(np.int64) for s in sets], "sketch": sketches})

    left = docs.select("doc_id", text_of().alias("text")).withColumn("digest", F.xxhash64("text"))
    ids = wanted.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "cid")
    found = left.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    sets = found.select("cid", "text").mapInPandas(rows, "cid long, set array<long>, sketch array<int>")
    # a repeated row gives its class's set again
    return sets


#: Sets that a shingle has to be in to be counted by matrices, and shingles of a matrix.
OFTEN, COLUMNS = 8, 1024


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more."""
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (``a, b``) whose sets are linked."""

    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(p, q) for p, q in zip(x, y, strict=True)], dtype="bool")

    # A class that many others are checked against is dealt out to as many tasks as it needs.
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"))
    parts = materialize(parts, "pair_parts")
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    one = sets.select(F.col("cid").alias("a"), F.col("set").alias("x")).join(parts, "a")
    one = one.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "x")
    two = sets.select(F.col("cid").alias("b"), F.col("set").alias("y"))
    return dealt.join(two, "b").join(one, ["a", "part"]).filter(check("x", "y")).select("a", "b")


def first_links(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between a class and the first class that it shares most buckets with."""
    best = (
        found.filter("cid <> first")
        .groupBy("cid", "first")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("cid")
        .agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("first"))
    )
    return verified(best.select(F.col("first").alias("a"), F.col("cid").alias("b")), sets)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share. Shingles that few sets have are counted pair by pair
    from the sets that have them; the others as products of matrices of ``COLUMNS`` shingles."""
    m, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    by = np.argsort(place, kind="stable")
    owner, starts = owner[by], np.cumsum(count) - count
    for n in range(2, OFTEN):
        rows = owner[starts[count == n][:, None] + np.arange(n)[None, :]]
        for i in range(n):
            for j in range(i + 1, n):
                np.add.at(out, (rows[:, i], rows[:, j]), 1)
                np.add.at(out, (rows[:, j], rows[:, i]), 1)
    often = np.flatnonzero(count >= OFTEN)
    for at in range(0, len(often), COLUMNS):
        some = often[at : at + COLUMNS]
        has = np.zeros((m, len(some)), np.float32)
        has[np.concatenate([owner[s : s + c] for s, c in zip(starts[some], count[some], strict=True)]), np.repeat(np.arange(len(some)), count[some])] = 1
        out += has @ has.T
    return out


def cell_links(cell: pd.DataFrame) -> pd.DataFrame:
    """Links of a cell that join components: the members of one or two chunks. All counts of shared
    shingles come at once, so look-alikes that are not linked cost no comparison each."""
    cell = cell.drop_duplicates("cid").sort_values(["chunk", "cid"], ignore_index=True)
    sets = list(cell["set"])
    size = cell["set"].map(len).to_numpy()
    parent = {c: c for c in set(cell["component"])}
    component, chunk, cid = (cell[c].to_numpy() for c in ("component", "chunk", "cid"))
    ok = 180 * shared_counts(sets).astype(np.float64) >= 80 * (size[:, None] + size[None, :])
    ok &= np.triu(component[:, None] != component[None, :], 1)
    if chunk[0] != chunk[-1]:
        ok &= chunk[:, None] != chunk[None, :]

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        a, b = root(component[i]), root(component[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((cid[i], cid[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def remaining_links(found: DataFrame, labels: DataFrame, sets: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """Links between components that still share a bucket, each cell's joining ones."""
    known = labels.select(F.col("node").alias("cid"), "component")
    named = found.select("key", "cid", "size").join(known, "cid", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "cid")), "named")
    open_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    left = materialize(named.join(open_.select("key"), "key"), "open_buckets")
    if left.isEmpty():
        return left.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    # Classes that buckets chain together form a cluster. A cluster is cut by its number of
    # shingles, and classes with the same largest bucket, their home, stay together if they can.
    chain = left.join(left.groupBy("key").agg(F.min("cid").alias("a")), "key").select("a", F.col("cid").alias("b"))
    clusters = connected_components(chain).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    home = left.groupBy("cid").agg(F.max(F.struct("size", "key")).alias("h"), F.min("component").alias("component"))
    home = home.select("cid", "component", F.col("h.key").alias("home")).join(clusters, "cid").join(sizes, "cid")
    home = materialize(home, "homes")
    parts = lambda by, name: materialize(
        home.groupBy(by).agg(F.ceil(F.sum(F.col("n_shingles") + CLASS) / chunk).alias(name)), name
    )
    dealt = home.join(parts("cluster", "cluster_parts"), "cluster").join(parts("home", "home_parts"), "home").select(
        "cid",
        "component",
        F.xxhash64(
            "cluster",
            F.pmod(F.xxhash64("home"), F.col("cluster_parts")),
            F.pmod(F.xxhash64("cid"), F.col("home_parts")),
        ).alias("chunk"),
    )
    dealt = materialize(dealt, "chunks")
    meet = left.select("key", "cid").join(dealt.select("cid", "chunk"), "cid").select("key", "chunk").distinct()
    meet = materialize(meet, "meet")
    other = meet.select("key", F.col("chunk").alias("chunk2"))
    cells = meet.join(other, "key").filter("chunk <= chunk2").select("chunk", "chunk2").distinct()
    cells = materialize(cells.withColumn("cell", F.xxhash64("chunk", "chunk2")), "cells")
    sides = cells.select("cell", F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk"))
    loaded = sides.join(dealt, "chunk").join(sets.select("cid", "set"), "cid")
    return loaded.groupBy("cell").applyInPandas(cell_links, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept`` and keys of the row."""
    rows = materialize(described(docs, words), "described")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "digest")
    classes = rows.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(
        F.min(place).alias("first"), F.any_value("bands").alias("bands")
    )
    classes = materialize(classes.withColumn("cid", F.col("first.row")), "classes")
    found = buckets(classes)
    involved = found.select("cid").distinct()
    wanted = classes.join(involved, "cid", "left_semi").select("cid", "first.doc_id", "first.digest")
    sets = materialize(shingle_sets(docs, wanted, words), "sets")
    links = materialize(first_links(found, sets), "first_links")
    labels = connected_components(links)
    more = materialize(remaining_links(found, labels, sets, classes.select("cid", "n_shingles"), chunk), "more_links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
        "h1", "h2", "n_shingles", F.coalesce("component", "cid").alias("component"), "first"
    )
    named = materialize(named, "named_classes")
    heads = materialize(named.groupBy("component").agg(F.min("first").alias("head")), "heads")
    by_class = materialize(named.join(heads, "component").select("h1", "h2", "n_shingles", "head"), "by_class")
    full = rows.select("row", "doc_id", "digest", "n_shingles", "h1", "h2").join(by_class, ["h1", "h2", "n_shingles"], "left")
    alone = F.col("head").isNull()
    return full.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (alone | F.coalesce(F.col("doc_id") == F.col("head.doc_id"), F.col("row") == F.col("head.row"))).alias("kept"),
        "digest",
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each component of ``docs``, with the columns it had."""
    kept = materialize(near_duplicates(docs, words).filter("kept").select("doc_id", "digest"), "kept")
    return keep_one(docs, kept, F.xxhash64(text_of()))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(read(spark, sf_dir, "documents"), words=4).drop("digest")
