"""Training sets: round-trip filter, negatives, contrastive tables, encoders and generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..session import stored
from .ingest import first_by
from .ordering import numbered
from .ranking import forward_index, guarded_negatives, own_rank


def round_trip(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Pairs whose own document is among the first ``k`` for their query; ``k`` 0 keeps all."""
    if not k:
        return pairs
    ranks = own_rank(pairs, queries, corpus).filter(F.col("own_rank") <= k)
    return pairs.join(ranks.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")


def mined(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, n: int, margin: float = 0.05) -> DataFrame:
    """``query_id, doc_id, negatives``: guarded hard negatives, the most similar first."""
    found = guarded_negatives(pairs, queries, corpus, n, margin)
    best = found.groupBy("query_id", F.col("own_doc").alias("doc_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("negatives")
    )
    empty = F.array().cast(dict(best.dtypes)["negatives"])
    out = pairs.select("query_id", "doc_id").join(best, ["query_id", "doc_id"], "left")
    return out.withColumn("negatives", F.coalesce("negatives", empty))


def padded(rows: DataFrame, cap: int | None = None, seed: int = 13) -> DataFrame:
    """Rows (seq, positive, negatives: document keys) with as many negatives as the row with the
    most, at most ``cap``. Short rows borrow distinct documents of other rows, never their own; only
    if those run out they repeat their own. ``padded`` tells which rows were filled.

    The pool is numbered in an order drawn by hash. A row takes the numbers from a place drawn by
    hash on, as many as it needs and owns, so it finds enough if the pool has enough; the pool is
    joined by an equal key and never paired with all rows.
    """
    size = F.size("negatives")
    target = rows.agg(F.max(size).alias("t")).select(F.least("t", F.lit(cap if cap is not None else 1 << 30)).alias("target"))
    pool = rows.select(F.explode(F.concat("negatives", F.array("positive"))).alias("doc")).distinct()
    placed = stored(numbered(pool, "place", F.xxhash64(F.lit(seed), "doc"), F.col("doc")).withColumn("place", F.col("place") - 1), "pool")
    total = placed.agg(F.count(F.lit(1)).alias("pool"))
    whole = rows.crossJoin(target).crossJoin(total).withColumn("need", F.greatest(F.col("target") - size, F.lit(0)))
    mine = F.array_distinct(F.concat("negatives", F.array("positive")))
    tries = F.sequence(F.lit(0), F.least(F.col("pool"), (F.col("need") + F.size("mine")).cast("bigint")).cast("int") - 1)
    drawn = whole.filter("need > 0").withColumn("mine", mine).select("seq", "need", "mine", F.explode(tries).alias("i"), "pool")
    drawn = drawn.withColumn("place", (draw(seed, F.col("seq")) + F.col("i")) % F.col("pool")).join(placed, "place")
    fresh = drawn.filter(~F.array_contains("mine", F.col("doc")))
    taken = fresh.withColumn("n", F.row_number().over(Window.partitionBy("seq").orderBy("i"))).filter("n <= need")
    borrowed = taken.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc"))), lambda x: x["doc"]).alias("more"))
    out = whole.join(borrowed, "seq", "left")
    given = F.concat(F.slice("negatives", 1, F.greatest(F.col("target"), F.lit(0))), F.coalesce("more", F.array().cast("array<string>")))
    cycled = F.when(F.size(given) == 0, given).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("target"), F.lit(1)) - 1), lambda i: F.element_at(given, (i % F.size(given)) + 1))
    )
    return out.select("seq", "positive", F.when(F.col("target") > 0, cycled).otherwise(F.slice("negatives", 1, 0)).alias("negatives"), (F.col("need") > 0).alias("padded"))


def contrastive(rows: DataFrame, arity: int) -> DataFrame:
    """anchor, positive, negative, negative_2, ... from rows with formatted texts."""
    names = ["negative" if i == 0 else f"negative_{i + 1}" for i in range(arity)]
    return rows.select(
        "seq", "anchor", "positive", *[F.get("negatives", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


def training_eval(test: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents ``d-i``, queries ``q-i`` with their document): the test pairs' documents in order
    of first sight, then train positives as distractors. Pairs have seq, query, title, content."""
    both = test.withColumn("part", F.lit(0)).unionByName(train.withColumn("part", F.lit(1)))
    key = F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("\x00"), "content"), 256)
    keyed = both.select(key.alias("key"), F.struct("part", "seq").alias("place"), "title", "content")
    first = first_by(keyed, ["key"], "place")
    # test documents take the first numbers, train documents those after them
    ahead = first.filter("place.part = 0")
    n = ahead.count()
    of = lambda df, start: numbered(df, "i", "place.seq").withColumn("i", F.col("i") + start)
    docs = of(ahead, -1).unionByName(of(first.filter("place.part = 1"), n - 1))
    docs = docs.withColumn("doc_id", F.concat(F.lit("d-"), F.col("i").cast("string")))
    asked = numbered(test.withColumn("key", key), "j", "seq")
    asked = asked.withColumn("query_id", F.concat(F.lit("q-"), (F.col("j") - 1).cast("string")))
    return docs.select("doc_id", "title", "content"), asked.join(docs.select("key", "doc_id"), "key").select("query_id", "query", "doc_id")


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The built-in encoder: counts of hashed trigrams of bytes at unit length; bits of a hash
    choose the dimension and the sign."""
    mix = np.uint32(2654435761)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for n, text in enumerate(texts):
            raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
            h = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * mix
            at = (h >> np.uint32(8)) % np.uint32(dim)
            plus = h >> np.uint32(31) == 1
            out[n] = np.bincount(at[plus], minlength=dim) - np.bincount(at[~plus], minlength=dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embedded(rows: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch: int = 32) -> DataFrame:
    """Add ``embedding`` to rows with ``text``. ``factory`` makes one encoder for each task; vectors
    of another length than ``dim`` are an error."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = factory()
        for frame in batches:
            parts = []
            for at in range(0, len(frame), batch):
                got = np.asarray(own([t or "" for t in frame["text"].iloc[at : at + batch]]), np.float32)
                if got.shape[1] != dim:
                    raise ValueError(f"the encoder gives {got.shape[1]} dimensions, not {dim}")
                parts += list(got)
            yield frame.assign(embedding=parts)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", embedding array<float>"
    return rows.mapInPandas(encode, schema)


def synthesized(corpus: DataFrame, generator: Callable[[str | None, str], list[str]], n: int, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, i, query``: up to ``n`` queries of each document by an injected generator;
    ``doc_id, error`` of documents whose generator failed ``retries`` times more)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for doc, title, text in zip(frame["doc_id"], frame["title"], frame["text"], strict=True):
                for attempt in range(retries + 1):
                    try:
                        rows += [(doc, i, q, None) for i, q in enumerate(generator(title, text)[:n])]
                        break
                    except Exception as e:  # noqa: BLE001  a generator may fail in any way
                        if attempt == retries:
                            rows.append((doc, -1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "i", "query", "error"])

    made = corpus.select("doc_id", "title", "text").mapInPandas(make, f"doc_id {dict(corpus.dtypes)['doc_id']}, i int, query string, error string")
    made = stored(made, "synthesized")
    return made.filter("error IS NULL").drop("error"), made.filter("error IS NOT NULL").select("doc_id", "error")


def default_queries(corpus: DataFrame, n: int = 3) -> DataFrame:
    """Without a generator: the ``n`` terms of each document with the highest tf-idf."""
    index = forward_index(corpus.withColumn("title", F.lit(None).cast("string")))
    terms = index.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("doc_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = corpus.agg(F.count(F.lit(1)).alias("n_docs"))
    weight = F.round(F.col("tf") * F.log((F.col("n_docs") + 1) / F.col("df")), 9)
    scored = terms.join(df, "term").crossJoin(total).withColumn("weight", weight)
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    best = scored.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= n)
    return best.select("doc_id", "i", F.col("term").alias("query"))
