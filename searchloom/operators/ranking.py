"""Rankings: exact dense search, BM25, rank fusion. Rankings are rows (query_id, doc_id, rank, score)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams
from ..session import stored

#: Bytes of query vectors that one block may hold, and of scores that are computed at once.
BLOCK_BYTES, TILE_BYTES = 32 << 20, 32 << 20


def top_k(scored: DataFrame, k: int | Column, by: list[str] | None = None) -> DataFrame:
    """The best ``k`` rows of each query, ranked; ties go to the smaller id.

    Catalyst limits each partition to its best ``k`` before the shuffle.
    """
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


#: Of a block of queries, their unit vectors, ids and unit vectors of documents: rows of a result.
Kernel = Callable[[pa.Table, np.ndarray, pa.Array, np.ndarray], pa.Table]


def _tiles(kernel: Kernel, queries: pa.Table, q: np.ndarray, docs: pa.Table | pa.RecordBatch) -> Iterator[pa.Table]:
    """The kernel's rows, tile by tile of so many documents that the scores stay within ``TILE_BYTES``."""
    x, ids = unit_rows(docs.column("embedding")), docs.column("doc_id")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    step = max(1, TILE_BYTES // (8 * max(1, len(q))))
    for at in range(0, len(x) if len(q) else 0, step):
        yield kernel(queries, q, ids.slice(at, step), x[at : at + step])


def meeting(queries: DataFrame, corpus: DataFrame, kernel: Kernel, schema: str, block: int = BLOCK_BYTES) -> DataFrame:
    """``kernel``'s rows for every query (query_id, embedding, ...) and document (doc_id, embedding).

    Queries that fit in one block are broadcast, and documents are scored where they lie. More of them
    are dealt over a grid: each query goes to one row of cells and each document to one column, a
    cell is a group of both in Arrow, and neither side passes through the driver. Of ``r`` query
    blocks and ``c`` document blocks, queries are sent ``c`` times and documents ``r`` times.
    """
    spark = corpus.sparkSession
    docs = corpus.select("doc_id", "embedding")
    first = queries.select(F.size("embedding")).first()
    width = 8 * max(1, first[0] if first else 1)
    rows = -(-queries.count() * width // block)
    if rows <= 1:
        shared = spark.sparkContext.broadcast(queries.toArrow())

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            q = unit_rows(own.column("embedding"))
            for batch in batches:
                for found in _tiles(kernel, own, q, batch):
                    yield from found.to_batches()

        return docs.mapInArrow(scored, schema)
    columns = max(1, -(-docs.count() * width // block))

    def dealt(df: DataFrame, key: str, own: int, others: int, cell: Callable[[Column, Column], Column]) -> DataFrame:
        # the running number keeps rows of one id from one block
        place = F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(own))
        spread = df.withColumn("__own", place).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return spread.withColumn("cell", cell(F.col("__own"), F.col("__other"))).drop("__own", "__other")

    left = dealt(queries, "query_id", rows, columns, lambda own, other: own * columns + other)
    right = dealt(docs, "doc_id", columns, rows, lambda own, other: other * columns + own)

    def met(own: pa.Table, others: pa.Table) -> pa.Table:
        found = list(_tiles(kernel, own, unit_rows(own.column("embedding")), others))
        return pa.concat_tables(found) if found else kernel(own.slice(0, 0), np.zeros((0, 1)), others.column("doc_id").combine_chunks().slice(0, 0), np.zeros((0, 1)))

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(met, schema)


def _type(df: DataFrame, column: str) -> str:
    return f"{column} {dict(df.dtypes)[column]}"


def _above(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's ``k`` largest scores; ties stay for the final order."""
    if not scores.size:
        return np.zeros(0, int), np.zeros(0, int)
    n = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    return np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK_BYTES) -> DataFrame:
    """Exact cosine top-k. A batch or cell of documents keeps the best ``k`` of each query, and what is
    kept is merged the same way: the best ``k`` of best ``k`` are those of all."""

    def best(own: pa.Table, q: np.ndarray, docs: pa.Array, x: np.ndarray) -> pa.Table:
        scores = q @ x.T
        row, col = _above(scores, k)
        return pa.table({"query_id": own.column("query_id").combine_chunks().take(pa.array(row)), "doc_id": docs.take(pa.array(col)), "score": scores[row, col]})

    asked = queries.select("query_id", "embedding")
    return top_k(meeting(asked, corpus, best, f"{_type(queries, 'query_id')}, {_type(corpus, 'doc_id')}, score double", block), k)


def _with_own(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """A row for each pair: ``query_id, own_doc, own_score, embedding``."""
    return queries.select("query_id", "embedding").join(_own_scores(pairs, queries, corpus).withColumnRenamed("doc_id", "own_doc"), "query_id")


def _own(own: pa.Table, docs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own scores and own documents as columns, documents as a row."""
    plain = lambda a: a.to_numpy(zero_copy_only=False)[:, None]
    return plain(own.column("own_score").combine_chunks()), plain(own.column("own_doc").combine_chunks()), docs.to_numpy(zero_copy_only=False)[None, :]


def own_rank(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, doc_id, own_score, own_rank`` of each pair: one and the number of documents
    that score higher, or as high with a smaller id. A kernel counts; counts are summed."""

    def count(own: pa.Table, q: np.ndarray, docs: pa.Array, x: np.ndarray) -> pa.Table:
        scores = q @ x.T
        score, mine, ids = _own(own, docs)
        near = np.abs(scores - score) < 1e-12
        ahead = ((scores > score) & ~near) | (near & (ids < mine))
        ahead &= ids != mine
        return own.select(["query_id", "own_doc", "own_score"]).append_column("ahead", pa.array(ahead.sum(axis=1).astype(np.int64)))

    schema = f"{_type(queries, 'query_id')}, own_doc {dict(corpus.dtypes)['doc_id']}, own_score double, ahead long"
    counted = meeting(_with_own(pairs, queries, corpus), corpus, count, schema, block)
    return counted.groupBy("query_id", F.col("own_doc").alias("doc_id"), "own_score").agg((F.sum("ahead") + 1).alias("own_rank"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _own_scores(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    from ..functions.text import unit

    q = queries.select("query_id", unit(F.col("embedding")).alias("q"))
    d = corpus.select("doc_id", unit(F.col("embedding")).alias("d"))
    both = pairs.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id")
    return both.select("query_id", "doc_id", dot(F.col("q"), F.col("d")).alias("own_score"))


def guarded_negatives(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, n: int, margin: float = 0.05, block: int = BLOCK_BYTES) -> DataFrame:
    """The ``n`` most similar other documents of each pair that stay below a share of the pair's
    own score, so that unlabelled positives are not taken for negatives."""

    def below(own: pa.Table, q: np.ndarray, docs: pa.Array, x: np.ndarray) -> pa.Table:
        scores = q @ x.T
        score, mine, ids = _own(own, docs)
        ceiling = np.where(score > 0, score * (1 - margin), score)
        row, col = _above(np.where((scores <= ceiling) & (ids != mine), scores, -np.inf), n)
        at = pa.array(row)
        named = [own.column(c).combine_chunks().take(at) for c in ("query_id", "own_doc")]
        return pa.table([*named, docs.take(pa.array(col)), pa.array(scores[row, col])], ["query_id", "own_doc", "doc_id", "score"])

    doc = dict(corpus.dtypes)["doc_id"]
    schema = f"{_type(queries, 'query_id')}, own_doc {doc}, doc_id {doc}, score double"
    found = meeting(_with_own(pairs, queries, corpus), corpus, below, schema, block)
    return top_k(found, n, by=["query_id", "own_doc"])


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, doc_len, terms, tfs`` of lower-case texts: the terms of ``bigrams``, found as numbers
    of two code points, with how often each occurs."""
    for batch in batches:
        found, counts, ends, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [0], []
        for text in batch.column("text").to_pylist():
            x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
            ok = ((x >= 48) & (x <= 57)) | ((x >= 97) & (x <= 122)) | ((x >= 0xAC00) & (x <= 0xD7A3))
            both = ok[:-1] & ok[1:]
            alone = ok.copy()
            alone[:-1] &= ~both
            alone[1:] &= ~both
            codes = np.concatenate(((x[:-1] << np.uint64(32) | x[1:])[both], (x << np.uint64(32))[alone]))
            terms, n = np.unique(codes, return_counts=True)
            found.append(terms)
            counts.append(n)
            ends.append(ends[-1] + len(terms))
            lengths.append(len(codes))
        distinct, at = np.unique(np.concatenate(found), return_inverse=True)
        names = pa.array([chr(c >> 32) + (chr(c & 0xFFFFFFFF) if c & 0xFFFFFFFF else "") for c in distinct.tolist()], pa.string())
        offsets = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(lengths, pa.int32()),
                pa.ListArray.from_arrays(offsets, names.take(pa.array(at))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts), pa.int32())),
            ],
            ["doc_id", "doc_len", "terms", "tfs"],
        )


def forward_index(corpus: DataFrame) -> DataFrame:
    """``doc_id, doc_len, terms, tfs`` of titled or untitled documents, a table: every text is cut
    into terms once, where it lies, whatever is asked of it later."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    schema = f"doc_id {dict(corpus.dtypes)['doc_id']}, doc_len int, terms array<string>, tfs array<int>"
    return stored(corpus.select("doc_id", F.lower(text).alias("text")).mapInArrow(counted_terms, schema), "terms")


def bm25_statistics(corpus: DataFrame | None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``term, df, idf``) and one row (``n_docs, avg_len``), of a corpus or its ``forward_index``."""
    index = forward_index(corpus) if index is None else index
    totals = index.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.crossJoin(totals.select("n_docs")).select("term", "df", idf.alias("idf")), totals


def bm25_top_k(queries: DataFrame, corpus: DataFrame | None, k: int, k1: float = 1.2, b: float = 0.75, index: DataFrame | None = None) -> DataFrame:
    """BM25 of a corpus or its ``forward_index``. Repeated terms of a query count repeatedly;
    documents that share no term are no candidates.

    Queries come in blocks whose matrix of term weights stays within ``BLOCK_BYTES``. A batch of
    documents becomes a matrix over the block's terms, in tiles, and keeps its best ``k`` of each
    query before anything is shuffled.
    """
    index = forward_index(corpus) if index is None else index
    asked = queries.select("query_id", F.explode(bigrams(F.col("text"))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    statistics, totals = bm25_statistics(None, index)
    weights = stored(asked.join(statistics, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "weights")
    size = weights.agg(F.count_distinct("query_id").alias("q"), F.count_distinct("term").alias("t")).first()
    mean = totals.first()["avg_len"] or 0.0
    schema = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(index.dtypes)['doc_id']}, score double"
    out = None
    # a block of few queries uses few terms, so this is the most that blocks can hold
    blocks = max(1, -(-size["q"] * min(size["t"], 1 << 20) * 8 // BLOCK_BYTES))
    for n in range(blocks):
        own = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toPandas()
        if not len(own):
            continue
        row, ids = pd.factorize(own["query_id"])
        col, terms = pd.factorize(own["term"])
        matrix = np.zeros((len(terms), len(ids)))
        matrix[col, row] = own["weight"].to_numpy()
        shared = index.sparkSession.sparkContext.broadcast((ids.to_numpy(), pa.array(terms), matrix))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, terms, matrix = shared.value
            step = max(1, TILE_BYTES // (8 * max(len(terms), len(ids))))
            names = pa.array(ids)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    lists = part.column("terms")
                    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                    term = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=terms), -1).to_numpy(zero_copy_only=False)
                    tf = pc.list_flatten(part.column("tfs")).to_numpy(zero_copy_only=False)
                    some = term >= 0
                    doc, term, tf = doc[some], term[some], tf[some]
                    length = part.column("doc_len").to_numpy(zero_copy_only=False)[doc]
                    tiles = np.zeros((part.num_rows, len(terms)))
                    tiles[doc, term] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                    scores = (tiles @ matrix).T
                    m = min(k, part.num_rows)
                    # a little under the k-th, so that scores equal after rounding stay
                    floor = np.partition(scores, part.num_rows - m, axis=1)[:, part.num_rows - m] - 1e-8
                    q, d = np.nonzero((scores >= floor[:, None]) & (scores > 0))
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(q)), part.column("doc_id").take(pa.array(d)), pa.array(scores[q, d])], ["query_id", "doc_id", "score"]
                    )

        found = index.mapInArrow(score, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = index.sparkSession.createDataFrame([], schema)
    # sums in another order differ in the last digits; a rounded score makes ties stable
    return top_k(out.withColumn("score", F.round("score", 9)).filter("score > 0"), k)


def rrf(rankings: list[tuple[DataFrame, float]], k: int = 60, depth: int = 50) -> DataFrame:
    """Weighted reciprocal rank fusion of two or more rankings; a weight of 0 adds nothing."""
    parts = None
    for ranking, weight in rankings:
        if weight:
            one = ranking.select("query_id", "doc_id", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("part"))
            parts = one if parts is None else parts.unionByName(one)
    fused = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"))
    return top_k(fused, depth)


def fusion_sweep(dense: DataFrame, lexical: DataFrame, steps: int = 10, k: int = 60, depth: int = 50) -> DataFrame:
    """Fused rankings for every weight 0, 1/steps, ..., 1 of the dense one, in one job.

    The grid is the small side: each ranking row meets its ``steps + 1`` weights.
    """
    grid = F.explode(F.array(*[F.lit(n / steps) for n in range(steps + 1)]))
    both = dense.select("query_id", "doc_id", "rank", F.lit(True).alias("is_dense")).unionByName(
        lexical.select("query_id", "doc_id", "rank", F.lit(False).alias("is_dense"))
    )
    weight = F.when(F.col("is_dense"), F.col("alpha")).otherwise(1 - F.col("alpha"))
    parts = both.withColumn("alpha", grid).withColumn("part", weight / (k + F.col("rank"))).filter("part > 0")
    fused = parts.groupBy("alpha", "query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"))
    return top_k(fused, depth, by=["alpha", "query_id"])
