"""A stored index of cells for approximate cosine search.

Vectors are assigned to the nearest of a number of fitted centres and written by cell: the cell is
the partition column, and a row is a page of up to ``PAGE`` ids and vectors, so that a cell of any size is
many rows of bounded size. The centres are a small table beside them. A search ranks the centres for each
query, joins pages on the cells that are probed, and reads no others: the cells' numbers pass to the scan
as a filter on its partitions while it runs, and are all that is broadcast. Pages and blocks of queries
meet by a shuffle; a row of that join is one page and one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unit
from ..session import stored
from .ranking import _above, _type, top_k, unit_rows

#: Rows that cells are fitted on at most, vectors of a page, queries of a block, and cells at most
#: (each is a folder, and all centres are broadcast).
FIT_ROWS, PAGE, ASKED, MOST_CELLS = 100_000, 1024, 512, 16_384


def fitted_centres(vectors: DataFrame, count: int, seed: int = 1) -> np.ndarray:
    """Centres of unit vectors, fitted on at most ``FIT_ROWS`` rows, those with the smallest hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = vectors
    if vectors.count() > FIT_ROWS:
        # only hashes and ids are sorted, and as many tasks as there are cores fit the rows
        place = F.struct(F.xxhash64("doc_id"), "doc_id")
        last = vectors.select(place.alias("__place")).orderBy("__place").limit(FIT_ROWS).agg(F.max("__place").alias("__last"))
        some = vectors.crossJoin(F.broadcast(last)).filter(place <= F.col("__last"))
    # in order, as the fit's first centres are drawn by rows' places
    some = some.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "doc_id").sortWithinPartitions("doc_id")
    held = stored(some.select(array_to_vector(unit(F.col("embedding")).cast("array<double>")).alias("v")), "fit")
    model = KMeans(k=count, seed=seed, featuresCol="v", maxIter=10).fit(held)
    return np.array(model.clusterCenters())


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of unit vectors, nearest first."""
    far = (centres**2).sum(axis=1) - 2 * x @ centres.T
    n = min(n, far.shape[1])
    some = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)


class CellIndex:
    """Cells and their centres below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, vectors: DataFrame, path: str, cells: int | None = None) -> CellIndex:
        """Index all of ``vectors`` (doc_id, embedding). There are as many cells as a cell has vectors,
        up to ``MOST_CELLS``, unless ``cells`` says otherwise."""
        spark = vectors.sparkSession
        rows = vectors.select("doc_id", "embedding")
        centres = fitted_centres(rows, cells or min(MOST_CELLS, max(16, isqrt(rows.count()))))
        shared, doc = spark.sparkContext.broadcast(centres), dict(rows.dtypes)["doc_id"]

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = _nearest(unit_rows(batch.column("embedding")), shared.value, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], ["cell", "doc_id", "embedding"])

        def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # sorted by cell; a batch ends the page it is in
                cell = batch.column("cell").to_numpy()
                for a, b in zip(at := np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), np.append(at[1:], len(cell)), strict=True):
                    for start in range(a, b, PAGE):
                        part = batch.slice(start, min(PAGE, b - start))
                        ends = pa.array([0, part.num_rows], pa.int32())
                        flat = part.column("embedding").flatten().cast(pa.float32())
                        lists = [pa.ListArray.from_arrays(ends, part.column("doc_id")), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)]
                        yield pa.RecordBatch.from_arrays([*lists, pa.array([cell[a]], pa.int32())], ["ids", "vectors", "cell"])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.mapInArrow(assigned, f"cell int, doc_id {doc}, {_type(rows, 'embedding')}")
        # ranges of (cell, hash), so that a large cell is dealt to several tasks and a small one is one file
        dealt = placed.repartitionByRange(n, "cell", F.xxhash64("doc_id")).sortWithinPartitions("cell")
        dealt.mapInArrow(paged, f"ids array<{doc}>, vectors array<float>, cell int").write.partitionBy("cell").parquet(f"{path}/pages")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
        return cls(spark, path)

    def centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()])

    def probes(self, queries: DataFrame, share: float) -> DataFrame:
        """``query_id, cell, place`` of the nearest cells of each query, a share of all, nearest first."""
        centres = self.centres()
        n, shared = max(1, round(share * len(centres))), self.spark.sparkContext.broadcast(centres)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = _nearest(unit_rows(batch.column("embedding")), shared.value, n)
                    rows = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                    places = np.tile(np.arange(cells.shape[1], dtype=np.int32), batch.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query_id").take(rows), batch.column("embedding").take(rows), pa.array(cells.ravel().astype(np.int32)), pa.array(places)],
                        ["query_id", "embedding", "cell", "place"],
                    )

        asked = queries.select("query_id", "embedding")
        return asked.mapInArrow(near, f"{_type(asked, 'query_id')}, {_type(asked, 'embedding')}, cell int, place int")

    def search(self, queries: DataFrame, k: int, share: float = 0.1) -> DataFrame:
        """Cosine top-k within the nearest cells of each query; with a share of 1 it is exact."""
        pages = self.spark.read.parquet(f"{self.path}/pages")
        probes = stored(self.probes(queries, share), "probes").filter(F.col("place") >= 0)
        pages = pages.join(F.broadcast(probes.select("cell").distinct()), "cell")
        block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // ASKED))))
        # a query's vector is there for each of its cells, in files a small part of its size in memory, by
        # which Spark would broadcast it: with all cells, as many vectors as queries times cells
        asked = probes.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked")).hint("merge")
        schema = f"{_type(queries, 'query_id')}, doc_id {dict(pages.dtypes)['ids'][6:-1]}, score double"

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    own, ids = (batch.column(c)[n].values for c in ("asked", "ids"))
                    x = batch.column("vectors")[n].values.to_numpy().astype(np.float64).reshape(len(ids), -1)
                    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
                    scores = unit_rows(own.field("embedding")) @ x.T
                    row, col = _above(scores, k)
                    yield pa.RecordBatch.from_arrays(
                        [own.field("query_id").take(pa.array(row)), ids.take(pa.array(col)), pa.array(scores[row, col])], ["query_id", "doc_id", "score"]
                    )

        return top_k(pages.join(asked, "cell").select("asked", "ids", "vectors").mapInArrow(scored, schema), k)


def recall_by_share(index: CellIndex, queries: DataFrame, exact: DataFrame, k: int, shares: tuple[float, ...]) -> DataFrame:
    """``share, cells, vectors, recall``: for each share of the cells, how many (query, cell) and (query,
    vector) pairs are met, and how much of the exact ranking a search finds.

    It finds a vector of the exact ranking just if that one's cell is probed, as no more vectors come
    before it there than among all. So the places at which a query probes the cells tell all shares.
    """
    pages, n = index.spark.read.parquet(f"{index.path}/pages"), len(index.centres())
    probes = stored(index.probes(queries, max(shares)).select("query_id", "cell", "place"), "probes")
    want = stored(exact.filter(F.col("rank") <= k).select("query_id", "doc_id"), "exact")
    sizes = pages.groupBy("cell").agg(F.sum(F.size("ids")).alias("size"))
    met = probes.groupBy("place", "cell").agg(F.count(F.lit(1)).alias("times")).join(sizes, "cell")
    met = met.groupBy("place").agg(F.sum("times").alias("cells"), F.sum(F.col("times") * F.col("size")).alias("vectors"))
    own = pages.select("cell", F.explode("ids").alias("doc_id")).distinct()
    same = want.join(own, "doc_id").join(probes, ["query_id", "cell"]).groupBy("place").agg(F.count(F.lit(1)).alias("same"))
    upto = index.spark.createDataFrame([(s, max(1, round(s * n))) for s in shares], "share double, upto int")
    rows = upto.join(met.join(same, "place", "left"), F.col("place") < F.col("upto"), "left").groupBy("share")
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cells", "vectors", "same")])
    return sums.crossJoin(want.agg(F.count(F.lit(1)).alias("all"))).select("share", "cells", "vectors", F.try_divide("same", "all").alias("recall"))
