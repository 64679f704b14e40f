"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Graph. Every distinct vector is a node; its copies share it. Nodes are first compared with those of the
same block in ``PASSES`` sorted orders (signs of random projections, then one projection). Each round
of NN-descent then joins neighbours of neighbours: a node's neighbours and up to ``REVERSE`` of the
nodes that list it meet, pair by pair, if one of the pair is new to the lists, and a pair that is
better than the worst neighbour of one side is offered to it. Rounds end after ``ROUNDS``, or when no
list changes. For inner products the graph is that of ``(x, sqrt(M^2 - |x|^2))``, M the largest
norm: all such vectors are equally long, so that near and large inner product are the same.

Search. A query starts from its own node and the ``ENTRIES`` longest vectors. Each step takes the
``STEP`` best nodes of its list of ``BEAM`` that are not expanded yet to their neighbours, as a join
with the stored graph (bucketed by node, with the neighbours' vectors beside it), until all are. The
best ``RESCORED`` nodes are scored again, on the original vectors in double precision.

Precision. Within graph and search a component is one byte, by the vector's largest; this only moves
nodes that are almost as good as others. The tests measure the recall against brute force; on isotropic
vectors of 64 dimensions, as in the given tables, it takes these long lists.

Spark. All steps are joins and grouped scans of bounded groups: lists have at most ``NEIGHBOURS``,
members at most ``NEIGHBOURS + REVERSE`` rows. A node that very many list (a hub) answers them by a join
that Spark can split, hears of ``REVERSE`` of them, limited before the shuffle, and gets at most
``NEIGHBOURS`` offers from a batch. Every row is indexed; nothing but the mean vector, the largest norm
and ``ENTRIES`` vectors reaches the driver.

Edge cases. Vectors that are null, zero or hold null or non-finite components take no part. Queries are
those rows whose ``vec_id`` is divisible by ``every``; a query of null id is none, a candidate of null
id comes last among equals. Rows that have the query's own id are no candidates of it; repeated rows of
another id are candidates each. An id with several vectors asks one query for each. All vectors must
have one length, else it is an error. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialize, read, shared_dir, small_batches, stored_at
from .vector_codes import usable

NEIGHBOURS, REVERSE, PASSES, BLOCK, ROUNDS = 32, 32, 4, 1024, 4
BEAM, STEP, STEPS, ENTRIES, RESCORED, WANTED = 320, 40, 12, 16, 64, 20
SEED = 11
#: Rows of an Arrow batch at most; one of the stored graph holds its neighbours' vectors too.
ROWS = 4000


def encoded(x: np.ndarray, longest: float) -> list[bytes]:
    """A float32 scale, the float32 last component, and a byte for each of the others."""
    scale = np.abs(x).max(axis=1)
    whole = np.rint(x / scale[:, None] * 127).astype(np.int8)
    extra = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    head = np.stack([scale, extra], axis=1).astype(np.float32)
    return [h.tobytes() + w.tobytes() for h, w in zip(head, whole, strict=True)]


def decoded(data: np.ndarray) -> np.ndarray:
    """Vectors, the last component behind the others, of rows of bytes."""
    head = np.ascontiguousarray(data[:, :8]).view(np.float32)
    out = np.empty((len(data), data.shape[1] - 7), np.float32)
    out[:, :-1] = np.ascontiguousarray(data[:, 8:]).view(np.int8) * (head[:, :1] / np.float32(127))
    out[:, -1] = head[:, 1]
    return out


def _bytes(column: pa.Array) -> np.ndarray:
    """Binaries of one length as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 8), np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of lists; a null is empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return sizes, column.flatten().to_numpy(zero_copy_only=False)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield joined(held)
            held = []
        cut = np.flatnonzero(keys != keys[-1])
        if len(cut):
            yield joined([*held, batch.slice(0, cut[-1] + 1)])
            held = []
        held.append(batch.slice(cut[-1] + 1 if len(cut) else 0))
    if held:
        yield joined(held)


def _grouped(rows: DataFrame, key: str, made: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, *order: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(made, _whole_groups(batches, key))

    return rows.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _best(node: np.ndarray, other: np.ndarray, sim: np.ndarray, late: np.ndarray, limit: int) -> np.ndarray:
    """Positions of the ``limit`` best others of each node, in order; of equal others one that is not late."""
    order = np.lexsort((late, other, node))
    same = (node[order][1:] == node[order][:-1]) & (other[order][1:] == other[order][:-1])
    order = order[np.concatenate(([True], ~same))] if len(order) else order
    order = order[np.lexsort((other[order], -sim[order], node[order]))]
    starts = np.flatnonzero(np.concatenate(([True], node[order][1:] != node[order][:-1]))) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < limit]


GRAPH = "node bigint, vec binary, ids array<bigint>, sims array<float>, fresh array<boolean>"
OFFERS = "node bigint, id bigint, sim float"


def _merged(graph: DataFrame, offers: DataFrame, limit: int, aging: bool, step: int = 0) -> DataFrame:
    """Lists with what they are offered. What was there before is fresh no more, if ``aging``; with
    ``step``, ``asked`` are as many fresh ones, which are so no longer."""
    both = graph.select("node", "vec", "ids", "sims", "fresh").unionByName(offers.select("node", "id", "sim"), True)

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch.column("node").to_numpy()
        old = batch.column("vec").is_valid().to_numpy(zero_copy_only=False)
        given = np.flatnonzero(~old)
        sizes, ids = _lists(batch.column("ids"))
        nodes = np.concatenate((np.repeat(node, sizes), node[given]))
        others = np.concatenate((ids, batch.column("id").to_numpy(zero_copy_only=False)[given])).astype(np.int64)
        sims = np.concatenate((_lists(batch.column("sims"))[1], batch.column("sim").to_numpy(zero_copy_only=False)[given])).astype(np.float32)
        late = np.concatenate((np.zeros(len(ids), bool), np.ones(len(given), bool)))
        was = _lists(batch.column("fresh"))[1].astype(bool)
        fresh = np.concatenate((was & (not aging), np.ones(len(given), bool)))
        kept = _best(nodes, others, sims, late, limit)
        kept = kept[others[kept] != nodes[kept]] if aging else kept
        nodes, fresh = nodes[kept], fresh[kept]
        rows = np.flatnonzero(old)
        rows = rows[np.argsort(node[rows], kind="stable")]
        low, high = np.searchsorted(nodes, node[rows], "left"), np.searchsorted(nodes, node[rows], "right")
        ends = pa.array(np.concatenate(([0], np.cumsum(high - low))), pa.int32())
        columns = [pa.array(node[rows]), batch.column("vec").take(pa.array(rows))]
        columns += [pa.ListArray.from_arrays(ends, pa.array(v[kept])) for v in (others, sims)]
        if step:
            before = np.cumsum(fresh) - fresh
            now = fresh & (before - np.repeat(before[low] if len(before) else low, high - low) < step)
            counts = np.add.reduceat(np.append(now, False), low)[: len(low)] if len(low) else low
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts * (high > low)))), pa.int32()), pa.array(others[kept][now])))
            fresh = fresh & ~now
        columns.insert(4, pa.ListArray.from_arrays(ends, pa.array(fresh)))
        return pa.RecordBatch.from_arrays(columns, names)

    schema = GRAPH + (", asked array<bigint>" if step else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return _grouped(both, "node", made, schema)


def _first_offers(graph: DataFrame, nodes: int, centre: np.ndarray) -> DataFrame:
    """Each node's best of the blocks that it falls into when nodes are sorted by random projections."""
    dim, depth = len(centre), max(0, min(40, int(np.ceil(np.log2(max(1, nodes / BLOCK))))))
    planes = np.random.default_rng(SEED).normal(size=(PASSES, dim, depth + 1)).astype(np.float32)
    schema = "code bigint, along double, node bigint, vec binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = decoded(_bytes(batch.column("vec")))[:, :-1] - centre
            for n, own in enumerate(planes):
                at = x @ own
                code = (at[:, :depth] > 0) @ (1 << np.arange(depth)) + (n << 48)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code.astype(np.int64)), pa.array(at[:, depth].astype(np.float64)), batch.column("node"), batch.column("vec")], ["code", "along", "node", "vec"]
                )

    def offered(node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        k = min(NEIGHBOURS, len(node) - 1)
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(node), 0), int)
        own = np.repeat(node, at.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(node[at.ravel()]), pa.array(np.take_along_axis(sims, at, 1).ravel())], ["node", "id", "sim"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held, rows = None, [], 0

        def ready() -> pa.RecordBatch:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return offered(one.column("node").to_numpy(), decoded(_bytes(one.column("vec"))))

        for batch in batches:
            number = batch.column("code").to_numpy() >> 48
            at = 0
            while at < len(number):
                if held and (rows >= BLOCK or number[at] != order):
                    yield ready()
                    held, rows = [], 0
                order = number[at]
                size = min(BLOCK - rows, int((number[at:] == order).sum()))
                held.append(batch.slice(at, size))
                rows, at = rows + size, at + size
        if held:
            yield ready()

    n = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = graph.select("node", "vec").mapInArrow(placed, schema).repartitionByRange(n, "code", "along").sortWithinPartitions("code", "along", "node")
    return ordered.mapInArrow(met, OFFERS)


def _members(graph: DataFrame) -> DataFrame:
    """``node, id, fresh, vec, floor``: the neighbours of each node and some of those that list it, with
    their vectors and what a new neighbour of theirs must exceed."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("id"), F.col("e.fresh").alias("fresh"))
    some = Window.partitionBy("node").orderBy(F.xxhash64("node", "id"), "id")
    back = edges.select(F.col("id").alias("node"), F.col("node").alias("id"), "fresh").withColumn("r", F.row_number().over(some)).filter(F.col("r") <= REVERSE).drop("r")
    floor = F.when(F.size("ids") >= NEIGHBOURS, F.array_min("sims")).otherwise(F.lit(float("-inf"))).cast("float")
    return edges.unionByName(back).join(graph.select(F.col("node").alias("id"), "vec", floor.alias("floor")), "id")


def _joined_pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Offers of the pairs among each node's members."""
    node, ids = batch.column("node").to_numpy(), batch.column("id").to_numpy()
    fresh, floor = batch.column("fresh").to_numpy(zero_copy_only=False), batch.column("floor").to_numpy()
    x = decoded(_bytes(batch.column("vec")))
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    sizes, found = np.diff(np.append(starts, len(node))), []
    for at in range(0, len(starts), 128):
        first, size = starts[at : at + 128], sizes[at : at + 128]
        rows = first[:, None] + np.arange(size.max())[None, :]
        there = np.arange(size.max())[None, :] < size[:, None]
        rows = np.where(there, rows, 0)
        own, new = np.where(there, ids[rows], -1), there & fresh[rows]
        sims = x[rows] @ x[rows].transpose(0, 2, 1)
        good = sims > np.where(there, floor[rows], np.inf)[:, :, None]
        good &= (new[:, :, None] | new[:, None, :]) & there[:, None, :] & (own[:, :, None] != own[:, None, :])
        g, i, j = np.nonzero(good)
        found.append((own[g, i], own[g, j], sims[g, i, j]))
    a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
    best = _best(a, b, s, np.zeros(len(a), bool), NEIGHBOURS)
    return pa.RecordBatch.from_arrays([pa.array(a[best]), pa.array(b[best]), pa.array(s[best].astype(np.float32))], ["node", "id", "sim"])


class Graph:
    """Nodes (node, h1, h2, embedding, ids) of a table and their neighbours (node, vec, ids, sims)."""

    def __init__(self, vectors: DataFrame, rounds: int = ROUNDS):
        self.spark = spark = vectors.sparkSession
        rows = distinct_rows(vectors)
        first = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("vec_id"))
        few = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= WANTED + 1)
        classes = few.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.collect_list(F.struct("vec_id")).alias("copies"))
        self.nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        size = self.nodes.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("dim")).first()
        self.count, self.dim, longest = size["n"], size["dim"], size["longest"]
        if size["low"] != self.dim:
            raise ValueError("vectors must have one length")
        if not self.count:
            return
        centre = np.array(self.nodes.select(*[F.avg(F.col("embedding")[i]) for i in range(self.dim)]).first(), np.float32)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
                n = batch.num_rows
                none = pa.array([0] * (n + 1), pa.int32())
                empty = [pa.ListArray.from_arrays(none, pa.array([], t)) for t in (pa.int64(), pa.float32(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(encoded(x, longest), pa.binary()), *empty], ["node", "vec", "ids", "sims", "fresh"])

        self.entries = self.nodes.orderBy(norm.desc(), "node").limit(ENTRIES).select("node", "embedding").collect()
        bare = materialize(self.nodes.select("node", "embedding").mapInArrow(pack, GRAPH), "bare")
        path = fresh_path(spark, "graph")
        self.lists = stored_at(_merged(bare, _first_offers(bare, self.count, centre), NEIGHBOURS, True), path)
        for _ in range(rounds):
            offers = _grouped(_members(self.lists), "node", _joined_pairs, OFFERS)
            before, path = path, fresh_path(spark, "graph")
            self.lists = stored_at(_merged(self.lists, offers, NEIGHBOURS, True), path)
            discard(spark, before)
            if not self.lists.filter(F.exists("fresh", lambda f: f)).limit(1).count():
                break

    def bucketed(self) -> tuple[str, str]:
        """Name and folder of a table of each node's members and their vectors, bucketed by node."""

        def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, data = batch.column("node").to_numpy(), _bytes(batch.column("vec"))
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            ids = batch.column("id").to_numpy()
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(node)), strict=True):
                own, at = np.unique(ids[a:b], return_index=True)
                out.append((node[a], own, data[a + at].tobytes()))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["node", "ids", "vecs"])

        rows = _grouped(_members(self.lists), "node", packed, "node bigint, ids array<bigint>, vecs binary")
        name, n = f"graph_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_dir(self.spark)}/{name}"
        rows.repartition(n, "node").write.bucketBy(n, "node").sortBy("node").option("path", path).saveAsTable(name)
        return name, path

    def search(self, asked: DataFrame, beam: int = BEAM) -> DataFrame:
        """``node, id`` (a node) for the nodes of ``asked`` (node): themselves and the best found."""
        spark, dim = self.spark, self.dim
        entry_ids = np.array([r["node"] for r in self.entries], np.int64)
        entry_vectors = np.array([r["embedding"] for r in self.entries], np.float32).T

        def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, dim).astype(np.float32)
                node = batch.column("node").to_numpy()
                ids = np.concatenate((node[:, None], np.tile(entry_ids, (len(node), 1))), axis=1)
                sims = np.concatenate(((x * x).sum(axis=1)[:, None], x @ entry_vectors), axis=1)
                ends = pa.array(np.arange(len(node) + 1) * ids.shape[1], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (ids.ravel(), sims.ravel(), np.ones(ids.size, bool))]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in x], pa.binary()), *lists], ["node", "vec", "ids", "sims", "fresh"])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                query = batch.column("query").to_numpy()
                floor, vectors = batch.column("floor").to_numpy(), batch.column("vec").to_pylist()
                for n, (ids, data) in enumerate(zip(batch.column("ids"), batch.column("vecs").to_pylist(), strict=True)):
                    own = ids.values.to_numpy()
                    x = decoded(np.frombuffer(data, np.uint8).reshape(len(own), -1))
                    sims = x[:, :-1] @ np.frombuffer(vectors[n], np.float32)
                    good = sims > floor[n]
                    out.append((np.full(good.sum(), query[n]), own[good], sims[good]))
                if out:
                    a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
                    best = _best(a, b, s, np.zeros(len(a), bool), beam)
                    yield pa.RecordBatch.from_arrays([pa.array(a[best]), pa.array(b[best]), pa.array(s[best].astype(np.float32))], ["node", "id", "sim"])

        name, folder = self.bucketed()
        graph = spark.table(name)
        state = self.nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "embedding").mapInArrow(begun, GRAPH)
        path = fresh_path(spark, "beams")
        state = stored_at(_merged(state, spark.createDataFrame([], OFFERS), beam, False, STEP), path)
        for _ in range(STEPS):
            floor = F.when(F.size("ids") >= beam, F.array_min("sims")).otherwise(F.lit(float("-inf"))).cast("float")
            ask = state.select(F.col("node").alias("query"), F.col("vec"), floor.alias("floor"), F.explode("asked").alias("node"))
            offers = ask.join(graph, "node").select("query", "vec", "floor", "ids", "vecs").mapInArrow(scored, OFFERS)
            before, path = path, fresh_path(spark, "beams")
            state = stored_at(_merged(state, offers, beam, False, STEP), path)
            discard(spark, before)
            if not state.filter(F.size("asked") > 0).limit(1).count():
                break
        spark.sql(f"DROP TABLE {name}")
        discard(spark, folder)
        return state.select("node", F.explode(F.slice("ids", 1, RESCORED)).alias("id"))


def distinct_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (double) of rows that take part, and two hashes that stand for the vector."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", F.transform(x, lambda v: v + 0.0).alias("embedding"))
    rows = rows.filter(F.exists("embedding", lambda v: v != 0))
    return rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))


def nearest(vectors: DataFrame, k: int = WANTED, every: int = 20, beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` (at most ``WANTED``) nearest found for each row
    whose id is divisible by ``every``."""
    graph = Graph(vectors, rounds)
    queries = distinct_rows(vectors).filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    queries = materialize(queries.join(graph.nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("query_id", "node"), "queries")
    if not graph.count:
        pairs = queries.select("node", F.col("node").alias("id"))
    else:
        pairs = graph.search(queries)
    own = graph.nodes.select("node", F.col("embedding").alias("q"))
    other = graph.nodes.select(F.col("node").alias("id"), "embedding", "copies")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(other, "id").join(own, "node").select("node", "copies", dot.alias("score"))
    # the best of a node's candidates are the same for all of its queries, but for their own rows
    spread = scored.select("node", "score", F.explode("copies").alias("c")).select("node", "score", "c.vec_id")
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    best = spread.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(*order))).filter(F.col("r") <= k + 1)
    found = queries.join(best, "node").filter(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "node").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, ROWS)
    return nearest(read(spark, sf_dir, "embeddings"))
