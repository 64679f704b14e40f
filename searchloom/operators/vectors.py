"""Versioned vector tables, approximate search, parity checks.

A version is named after its model, dimension and corpus; a pointer names the live one and moves last.
Both are logs of commits (``sources.commits``), so a reader sees a whole version and one pointer at any
time, whatever is being written or has been left unfinished, and of two writers none is lost.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm, shortened
from ..session import scratch
from ..sources.commits import CommitLog
from .cells import CellIndex
from .ingest import first_by, hits_to_ids
from .metrics import means, per_query
from .ranking import dense_top_k, dot


def version_name(prefix: str, model: str, dim: int, fingerprint: str | None) -> str:
    token = re.sub("[^a-z0-9]+", "-", model.lower()).strip("-") or "model"
    return f"{prefix}__{token}__{dim}d__{fingerprint or 'nofp'}"


def parsed_names(names: DataFrame) -> DataFrame:
    """``prefix, model_slug, dim, fingerprint`` of version names, read from the right."""
    at = lambda i: F.regexp_extract("name", r"^(.*)__(.*)__(-?[0-9]+)d__(.*)$", i)
    ok = at(1) != ""
    some = lambda c: F.when(ok, c)
    return names.select("name", some(at(1)).alias("prefix"), some(at(2)).alias("model_slug"), some(at(3)).cast("int").alias("dim"), some(at(4)).alias("fingerprint"))


#: Deltas of a version that are read beside its base before they are merged into a new one.
DELTAS = 8


class VectorStore:
    """Versions and the live pointer below one folder that all executors see.

    A version is a base and the deltas since. An upsert writes its own points alone, as a delta; a reader
    takes the newest row of each id in the deltas, and the base's rows of all other ids. After
    ``DELTAS`` of them the whole is written as a new base.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/versions/{name}"

    def _log(self, name: str) -> CommitLog:
        return CommitLog(self.spark, self._path(name))

    def _pointers(self, prefix: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/live/{prefix}")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[str]:
        fs, path = self._fs()
        root = path(f"{self.root}/versions")
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    @staticmethod
    def _current(entries: list[dict]) -> list[dict]:
        """The last base and the deltas since."""
        last = max((i for i, e in enumerate(entries) if e["kind"] == "base"), default=0)
        return entries[last:]

    def exists(self, name: str) -> bool:
        return bool(self._log(name).entries())

    def upsert(self, name: str, points: DataFrame, recreate: bool = False) -> None:
        """Add points (point_id, embedding, ...) to a version, or make it of them alone. Of equal ids
        the last written stays, of those written together the last by ``seq``."""
        log = self._log(name)
        path = log.fresh()
        first_by(points, ["point_id"], F.desc("seq")).write.parquet(path)
        log.commit(lambda entries: {"kind": "base" if recreate or not entries else "delta", "path": path})
        if len(self._current(log.entries())) > DELTAS + 1:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Write a version's rows as a new base; again, if points are added meanwhile."""
        log = self._log(name)

        def base(entries: list[dict]) -> dict:
            path = log.fresh()
            self._rows(entries).write.parquet(path)
            return {"kind": "base", "path": path}

        log.commit(base)

    def _rows(self, entries: list[dict]) -> DataFrame:
        read = [self.spark.read.parquet(e["path"]) for e in self._current(entries)]
        if len(read) == 1:
            return read[0]
        later = None
        for n, delta in enumerate(read[1:]):
            delta = delta.withColumn("__n", F.lit(n))
            later = delta if later is None else later.unionByName(delta, True)
        newest = first_by(later, ["point_id"], F.desc("__n")).drop("__n")
        return read[0].join(newest.select("point_id"), "point_id", "left_anti").unionByName(newest, True)

    def scan(self, name: str) -> DataFrame:
        return self._rows(self._log(name).entries())

    def live(self, prefix: str) -> str | None:
        pointers = self._pointers(prefix).entries()
        return pointers[-1]["name"] if pointers else None

    def point(self, prefix: str, name: str) -> None:
        """Make ``name`` live. A version of another family or that does not exist is an error."""
        if not name.startswith(prefix + "__") or not self.exists(name):
            raise ValueError(f"no version {name} of {prefix}")
        self._pointers(prefix).commit(lambda _: {"kind": "live", "name": name})

    def publish(self, prefix: str, model: str, dim: int, fingerprint: str | None, points, expected: int, recreate: bool = False) -> tuple[str, bool]:
        """Write a version unless it is there in full, then make it live; ``points()`` gives its
        rows. Returns the name and whether it was written."""
        name = version_name(prefix, model, dim, fingerprint)
        full = not recreate and self.exists(name) and self.scan(name).count() == expected
        if not full:
            self.upsert(name, points(), recreate=True)
            if self.scan(name).count() != expected:
                raise RuntimeError(f"{name} holds another number of points than {expected}")
        self.point(prefix, name)
        return name, not full

    def prune(self, prefix: str) -> list[str]:
        """Delete all versions of a family but the live one, and what writes and pointers before the
        last have left."""
        fs, path = self._fs()
        live = self.live(prefix)
        gone = [n for n in self.versions() if n.startswith(prefix + "__") and n != live]
        for name in gone:
            fs.delete(path(self._path(name)), True)
        for log in (self._pointers(prefix), *([self._log(live)] if live else [])):
            entries = log.entries()
            kept = entries[-1:] if log.root.endswith(f"/live/{prefix}") else self._current(entries)
            log.forget([e for e in entries if e not in kept])
        return gone

    def status(self, prefix: str, dim: int, model: str) -> DataFrame:
        """Each version of a family: points, dimension, whether live, and whether it fits a model."""
        live, rows = self.live(prefix), None
        for name in (n for n in self.versions() if n.startswith(prefix + "__")):
            one = self.scan(name).agg(F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).alias("dim"))
            one = one.select(F.lit(name).alias("name"), "points", "dim", F.lit(name == live).alias("live"))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            raise ValueError(f"no version of {prefix}")
        token = version_name(prefix, model, dim, None).split("__")[-3]
        return rows.withColumn("dim_matches", F.col("dim") == dim).withColumn("model_matches", F.contains("name", F.lit(f"__{token}__")))

    def searchable(self, prefix: str, dim: int) -> DataFrame:
        """The live version's points; none, or another dimension, is an error."""
        name = self.live(prefix)
        if name is None:
            raise ValueError(f"nothing of {prefix} is live")
        points = self.scan(name)
        if f"__{dim}d__" not in name:
            raise ValueError(f"{name} does not have {dim} dimensions")
        return points


def parity(a: DataFrame, b: DataFrame, floor: float = 0.999) -> DataFrame:
    """Cosine of two encoders' vectors of the same key, and whether they agree."""
    both = a.select("key", F.col("embedding").alias("x")).join(b.select("key", F.col("embedding").alias("y")), "key")
    cosine = dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y")) + 1e-12)
    return both.select("key", cosine.alias("cosine")).withColumn("agrees", F.col("cosine") >= floor)


def approximate_top_k(queries: DataFrame, corpus: DataFrame, k: int, n_cells: int | None = None, probed: float = 0.75) -> DataFrame:
    """Cosine top-k within the nearest cells of each query, a share ``probed`` of them, of a corpus that
    is indexed for this search alone. An index that serves many searches is a ``CellIndex``."""
    return CellIndex.write(corpus, scratch(corpus.sparkSession, "cells"), n_cells).search(queries, k, probed)


def approximation_loss(exact: DataFrame, approximate: DataFrame, qrels: DataFrame) -> DataFrame:
    """Exact minus approximate, of each metric."""
    queries = exact.select("query_id").distinct()
    one = means(per_query(exact, qrels, queries)).select("metric", F.col("mean").alias("exact"))
    two = means(per_query(approximate, qrels, queries)).select("metric", F.col("mean").alias("approximate"))
    return one.join(two, "metric").withColumn("loss", F.round(F.col("exact") - F.col("approximate"), 6))


def judging_list(ranking: DataFrame, corpus: DataFrame, n: int = 10, length: int = 200) -> DataFrame:
    """The first documents of each query with their texts cut for a reader."""
    first = ranking.filter(F.col("rank") <= n)
    text: Column = shortened(F.col("text"), length)
    return first.join(corpus, "doc_id").select("query_id", "doc_id", "rank", "score", text.alias("text"))


def judging_search(
    queries: DataFrame, vectors: DataFrame, corpus: DataFrame, n: int = 10, length: int = 200,
    store: VectorStore | None = None, prefix: str = "", model: str = "", dim: int = 0,
) -> DataFrame:
    """The ``n`` most similar documents of each query (query_id, embedding), for a reader to judge.

    If the store's live version is of this model and dimension its vectors are searched, more than
    are asked for (``max(3 n, 30)``), as it may hold other documents; its payloads (title, content)
    are mapped to the corpus by content. Otherwise ``vectors`` (doc_id, embedding) are.
    """
    live = store.live(prefix) if store else None
    if live and live.startswith(version_name(prefix, model, dim, None).removesuffix("nofp")):
        points = store.searchable(prefix, dim)
        hits = dense_top_k(queries, points.select(F.col("point_id").alias("doc_id"), "embedding"), max(3 * n, 30))
        named = hits.join(points.select(F.col("point_id").alias("doc_id"), "title", "content"), "doc_id")
        ranked = hits_to_ids(named.select("query_id", "rank", "title", "content"), corpus, n)
    else:
        ranked = dense_top_k(queries, vectors, n).select("query_id", "doc_id", "rank")
    return ranked.join(corpus.select("doc_id", "title", shortened(F.col("text"), length).alias("text")), "doc_id")
