"""Structured Streaming jobs with the rules of their batch twins."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import clicklog, runs
from ..operators.ingest import first_by
from ..operators.mining import embedded, hashed_encoder
from ..session import scratch, stored
from ..sources.commits import CommitLog
from ..sources.files import epoch_points

#: How long a key is remembered.
TTL = timedelta(days=7)
#: Time between two events of a session at most, and how much later than the newest an event may come.
GAP, LATE = "30 minutes", "1 hour"


def finished(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over what is there now into Parquet files."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", path + "-state")
        .option("path", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def closed_sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Events (ts timestamp, session, seq, query, results, clicks) gathered by session window; a
    session comes out when the watermark passes its end, and events whose own window the watermark
    has passed are dropped and counted (``late_events``). An event with a null or empty session is a
    session of its own."""
    alone = F.concat(F.lit("\x00solo-"), F.col("seq").cast("string"))
    return (
        events.withColumn("session", F.coalesce(F.nullif("session", F.lit("")), alone))
        .withWatermark("ts", late)
        .groupBy("session", F.session_window("ts", gap).alias("window"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "query", "results", "clicks"))).alias("events"))
        .select(F.concat_ws("@", "session", F.col("window.start").cast("string")).alias("session"), "events")
    )


def session_labels(sessions: DataFrame) -> DataFrame:
    """The click log's rules over closed sessions."""
    spread = sessions.select("session", F.explode("events").alias("e")).select("session", "e.*")
    return clicklog.labels(spread)


def batches(stream: DataFrame, path: str, made) -> StreamingQuery:
    """Run a stream over what is there now; ``made`` of each batch is written once, by its number."""

    def keep(batch: DataFrame, number: int) -> None:
        # written first, so that what the stream holds runs once, however often ``made`` reads it
        made(stored(batch, "batch")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_events(query: StreamingQuery) -> int:
    """Events that a stream has dropped because the watermark had passed their session, over all the
    progress that it still holds."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def stream_labels(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Labels of a stream of events, written in the batch in which their session closes."""
    return stream_labels_counted(spark, events)[0]


def stream_labels_counted(spark: SparkSession, events: DataFrame, path: str | None = None) -> tuple[DataFrame, int]:
    """The labels, and how many events came too late in this run; another run with the same ``path``
    goes on where the one before ended."""
    path = path or scratch(spark, "labels")
    query = batches(closed_sessions(events), path, session_labels)
    return spark.read.parquet(path).drop("batch"), late_events(query)


class BatchStore:
    """Rows of a stream's batches, each batch once: a commit carries the number of its batch, and a
    batch that comes again after a restart finds it and writes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def keep(self, batch: DataFrame, number: int) -> None:
        if any(e["batch"] == number for e in self.log.entries()):
            return
        path = self.log.fresh()
        batch.write.parquet(path)

        def entry(entries: list[dict]) -> dict:
            taken = any(e["batch"] == number for e in entries)  # by the same batch of a driver that was thought dead
            return {"kind": "void" if taken else "append", "path": None if taken else path, "batch": number}

        self.log.commit(entry)

    def scan(self, schema: str | StructType) -> DataFrame:
        paths = [e["path"] for e in self.log.entries() if e["path"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def recent(self, ttl: timedelta | None) -> list[str]:
        """Folders of the commits of the last ``ttl``, or all."""
        since = 0.0 if ttl is None else time.time() - ttl.total_seconds()
        return [e["path"] for e in self.log.entries() if e["path"] and e["at"] >= since]

    def keep_first(self, key: list[str], order: str, ttl: timedelta | None) -> Callable[[DataFrame, int], None]:
        """Keep the first row of each key, by ``order`` within a batch; a key that the store was given
        within ``ttl`` brings no more. The keys of that time's commits are all the state there is."""

        def keep(batch: DataFrame, number: int) -> None:
            first, known = first_by(stored(batch, "batch"), key, order), self.recent(ttl)
            if known:
                first = first.join(self.spark.read.schema(batch.schema).parquet(*known).select(*key), key, "left_anti").select(*batch.columns)
            self.keep(first, number)

        return keep

    def run(self, stream: DataFrame, keep: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """Take what is there now; the stream's checkpoint lies beside the store."""
        query = stream.writeStream.foreachBatch(keep or self.keep).option("checkpointLocation", self.log.root + "-state").trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def stream_appended(spark: SparkSession, pairs: DataFrame, existing: DataFrame, root: str | None = None, ttl: timedelta | None = TTL) -> DataFrame:
    """Pairs (seq, query, content) whose key neither ``existing`` nor the stream before has (within
    ``ttl``), in a store to which each batch is added once."""
    key = lambda df: df.withColumn("__q", F.trim(F.lower("query"))).withColumn("__c", F.sha2(F.trim("content"), 256))
    known = key(existing).select("__q", "__c").distinct()
    fresh = key(pairs).join(known, ["__q", "__c"], "left_anti").select("seq", "query", "content", "__q", "__c")
    store = BatchStore(spark, root or scratch(spark, "pairs"))
    store.run(fresh, store.keep_first(["__q", "__c"], "seq", ttl))
    return store.scan(fresh.schema).drop("__q", "__c")


def deduplicated(pairs: DataFrame, within: str = "1 day") -> DataFrame:
    """Equal (query, content) once within the watermark: state stays bounded."""
    return pairs.withWatermark("ts", within).dropDuplicatesWithinWatermark(["query", "content"])


def stream_verdicts(spark: SparkSession, lines: DataFrame, finished_epochs: DataFrame) -> DataFrame:
    """Verdicts on live runs (run_idx, line_no, value) against the epochs of finished ones.

    What the finished runs' medians are is ranked once, before the stream. An epoch of a batch meets one
    row of it, whose median is carried to that epoch, and the best of its own run so far, of which
    there is one number for a run, written with each batch. Lines are numbered by run or over all runs.
    """
    store, state = BatchStore(spark, scratch(spark, "verdicts")), CommitLog(spark, scratch(spark, "bests"))
    peers = stored(runs.peer_medians(finished_epochs), "peers")

    def judged(batch: DataFrame, number: int) -> None:
        before = [e for e in state.entries() if e["batch"] < number]
        best = spark.read.parquet(before[-1]["path"]) if before else spark.createDataFrame([], "run_idx bigint, before double")
        live = epoch_points(batch, "run_idx").withColumn("run_idx", F.col("run_idx").cast("bigint"))
        own = runs.best_so_far(live.select("run_idx", "epoch", "ndcg", "eval_loss"))
        own = stored(own.join(best, "run_idx", "left").select("run_idx", "epoch", F.greatest("best_ndcg", "before").alias("v")), "live")
        store.keep(runs.judged_by(own, peers), number)
        if not any(e["batch"] == number for e in state.entries()):
            both = best.unionByName(own.select("run_idx", F.col("v").alias("before")))
            path = state.fresh()
            both.groupBy("run_idx").agg(F.max("before").alias("before")).write.parquet(path)
            state.commit(lambda _: {"kind": "best", "path": path, "batch": number})

    query = lines.writeStream.foreachBatch(judged).option("checkpointLocation", store.log.root + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.scan("run_idx bigint, epoch int, best double, median double, prune boolean")


def stream_leaderboard(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """Mean and best score of each configuration, kept up to date (the last state is returned)."""
    path = scratch(spark, "board")
    board = scored.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg("ndcg").alias("mean"), F.max("ndcg").alias("best"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = board.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    whole = spark.read.parquet(path)
    last = whole.agg(F.max("batch").alias("last"))
    return whole.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("batch", "last")


def stream_vectors(spark: SparkSession, documents: DataFrame, dim: int = 32, root: str | None = None, ttl: timedelta | None = TTL) -> DataFrame:
    """Documents (doc_id, text) embedded once for each distinct content (within ``ttl``), in a store to
    which each batch is added once."""
    keyed = documents.select(F.sha2("text", 256).alias("content"), "doc_id", "text")
    schema = "content string, doc_id bigint, embedding array<float>"
    store = BatchStore(spark, root or scratch(spark, "points"))

    def keep(batch: DataFrame, number: int) -> None:
        first, known = first_by(stored(batch, "batch"), ["content"], "doc_id"), store.recent(ttl)
        if known:
            first = first.join(spark.read.schema(schema).parquet(*known).select("content"), "content", "left_anti")
        store.keep(embedded(first, lambda: hashed_encoder(dim), dim).select("content", "doc_id", "embedding"), number)

    store.run(keyed, keep)
    return store.scan(schema)
