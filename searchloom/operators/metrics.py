"""Retrieval metrics and statistics over rankings (query_id, doc_id, rank) and judgments
(query_id, doc_id, gain). Per-query scores are rows (query_id, metric, value)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from .ordering import numbered

CUTOFFS = (1, 3, 5, 10)
#: Bytes of scores that every task of a bootstrap may be given.
SCORE_BYTES = 32 << 20


def restricted(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have judgments."""
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def per_query(rankings: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, cutoffs: tuple[int, ...] = CUTOFFS, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """recall at each cutoff, mrr and ndcg at ``k``, of each query that is judged.

    ``queries`` are those that were ranked (default: those with rows in ``rankings``); one with an
    empty ranking scores 0. One join and one aggregation give all metrics. ``by`` are more keys
    of the rankings.
    """
    keys = [*by, "query_id"]
    asked = (rankings if queries is None else queries).select(*keys).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    ideal = qrels.withColumn("place", F.row_number().over(order)).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("relevant"),
        F.sum(F.when(F.col("place") <= k, F.col("gain") / F.log2(F.col("place") + 1))).alias("ideal"),
    )
    hits = rankings.join(qrels.withColumnRenamed("gain", "__gain"), ["query_id", "doc_id"]).groupBy(*keys).agg(
        *[F.count_if(F.col("rank") <= c).alias(f"hits_{c}") for c in cutoffs],
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, F.col("__gain") / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    whole = asked.join(ideal, "query_id").join(hits, keys, "left")
    values = [(f"recall@{c}", F.coalesce(F.col(f"hits_{c}") / F.col("relevant"), F.lit(0.0))) for c in cutoffs]
    values.append((f"mrr@{k}", F.coalesce(1 / F.col("first"), F.lit(0.0))))
    values.append((f"ndcg@{k}", F.coalesce(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), F.lit(0.0))))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values])
    return whole.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", "p.value")


def means(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def means_with_slices(scores: DataFrame, slices: DataFrame) -> DataFrame:
    """Means of all queries (``slice`` null) and of each slice, in one job.

    Slices are reported only if there are two or more; untagged queries count in the whole alone.
    """
    tagged = scores.join(slices.select("query_id", "slice"), "query_id", "left")
    both = tagged.rollup("metric", "slice").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    )
    kinds = slices.join(scores.select("query_id").distinct(), "query_id", "left_semi").agg(
        F.count_distinct("slice").alias("kinds")
    )
    keep = (F.col("g") == 1) | ((F.col("g") == 0) & F.col("slice").isNotNull() & (F.col("kinds") >= 2))
    return both.crossJoin(kinds).filter(keep & F.col("metric").isNotNull()).select("metric", "slice", "mean", "n")


def _drawn_in_blocks(scores: DataFrame, placed: DataFrame, n: int, names: list[str], resamples: int, seed: int) -> DataFrame:
    """``metric, b, mean`` of each resample. The scores are a matrix of known size that every task has; a
    task draws for a block of places and adds up, for each resample and metric, what it drew."""
    spark = scores.sparkSession
    rows = placed.select(F.col("at"), "query_id").join(scores, "query_id").select("at", "metric", "value").toArrow()
    values = np.full((n, len(names)), np.nan)
    at = {m: i for i, m in enumerate(names)}
    values[rows["at"].to_numpy(), [at[m] for m in rows["metric"].to_pylist()]] = rows["value"].to_numpy()
    shared = spark.sparkContext.broadcast(values)
    heads = [f"{seed}|{b}|".encode() for b in range(resamples)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = ~np.isnan(shared.value)
        filled = np.where(there, shared.value, 0.0)
        sums, times = np.zeros((resamples, len(names))), np.zeros((resamples, len(names)), np.int64)
        for batch in batches:
            tails = [str(j).encode() for j in batch.column("id").to_pylist()]
            for b, head in enumerate(heads):
                own = np.frombuffer(b"".join(md5(head + t).digest()[:4] for t in tails), ">u4") % len(filled)
                sums[b] += filled[own].sum(axis=0)
                times[b] += there[own].sum(axis=0)
        for i, name in enumerate(names):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sums[:, i].tolist()]), pa.array([times[:, i].tolist()])], ["metric", "sums", "times"])

    vectors = spark.range(n).mapInArrow(run, "metric string, sums array<double>, times array<bigint>")
    each = vectors.select("metric", F.posexplode(F.arrays_zip("sums", "times")).alias("b", "own"))
    both = each.groupBy("metric", "b").agg(F.sum("own.sums").alias("total"), F.sum("own.times").alias("times")).filter("times > 0")
    return both.select("metric", "b", (F.col("total") / F.col("times")).alias("mean"))


def _drawn_as_rows(scores: DataFrame, placed: DataFrame, total: DataFrame, resamples: int, seed: int) -> DataFrame:
    """The same for scores of any number: draws are rows, draw (b, j) names the j-th query's stand-in, so
    counts of how often a query is drawn in a resample meet the scores in one join."""
    draws = (
        placed.select(F.col("at").alias("j"))
        .crossJoin(scores.sparkSession.range(resamples).withColumnRenamed("id", "b"))
        .crossJoin(total)
        .select("b", (draw(seed, F.col("b"), F.col("j")) % F.col("n")).alias("at"))
        .groupBy("b", "at")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    drawn = draws.join(placed, "at").join(scores, "query_id")
    return drawn.groupBy("metric", "b").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mean"))


def bootstrap(scores: DataFrame, resamples: int = 1000, seed: int = 0, block: int = SCORE_BYTES) -> DataFrame:
    """95 % intervals of means by resampling queries; all metrics share a resample. Scores of up to
    ``block`` bytes are given to every task, more of them are joined."""
    ids = scores.select("query_id").distinct()
    placed = numbered(ids, "at", "query_id").withColumn("at", F.col("at") - 1)
    n, names = ids.count(), [r[0] for r in scores.select("metric").distinct().orderBy("metric").limit(1000).collect()]
    if n * len(names) * 8 <= block and len(names) < 1000:
        averages = _drawn_in_blocks(scores, placed, n, names, resamples, seed)
    else:
        averages = _drawn_as_rows(scores, placed, ids.agg(F.count(F.lit(1)).alias("n")), resamples, seed)
    bounds = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return averages.groupBy("metric").agg(bounds.alias("c")).select(
        "metric", F.col("c")[0].alias("lo"), F.col("c")[1].alias("hi")
    )


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """``query_id, metric, a, b, delta`` of queries that both runs score."""
    one = a.select("query_id", "metric", F.col("value").alias("a"))
    two = b.select("query_id", "metric", F.col("value").alias("b"))
    return one.join(two, ["query_id", "metric"]).withColumn("delta", F.col("b") - F.col("a"))


def flipped_sums(changed: DataFrame, flips: int, seed: int) -> DataFrame:
    """``metric, b, flipped``: for each flip, the absolute sum of differences (metric, query_id, delta)
    whose signs are drawn by ``draw(seed, b, query_id)``.

    A task adds up its differences in one vector of ``flips`` numbers for each metric, so that what is
    shuffled is those vectors alone. A query's signs are drawn once for all of its metrics in a batch.
    """
    names = [f"{seed}|{b}|".encode() for b in range(flips)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            queries = batch.column("query").dictionary_encode()
            metrics, deltas = batch.column("metric").to_pylist(), batch.column("delta").to_numpy()
            order = np.argsort(at := queries.indices.to_numpy(), kind="stable")
            last, signs = -1, None
            for i in order:
                if at[i] != last:
                    last, own = at[i], queries.dictionary[int(at[i])].as_py().encode()
                    signs = 1 - 2 * (np.frombuffer(b"".join(md5(n + own).digest()[3:4] for n in names), np.uint8) & 1).astype(np.float64)
                sums[metrics[i]] = sums.get(metrics[i], 0.0) + deltas[i] * signs
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["metric", "sums"])

    rows = changed.select("metric", F.col("query_id").cast("string").alias("query"), "delta")
    vectors = rows.mapInArrow(run, "metric string, sums array<double>")
    return vectors.select("metric", F.posexplode("sums").alias("b", "own")).groupBy("metric", "b").agg(F.abs(F.sum("own")).alias("flipped"))


def permutation_test(pairs: DataFrame, flips: int = 10_000, seed: int = 0) -> DataFrame:
    """Two-sided p of the mean difference by flipping signs of paired differences.

    Differences of zero change no sum and are dropped first. A metric without differences has p = 1.
    """
    changed = pairs.filter("delta <> 0")
    sums = flipped_sums(changed, flips, seed)
    observed = changed.groupBy("metric").agg(F.abs(F.sum("delta")).alias("observed"))
    extreme = sums.join(observed, "metric").groupBy("metric").agg(
        F.count_if(F.col("flipped") >= F.col("observed") - 1e-12).alias("extreme")
    )
    return pairs.select("metric").distinct().join(extreme, "metric", "left").select(
        "metric", F.coalesce((F.col("extreme") + 1) / (flips + 1), F.lit(1.0)).alias("p")
    )


def comparison(a: DataFrame, b: DataFrame, flips: int = 10_000, tolerance: float = 0.0) -> DataFrame:
    """Wins, losses, ties, means and p of each metric that both runs have."""
    pairs = paired(a, b)
    counts = pairs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg("delta").alias("delta"),
        F.count_if(F.col("delta") > tolerance).alias("wins"),
        F.count_if(F.col("delta") < -tolerance).alias("losses"),
        F.count_if(F.abs("delta") <= tolerance).alias("ties"),
    )
    return counts.join(permutation_test(pairs, flips), "metric")


def sweep_test(scores: DataFrame, flips: int = 10_000, metric: str = "ndcg@10") -> DataFrame:
    """One row: the weight of a sweep's per-query scores (alpha, query_id, metric, value) with the
    best mean (the smallest among equals) against the dense run alone (alpha 1)."""
    own = scores.filter(F.col("metric") == metric)
    means_ = own.groupBy("alpha").agg(F.round(F.avg("value"), 9).alias("mean"))
    best = means_.agg(F.max_by("alpha", F.struct("mean", -F.col("alpha"))).alias("best"))
    chosen = own.crossJoin(best).filter("alpha = best").select("query_id", "metric", "value", "best")
    alone = own.filter("alpha = 1").select("query_id", "metric", "value")
    out = comparison(alone, chosen, flips)
    return out.crossJoin(best).select("best", "n", F.col("mean_a").alias("dense"), F.col("mean_b").alias("fused"), "delta", "wins", "losses", "ties", "p")


def same_judgments(runs: DataFrame, a: str, b: str) -> None:
    """An error unless both runs (run_id, fingerprint) were scored on the same judgments: scores on
    others do not compare."""
    prints = {r[0] for r in runs.filter(F.col("run_id").isin(a, b)).select("fingerprint").distinct().limit(3).collect()}
    if len(prints - {None}) > 1:
        raise ValueError(f"{a} and {b} were scored on different judgments")


def group_deltas(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean differences of each slice or topic, if there are two or more groups."""
    tagged = pairs.join(groups.filter("slice IS NOT NULL").select("query_id", "slice"), "query_id")
    kinds = tagged.agg(F.count_distinct("slice").alias("kinds"))
    out = tagged.groupBy("slice", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("delta").alias("delta")
    )
    return out.crossJoin(kinds).filter("kinds >= 2").drop("kinds")


def complementarity(a: DataFrame, b: DataFrame, qrels: DataFrame, k: int, slices: DataFrame | None = None) -> DataFrame:
    """Recall of the candidates of A, of B and of their union, and what each adds."""
    side = lambda r, n: r.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(n).alias("side"))
    union = side(a, "a").unionByName(side(b, "b")).groupBy("query_id", "doc_id").agg(
        F.bool_or(F.col("side") == "a").alias("in_a"), F.bool_or(F.col("side") == "b").alias("in_b")
    )
    ranked = a.select("query_id").distinct().intersect(b.select("query_id").distinct())
    relevant = qrels.join(ranked, "query_id", "left_semi").join(union, ["query_id", "doc_id"], "left")
    one = relevant.groupBy("query_id").agg(
        F.avg(F.coalesce(F.col("in_a"), F.lit(False)).cast("int")).alias("recall_a"),
        F.avg(F.coalesce(F.col("in_b"), F.lit(False)).cast("int")).alias("recall_b"),
        F.avg(F.coalesce(F.col("in_a") | F.col("in_b"), F.lit(False)).cast("int")).alias("recall_union"),
    )
    if slices is not None:
        one = one.join(slices.select("query_id", "slice"), "query_id", "left").rollup("slice")
        grouped = one.agg(*_unions(), F.grouping_id().alias("g"))
        return grouped.filter("g = 1 OR slice IS NOT NULL").drop("g")
    return one.agg(*_unions())


def _unions() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg("recall_a").alias("recall_a"),
        F.avg("recall_b").alias("recall_b"),
        F.avg("recall_union").alias("recall_union"),
        F.avg(F.col("recall_union") - F.col("recall_b")).alias("marginal_a"),
        F.avg(F.col("recall_union") - F.col("recall_a")).alias("marginal_b"),
    ]


def diff_details(pairs: DataFrame, a: DataFrame, b: DataFrame, queries: DataFrame, corpus: DataFrame, qrels: DataFrame, depth: int = 5) -> DataFrame:
    """Each compared query with its text and the first documents of both runs: title (or id) and
    whether they are relevant."""

    def listed(ranking: DataFrame, name: str) -> DataFrame:
        rows = ranking.filter(F.col("rank") <= depth)
        rows = rows.join(corpus.select("doc_id", "title"), "doc_id", "left")
        rows = rows.join(qrels.select("query_id", "doc_id", F.lit(True).alias("__r")), ["query_id", "doc_id"], "left")
        one = F.struct("rank", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), F.coalesce("__r", F.lit(False)).alias("relevant"))
        return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias(name))

    out = pairs.join(queries.select("query_id", "text"), "query_id", "left")
    return out.join(listed(a, "top_a"), "query_id", "left").join(listed(b, "top_b"), "query_id", "left")
