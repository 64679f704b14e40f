"""Search logs to training pairs.

Events are rows (seq, session, query, results array<string>, clicks array<struct<doc_id, rank,
dwell_sec>>); ``seq`` is the order of the log. The rules work on arrays of one event and on
windows over one session; a report is one conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_pii, stripped

MIN_DWELL, SKIP_ABOVE = 20.0, 2


def asked(events: DataFrame) -> DataFrame:
    """Events whose query is not blank, without white space around it."""
    return events.withColumn("query", stripped(F.col("query"))).filter("query <> ''")


def marked(events: DataFrame, min_dwell: float = MIN_DWELL) -> DataFrame:
    """Events with a query: personal data, satisfied clicks, the document that settled each, and
    what its session ended with. An event with a null or empty session is a session of its own."""
    known = asked(events)
    good = F.filter(
        F.coalesce("clicks", F.array().cast(dict(events.dtypes)["clicks"])),
        lambda c: (c["doc_id"] != "") & (F.coalesce(c["dwell_sec"], F.lit(0.0)) >= min_dwell),
    )
    known = known.select(
        "seq",
        F.coalesce(F.nullif("session", F.lit("")), F.concat(F.lit("\x00solo-"), F.col("seq").cast("string"))).alias("session"),
        "query",
        "results",
        F.coalesce(F.size("clicks"), F.lit(0)).alias("n_clicks"),
        good.alias("good"),
        has_pii(F.col("query")).alias("pii"),
    )
    last = F.when(F.size("good") > 0, F.element_at("good", -1))
    known = known.withColumn("last", last)
    whole = Window.partitionBy("session", "pii").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    direct = F.when(F.col("last").isNotNull(), F.lower("query"))
    return (
        known.withColumn("final", F.last("last.doc_id", ignorenulls=True).over(whole))
        .withColumn("first_seq", F.min("seq").over(whole))
        .withColumn("settled", F.max(F.col("last").isNotNull()).over(Window.partitionBy("session", "pii", F.lower("query"))))
        .withColumn("resolved", direct.isNotNull())
    )


def labels(events: DataFrame, min_dwell: float = MIN_DWELL, skip_above: int = SKIP_ABOVE, transfer: bool = True) -> DataFrame:
    """Each event's label: ``first_seq, kind, seq`` (their order), ``query, doc_id, negatives``.

    ``kind`` 0 is an event's own satisfied click, 1 the session's final document for an event that
    settled nothing and whose query the session did not settle either.
    """
    own = marked(events, min_dwell).filter("NOT pii")
    above = F.slice("results", 1, F.greatest(F.col("last.rank") - 1, F.lit(0)))
    skipped = F.filter(above, lambda d: d != F.col("last.doc_id"))
    kept = F.slice(skipped, F.greatest(F.size(skipped) - skip_above + 1, F.lit(1)), skip_above) if skip_above else F.slice(skipped, 1, 0)
    none = F.array().cast("array<string>")
    direct = own.filter("resolved").select(
        "first_seq", F.lit(0).alias("kind"), "seq", "query", F.col("last.doc_id").alias("doc_id"),
        F.when(F.col("last.rank") > 1, F.coalesce(kept, none)).otherwise(none).alias("negatives"),
    )
    if not transfer:
        return direct
    moved = own.filter("NOT resolved AND final IS NOT NULL AND NOT settled").select(
        "first_seq", F.lit(1).alias("kind"), "seq", "query", F.col("final").alias("doc_id"), none.alias("negatives")
    )
    return direct.unionByName(moved)


def pairs(labelled: DataFrame, min_count: int = 1) -> DataFrame:
    """``query, doc_id, count, negatives`` of equal (lower query, document): the casing seen first,
    negatives in order of first sight and never the document itself."""
    place = F.struct("first_seq", "kind", "seq")
    key = [F.lower("query").alias("key"), "doc_id"]
    counted = labelled.groupBy(*key).agg(
        F.min_by("query", place).alias("query"), F.count(F.lit(1)).alias("count"), F.min(place).alias("place")
    )
    spread = labelled.select(F.lower("query").alias("key"), "doc_id", place.alias("p"), F.posexplode("negatives").alias("i", "negative"))
    first = spread.filter("negative <> doc_id").groupBy("key", "doc_id", "negative").agg(F.min(F.struct("p", "i")).alias("at"))
    ordered = first.groupBy("key", "doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "negative"))), lambda x: x["negative"]).alias("negatives")
    )
    out = counted.filter(F.col("count") >= min_count).join(ordered, ["key", "doc_id"], "left")
    return out.select("query", "doc_id", "count", F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives"), "place")


def report(events: DataFrame, min_dwell: float = MIN_DWELL, skip_above: int = SKIP_ABOVE, min_count: int = 1) -> DataFrame:
    """One row of counters: what came in, what each rule dropped, what came out."""
    own = marked(events, min_dwell)
    total = events.agg(F.count(F.lit(1)).alias("events"))
    kept = ~F.col("pii")
    rules = own.agg(
        F.count_if("pii").alias("dropped_pii"),
        F.coalesce(F.sum(F.when(kept, F.col("n_clicks") - F.size("good"))), F.lit(0)).cast("long").alias("bounces_ignored"),
        F.count_distinct(F.when(kept & F.col("final").isNull(), F.col("session"))).alias("abandoned_sessions"),
        F.count_distinct(F.when(kept, F.col("session"))).alias("sessions"),
    )
    labelled = labels(events, min_dwell, skip_above)
    made = labelled.agg(
        F.count_if(F.col("kind") == 0).alias("direct_pairs"),
        F.count_if(F.col("kind") == 1).alias("transferred_pairs"),
        F.coalesce(F.sum(F.size("negatives")), F.lit(0)).cast("long").alias("hard_negatives"),
    )
    below = pairs(labelled).agg(F.count_if(F.col("count") < min_count).alias("below_min_count"), F.count_if(F.col("count") >= min_count).alias("pairs"))
    return total.crossJoin(rules).crossJoin(made).crossJoin(below)


def naive_pairs(events: DataFrame) -> DataFrame:
    """Every click on a document as a pair: the control."""
    clicks = asked(events).select("seq", "query", F.posexplode("clicks").alias("i", "c"))
    return clicks.filter("c.doc_id <> ''").select("seq", "i", "query", "c.doc_id")


def label_quality(found: DataFrame, truth: DataFrame, slice_: str) -> DataFrame:
    """Precision over distinct (lower query, document), and the share of one slice's queries with
    a right label. ``truth`` has (query, doc_id, slice)."""
    key = [F.lower("query").alias("query"), "doc_id"]
    right = truth.select(*key, "slice").distinct().withColumn("right", F.lit(True))
    got = found.select(*key).distinct().join(right, ["query", "doc_id"], "left")
    precision = got.agg(F.avg(F.coalesce("right", F.lit(False)).cast("int")).alias("precision"))
    wanted = truth.filter(F.col("slice") == slice_).select(*key[:1]).distinct()
    hit = got.filter(F.col("right") & (F.col("slice") == slice_)).select("query").distinct().withColumn("hit", F.lit(1))
    recall = wanted.join(hit, "query", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return precision.crossJoin(recall)
