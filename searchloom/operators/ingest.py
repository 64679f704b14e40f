"""Records to training pairs, judgments and honest splits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.text import normal_query, stripped
from ..session import stored
from .ordering import numbered


def first_by(rows: DataFrame, key: list[Column | str], order: Column | str = "seq") -> DataFrame:
    """The first row of each key; only the smallest place of a key is shuffled ahead."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("__n = 1").drop("__n")


def distinct_queries(pairs: DataFrame) -> DataFrame:
    """Pairs without repeated queries, the first staying."""
    return first_by(pairs, [normal_query(F.col("query"))])


def resolved_pairs(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records (seq, query, doc_id, title, content) as pairs, or with the reason why not.

    A document id wins even if it leads nowhere; else the record's own content is the positive.
    White space around fields does not count.
    """
    for field in ("query", "doc_id", "content"):
        records = records.withColumn(field, stripped(F.col(field)))
    found = corpus.select(
        F.col("doc_id").alias("__id"), F.col("title").alias("__title"), F.col("text").alias("__text")
    )
    some = F.col("doc_id") != ""
    joined = records.join(found, F.col("doc_id") == F.col("__id"), "left")
    named = F.coalesce(some, F.lit(False))
    inline = F.coalesce(F.col("content") != "", F.lit(False))
    reason = (
        F.when(F.coalesce(F.col("query"), F.lit("")) == "", "no query")
        .when(named & F.col("__id").isNull(), "unknown document")
        .when(~named & ~inline, "no document")
    )
    positive = F.struct(
        F.when(named, F.col("__title")).otherwise(F.nullif("title", F.lit(""))).alias("title"),
        F.when(named, F.col("__text")).otherwise(F.col("content")).alias("content"),
    )
    return joined.select("seq", "query", "doc_id", F.when(reason.isNull(), positive).alias("positive"), reason.alias("reason"))


def known_negatives(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """``seq, negatives``: negatives that the corpus knows, in order."""
    spread = pairs.select("seq", F.posexplode("negatives").alias("i", "doc_id")).join(corpus.select("doc_id"), "doc_id")
    return spread.groupBy("seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "doc_id"))), lambda x: x["doc_id"]).alias("negatives")
    )


def judgable(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records that can be judgments: with a query and a document that the corpus has."""
    bare = records.withColumn("query", stripped(F.col("query"))).withColumn("doc_id", stripped(F.col("doc_id")))
    return bare.filter("query <> '' AND doc_id <> ''").join(corpus.select("doc_id"), "doc_id", "left_semi")


def new_queries(records: DataFrame, taken: DataFrame, prefix: str = "q-user-") -> DataFrame:
    """``query_id, text, seq`` for each distinct lower-cased query of ``records``, in order of first
    sight; numbers count up and skip those that ``taken`` (query_id) has.

    The n-th new query takes the n-th free number: free numbers are those below the number of new
    and taken ones that are not taken.
    """
    first = first_by(records, [F.lower("query")]).select("seq", F.col("query").alias("text"))
    new = numbered(first, "n", "seq")
    number = F.expr(f"try_cast(substr(query_id, {len(prefix) + 1}) AS bigint)")
    used = taken.filter(F.col("query_id").startswith(prefix)).select(number.alias("id")).filter("id >= 1").distinct()
    ids = records.sparkSession.range(1, new.count() + used.count() + 1)
    free = numbered(ids.join(used, "id", "left_anti"), "n", "id")
    return new.join(free, "n").select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("query_id"), "text", "seq")


def judged(records: DataFrame, queries: DataFrame) -> DataFrame:
    """Judgments of gain 1 from records with a document, by ``new_queries``' ids."""
    ids = queries.select(F.lower("text").alias("__key"), "query_id")
    return (
        records.filter("doc_id <> ''").join(ids, F.lower("query") == F.col("__key"))
        .select("query_id", "doc_id").distinct().withColumn("gain", F.lit(1.0))
    )


def merged_judgments(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing judgments stay as they are; only pairs that are absent are added."""
    return existing.select("query_id", "doc_id", "gain").unionByName(
        new.join(existing, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "gain")
    )


def committed_judgments(choices: DataFrame, corpus: DataFrame) -> DataFrame:
    """Chosen documents (query, doc_id): all of a query's choices, or none and the unknown ones."""
    marked = choices.join(corpus.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    whole = marked.groupBy("query").agg(
        F.count(F.lit(1)).alias("chosen"), F.count_if(F.col("known").isNull()).alias("unknown")
    )
    return whole.select("query", F.when(F.col("unknown") == 0, F.col("chosen")).otherwise(0).alias("committed"), "unknown")


def commit(choices: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new queries, all judgments, new training pairs) after a batch of choices (seq, query, doc_id).

    A query with a document that the corpus does not have adds nothing. ``queries`` (query_id) are
    those that exist, ``qrels`` and ``pairs`` (query, content) what is there already.
    """
    whole = committed_judgments(choices, corpus).filter("committed > 0").select("query")
    good = judgable(choices.join(whole, "query", "left_semi"), corpus)
    fresh = new_queries(good, queries)
    empty = F.lit(None).cast("string")
    resolved = resolved_pairs(good.select("seq", "query", "doc_id", empty.alias("title"), empty.alias("content")), corpus)
    trained = resolved.select("seq", "query", F.col("positive.content").alias("content"))
    return fresh, merged_judgments(qrels, judged(good, fresh)), appended(pairs, trained)


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New pairs (seq, query, content) whose key is in neither ``existing`` nor an earlier new row."""
    key = lambda df: df.withColumn("__q", F.trim(F.lower("query"))).withColumn("__c", F.trim("content"))
    fresh = key(new).join(key(existing).select("__q", "__c").distinct(), ["__q", "__c"], "left_anti")
    return first_by(fresh, ["__q", "__c"]).drop("__q", "__c")


def by_content(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add the id of the corpus document with the same title and content; of equal documents the
    last one. The key is a digest, so the join moves no texts."""
    digest = lambda t, c: F.sha2(F.concat(F.coalesce(t, F.lit("")), F.lit("\x00"), F.coalesce(c, F.lit(""))), 256)
    last = corpus.groupBy(digest(F.col("title"), F.col("text")).alias("__key")).agg(F.max_by("doc_id", "seq").alias("found_id"))
    keyed = pairs.withColumn("__key", digest(F.col("title"), F.col("content")))
    return keyed.join(last, "__key", "left").drop("__key")


def hits_to_ids(hits: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """Hits (query_id, rank, title, content) as the first ``n`` distinct corpus ids of each query."""
    found = by_content(hits, corpus).filter("found_id IS NOT NULL")
    best = found.groupBy("query_id", F.col("found_id").alias("doc_id")).agg(F.min("rank").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("at")


def split_by_document(pairs: DataFrame, fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """Add ``test``: whole documents held out, half of ties rounding to even."""
    docs = pairs.select("doc_id").distinct()
    total = docs.agg(F.bround(F.count(F.lit(1)) * F.lit(fraction), 0).cast("bigint").alias("held"))
    placed = numbered(docs, "__n", draw(seed, F.col("doc_id")), F.col("doc_id"))
    held = placed.crossJoin(total).filter("__n <= held").select("doc_id", F.lit(True).alias("test"))
    return pairs.join(held, "doc_id", "left").withColumn("test", F.coalesce("test", F.lit(False)))


def split_pairs(pairs: DataFrame, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Add ``test``: at least one row, half of ties rounding to even."""
    total = pairs.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(fraction), 0)).cast("bigint").alias("held"))
    placed = numbered(pairs, "__n", draw(seed, F.col("seq")), F.col("seq"))
    return placed.crossJoin(total).withColumn("test", F.col("__n") <= F.col("held")).drop("__n", "held")


def split_judgments(qrels: DataFrame, fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """Add ``split``: of each document with several queries a share goes to ``final``; a query that
    is final for any document is final with all its rows."""
    order = Window.partitionBy("doc_id").orderBy(draw(seed, F.col("doc_id"), F.col("query_id")), "query_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    marked = qrels.withColumn("__n", n).withColumn("__at", F.row_number().over(order))
    take = F.when(F.col("__n") > 1, F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(fraction), 0))).otherwise(0)
    final = marked.filter(F.col("__at") <= take).select("query_id").distinct().withColumn("__final", F.lit(True))
    return qrels.join(final, "query_id", "left").withColumn("split", F.when(F.col("__final"), "final").otherwise("dev")).drop("__final")


def haystack(corpus: DataFrame, gold: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Gold documents and ``n`` others drawn by hash."""
    mine = corpus.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    rest = corpus.join(gold.select("doc_id").distinct(), "doc_id", "left_anti")
    drawn = rest.orderBy(draw(seed, F.col("doc_id")), "doc_id").limit(n)
    return mine.unionByName(drawn)


def eval_set(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judged queries from pairs: ``page-i`` ids by corpus order; ids keep a pair's own number."""
    pages = numbered(corpus, "i", "seq").withColumn("doc_id", F.concat(F.lit("page-"), F.col("i").cast("string")))
    return by_content(numbered(pairs, "j", "seq"), pages).select(
        F.concat(F.lit("q-test-"), F.col("j").cast("string")).alias("query_id"), "query", F.col("found_id").alias("doc_id")
    )


#: Bytes of searched strings in one automaton.
NEEDLES = 16 << 20


_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, words: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a block of strings, built once by a Python worker and kept until it is given
    another block."""
    if name not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for word in words.value:
            built.add_word(word, word)
        built.make_automaton()
        _BUILT[name] = built
    return _BUILT[name]


def containing(needles: DataFrame, corpus: DataFrame) -> DataFrame:
    """(needle, doc_id) where a text of ``corpus`` (doc_id, text) holds a string of ``needles`` (needle).

    Strings go in blocks of bounded size, each one pass: a text is read once for all strings of a
    block, by an automaton, so the work is that of the texts and the finds, not their product. An
    empty string is nowhere.
    """
    some = stored(needles.filter("needle <> ''").select("needle").distinct(), "needles")
    blocks = max(1, -(-(some.agg(F.sum(F.octet_length("needle"))).first()[0] or 0) // NEEDLES))
    schema = f"needle string, doc_id {dict(corpus.dtypes)['doc_id']}"
    out = None
    for n in range(blocks):
        shared = corpus.sparkSession.sparkContext.broadcast(
            [r[0] for r in some.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == n).collect()]
        )

        def find(batches: Iterator[pd.DataFrame], shared=shared, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            machine = automaton(name, shared)
            for batch in batches:
                found = [(x, doc) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) if text for x in {y for _, y in machine.iter(text)}] if shared.value else []
                yield pd.DataFrame(found, columns=["needle", "doc_id"]).astype({"doc_id": batch["doc_id"].dtype})

        one = corpus.select("doc_id", "text").mapInPandas(find, schema)
        out = one if out is None else out.unionByName(one)
    return out


def leaks(aliases: DataFrame, corpus: DataFrame) -> DataFrame:
    """(alias, doc_id) where a text holds an alias, in any case."""
    lower = aliases.select("alias", F.lower("alias").alias("needle")).distinct()
    found = containing(lower, corpus.select("doc_id", F.lower("text").alias("text")))
    return found.join(lower, "needle").select("alias", "doc_id")


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Queries in both."""
    key = lambda df: df.select(normal_query(F.col("query")).alias("query"))
    return key(train).intersect(key(test))
