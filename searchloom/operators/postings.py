"""A stored inverted index for BM25.

Documents in order of length are cut into ranges of ``RANGE`` documents. A block is the postings of one
term in one range: the documents' places in the range, how often each has the term, and the largest
impact (what the term adds to a score at weight 1) of the block. Blocks are written by term: the
partition column is a hash of the term, and files are sorted by term. The ranges are a second table:
ids and lengths of their documents.

A search reads the blocks of its queries' terms only, and in two steps. First the impacts alone are read:
the sum of a query's weights times its terms' largest impacts bounds every score in a range. The
``FIRST`` ranges of the largest bounds are scored; the k-th best score found there is a floor. Then
those of the other ranges are scored in which some query's bound reaches its floor. A range holds
documents of about one length, so bounds of ranges of long documents are low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams
from ..session import stored
from .ordering import numbered
from .ranking import _type, forward_index, top_k

#: Documents of a range, queries of a block, folders of terms, and ranges that are scored first.
RANGE, ASKED, FOLDERS, FIRST = 1024, 256, 64, 2

BLOCKS = "term string, range bigint, most double, n int, at array<int>, tf array<int>, folder int"


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


class PostingIndex:
    """Blocks, ranges, term and corpus statistics below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(BLOCKS) if name == "blocks" else self.spark.read  # without rows there is no file
        return reader.parquet(f"{self.path}/{name}")

    @classmethod
    def write(cls, corpus: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, size: int = RANGE) -> PostingIndex:
        """Index a corpus (doc_id, title, text). ``k1`` and ``b`` are those of all its searches."""
        spark = corpus.sparkSession
        index = forward_index(corpus)
        placed = numbered(index.select("doc_id", "doc_len"), "place", "doc_len", "doc_id")
        placed = placed.withColumn("range", F.floor((F.col("place") - 1) / size)).withColumn("at", ((F.col("place") - 1) % size).cast("int"))
        placed = stored(placed.select("doc_id", "doc_len", "range", "at"), "placed")
        listed = F.array_sort(F.collect_list(F.struct("at", "doc_id", "doc_len")))
        docs = placed.groupBy("range").agg(listed.alias("d")).select("range", F.col("d.doc_id").alias("ids"), F.col("d.doc_len").alias("lens"))
        docs.write.parquet(f"{path}/ranges")
        totals = placed.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
        totals = totals.select("*", F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))
        totals.write.parquet(f"{path}/totals")
        mean = totals.first()["avg_len"] or 1.0
        each = index.drop("doc_len").join(placed, "doc_id").select("range", "at", "doc_len", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        tf = F.col("p.tfs")
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / mean))
        blocks = each.groupBy(F.col("p.terms").alias("term"), "range").agg(
            F.max(impact).alias("most"), F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("at", tf.alias("tf")))).alias("p")
        )
        blocks = blocks.select("term", "range", "most", "n", F.col("p.at").alias("at"), F.col("p.tf").alias("tf"), _folder(F.col("term")).alias("folder"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # ranges of (folder, term), so that a term of very many blocks is dealt to several tasks
        blocks.repartitionByRange(n, "folder", "term", "range").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/blocks")
        found = cls(spark, path)
        found.table("blocks").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
        return found

    def statistics(self) -> DataFrame:
        """``term, df, idf``."""
        n = self.table("totals").first()["n_docs"]
        return self.table("terms").select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))

    def weights(self, queries: DataFrame) -> DataFrame:
        """``query_id, term, weight, folder`` of queries (query_id, text); a term counts as often as it is asked."""
        asked = queries.select("query_id", F.explode(bigrams(F.col("text"))).alias("term"))
        asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")).join(self.statistics(), "term")
        return asked.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), _folder(F.col("term")).alias("folder"))

    def _blocks(self, weights: DataFrame) -> DataFrame:
        """Blocks of the terms that are asked: folders of no such term are not read."""
        folders = [r[0] for r in weights.select("folder").distinct().collect()]  # at most FOLDERS numbers
        return self.table("blocks").filter(F.col("folder").isin(folders)) if folders else self.table("blocks").limit(0)

    def _scores(self, blocks: DataFrame, packed: DataFrame, wanted: DataFrame, queries: str) -> DataFrame:
        """Scores of all documents with a term of a query, in the wanted (group, range) pairs."""
        totals = self.table("totals").first()
        mean, k1, b = totals["avg_len"] or 1.0, totals["k1"], totals["b"]
        ranges = self.table("ranges")
        schema = f"{queries}, doc_id {dict(ranges.dtypes)['ids'][6:-1]}, score double"
        met = blocks.select("term", "range", "at", "tf").join(packed, "term").join(wanted.select("group", "range").distinct(), ["group", "range"], "left_semi")
        rows = met.groupBy("group", "range").agg(F.collect_list(F.struct("at", "tf", "asked")).alias("terms")).join(ranges, "range")

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    terms, ids, lens = (batch.column(c)[n].values for c in ("terms", "ids", "lens"))
                    asked = terms.field("asked").flatten()
                    names = asked.field("query_id").dictionary_encode()
                    rows_of = lambda a: np.repeat(np.arange(len(terms)), a.value_lengths().to_numpy(zero_copy_only=False))
                    weights, impacts = np.zeros((len(names.dictionary), len(terms))), np.zeros((len(terms), len(ids)))
                    weights[names.indices.to_numpy(), rows_of(terms.field("asked"))] = asked.field("weight").to_numpy()
                    at, tf = (terms.field(c).flatten().to_numpy() for c in ("at", "tf"))
                    length = lens.to_numpy()[at]
                    impacts[rows_of(terms.field("at")), at] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                    scores = weights @ impacts
                    q, d = np.nonzero(scores > 0)
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(q)), ids.take(pa.array(d)), pa.array(scores[q, d])], ["query_id", "doc_id", "score"])

        return rows.select("terms", "ids", "lens").mapInArrow(scored, schema)

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """BM25 top-k of queries (query_id, text), as ``bm25_top_k``."""
        groups = max(1, -(-queries.count() // ASKED))
        group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
        weights = stored(self.weights(queries).withColumn("group", group), "weights")
        blocks = self._blocks(weights)
        packed = weights.groupBy("group", "term").agg(F.collect_list(F.struct("query_id", "weight")).alias("asked"))
        bounds = blocks.select("term", "range", "most").join(weights, "term").groupBy("query_id", "group", "range")
        bounds = stored(bounds.agg(F.sum(F.col("weight") * F.col("most")).alias("bound")), "bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        early = stored(bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= first).select("group", "range").distinct(), "early")
        kind = _type(queries, "query_id")
        # sums in another order differ in the last digits; a rounded score makes ties stable
        best = lambda scores: top_k(scores.withColumn("score", F.round("score", 9)).filter("score > 0"), k)
        found = stored(best(self._scores(blocks, packed, early, kind)), "found")
        floors = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        late = bounds.join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-8))
        late = stored(late.join(early, ["group", "range"], "left_anti").select("group", "range").distinct(), "late")
        rest = best(self._scores(blocks, packed, late, kind))
        return top_k(found.drop("rank").unionByName(rest.drop("rank")), k).select("query_id", "doc_id", "score", "rank")
