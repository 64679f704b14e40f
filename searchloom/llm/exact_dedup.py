"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of characters. The distinct blocks are
sorted within the partitions that ``distinct`` made, and a block's integer name is its partition's
number with its place there. Then adjacent names are paired, the distinct pairs are sorted and named
the same way, and so on until one name is left of each document. Two texts are equal exactly if they
took equally many rounds and ended with the same name: a name stands for one distinct value, so
names cannot collide. Names depend on the number of partitions; what is equal does not.

Only the first round moves text, and it moves each distinct block once. Documents find their
blocks' names by a 128-bit routing hash; the table of names is checked to have no two blocks with
the same hash, and is built again with another salt if it has, so the hash decides nothing.

Every table of names comes from a partially aggregated ``distinct``, so a block that a third of
all rows share reaches the naming task once for each map task.

Edge cases. A null text counts as empty; all empty texts are equal. A null ``doc_id`` sorts after
all others. Repeated rows (same id, same text) are copies of each other like any other rows and
exactly one of them stays. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_one, materialize, read, text_of

#: Characters in a block.
BLOCK = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def route(value: Column, salt: int) -> Column:
    """128 bits that route a block to its name."""
    return F.struct(
        F.xxhash64(F.lit(2 * salt), value).alias("a"), F.xxhash64(F.lit(2 * salt + 1), value).alias("b")
    )


def blocks_of(text: Column, size: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(found)


def named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Give each row of ``distinct`` an integer name: its partition and its place among the keys there."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _first_names(texts: DataFrame, size: int, hashed: Callable[[Column, int], Column]) -> tuple[DataFrame, int]:
    """Names of the distinct blocks, and the salt under which their routing hashes differ."""
    blocks = texts.select(F.explode(blocks_of(F.col("norm"), size)).alias("block")).distinct()
    salt = 0
    while True:
        names = materialize(
            named(blocks, "block").select(hashed(F.col("block"), salt).alias("h"), "name"), "block_names"
        )
        if names.groupBy("h").count().filter("count > 1").isEmpty():
            return names, salt
        salt += 1


def identities(
    docs: DataFrame, size: int = BLOCK, hashed: Callable[[Column, int], Column] = route
) -> DataFrame:
    """``row, doc_id, text_sha256, level, name`` for each row; equal (level, name): equal texts."""
    texts = docs.select("doc_id", normalised(text_of()).alias("norm"))
    names, salt = _first_names(texts, size, hashed)
    rows = materialize(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(blocks_of(F.col("norm"), size), lambda b: hashed(b, salt)).alias("hs"),
        ),
        "rows",
    )
    spread = rows.select("row", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    current = materialize(spread.join(names, "h").select("row", "n", "pos", "name"), "level_0")
    done, level = [], 0
    while True:
        done.append(current.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = current.filter("n > 1")
        if rest.isEmpty():
            break
        level += 1
        half = F.pmod("pos", F.lit(2)) == 0
        pairs = materialize(
            rest.groupBy("row", "n", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(half, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            f"pairs_{level}",
        )
        names = materialize(named(pairs.select("left", "right").distinct(), "left", "right"), f"names_{level}")
        current = materialize(
            pairs.join(names, ["left", "right"]).select(
                "row", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "name"
            ),
            f"level_{level}",
        )
    ends = done[0]
    for other in done[1:]:
        ends = ends.unionByName(other)
    return rows.drop("hs").join(ends, "row")


def exact_duplicates(docs: DataFrame, size: int = BLOCK, hashed=route) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    ids = materialize(identities(docs, size, hashed), "identities")
    # null ids last, then the smallest id; ``row`` settles repeated rows
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = materialize(
        ids.groupBy("level", "name").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size")),
        "groups",
    )
    return ids.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had."""
    kept = materialize(exact_duplicates(docs, size).filter("kept").select("doc_id", "text_sha256"), "kept")
    return keep_one(docs, kept.withColumnRenamed("text_sha256", "digest"), F.sha2(normalised(text_of()), 256))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
