"""Running numbers and running values over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Bits of ``monotonically_increasing_id`` that count within a partition; lines of a block.
ROW_BITS, BLOCK = 33, 50_000


def numbered(rows: DataFrame, name: str, *by: Column | str) -> DataFrame:
    """Add ``name``: the place of each row, from 1, in the order of ``by``.

    Rows are range-partitioned, so any number of rows takes as many sorting tasks as the session
    has shuffle partitions; each numbers its own and begins where those before it end. The sorted
    rows are stored, as two runs may cut the ranges elsewhere. What is broadcast is one count for
    each partition.
    """
    own = F.monotonically_increasing_id()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stored(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", own), "ordered")
    part = F.shiftright("__at", ROW_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return held.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, place).drop("__part", "__start", "__at")


def _blocks(lines: DataFrame) -> DataFrame:
    return lines.withColumn("__block", F.floor(F.col("line_no") / BLOCK))


def _joined(held: DataFrame, blocks: DataFrame) -> DataFrame:
    return held.join(blocks, "__block").drop("__block")


def carried(lines: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null up to each line (``line_no``).

    Lines are taken in blocks; one row of each block meets the rows of the others in one small
    window.
    """
    held = _blocks(lines.withColumn("__v", value))
    ends = held.groupBy("__block").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("line_no"))).alias("__end"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__block", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    own = F.last("__v", ignorenulls=True).over(
        Window.partitionBy("__block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    )
    return _joined(held.withColumn("__own", own), ends).withColumn(name, F.coalesce("__own", "__before")).drop("__v", "__own", "__before")


def summed_before(lines: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the lines before each line (``line_no``)."""
    held = _blocks(lines.withColumn("__v", value))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("__block").agg(F.sum("__v").alias("__sum"))
    sums = sums.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    own = F.sum("__v").over(Window.partitionBy("__block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    out = _joined(held.withColumn("__own", F.coalesce(own, F.lit(0))), sums)
    return out.withColumn(name, F.col("__own") + F.col("__before")).drop("__v", "__own", "__before")
