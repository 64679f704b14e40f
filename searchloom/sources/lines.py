"""Lines of text files and records of CSV, numbered over files that are read in splits."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import carried, summed_before
from ..session import scratch, stored

#: Characters that a CSV record may have; a quote that is not closed within them is a bad record.
RECORD_CHARACTERS = 1 << 19


def numbered_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``file, line_no, value``: numbers, from 1, count within a file and follow its order; if ``whole``,
    they go on over all files in order of their names.

    Spark reads a file in splits. A split's lines are counted where they are read, and it begins where
    the splits before it, by their place in the file, end; so no file is sorted or read in one task.
    The table of splits, one row for each, is all that is ordered.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    )
    counts = read.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    by = Window.orderBy("file", "start") if whole else Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = stored(counts.select("file", "start", (before - F.col("first") + 1).alias("shift")), "splits")
    return read.join(splits, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def written_lines(lines: DataFrame, path: str) -> None:
    """Write lines (line_no, value) as text files whose names follow their order."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)


def refiled(lines: DataFrame) -> DataFrame:
    """Lines written to files and read again by number, as a log that comes in files would be."""
    path = scratch(lines.sparkSession, "lines")
    written_lines(lines, path)
    return numbered_lines(lines.sparkSession, path, whole=True).select("line_no", "value")


def ends_open(line: str, open_: bool) -> bool:
    """Whether a quoted cell is open behind ``line``, given whether one is before it. A quote opens a
    cell at its start only; within quotes a doubled one is a quote, and what follows the closing one
    belongs to the cell up to the next comma."""
    at = 0
    while True:
        if open_:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            open_ = False
        elif line.startswith('"', at):
            at, open_ = at + 1, True
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column("value").to_pylist()
        both = [pa.array([ends_open(x or "", s) for x in lines], pa.bool_()) for s in (False, True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *both], ["line_no", "value", "__closed", "__open"])


def csv_records(lines: DataFrame) -> DataFrame:
    """``line_no, value, whole`` of CSV records: lines (line_no, value) that a quoted cell joins are one
    record, which has the number of its first line.

    A line takes each of two states (no cell open, one open) to one of them: to the same from both, to
    its own, or to the other. So the state behind a line is that of the last line of the first kind,
    changed by the number of lines of the third kind since, and both are carried in blocks. A record
    of more than ``RECORD_CHARACTERS`` is its first line alone and not ``whole``; its lines are never
    brought together.
    """
    schema = "line_no bigint, value string, __closed boolean, __open boolean"
    held = lines.select(F.col("line_no").cast("bigint").alias("line_no"), "value").mapInArrow(_ends, schema)
    swaps = (F.col("__closed") & ~F.col("__open")).cast("bigint")
    held = summed_before(stored(held, "ends"), "__swaps", swaps).withColumn("__swaps", F.col("__swaps") + swaps)
    base = F.when(F.col("__closed") == F.col("__open"), (F.col("__closed").cast("bigint") + F.col("__swaps")) % 2)
    held = carried(held, "__base", base)
    closed = (F.coalesce("__base", F.lit(0)) + F.col("__swaps")) % 2 == 0
    held = stored(summed_before(held.withColumn("__ended", closed.cast("bigint")), "__record", F.col("__ended")).select("line_no", "value", "__record"), "records")
    sizes = held.groupBy("__record").agg(F.sum(F.length("value") + 1).alias("__size"), F.min("line_no").alias("__first"))
    joined = held.join(sizes, "__record").withColumn("__whole", F.col("__size") <= RECORD_CHARACTERS)
    rows = joined.filter(F.col("__whole") | (F.col("line_no") == F.col("__first"))).groupBy(F.col("__first").alias("line_no"), F.col("__whole").alias("whole"))
    own = rows.agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("__l"))
    return own.select("line_no", F.array_join(F.transform("__l", lambda x: x["value"]), "\n").alias("value"), "whole")


def _cells(value: str | None, whole: bool) -> list[str] | None:
    try:
        return next(csv.reader(io.StringIO(value or "", newline="\n")), []) if whole else None
    except csv.Error:
        return None


def csv_cells(records: DataFrame) -> DataFrame:
    """Records with their ``cells``; null, if they cannot be read as CSV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(RECORD_CHARACTERS)
        for batch in batches:
            cells = [_cells(v, w) for v, w in zip(batch.column("value").to_pylist(), batch.column("whole").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.string()))], ["line_no", "value", "whole", "cells"])

    return records.select("line_no", "value", "whole").mapInArrow(run, "line_no bigint, value string, whole boolean, cells array<string>")
