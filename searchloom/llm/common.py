"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests)
    gets a temporary folder, once for each application; on a cluster it is an error, as executors
    would each write to a disk of their own. Tables of finished jobs stay there until the folder is
    cleared: they are what a lost executor's work is repeated from.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return "file://" + _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/work-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage, fixes generated ids, and leaves a table that survives the loss of
    executors.
    """
    return stored_at(df, fresh_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table from which all that is still needed has been written elsewhere."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_HELD: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between batches, such as a cache of words: one thing at a time, so
    that a worker that serves one stage after another holds the words of the last alone."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def keep_rows(docs: DataFrame, decided: DataFrame, on: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose key expressions occur in ``decided``; the columns stay as they were.

    ``on`` maps columns of ``decided`` to expressions over ``docs``. Nulls are equal. The keys
    carry names of their own, so that no column of ``docs`` can clash with them.
    """
    return _filtered(docs, decided, on, "left_semi")


def drop_rows(docs: DataFrame, decided: DataFrame, on: dict[str, Column]) -> DataFrame:
    """The other rows of ``docs``."""
    return _filtered(docs, decided, on, "left_anti")


def _filtered(docs: DataFrame, decided: DataFrame, on: dict[str, Column], how: str) -> DataFrame:
    keys = decided.select(*[F.col(c).alias(f"__key_{c}") for c in on])
    cond = F.lit(True)
    for c, expr in on.items():
        cond = cond & expr.eqNullSafe(keys[f"__key_{c}"])
    return docs.join(keys, cond, how)


def keep_one(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` in ``kept`` (``doc_id, digest``), one of each id and digest."""
    out = keep_rows(docs, kept, {"doc_id": docs["doc_id"], "digest": digest})
    again = materialize(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return out
    # Only rows whose id occurs again can have the id and digest of a row that stays.
    marked = out.withColumn("__digest", digest).join(
        again.select(F.col("doc_id").alias("__again"), F.lit(True).alias("__many")),
        F.col("doc_id").eqNullSafe(F.col("__again")),
        "left",
    )
    once = marked.filter("__many IS NULL").drop("__again", "__many", "__digest")
    first = marked.filter("__many").dropDuplicates(["doc_id", "__digest"]).drop("__again", "__many", "__digest")
    return once.unionByName(first)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold few rows, as these tables have long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))
