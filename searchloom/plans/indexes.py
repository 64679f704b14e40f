"""Indexes that several queries share: written once for a folder of tables in an application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..operators.cells import CellIndex
from ..operators.postings import PostingIndex
from ..session import scratch
from .fixtures import fx

_PATHS: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, d: str, kind: str, write: Callable[[str], object]) -> str:
    """Where the index of ``kind`` over the tables in ``d`` is; ``write(path)`` makes it if need be."""
    key = (spark.sparkContext.applicationId, d, kind)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p))
    if key not in _PATHS or not there(_PATHS[key]):
        fresh = scratch(spark, kind)
        write(fresh)
        _PATHS[key] = fresh
    return _PATHS[key]


def cell_index(spark: SparkSession, d: str) -> CellIndex:
    """Of the vectors, as ``fx_vec_corpus``."""
    return CellIndex(spark, written(spark, d, "cells", lambda path: CellIndex.write(fx(spark, d, "fx_vec_corpus"), path)))


def posting_index(spark: SparkSession, d: str) -> PostingIndex:
    """Of the texts, as ``fx_corpus``."""
    return PostingIndex(spark, written(spark, d, "postings", lambda path: PostingIndex.write(fx(spark, d, "fx_corpus"), path)))
