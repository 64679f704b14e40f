"""Session settings that the library's results depend on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """Spark 4.1 may take a union of two shuffled inputs for one shuffled input and leave out the
    shuffle before an aggregate over it, although adaptive execution gave the two different
    partitions. Rows of one key then stay apart. The setting turns that off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests)
    gets a temporary folder; on a cluster it is an error, as executors would each write to a disk of
    their own. What is written there stays until the folder is cleared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for what is used several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
