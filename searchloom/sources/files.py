"""Sources and sinks: JSON lines, BEIR folders, TREC runs, logs, registries. All on Spark's readers,
so any file system that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import first_by
from ..functions.text import stripped
from ..operators.ordering import carried, numbered
from ..session import stored
from .commits import CommitLog
from .lines import csv_cells, csv_records


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def corpus(records: DataFrame) -> DataFrame:
    """``doc_id, title, text`` of records (_id, title, text, seq); the last row of an id stays."""
    last = first_by(records, ["_id"], F.desc("seq"))
    return last.select(F.col("_id").cast("string").alias("doc_id"), F.when(F.col("title") != "", F.col("title")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def queries(records: DataFrame) -> DataFrame:
    """``query_id, text, slice``; an empty slice is none."""
    return records.select(F.col("_id").cast("string").alias("query_id"), "text", F.when(F.col("slice") != "", F.col("slice")).alias("slice"))


def qrels(lines: DataFrame) -> DataFrame:
    """``query_id, doc_id, gain`` of tab-separated lines (line_no, value). Lines without three fields
    or a number (the header) are skipped, so are gains of zero or less; the last of a pair stays."""
    f = F.split("value", "\t")
    parsed = lines.filter(F.size(f) >= 3).select(
        "line_no", f[0].alias("query_id"), f[1].alias("doc_id"), F.expr("try_cast(split(value, '\\t')[2] AS double)").alias("gain")
    )
    return first_by(parsed.filter("gain IS NOT NULL AND gain > 0"), ["query_id", "doc_id"], F.desc("line_no")).drop("line_no")


def trec_run(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranking, bad lines) of ``query Q0 doc rank score tag`` lines (line_no, value): ranked anew by
    the given rank; a document that occurs twice keeps its best one."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rank = F.expr("try_cast(try_cast(split(trim(regexp_replace(value, '\\\\s+', ' ')), ' ')[3] AS double) AS int)")
    parsed = lines.filter(F.trim("value") != "").select(
        "line_no", "value", F.size(f).alias("n"), F.get(f, F.lit(0)).alias("query_id"), F.get(f, F.lit(2)).alias("doc_id"),
        F.when(F.size(f) >= 4, rank).alias("given"),
    )
    good = parsed.filter("n >= 4 AND given IS NOT NULL")
    best = good.groupBy("query_id", "doc_id").agg(F.min(F.struct("given", "line_no")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    ranking = best.select("query_id", "doc_id", F.row_number().over(order).alias("rank"))
    return ranking, parsed.filter("n < 4 OR given IS NULL").select("line_no", "value")


# How ids of a bundled sample begin.
SAMPLE_IDS = ("distractor-", "gold-")

RECORD = "query string, doc_id string, title string, content string"


def log_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of search records as JSON lines or CSV (line_no, value).

    The first line that is not blank tells the format: ``{`` begins JSON, whose records are objects
    with any fields; a CSV header names ``query``, else the columns are query, doc_id, title,
    content, as far as the first record goes. CSV cells lose the white space around them, may be
    quoted and hold line ends; a record without a query is bad, and so is one that is no CSV or
    whose quote is not closed within a bound of characters; one without anything is none.
    """
    some = lines.filter(stripped(F.col("value")) != "")
    first = some.orderBy("line_no").select("line_no", "value").first()
    if first is None:
        none = lines.limit(0)
        return none.selectExpr("line_no", *[f"CAST(NULL AS string) AS {c.split()[0]}" for c in RECORD.split(", ")]), none
    names = [c.split()[0] for c in RECORD.split(", ")]
    if first["value"].lstrip().startswith("{"):
        parsed = some.withColumn("r", F.from_json("value", RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
        one = F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1
        good = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.coalesce(one, F.lit(False)) & F.ltrim("value").startswith("{")
        fields = [F.col(f"r.{c}").alias(c) for c in names]
        return parsed.filter(good).select("line_no", *fields), parsed.filter(~good).select("line_no", "value")
    records = stored(csv_cells(csv_records(lines).filter(stripped(F.col("value")) != "")), "cells")
    head = records.orderBy("line_no").select("cells").first()[0] or []
    header = [x.strip().lower() for x in head]
    titled = "query" in header
    cols = header if titled else names[: len(head)]
    rows = records.filter(F.col("line_no") != first["line_no"]) if titled else records
    cells = {c: stripped(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))) for i, c in enumerate(cols)}
    fields = [cells.get(c, F.lit(None).cast("string")).alias(c) for c in names]
    some = F.col("cells").isNull() | F.exists("cells", lambda x: stripped(x) != "")
    parsed = rows.filter(some).select("line_no", "value", "cells", *fields)
    bad = F.col("cells").isNull() | (F.coalesce("query", F.lit("")) == "")
    return parsed.filter(~bad).select("line_no", *names), parsed.filter(bad).select("line_no", "value")


def write_beir(path: str, corpus_: DataFrame, queries_: DataFrame, judgments: DataFrame) -> None:
    """A BEIR-like folder; judgments (with ``split``) are partitioned by it."""
    corpus_.select(F.col("doc_id").alias("_id"), "title", "text").write.mode("overwrite").json(f"{path}/corpus")
    queries_.select(F.col("query_id").alias("_id"), "text", "slice").write.mode("overwrite").json(f"{path}/queries")
    judgments.select("query_id", "doc_id", "gain", "split").write.mode("overwrite").partitionBy("split").option("sep", "\t").csv(f"{path}/qrels")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, doc_id string, gain double, split string").option("sep", "\t").csv(f"{path}/qrels")


def split_rows(judgments: DataFrame, split: str) -> DataFrame:
    """Rows of a split. ``dev`` falls back to the older name ``test``; ``final`` never falls back, and
    a split that is missing is an error."""
    for name in (split, "test") if split == "dev" else (split,):
        found = judgments.filter(F.col("split") == name)
        if not found.isEmpty():
            return found
    raise ValueError(f"no split {split}")


def kept_splits(judgments: DataFrame, names: list[str]) -> DataFrame:
    """Judgments of the named splits; the rest is stale."""
    return judgments.filter(F.col("split").isin(names))


def append_bench(records: DataFrame, path: str) -> None:
    """Bench records, partitioned by ``hardware_key``, so that a scan reads one hardware's alone."""
    records.write.mode("append").partitionBy("hardware_key").parquet(path)


def load_bench(spark: SparkSession, path: str, hardware: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if hardware is None else rows.filter(F.col("hardware_key") == hardware)


class RunRegistry:
    """Runs as JSON lines below one folder that all executors see, the last appended first.

    Each append is a commit of its own with the next batch number; deleting commits all runs that are
    left in place of what was before. Batch numbers go on after a deletion, also that of the last run.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.schema, self.log = spark, schema, CommitLog(spark, root)

    @staticmethod
    def _current(entries: list[dict]) -> list[dict]:
        """The commits since what was last left, and that."""
        last = max((i for i, e in enumerate(entries) if e["kind"] == "left"), default=0)
        return entries[last:]

    def append(self, runs: DataFrame) -> int:
        """Add runs; of one call they are in the order of ``seq`` (which is kept). Returns the batch."""
        path = self.log.fresh()
        runs.write.json(path)
        number = self.log.commit(lambda e: {"kind": "append", "path": path, "batch": e[-1]["batch"] + 1 if e else 0})
        return next(e["batch"] for e in self.log.entries() if e["number"] == number)

    def folders(self) -> list[str]:
        return [e["path"] for e in self._current(self.log.entries())]

    def _rows(self, entries: list[dict]) -> DataFrame:
        current = self._current(entries)
        if not current:
            return self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        batch = F.create_map(*[F.lit(x) for e in current for x in (e["path"].rsplit("/", 1)[1], e["batch"])])
        parsed = F.from_json("value", self.schema + ", batch bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        rows = self.spark.read.text([e["path"] for e in current]).select(batch[folder].alias("__batch"), parsed.alias("r")).filter("r IS NOT NULL AND r._bad IS NULL")
        rows = rows.select("__batch", "r.*").withColumn("batch", F.coalesce("batch", "__batch")).drop("__batch", "_bad")
        return rows.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.col("model")))

    def scan(self) -> DataFrame:
        """Runs with ``batch, seq``; lines that are no records are skipped, a missing label is the model."""
        return self._rows(self.log.entries())

    def newest(self) -> DataFrame:
        """All runs, the last appended first."""
        return self.scan().orderBy(F.desc("batch"), F.desc("seq"))

    def get(self, run_id: str) -> DataFrame:
        return self.scan().filter(F.col("id") == run_id)

    def delete(self, run_id: str) -> int:
        """Remove a run; returns how many remain. If runs are appended meanwhile it begins again."""

        def left(entries: list[dict]) -> dict:
            path = self.log.fresh()
            self._rows(entries).filter(~F.col("id").eqNullSafe(F.lit(run_id))).write.json(path)
            return {"kind": "left", "path": path, "batch": entries[-1]["batch"] if entries else -1}

        self.log.commit(left)
        return self.scan().count()


def is_sample(corpus_: DataFrame) -> bool:
    """Whether a corpus (doc_id, seq) looks like a bundled sample: by the id of its first document."""
    first = corpus_.orderBy("seq").select("doc_id").first()
    return first is not None and str(first[0]).startswith(SAMPLE_IDS)


def overview(pairs: DataFrame, limit: int, length: int) -> tuple[DataFrame, DataFrame]:
    """(counts, preview) of pairs (seq, query, content, negatives)."""
    from ..functions.text import shortened

    counts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.max(F.size("negatives") > 0), F.lit(False)).alias("has_negatives"))
    return counts, pairs.orderBy("seq").limit(limit).select("seq", "query", shortened(F.col("content"), length).alias("content"))


# What training logs look like.
LOSS = r"'loss':\s*'?([0-9.eE+-]+)"
EPOCH = r"'epoch':\s*'?([0-9.eE+-]+)"
EPOCH_LINE = r"\[epoch\]\s+(\d+)/(\d+)\s+eval_loss=([0-9.eE+-]+)\s+ndcg@10=([0-9.eE+-]+)\s+best=(\d+)"
NDCG = r"ndcg@10\s*=\s*([0-9.]+)"
SUMMARY = r"\[train\] summary best_epoch=(\d+) ran=(\d+) early_stopped=(yes|no)"
SAVED = r"saved fine-tuned model to (.+?)\s*$"


def last_redraw(value: Column) -> Column:
    """A progress line as it stood in the end."""
    return F.substring_index(value, "\r", -1)


def _number(pattern: str, group: int = 1, kind: str = "double") -> Column:
    got = F.regexp_extract("value", pattern, group)
    return F.when(got != "", got.try_cast(kind))


def loss_points(lines: DataFrame) -> DataFrame:
    """``step, epoch, loss`` of each logged step; a missing epoch is the step."""
    found = lines.select("line_no", _number(LOSS).alias("loss"), _number(EPOCH).alias("epoch")).filter("loss IS NOT NULL")
    return numbered(found, "step", "line_no").select(F.col("step").cast("int").alias("step"), F.coalesce("epoch", F.col("step").cast("double")).alias("epoch"), "loss")


def epoch_points(lines: DataFrame, *also: str) -> DataFrame:
    """The epochs of log lines (line_no, value), with the lines' columns ``also``."""
    found = lines.filter(F.col("value").rlike(EPOCH_LINE))
    return found.select(
        *also, "line_no", _number(EPOCH_LINE, 1, "int").alias("epoch"), _number(EPOCH_LINE, 2, "int").alias("max_epochs"),
        _number(EPOCH_LINE, 3).alias("eval_loss"), _number(EPOCH_LINE, 4).alias("ndcg"), _number(EPOCH_LINE, 5, "int").alias("best_epoch"),
    )


def log_outcome(lines: DataFrame) -> DataFrame:
    """One row: score before (the first of the baseline section) and after (the last of the section
    after tuning), the summary, and where the model was saved."""
    section = F.when(F.contains("value", F.lit("baseline eval")), "before").when(F.contains("value", F.lit("after fine-tuning")), "after")
    rows = carried(lines, "section", section).withColumn("ndcg", _number(NDCG))
    of = lambda pattern, group, kind: F.max_by(_number(pattern, group, kind), F.when(F.col("value").rlike(pattern), F.col("line_no")))
    scored = lambda name: F.when((F.col("section") == name) & F.col("ndcg").isNotNull(), F.col("line_no"))
    return rows.agg(
        F.min_by("ndcg", scored("before")).alias("before"), F.max_by("ndcg", scored("after")).alias("after"),
        of(SUMMARY, 1, "int").alias("best_epoch"), of(SUMMARY, 2, "int").alias("ran"), of(SUMMARY, 3, "string").alias("early_stopped"),
        of(SAVED, 1, "string").alias("saved"),
    )


# Signs of failure and the kind each means; the first that the log's end holds wins.
FAILURES = [
    (1, "memory", ["out of memory", "mps backend out of memory", "cuda out of memory"]),
    (2, "packages", ["no module named", "modulenotfounderror"]),
    (3, "negatives", ["hard negative"]),
    (4, "service", ["connection refused", "connecterror", "11434"]),
    (5, "disk", ["no space left"]),
]


def failure_kinds(lines: DataFrame, tail: int = 25) -> DataFrame:
    """``run_id, kind`` of runs by the last ``tail`` lines of their logs (run_id, line_no, value)."""
    back = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("line_no")))
    end = lines.withColumn("back", back).filter(F.col("back") <= tail)
    rule = F.lit(None).cast("int")
    for number, _, needles in reversed(FAILURES):
        hit = F.lit(False)
        for needle in needles:
            hit |= F.contains(F.lower("value"), F.lit(needle))
        rule = F.when(hit, number).otherwise(rule)
    kinds = F.array(*[F.lit(k) for _, k, _ in FAILURES])
    return end.groupBy("run_id").agg(F.min(rule).alias("rule")).select("run_id", F.get(kinds, F.col("rule") - 1).alias("kind"))
