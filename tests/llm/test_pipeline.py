"""The pipeline's stages against brute force on a small table."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from searchloom.llm import decontam, quality

from .test_dedup import brute


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = (before, {r["doc_id"] for r in docs.collect()})
    before, after = kept["quality"]
    model = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert after == {i for i, t in before.items() if model.score(t) >= 0.5}
    before, after = kept["exact_dedup"]
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
    assert after == set(first.values())
    before, after = kept["minhash_dedup"]
    assert after == {i for i, (_, c) in brute(list(before.items()), 5).items() if i == c}
    before, after = kept["decontamination"]
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert after == {i for i, t in before.items() if not any(x in " ".join(re.findall(r"\w+", t.lower())) for x in items)}
    packed = corpus_pipeline.STAGES[4][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == after


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated texts, repeated ids, long texts, extra columns and empty tables go through all stages."""
    d = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{d}/documents.parquet").limit(40)
    rows = [(None, None), (None, None), (None, ""), (1, None), (1, "twice the same"), (1, "twice the same"), (1, "another text of this id"), (2, "word " * 200_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "'s' AS source", "CAST(0 AS bigint) AS n_chars")
    docs = base.unionByName(odd.select(*[F.col(c).cast(t) for c, t in base.dtypes]))
    docs = docs.selectExpr("*", "1 AS row", "2 AS digest", "3 AS kept", "4 AS component", "5 AS length", "6 AS name")
    for table in (docs, docs.limit(0)):
        table.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        now = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, now, d)
            assert out.columns == now.columns
            held = spark.createDataFrame(out.collect(), out.schema)
            assert held.exceptAll(now).count() == 0
            now = held
        packed = corpus_pipeline.STAGES[4][1](spark, now, d)
        pieces = packed.filter("piece = 0").select("doc_id")
        assert pieces.exceptAll(now.select("doc_id")).count() == 0 and pieces.count() == now.count()


def test_decontamination_is_fitted_on_all_words(spark, tmp_path, monkeypatch):
    """Of more than a thousand documents, and of long ones, every word reaches the fit of the stage."""
    rng = random.Random(2)
    pool = [f"w{n}" for n in range(500)]
    rows = [(n, " ".join(rng.choices(pool, k=30))) for n in range(1_200)] + [(1_200, " ".join(rng.choices(pool, k=5_000))), (1_201, None)]
    items = [(n, " ".join(rng.choices(pool, k=50))) for n in range(10)] + [(10, rows[7][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fit, fitted = decontam.randomised_svd, []

    def counting(passages, idf):
        fitted.append(passages.agg(F.sum(F.octet_length("words") / 4)).first()[0])
        return fit(passages, idf)

    monkeypatch.setattr(decontam, "randomised_svd", counting)
    out = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {n for n, _ in rows} - {7}
    assert fitted == [sum(len(t.split()) for _, t in rows + items if t)]


def test_all_operators_are_registered():
    """An import that fails inside the subpackage must not pass for its absence."""
    import __spark_entry__

    numbers = {int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in __spark_entry__.queries()
