"""CSV records against the csv module, and line numbers of files that are read in splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from searchloom.operators import ordering
from searchloom.sources import files as S
from searchloom.sources import lines as L


def lines_of(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line_no int, value string").repartition(3)


def test_a_quote_within_a_cell(spark):
    text = 'query,doc_id,title,content\n5" screen,d2,t,y\nb,d3,,\n"c ""x"" y"z,d4\n"a\nb",d5\n"",d6\nx,"open'
    good, bad = S.log_records(lines_of(spark, text))
    got = [(r["line_no"], r["query"], r["doc_id"]) for r in good.orderBy("line_no").collect()]
    assert got == [(2, '5" screen', "d2"), (3, "b", "d3"), (4, 'c "x" yz', "d4"), (5, "a\nb", "d5"), (8, "x", "open")]
    assert [r["line_no"] for r in bad.collect()] == [7]


@pytest.mark.parametrize("block", [3, 50_000])
def test_as_the_csv_module(spark, monkeypatch, block):
    monkeypatch.setattr(ordering, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(3):
        text = "".join(rng.choice('"",,\n\nab "') for _ in range(400))
        rows = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
        records = L.csv_cells(L.csv_records(lines_of(spark, text)))
        got = [r["cells"] for r in records.orderBy("line_no").collect()]
        assert [r for r in got if any(c.strip() for c in r)] == rows


def test_an_open_quote_is_bad_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "RECORD_CHARACTERS", 100)
    text = "query,doc_id\na,d1\n" + '"never closed,d2\n' + "\n".join(f"line {i}" for i in range(50))
    good, bad = S.log_records(lines_of(spark, text))
    assert [r["query"] for r in good.collect()] == ["a"] and [r["line_no"] for r in bad.collect()] == [3]


def test_numbers_over_splits(spark, tmp_path):
    rng, want = random.Random(2), []
    for name in ("b.txt", "a.txt", "c.txt"):
        own = ["".join(rng.choice("abc é") for _ in range(rng.choice((0, 3, 90)))) for _ in range(700)]
        (tmp_path / name).write_text("\n".join(own) + "\n")
        want += [(name, i, x) for i, x in enumerate(own, 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        name = F.element_at(F.split("file", "/"), -1)
        found = L.numbered_lines(spark, str(tmp_path))
        assert sorted((r[0], r[1], r[2]) for r in found.select(name, "line_no", "value").collect()) == sorted(want)
        whole = L.numbered_lines(spark, str(tmp_path), whole=True).orderBy("line_no").collect()
        assert [(r["line_no"], r["value"]) for r in whole] == list(enumerate((x for _, _, x in sorted(want, key=lambda r: (r[0], r[1]))), 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
