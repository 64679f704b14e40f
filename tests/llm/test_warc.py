"""An exact round trip, and ranges of selected records."""

import gzip
import hashlib
import random

from searchloom.llm import warc
from searchloom.llm.common import fresh_path

PAGES = [
    (3, "http://a/3", "x" * 200),
    (1, "http://a/1", "x" * 200),
    (2, "http://a/2", "é" * 60),
    (5, "http://a/5\r\nX: y", "é" * 60),
    (4, None, "short"),
    (6, "http://a/6", "short"),
    (7, "http://a/7", None),
    (None, "http://a/n", "x" * 200),
    (1, "http://a/1", "x" * 200),
    (8, "http://a/8", "line\r\n\r\nWARC/1.1\r\n\r\n" * 30),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload").repartition(2)


def test_round_trip(spark):
    index = warc.write_archives(frame(spark, PAGES), fresh_path(spark, "t"), shard_bytes=500)
    rows = warc.read_records(index).collect()
    assert len(rows) == len(PAGES)
    by = {r["page_id"]: r for r in rows}
    assert by[1]["record_type"] == "response" and by[3]["refers_to"] == 1 and by[None]["refers_to"] == 1
    assert by[5]["refers_to"] == 2 and by[5]["payload_bytes"] == 120
    assert by[4]["record_type"] == by[6]["record_type"] == by[7]["record_type"] == "response"
    assert by[8]["payload"] == PAGES[-1][2] and by[7]["payload"] == ""
    for page, _, html in PAGES:
        raw = (html or "").encode()
        assert by[page]["payload_digest"] == hashlib.sha256(raw).hexdigest() and by[page]["payload_bytes"] == len(raw)


def test_index_names_the_records(spark):
    index = warc.write_archives(frame(spark, PAGES), fresh_path(spark, "t"))
    for r in index.collect():
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            data = gzip.decompress(f.read(r["length"]))
        assert data.startswith(b"WARC/1.1\r\n") and f"<urn:page:{r['page_id'] if r['page_id'] is not None else 'null'}>".encode() in data
    some = index.filter("page_id IN (2, 8)")
    assert sorted(r["page_id"] for r in warc.read_records(some).collect()) == [2, 8]


def test_empty(spark):
    index = warc.write_archives(frame(spark, PAGES).limit(0), fresh_path(spark, "t"))
    assert warc.read_records(index).count() == 0


def test_coalesced():
    assert [(a, b, len(x)) for a, b, x in warc.coalesced([(0, 5), (5, 5), (30, 5), (200, 5)], 20, 1000)] == [(0, 35, 3), (200, 205, 1)]
    assert [(a, b) for a, b, _ in warc.coalesced([(0, 5), (5, 5), (10, 50)], 20, 10)] == [(0, 10), (10, 60)]


def test_large_payloads_and_file_heads(spark):
    rng = random.Random(1)
    large = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(warc.RANGE_BYTES * 3 // 2))
    rows = [(1, "u", large), (2, "u", "small"), (3, "v", large)]
    index = warc.write_archives(frame(spark, rows), fresh_path(spark, "t"))
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    assert got[1]["payload"] == large and got[3]["refers_to"] == 1 and got[3]["payload_bytes"] == len(large)
    for name in {r["file"] for r in index.collect()}:
        with gzip.open(name.removeprefix("file://")) as f:
            assert f.read(200).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_reading_is_dealt_out_by_bytes(spark):
    index = spark.range(4000).selectExpr("concat('f', id % 7) AS file", "id div 7 * 100000 AS offset", "100000L AS length")
    assert warc.read_records(index).rdd.getNumPartitions() == -(-4000 * 100000 // warc.RANGE_BYTES)
