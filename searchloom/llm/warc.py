"""WARC archives, index first.

1. Tasks write the archives where the pages lie, one gzip member for each record after a
   ``warcinfo`` record that begins each file, and return an index row (file, offset, length, url, digest) for each; the index is committed as a table
   before anything is read. A task that is run again writes a file of another name, and only the
   rows of the attempt that Spark committed are in the index, so lost executors leave nothing but
   files that no index names.
2. Selected records are read by byte ranges: the index rows are sorted by file and offset, near
   ranges are coalesced, and each range is read once.

Revisits. Of records with equal payloads of at least ``min_bytes`` bytes that with the smallest
page id is ``response``; the others refer to it and carry no payload. Their HTTP headers keep the
length and the WARC header the digest, both of the full payload. Only digests are shuffled to find
them; the pages meet the few revisits in a join that Spark broadcasts while they are small.

Edge cases. A null html is an empty payload. Null urls give records without a target URI. A null
page id is written as ``null``; it never comes before another id and reads back as null. Repeated
rows are written as often as they occur, with one record id, which is the page's; those with the
smallest id are all ``response``. A payload larger than a range is read at once. Line ends in an url
are percent-encoded in its header. An empty table gives no archive and an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, read, small_batches

CRLF = "\r\n"
END = CRLF + CRLF
#: Bytes of a shard, about; of a range read at once, at most unless one record is larger; and of a
#: gap between two ranges that is read over.
SHARD_BYTES, RANGE_BYTES, GAP_BYTES = 32 << 20, 8 << 20, 64 << 10
#: Reading tasks at most; beyond that each reads more ranges.
TASKS = 20_000


def planned(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload_digest, payload_bytes, record_type, refers_to`` of each page."""
    payload = F.coalesce("html", F.lit(""))
    meta = materialize(
        pages.select(
            "page_id",
            "url",
            F.sha2(payload, 256).alias("payload_digest"),
            F.octet_length(payload).cast("long").alias("payload_bytes"),
        ),
        "meta",
    )
    firsts = (
        meta.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    again = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    firsts = materialize(firsts, "firsts")
    return meta.join(firsts, ["payload_digest", "payload_bytes"], "left").select(
        "page_id",
        "url",
        "payload_digest",
        "payload_bytes",
        F.when(F.col("first_id").isNotNull() & again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


INDEX = (
    "file string, offset long, length long, url string, page_id long, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long"
)


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{END}".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines.append(f"WARC-Refers-To: {_urn(original)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join(lines).encode() + END.encode() + block + END.encode()


def info(date: str) -> bytes:
    """The record that begins an archive."""
    block = f"software: searchloom{CRLF}format: WARC File Format 1.1{CRLF}".encode()
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    lines += ["Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return CRLF.join(lines).encode() + END.encode() + block + END.encode()


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, without a time or a name."""
    own = zlib.compressobj(level, zlib.DEFLATED, 31)
    return own.compress(data) + own.flush()


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 100,
    shard_bytes: int = SHARD_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per page below ``path``; return the index, a committed table.

    Offset and length are those of a record's gzip member.
    """
    revisits = planned(pages, min_bytes).filter("record_type = 'revisit'").select(
        F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "refers_to"
    )
    revisits = materialize(revisits.distinct(), "revisits")
    payload = F.coalesce("html", F.lit(""))
    joined = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    ).join(
        revisits, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left"
    ).select("page_id", "url", "payload", "digest", "refers_to", F.col("__digest").isNotNull().alias("revisit"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            batch = batch.astype({"page_id": "Int64", "refers_to": "Int64"}).astype(object)
            for page, url, text, digest, original, revisit in batch.itertuples(index=False):
                page, original = (None if x is pd.NA else x for x in (page, original))
                if out is None:
                    name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                    system, where = _filesystem(name)
                    system.create_dir(where.rpartition("/")[0])
                    out = system.open_output_stream(where, compression=None)
                    head = member(info(date))
                    out.write(head)
                    at = len(head)
                raw = text.encode()
                data = member(record(page, url, raw, digest, original, revisit, date))
                out.write(data)
                rows.append((name, at, len(data), url, page, digest, len(raw), "revisit" if revisit else "response", original))
                at += len(data)
                if at >= shard_bytes:
                    out.close()
                    out = None
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    return materialize(joined.mapInPandas(write, INDEX), "warc_index")


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def coalesced(spans: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, spans) of ranges to read, from (offset, length) spans in order."""
    held: list[tuple[int, int]] = []
    start = end = 0
    for offset, length in spans:
        if held and (offset > end + gap or offset + length - start > most):
            yield start, end, held
            held = []
        if not held:
            start = offset
        end = max(end, offset + length) if held else offset + length
        held.append((offset, length))
    if held:
        yield start, end, held


def parsed(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields of a record, the payload's length by its HTTP headers, and the payload."""
    head, _, block = data.partition(END.encode())
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    if len(block) != int(fields["Content-Length"]) + len(END):
        raise ValueError(f"{fields['WARC-Record-ID']}: the block has another length than its header says")
    http, _, payload = block[: -len(END)].partition(END.encode())
    length = next(int(x[16:]) for x in http.decode().split(CRLF) if x.startswith("Content-Length: "))
    return fields, length, payload


def _id_of(urn: str) -> int | None:
    text = urn[len("<urn:page:") : -1]
    return None if text == "null" else int(text)


COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records that ``index`` (any subset of an index) names, by coalesced byte ranges."""

    def of_file(name: str, spans: list[tuple[int, int]]) -> Iterator[dict]:
        system, path = _filesystem(name)
        with system.open_input_file(path) as f:
            for start, end, held in coalesced(spans, GAP_BYTES, RANGE_BYTES):
                data = f.read_at(end - start, start)
                for offset, length in held:
                    packed = data[offset - start : offset - start + length]
                    fields, size, payload = parsed(zlib.decompress(packed, 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
                    yield {
                        "page_id": _id_of(fields["WARC-Record-ID"]),
                        "url": fields.get("WARC-Target-URI"),
                        "payload_bytes": size,
                        "payload_digest": digest,
                        "record_type": kind,
                        "refers_to": _id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
                        "payload": payload.decode() if payloads and kind == "response" else None,
                    }

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("file", sort=False):
                out: list[dict] = []
                size = 0
                for row in of_file(name, list(zip(part["offset"], part["length"], strict=True))):
                    out.append(row)
                    size += len(row["payload"] or "") + 200
                    if size > RANGE_BYTES:
                        yield _frame(out)
                        out, size = [], 0
                if out:
                    yield _frame(out)

    block = F.floor(F.col("offset") / RANGE_BYTES)
    dealt = index.select("file", "offset", "length").withColumn("block", block)
    total = index.agg(F.sum("length")).first()[0] or 0
    # as many tasks as there are ranges of payload, whatever little the index itself weighs
    tasks = max(1, -(-total // max(RANGE_BYTES, total // TASKS)))
    return (
        dealt.repartition(tasks, "file", "block")
        .sortWithinPartitions("file", "offset")
        .select("file", "offset", "length")
        .mapInPandas(rows, COLUMNS)
    )


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = write_archives(read(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_records(index, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
