"""Content-addressed WARC archive.

Payloads of at least `least` bytes are stored once: the page with the largest page_id of those with the same SHA-256
is the `response` that holds the bytes, the others are `revisit` records without a block that name its digest.
Spark's text writer writes the records (its row separator is the blank lines that end a WARC record), gzipped, so the
files are committed by task attempt and can go to any store that Spark knows. Reading checks each payload against both
digests of its record, keeps the exact header bytes of every record apart from the payloads, and rebuilds whole records
by a join on the digest.

Defined cases: a null or empty html is a payload of 0 bytes; rows that repeat the largest page_id of a payload are all
responses; a null page_id is the largest only among null ids, and its record has no Page-ID; a null url is an empty
target; line breaks in a url are escaped; an empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.runtime import arrow_rows, materialise, scratch, table

LEAST = 1000
RECORDS_PER_FILE = 2048
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """head and payload of the record of each row (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    own = pages.select("page_id", "url", payload.alias("payload")).withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    # only payloads that occur more than once; written first, so that its true size decides the join
    shared = materialise(own.filter(F.col("n") >= least).groupBy("sha256").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "warc-shared")
    own = own.join(shared.withColumn("again", F.lit(True)), "sha256", "left")
    response = F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("holder"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    line = "\r\n"
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "),
        F.when(response, "response").otherwise("revisit"),
        F.lit(f"{line}WARC-Record-ID: <urn:uuid:"),
        F.regexp_replace(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), uri, F.col("sha256")).cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"),
        F.lit(f">{line}WARC-Date: 1970-01-01T00:00:00Z{line}WARC-Target-URI: "),
        uri,
        F.coalesce(F.concat(F.lit(f"{line}Page-ID: "), F.col("page_id").cast("string")), F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.lit(f"{line}Payload-SHA256: "),
        F.col("sha256"),
        F.when(response, "").otherwise(F.concat(F.lit(f"{line}WARC-Profile: {PROFILE}{line}WARC-Refers-To-Page: "), F.coalesce(F.col("holder").cast("string"), F.lit("")))),
        F.lit(f"{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "),
        F.when(response, F.col("n")).otherwise(F.lit(0)).cast("string"),
        F.lit(END),
    )
    return own.select(head.alias("head"), F.when(response, F.col("payload")).otherwise(F.lit("").cast("binary")).alias("payload"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write a record for each row to gzipped WARC files under path."""
    rows = records(pages, least).select(F.concat(F.col("head"), F.col("payload").cast("string")).alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Exact header bytes, named fields and block of each record of a gzipped WARC file."""
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while first := f.readline():
        lines = [first]
        while (line := f.readline()) not in (b"\r\n", b""):
            lines.append(line)
        fields = dict(x.decode("utf-8", "replace").rstrip("\r\n").split(": ", 1) for x in lines[1:])
        block = f.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or f.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
        yield b"".join([*lines, b"\r\n"]), fields, block


_FIELDS = "page_id long, url string, record_type string, refers_to long, sha256 string, sha1 string, n long, head binary"


def _record_rows(data: bytes, with_block: bool) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()][: 8 + with_block]
        names = ["page_id", "url", "record_type", "refers_to", "sha256", "sha1", "n", "head", "payload"][: 8 + with_block]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows, held = [], 0
    for head, f, block in parse(data):
        kind, sha1 = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (hashlib.sha256(block).hexdigest() != f["Payload-SHA256"] or hashlib.sha1(block).hexdigest() != sha1):
            raise ValueError(f"record {f['WARC-Record-ID']} does not have the payload of its digest")
        whole = kind == "response"
        number = lambda x: int(x) if x else None
        rows.append((number(f.get("Page-ID")), f["WARC-Target-URI"], kind, number(f.get("WARC-Refers-To-Page")), f["Payload-SHA256"], sha1, len(block) if whole else None, head, *((block if whole else None,) if with_block else ())))
        held += len(block)
        if held > 8_000_000:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record, in the archive's own terms: a revisit has no n and no payload. head: its header bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from _record_rows(data.as_py(), payload)

    return arrow_rows(spark.read.format("binaryFile").load(path).select("content"), rows, _FIELDS + ", payload binary" * payload)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """head and whole payload of every record: headers joined to the payload of their digest."""
    found = read_records(spark, path, payload=True)
    blocks = found.filter("record_type = 'response'").groupBy("sha256").agg(F.max("payload").alias("payload"))
    return found.drop("payload", "n").join(blocks, "sha256", "left")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    heads = materialise(read_records(spark, path), "warc-heads")
    revisits = heads.filter("record_type = 'revisit'")
    blocks = heads.filter("record_type = 'response'").groupBy("sha256").agg(F.max("n").alias("n"))
    sized = revisits.drop("n").join(blocks, "sha256").unionByName(heads.filter("record_type = 'response'"))
    return sized.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


OP7_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
own AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
shared AS (SELECT digest, n, max(page_id) AS holder FROM own WHERE n >= {LEAST} GROUP BY digest, n)
SELECT own.page_id, CAST(own.n AS BIGINT) AS payload_bytes, own.digest AS payload_digest,
    CASE WHEN holder IS NULL OR holder = own.page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN holder <> own.page_id THEN holder END AS refers_to
FROM own LEFT JOIN shared ON own.digest = shared.digest AND own.n = shared.n
"""
