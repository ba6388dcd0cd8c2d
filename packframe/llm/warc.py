"""Operator 8, WARC: a content-addressed archive.

The archive is three tables.  ``payloads`` holds the bytes of each distinct payload once, under its SHA-256 and
compressed before they are shuffled; ``headers`` holds one WARC/1.1 record header per page, byte for byte as it stands
in front of the block, with the digest of its payload; ``common`` names the digests with more than COMMON records,
whose payloads are joined in several copies, so that no task gets all of their records.  Records are put together again
by a join on the digest, under verification of that digest, and what is read from an archive is parsed from the bytes
of the rebuilt records.

Of the records with equal payloads of at least `least` bytes the one with the largest page_id is the response and
the others are revisits of it; smaller payloads are always responses.

Defined results: a null html is an empty payload; a null page_id is a record whose id names no page, and is the
response only if no record of its payload has a page_id; rows that repeat the largest page_id are all responses, of
which revisits name one; every record has an id of its own; line breaks in urls are percent-encoded; very long payloads
are worked on one at a time; other columns are ignored, whatever their names; an empty table is an archive without
records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import BATCH_BYTES, map_batches, rows_of, shared_path, stored, table

REVISIT = 1000
#: Records of a payload from which on its payload is joined in more than one copy, and the most rows of a table of
#: such digests that is broadcast; beyond, the joins are left to adaptive execution.
COMMON, BROADCAST_ROWS = 1000, 100_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column, own: Column) -> Column:
    """Of a record: names the page, if there is one, and is the record's own."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), own, F.lit(">"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _packed(rows: DataFrame) -> DataFrame:
    """digest, packed of rows (digest, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            for part in rows_of(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((pack(x.as_buffer()) for x in part.column(1)), pa.binary())], ["digest", "packed"])

    return map_batches(rows, run, "digest binary, packed binary")


def write_archive(pages: DataFrame, path: str, least: int = REVISIT, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes pages(page_id, url, html) to the tables `path`/headers, `path`/payloads and `path`/common."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # first() is summed up before the shuffle: a payload leaves a task once, however many copies it has there
    _packed(rows.select("digest", "payload")).groupBy("digest").agg(F.first("packed").alias("packed")).write.option("compression", "none").parquet(f"{path}/payloads")

    records = stored(rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"), F.uuid().alias("own")), "records")
    named = F.struct("page_id", "own")
    several = stored(records.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max(F.when(F.col("page_id").isNotNull(), named)).alias("response")).filter("copies > 1"), "several")
    several.filter(F.col("copies") > COMMON).select("digest", F.ceil(F.col("copies") / COMMON).cast("int").alias("salts")).write.parquet(f"{path}/common")

    common = _common(pages.sparkSession, path)
    dealt = records.join(common, "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("own"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    joined = dealt.join(_copied(several, common).drop("copies"), ["digest", "salt"], "left")
    revisit = (F.col("n") >= least) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response.page_id"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("own"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("response.page_id"), F.col("response.own")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    )
    joined.select(header.alias("header"), "digest", "salt").write.option("compression", "zstd").parquet(f"{path}/headers")


def _common(spark: SparkSession, path: str) -> DataFrame:
    return _small(spark.read.schema("digest binary, salts int").parquet(f"{path}/common"))


def _copied(df: DataFrame, common: DataFrame) -> DataFrame:
    """df (digest, ...), with salt: once, and those of common digests once for each of their salts."""
    return df.join(common, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


class Record(NamedTuple):
    """What stands in a record's bytes."""

    page_id: int | None
    record_type: str
    refers_to: int | None
    declared_digest: str | None
    fields: dict[str, str]
    block: bytes


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").partition(":")[0]
    return int(found) if found else None


def parse_record(record: bytes) -> Record:
    """Parses one record; fails where its block isn't as long as it says."""
    head, _, rest = record.partition(_END)
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != _END:
        raise ValueError(f"not a record: {head[:80]!r}")
    digest = fields.get("WARC-Payload-Digest")
    return Record(_page(fields["WARC-Record-ID"]), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), digest and digest.removeprefix("sha1:"), fields, rest[:size])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """The bytes of each record and its full payload, from rows (header, digest, packed)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for header, digest, packed in zip(*(batch.column(i) for i in range(3)), strict=True):
            payload = unpack(packed.as_buffer())
            if hashlib.sha256(payload).digest() != digest.as_py():
                raise ValueError("a payload doesn't have its digest")
            head = header.as_py()
            block = b"" if "\r\nWARC-Type: revisit\r\n" in head else payload
            yield head.encode() + block + _END, payload


def _joined(spark: SparkSession, path: str) -> DataFrame:
    headers = spark.read.schema("header string, digest binary, salt int").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, packed binary").parquet(f"{path}/payloads")
    return headers.join(_copied(payloads, _common(spark, path)), ["digest", "salt"]).select("header", "digest", "packed")


def _emit(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], [*types])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from its rebuilt bytes: page_id, record_type, refers_to, payload_bytes and payload_digest (SHA-1;
    both of the full payload), declared_digest and record_bytes.  A block that isn't the payload fails."""
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "declared_digest": pa.string(), "record_bytes": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for record, payload in _rebuilt(batches):
            got = parse_record(record)
            full = payload if got.record_type == "revisit" else got.block
            rows.append((got.page_id, len(full), hashlib.sha1(full).hexdigest(), got.record_type, got.refers_to, got.declared_digest, len(record)))
            if len(rows) >= 10_000:
                yield _emit(rows, types)
                rows = []
        if rows:
            yield _emit(rows, types)

    return map_batches(_joined(spark, path), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, declared_digest string, record_bytes long")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the bytes of the WARC record), payload (the full payload, for revisits too)."""
    types = {"page_id": pa.int64(), "record": pa.binary(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for record, payload in _rebuilt(batches):
            rows.append((parse_record(record).page_id, record, payload))
            size += len(record) + len(payload)
            if size >= BATCH_BYTES:
                yield _emit(rows, types)
                rows, size = [], 0
        if rows:
            yield _emit(rows, types)

    return map_batches(_joined(spark, path), run, "page_id long, record binary, payload binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    got = read_index(spark, path)
    sound = F.col("declared_digest") == F.col("payload_digest")
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest isn't that of its payload")).cast("string"))
    return got.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
g AS (SELECT html, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""
