"""WARC archives with revisit resolution.

Archives are written with Spark's text writer: a record is one row and the
record separator of the format (two CRLFs) is the line separator, so any file
system that Spark writes to will do and task commits are Spark's own. Reading
goes through the binary file source and a streaming parser.

Resolution: a first pass writes every page as a response; headers with recomputed
payload digests are read back, shuffled by digest, and each later record of a
payload becomes a revisit of its first. The decisions are gathered by archive and
joined with the archives, so a second pass streams each archive beside its own
decisions and writes the deduplicated archives with fresh headers (new record ids
and block lengths). Payloads are not shuffled; where the decisions are too many to
broadcast, Spark moves archives as they are, compressed.

Archives are bounded in bytes: pages are written by size class, each of which has a
number of records to a file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, fresh_path, frugal, small_batches, written

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: (Payload bytes, records): payloads of up to so many bytes, so many to an archive at most. A class has 256 MB at most to an
#: archive before compression, the last one a record.
CLASSES = [(1 << 16, 4096), (1 << 20, 256), (1 << 24, 16), (1 << 31, 1)]
#: Bytes of payload in an Arrow batch, about.
BATCH_BYTES = 8 << 20

_HEADERS = "archive string, page_id long, uri string, record_id string, record_type string, refers_to_record string, refers_to long, payload_bytes long, payload_digest string"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null. CR and LF in values are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def record(payload: Column, page_id: Column, uri: Column, record_id: Column, digest: Column, date: str,
           revisit_of: Column | None = None, revisit_uri: Column | None = None, revisit_page: Column | None = None,
           payload_bytes: Column | None = None) -> Column:
    """A whole WARC record as a string column; a revisit where ``revisit_of`` isn't null."""
    size = F.coalesce(payload_bytes, F.octet_length(payload)) if payload_bytes is not None else F.octet_length(payload)
    http = F.concat(F.lit(HTTP_HEAD), size.cast("string"), F.lit(CRLF + CRLF))
    none = F.lit(None).cast("string")
    again = revisit_of.isNotNull() if revisit_of is not None else F.lit(False)
    block = F.when(again, http).otherwise(F.concat(http, payload))
    return F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("X-Page-ID", page_id),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("X-Payload-Length", size),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:uuid:"), revisit_of, F.lit(">"))) if revisit_of is not None else none),
        _line("WARC-Refers-To-Target-URI", revisit_uri if revisit_uri is not None else none),
        _line("X-Refers-To-Page", revisit_page if revisit_page is not None else none),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit(CRLF), block,
    )


def size_class(size: Column) -> Column:
    """The first of CLASSES that a payload fits in."""
    out = F.lit(len(CLASSES) - 1)
    for k in range(len(CLASSES) - 2, -1, -1):
        out = F.when(size <= CLASSES[k][0], F.lit(k)).otherwise(out)
    return out


def write_archives(records: DataFrame, column: str, path: str, per_file: int) -> None:
    with small_batches(records.sparkSession):
        (records.select(column).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
         .option("maxRecordsPerFile", per_file).text(path))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of every record; junk between records is skipped."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length") or 0))


def _urn(value: str | None) -> str | None:
    return value.removeprefix("<urn:uuid:").removesuffix(">") if value else None


#: What a revisit gets of the record that it refers to.
_DECISION = "first_record_id string, first_page_id long, first_uri string"


def _schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in fields.split(", ")])


def _reader(bodies: bool):
    """Partition function over (path, content): a row for each record. With ``bodies`` there is a third column, the archive's
    decisions, and rows have the payload and the record's own decision too."""
    schema = _schema(_HEADERS + (f", payload binary, {_DECISION}" if bodies else ""))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for i, (path, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                decided = {d["record_id"]: d for d in batch.column(2)[i].as_py() or ()} if bodies else {}
                for fields, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())), 1 << 20)):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    page, to, own = fields.get("x-page-id"), fields.get("x-refers-to-page"), _urn(fields.get("warc-record-id"))
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                    row = (path, int(page) if page else None, fields.get("warc-target-uri"), own, kind,
                           _urn(fields.get("warc-refers-to")), int(to) if to else None, size, digest)
                    if bodies:
                        first = decided.get(own)  # the payload of a revisit is not written again
                        row += (b"", first["first_record_id"], first["first_page_id"], first["first_uri"]) if first else (payload, None, None, None)
                        held += len(payload)
                    out.append(row)
                    if len(out) >= 4096 or held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return frugal("warc", rows)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record. Sizes and digests of responses are computed from their payloads, not trusted."""
    return _archives(spark, path).mapInArrow(_reader(False), _HEADERS)


def resolve(headers: DataFrame, least: int) -> DataFrame:
    """Headers plus the record that each one revisits (first_*; null for responses).

    Of equal payloads of at least ``least`` bytes the smallest page_id is the
    response; null page_ids rank last, and ties go by record id.
    """
    groups = written(
        headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
            F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id", "record_id", "uri")).alias("first"), F.count(F.lit(1)).alias("n"),
        ).where("n > 1"),
        "revisits",
    )
    found = attach(headers, groups, ["payload_digest"], "n", ["record_id"])
    other = (F.col("payload_bytes") >= least) & (F.col("first.record_id") != F.col("record_id"))
    return found.select(
        *headers.columns,
        *(F.when(other, F.col(f"first.{c}")).alias(f"first_{c}") for c in ("record_id", "page_id", "uri")),
    )


def warc_roundtrip(pages: DataFrame, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC, resolve revisits, rewrite, and read the result back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to. A
    null html is an empty payload, a null url leaves the target out, a null
    page_id comes back null. Payloads below ``least`` bytes are always
    responses. Repeated rows are further records: all but one become revisits.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    raw, final = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    level = size_class(F.octet_length(payload))
    first = pages.select(level.alias("level"), record(payload, F.col("page_id"), F.col("url"), F.expr("uuid()"), F.sha2(payload, 256), date).alias("record"))
    levels = sorted(r.level for r in pages.select(level.alias("level")).distinct().collect()) or [0]
    for k in levels:
        write_archives(first.where(F.col("level") == k), "record", f"{raw}/{k}", CLASSES[k][1])
    headers = written(read_archives(spark, raw), "warc-headers")
    # Only revisits need a decision; responses are the records without one. An archive has CLASSES' number of them at most.
    revisits = resolve(headers, least).where(F.col("first_record_id").isNotNull())
    decision = F.struct("record_id", "first_record_id", "first_page_id", "first_uri")
    decisions = written(revisits.groupBy("archive").agg(F.collect_list(decision).alias("decisions")), "decisions")
    # Record ids are derived anew and alike for a response and for what refers to it.
    new_id = lambda c: F.regexp_replace(F.md5(F.concat(F.lit("deduplicated:"), c)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    for k in levels:
        files = _archives(spark, f"{raw}/{k}")
        bodies = files.join(decisions, F.col("path") == F.col("archive"), "left").select("path", "content", "decisions")
        bodies = bodies.mapInArrow(_reader(True), f"{_HEADERS}, payload binary, {_DECISION}")
        write_archives(
            bodies.select(
                record(F.col("payload").cast("string"), F.col("page_id"), F.col("uri"), new_id(F.col("record_id")), F.col("payload_digest"), date,
                       new_id(F.col("first_record_id")), F.col("first_uri"), F.col("first_page_id"), F.col("payload_bytes")).alias("record")
            ),
            "record", f"{final}/{k}", CLASSES[k][1],
        )
    return read_archives(spark, final).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
