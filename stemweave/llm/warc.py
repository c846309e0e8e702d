"""WARC archives: pages become request, response or revisit, and metadata records; reading joins them per capture.

Writing is DataFrame work up to Spark's own text sink, whose commit protocol makes a lost executor harmless; a file
is one gzip stream of records. Reading takes a file at a time (files are bounded by ``records_per_file``), walks its
records by Content-Length in a small Python helper, and the rest is joins and grouping.

Defined results: a null payload is an empty payload. A null page id or url is left out of the records and read back
as null. Repeated rows are captures of their own; among equal payloads the smallest page id (nulls last, then the
order of rows) is the response. Records without a counterpart give captures with null parts; a request or metadata
record whose capture is missing gives a row of its own. If several requests or metadata records name one capture, the
smallest record id is nested and the others get rows of their own. Malformed record headers raise. An empty table
gives an empty archive and no captures. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemweave.plans.durable import shared_folder, written

#: Fixed values of RFC 4648 base32, and the same digits as ``conv`` writes them.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "record_id string, warc_type string, headers map<string,string>, concurrent_to array<string>, block binary, body_at int"
CAPTURES = ("response", "revisit", "resource")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), CONV32, BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, rid: Column, length: Column, extra: list[Column], block: Column) -> Column:
    """A record less its last line end, which the text sink writes."""
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid),
        F.lit(f"WARC-Date: {DATE}"), *extra, F.concat(F.lit("Content-Length: "), length.cast("string")),
    )
    return F.concat(head, F.lit(CRLF + CRLF), block, F.lit(CRLF))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, records_per_file: int = 50_000,
) -> None:
    """Three records per page under ``path``; repeated payloads of ``min_revisit_bytes`` or more become revisits.

    The source of ``pages`` is read twice, for the payload groups and for the records, so it must be stored rows
    (a table), as row numbers tell repeated rows apart.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", base32_sha1(F.col("body")))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    first = (
        rows.filter(F.octet_length("body") >= min_revisit_bytes)
        .groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1").select(F.col("digest").alias("of"), "first")
    )
    first = written(first, "payloads")  # a file of known size: broadcast only below the session's threshold
    rows = rows.join(first, F.col("digest") == F.col("of"), "left").withColumn(
        "revisit", F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    )
    name = [F.col("row").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest")]
    capture, request, meta = (_urn(F.lit(k), *name) for k in ("capture", "request", "metadata"))
    original = _urn(F.lit("capture"), F.col("first.row").cast("string"), F.coalesce(F.col("first.id").cast("string"), F.lit("")), F.col("digest"))
    target = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("body").cast("string"), F.lit(CRLF + CRLF))
    response = F.concat(http, F.col("body"))
    asked = F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF))
    fields = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.lit("fetcher: stored-page"), F.lit(""))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    to = F.concat(F.lit("WARC-Concurrent-To: "), capture)
    block = F.when(F.col("revisit"), http).otherwise(response)
    records = F.array(
        _record(F.lit("request"), request, F.octet_length(asked), [target, to, F.lit("Content-Type: application/http; msgtype=request")], asked),
        _record(
            F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), capture, F.octet_length(block),
            [target, digest, F.lit("Content-Type: application/http; msgtype=response"),
             F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), original)),
             F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT_PROFILE}"))], block),
        _record(F.lit("metadata"), meta, F.octet_length(fields), [target, to, F.lit("Content-Type: application/warc-fields")], fields),
    )
    (
        rows.select(F.explode(records).alias("value")).write.option("lineSep", CRLF).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


def _inflated(data: bytes) -> bytes:
    """Plain, gzip, or one gzip member per record."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        stream = zlib.decompressobj(31)
        parts.append(stream.decompress(data) + stream.flush())
        if not stream.eof:
            raise ValueError("truncated gzip member")
        data = stream.unused_data.lstrip(b"\0")
    return b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[str | None, str | None, dict[str, str], list[str], bytes]]:
    """Records of one archive, told apart by Content-Length alone, so a payload may hold record headers."""
    data = _inflated(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":  # the end of the record before
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, str] = {}
        beside = []
        for line in data[at:end].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                beside.append(value)
            headers[name] = value
        size = int(headers["content-length"])
        if end + 4 + size > len(data):
            raise ValueError(f"truncated record at byte {at}")
        yield headers.get("warc-record-id"), headers.get("warc-type"), headers, beside, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under ``path``; ``body_at`` is where the payload of an HTTP block begins."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "warc_type", "headers", "concurrent_to", "block", "body_at"]
        for batch in batches:
            for content in batch["content"]:
                held, size = [], 0
                for record in parse(bytes(content)):
                    held.append((*record, (record[-1].find(b"\r\n\r\n") + 4) % (len(record[-1]) + 4)))
                    size += len(record[-1])
                    if size > 8 << 20 or len(held) >= 5_000:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, RECORD_SCHEMA)


def http_payload() -> Column:
    """What follows the HTTP header of a record's block."""
    return F.expr("substring(block, body_at + 1)")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, capture, request, metadata), joined through concurrent-to ids.

    Concurrency is symmetric, so a link counts in either direction; metadata may also name the request of a capture.
    Everything is an equality join on record ids.
    """
    part = F.struct("record_id", "headers", "block")
    links = records.select("record_id", "warc_type", F.explode("concurrent_to").alias("to"))
    captures = records.filter(F.col("warc_type").isin(*CAPTURES)).select(
        F.col("record_id").alias("capture_id"), F.struct("record_id", "warc_type", "headers", "block").alias("capture")
    )
    others = records.filter(~F.col("warc_type").isin(*CAPTURES) & (F.col("warc_type") != "warcinfo"))
    ids = captures.select("capture_id")
    forward = links.filter(~F.col("warc_type").isin(*CAPTURES)).select("record_id", "to")
    backward = links.filter(F.col("warc_type").isin(*CAPTURES)).select(F.col("to").alias("record_id"), F.col("record_id").alias("to"))
    either = forward.unionByName(backward)
    direct = either.join(ids, F.col("to") == F.col("capture_id"), "left_semi").groupBy("record_id").agg(F.min("to").alias("capture_id"))
    by_request = (
        forward.join(direct.withColumnRenamed("record_id", "request_id"), F.col("to") == F.col("request_id"))
        .groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    )
    home = direct.withColumn("far", F.lit(0)).unionByName(by_request.withColumn("far", F.lit(1))).groupBy("record_id").agg(F.min_by("capture_id", "far").alias("capture_id"))
    placed = others.join(home, "record_id", "left").select("capture_id", "warc_type", "record_id", part.alias("part"))
    chosen = placed.filter("capture_id IS NOT NULL").groupBy("capture_id", "warc_type").agg(F.min("record_id").alias("record_id"))
    nested = placed.join(chosen.select("record_id", F.lit(True).alias("chosen")), "record_id", "left")
    slots = nested.filter("chosen").groupBy("capture_id").agg(
        *[F.min_by(F.when(F.col("warc_type") == t, F.col("part")), F.when(F.col("warc_type") == t, F.col("record_id"))).alias(t) for t in ("request", "metadata")]
    )
    whole = captures.join(slots, "capture_id", "left").select("capture_id", "capture", "request", "metadata")
    alone = nested.filter("chosen IS NULL OR warc_type NOT IN ('request', 'metadata')").select(
        "capture_id", F.lit(None).cast(captures.schema["capture"].dataType).alias("capture"),
        *[F.when(F.col("warc_type") == t, F.col("part")).alias(t) for t in ("request", "metadata")],
    )
    return whole.unionByName(alone)


def round_trip(pages: DataFrame, id_kind: str = "long") -> DataFrame:
    """Writes the pages to a new archive in the shared folder, reads it back and describes every capture.

    A revisit takes its length and digest from the response that it refers to, joined by record id; lengths and
    digests are measured on the payload bytes read back.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = read_records(spark, path)
    # blocks of captures are only measured, so they are dropped before any shuffle
    slim = records.withColumn("payload", F.when(F.col("warc_type") == "response", http_payload())).select(
        "record_id", "warc_type", "concurrent_to",
        F.map_concat(F.col("headers"), F.when(F.col("warc_type") == "response", F.create_map(F.lit("measured-bytes"), F.octet_length("payload").cast("string"), F.lit("measured-digest"), base32_sha1(F.col("payload")))).otherwise(F.create_map().cast("map<string,string>"))).alias("headers"),
        F.when(F.col("warc_type") == "metadata", F.col("block")).alias("block"),
    )
    slim = written(slim, "records")
    found = assemble(slim).filter("capture IS NOT NULL").select(
        "capture_id", F.col("capture.warc_type").alias("record_type"),
        F.regexp_extract(F.decode("metadata.block", "utf-8"), r"(?m)^page-id: (.*?)\r?$", 1).alias("page"),
        F.col("request.record_id").alias("request_id"),
        F.element_at("capture.headers", "warc-refers-to").alias("refers_id"),
        F.element_at("capture.headers", "measured-bytes").cast("long").alias("bytes"),
        F.element_at("capture.headers", "measured-digest").alias("digest"),
        F.element_at("capture.headers", "warc-payload-digest").alias("stated"),
    ).withColumn("page_id", F.when(F.col("page") != "", F.col("page")).cast(id_kind))
    # only revisits look for another capture; a response stands under its own id, so no null key gathers
    found = written(found.withColumn("refers_id", F.coalesce("refers_id", "capture_id")), "captures")
    originals = found.filter("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("first_page"), F.col("bytes").alias("first_bytes"), F.col("digest").alias("first_digest"))
    return found.join(originals, "refers_id", "left").select(
        "page_id", F.coalesce("bytes", "first_bytes").alias("payload_bytes"), F.coalesce("digest", "first_digest").alias("payload_digest"),
        "record_type", F.when(F.col("record_type") == "revisit", F.col("first_page")).alias("refers_to"),
        (F.concat(F.lit("sha1:"), F.coalesce("digest", "first_digest")) == F.col("stated")).alias("digest_matches"),
        F.col("request_id").isNotNull().alias("has_request"),
    )
