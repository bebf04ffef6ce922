"""WARC archives: writing captures and assembling transactions from the records.

A capture is three records: request, response (or revisit) and metadata. Request and
metadata name the response in ``WARC-Concurrent-To``; reading lets them meet on it. Spark's
text writer makes the files: a record is one string, and the two line ends that close
every record are the writer's line separator, so no worker opens a file of its own.

Cases: a null payload is an empty one; equal payloads of ``min_revisit`` bytes or more
have one response (largest id, which is a response wherever it is repeated), the others
revisit it; payloads may hold anything, line ends included (records are read by
Content-Length); a null id or url is written as an empty field; every row is a capture:
where its id is null or stands in an earlier row, its records are named by a number of
the row before the id; other columns are not read, whatever their names; an empty table gives an archive without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, new_path

#: Two line ends close a record.
END = "\r\n\r\n"
#: Captures in one archive file, by the most bytes of their payloads: bounds the memory of
#: the task that reads it. A larger capture has a file of its own.
CAPTURES_PER_FILE = ((1 << 16, 2000), (1 << 21, 64), (None, 1))
RECORD = "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, page_id long, payload_bytes long, payload binary"


def digest32(payload: Column) -> Column:
    """SHA-1 in base 32: each 5 hexadecimal digits are 4 digits of base 32."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def capture_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """``record`` (text of all three records of a capture) and its size class ``tier``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    tier = sum((F.octet_length(payload) > most).cast("int") for most, _ in CAPTURES_PER_FILE if most is not None)
    # a number for each row, made once: only what is written keeps it
    p = keep(
        pages.select(
            F.monotonically_increasing_id().alias("n"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
            payload.alias("payload"), digest32(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), tier.alias("tier"),
        ),
        "warc-pages", by="tier", compression="zstd",
    )
    ids = p.where("id is not null").select("n", "id")
    repeated = ids.groupBy("id").agg(F.min("n").alias("first_n"), F.count("*").alias("rows")).where("rows > 1")
    later = ids.join(repeated, "id").where("n <> first_n").select(F.col("n").alias("later_n"))
    name = F.when(F.col("id").isNull() | F.col("later_n").isNotNull(), F.concat(F.col("n").cast("string"), F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit("")))).otherwise(F.col("id").cast("string"))
    # few columns, so a hot digest splits cheaply; the payloads then meet it by unique number
    named = keep(p.select("n", "id", "digest", "bytes", "tier").join(later, F.col("n") == F.col("later_n"), "left").select("n", "id", "digest", "bytes", name.alias("name"), "tier"), "warc-names")
    # the response of a digest: partial maxima first, so a hot digest is one row a task
    first = named.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max(F.struct("id", "n", "name")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    revisits = named.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("first.id")) & (F.col("bytes") >= min_revisit)).select(F.col("n").alias("revisit_n"), F.col("first.name").alias("first_name"))
    names = keep(named.join(revisits, F.col("n") == F.col("revisit_n"), "left").select("n", "name", "first_name", "tier"), "warc-named", by="tier")
    p = p.select("n", "id", "url", "payload", "digest", "tier").join(names, ["n", "tier"])
    urn = lambda kind, i: F.concat(F.lit(f"<urn:capture:{kind}:"), i, F.lit(">"))
    url = F.translate("url", "\r\n", "")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\r\n]*)", 1)
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    line = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs], F.lit("\r\n"))

    def record(kind: Column | str, uid: Column, content_type: str, body: Column, *more: Column) -> Column:
        head = F.concat(
            line("WARC/1.1"), line("WARC-Type: ", kind), line("WARC-Record-ID: ", uid), line("WARC-Date: 1970-01-01T00:00:00Z"),
            line("WARC-Target-URI: ", url), *more, line("Content-Type: ", content_type), line("Content-Length: ", F.octet_length(body).cast("string")),
        )
        return F.concat(head, F.lit("\r\n"), body)

    uid = urn("response", F.col("name"))
    is_revisit = F.col("first_name").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    main = record(
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), uid, "application/http; msgtype=response", http,
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(is_revisit, F.concat(line("WARC-Refers-To: ", urn("response", F.col("first_name"))), line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
    )
    request = record("request", urn("request", F.col("name")), "application/http; msgtype=request", F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)), line("WARC-Concurrent-To: ", uid))
    metadata = record("metadata", urn("metadata", F.col("name")), "application/warc-fields", F.concat(line("captureId: ", F.coalesce(F.col("id").cast("string"), F.lit(""))), line("payloadLength: ", F.octet_length("payload").cast("string"))), line("WARC-Concurrent-To: ", uid))
    return p.select(F.concat(request, F.lit(END), main, F.lit(END), metadata).alias("record"), "tier")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> None:
    """Writes gzip archives under ``path``, in a folder for each of the size classes."""
    records = capture_records(pages, id_col, url_col, payload_col, min_revisit)
    for number, (_, captures_) in enumerate(CAPTURES_PER_FILE):
        # the tables behind have a folder for each class, so every class reads its own only
        records.where(F.col("tier") == number).select("record").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", captures_).text(f"{path}/{number}")


def parse_records(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one unpacked archive, by their Content-Length."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split("\r\n")[1:] if ": " in x)
        body = data[stop + 4 : stop + 4 + int(head["Content-Length"])]
        at = stop + 4 + int(head["Content-Length"])
        kind, payload, page, size = head["WARC-Type"], None, None, None
        if kind == "response":
            payload = body[body.index(b"\r\n\r\n") + 4 :]
            size = len(payload)
            if "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != head["WARC-Payload-Digest"]:
                raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in body.decode("utf-8").split("\r\n") if ": " in x)
            page, size = (int(fields["captureId"]) if fields.get("captureId") else None), int(fields["payloadLength"])
        elif kind == "request":
            payload = body
        yield (
            head["WARC-Record-ID"], kind, head.get("WARC-Target-URI"), head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"),
            head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, page, size, payload if with_payload else None,
        )


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``."""
    kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(parse_records(zlib.decompressobj(31).decompress(content.as_py()), with_payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(parse, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata
    records that are concurrent to it. The records are read once and meet on the id of the
    response, which all three name; ids are unique, so no key is hot. Records that are
    concurrent to none, and requests or metadata without a response, give no row."""
    kind = F.col("record_type")
    of = lambda some, row: F.first(F.when(some, row), ignorenulls=True)
    met = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        of(kind.isin("response", "revisit"), F.struct("record_id", "record_type", "refers_to", "payload_digest", "payload", "target_uri")).alias("main"),
        of(kind == "request", F.struct("record_id", F.col("payload").alias("head"))).alias("request"),
        of(kind == "metadata", F.struct("record_id", "page_id", "payload_bytes")).alias("metadata"),
    )
    response = F.struct(*[F.col("main")[c].alias(c) for c in ("record_id", "record_type", "refers_to", "payload_digest", "payload")])
    return met.where("main is not null").select(F.col("metadata.page_id").alias("page_id"), F.col("main.target_uri").alias("target_uri"), "request", response.alias("response"), "metadata")


def round_trip(pages: DataFrame, with_payload: bool = False, **options) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and assembles what they hold."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return captures(read_warc(pages.sparkSession, path, with_payload))
