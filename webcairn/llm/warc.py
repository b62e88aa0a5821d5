"""WARC archives of captures: write them, read them, assemble transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata
record that name each other through WARC-Concurrent-To.  Archives are written by Spark's
text writer, one record per row, gzipped per file; they are read whole-file by
Spark and parsed record by record by Content-Length.  Assembly joins the records on
their concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from webcairn.llm.common import materialize, table
from webcairn.session import checkpoint_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
MIN_PAYLOAD = 0
READ_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("http_headers", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32(digits: Column) -> Column:
    """Upper-case base32 of the 40 hex digits of a SHA-1, five bytes at a time."""
    groups = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record(kind: str, id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text; a null field is left out."""
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), id, F.lit(CRLF)]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*head, F.lit("Content-Length: "), size, F.lit(CRLF + CRLF), block)


def write_warc(
    pages: DataFrame,
    path: str,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_payload: int = MIN_PAYLOAD,
    date: str = DATE,
) -> None:
    """Write three records per row of ``pages``.

    Of rows with equal payloads of at least ``min_payload`` bytes the one with the
    largest id is the response, the others revisit it; rows that share id and payload
    too count in url order, the first being the larger.  A null payload is empty, a null
    id the smallest, a null url gives no WARC-Target-URI.  No rows write no records.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id).alias("id"),
        F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        body.alias("body"),
    ).withColumns(
        {
            "pid": F.coalesce(F.col("id").cast("string"), F.lit("")),
            "sha": F.sha1(F.col("body").cast("binary")),
            "n": F.octet_length("body"),
        }
    )
    # the bodies are read once for what decides and once to be written; base32 is for print
    held = materialize(rows.select("id", "pid", "sha").distinct())  # one row per (id, payload)
    largest = held.groupBy("sha").agg(F.max("id").alias("largest"))
    own = materialize(held.join(largest, "sha").select("pid", "sha", "largest", base32(F.col("sha")).alias("digest")))
    same = Window.partitionBy("pid", "sha").orderBy("url")
    big = F.col("largest").cast("string")
    first = (F.col("turn") == 1) & (F.coalesce(big, F.lit("")) == F.col("pid"))
    uid = lambda kind, *parts: F.concat(
        F.lit("<urn:uuid:"),
        F.regexp_replace(
            F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary")),
            "(.{8})(.{4})(.{4})(.{4})(.{12})",
            "$1-$2-$3-$4-$5",
        ),
        F.lit(">"),
    )
    turn = F.col("turn").cast("string")
    ready = (
        rows.join(own, ["pid", "sha"])
        .withColumn("turn", F.row_number().over(same))
        .withColumn("revisit", (F.col("n") >= min_payload) & ~first)
        .withColumns(
            {
                "rid": uid("capture", "pid", "digest", turn),
                "first_id": uid("capture", F.coalesce(big, F.lit("")), F.col("digest"), F.lit("1")),
                "stated": F.concat(F.lit("sha1:"), F.col("digest")),
            }
        )
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(CRLF + CRLF),
    )
    path_part = F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.coalesce(path_part, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF + CRLF))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    answer = [*common, ("WARC-Payload-Digest", F.col("stated")), ("Content-Type", F.lit("application/http;msgtype=response"))]
    again = [
        *common,
        ("WARC-Payload-Digest", F.col("stated")),
        ("WARC-Refers-To", F.col("first_id")),
        ("WARC-Profile", F.lit(REVISIT_PROFILE)),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    near = ("WARC-Concurrent-To", F.col("rid"))
    about = F.concat(F.lit("page-id: "), F.col("pid"), F.lit(f"{CRLF}length: "), F.col("n").cast("string"), F.lit(CRLF))
    records = F.array(
        _record("request", uid("request", "pid", "digest", turn), [*common, near, ("Content-Type", F.lit("application/http;msgtype=request"))], get),
        F.when(F.col("revisit"), _record("revisit", F.col("rid"), again, http)).otherwise(
            _record("response", F.col("rid"), answer, F.concat(http, F.col("body")))
        ),
        _record("metadata", uid("metadata", "pid", "digest", turn), [*common, near, ("Content-Type", F.lit("application/warc-fields"))], about),
    )
    ready.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


class _Stream:
    """Bytes of one archive, unpacked a piece at a time; plain or gzip of any number of members."""

    def __init__(self, raw):
        self.raw, self.at, self.have = memoryview(raw), 0, bytearray()
        self.gzip = bytes(self.raw[:2]) == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.gzip else None

    def more(self) -> bool:
        if not self.gzip:
            piece = self.raw[self.at : self.at + READ_BYTES]
            self.at += len(piece)
            self.have += piece
            return bool(len(piece))
        if self.unpack.eof:
            rest = self.unpack.unused_data
            if not rest and self.at >= len(self.raw):
                return False
            self.unpack = zlib.decompressobj(31)
            self.have += self.unpack.decompress(rest)
            return True
        piece = self.raw[self.at : self.at + READ_BYTES // 4]
        if not len(piece):
            return False
        self.at += len(piece)
        self.have += self.unpack.decompress(piece)
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (end := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark))
            if not self.more():
                return None
        out = bytes(self.have[:end])
        del self.have[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def _parse(raw, payload: bool):
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            continue
        fields: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda name: fields.get(name, [None])[0]
        block = stream.take(int(one("content-length") or 0))
        http, body = None, block
        if (one("content-type") or "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
        stated = one("warc-payload-digest")
        yield {
            "type": one("warc-type"),
            "record_id": one("warc-record-id"),
            "concurrent_to": fields.get("warc-concurrent-to", []),
            "target_uri": one("warc-target-uri"),
            "refers_to": one("warc-refers-to"),
            "date": one("warc-date"),
            "stated_digest": stated.removeprefix("sha1:") if stated else None,
            "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode(),
            "payload_bytes": len(body),
            "http_headers": http,
            "payload": body if payload or one("warc-type") == "metadata" else None,
        }


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; digest and size are those of the bytes read.

    Without ``payload`` only metadata records keep their block.
    """
    names = RECORD.fieldNames()

    def scan(batches):
        for batch in batches:
            column = batch.column("content")
            for i in range(len(batch)):
                rows, held = [], 0
                for row in _parse(column[i].as_buffer(), payload):
                    rows.append(row)
                    held += row["payload_bytes"] if payload else 0
                    if len(rows) >= 2000 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"concurrent_to": pa.list_(pa.string()), "payload_bytes": pa.int64(), "payload": pa.binary()}
    arrow = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: capture (its own fields), request, metadata (array).

    Requests and metadata are joined by concurrent-to identifiers in either direction.
    Of several requests the one with the least identifier stays; a capture without
    request has null, without metadata an empty array.
    """
    fields = [f for f in records.columns]
    captures = records.where(F.col("type").isin("response", "revisit"))
    others = records.where(F.col("type").isin("request", "metadata"))
    link = (
        others.select(F.col("record_id").alias("other"), F.explode("concurrent_to").alias("capture_id"))
        .union(captures.select(F.explode("concurrent_to").alias("other"), F.col("record_id").alias("capture_id")))
        .distinct()
    )
    nested = F.struct("record_id", *[c for c in fields if c != "record_id"])
    found = (
        link.join(others.withColumnRenamed("record_id", "other").withColumn("record_id", F.col("other")), "other")
        .groupBy("capture_id")
        .agg(
            F.min(F.when(F.col("type") == "request", nested)).alias("request"),
            F.array_sort(F.collect_list(F.when(F.col("type") == "metadata", nested))).alias("metadata"),
        )
    )
    return captures.select(F.col("record_id").alias("capture_id"), nested.alias("capture")).join(found, "capture_id", "left").select(
        "capture_id",
        "capture",
        "request",
        F.coalesce("metadata", F.array().cast(found.schema["metadata"].dataType)).alias("metadata"),
    )


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    block = F.decode(F.element_at("metadata", 1)["payload"], "utf-8")
    rows = materialize(
        assemble(read_warc(spark, path, payload=False)).select(
            "capture_id",
            F.expr("try_cast(nullif(regexp_extract(decode(metadata[0].payload, 'utf-8'), 'page-id: ([^\\r\\n]*)', 1), '') as bigint)").alias("page_id"),
            F.when(F.col("capture.type") == "revisit", F.regexp_extract(block, "length: ([0-9]+)", 1).cast("bigint"))
            .otherwise(F.col("capture.payload_bytes"))
            .alias("payload_bytes"),
            F.when(F.col("capture.type") == "revisit", F.col("capture.stated_digest"))
            .otherwise(F.col("capture.payload_digest"))
            .alias("payload_digest"),
            F.col("capture.type").alias("record_type"),
            F.col("capture.refers_to").alias("refers"),
        )
    )
    origin = rows.where("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"))
    return rows.join(origin, "refers", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * i // 4 + 1)::INT, 2))::INT >> (3 - 5 * i % 4)::INT) & 31) + 1)::INT, 1)), '') AS digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""
