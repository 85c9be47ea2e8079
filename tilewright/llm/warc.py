"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling
them again through their concurrent-to identifiers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_LONG, id_order, scratch_path

MIN_REVISIT_BYTES = 0
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: each 5 hexadecimal digits are 4 base32 letters."""
    letters = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a + 1, b - a) for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)  # null where the value is null: left out


def _record(headers: list[Column], block: Column) -> Column:
    length = _line("Content-Length", F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(_CRLF, F.lit("WARC/1.1"), *headers, length), F.lit(_CRLF * 2), block)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Which pages become responses and which revisits: ord, url, payload, payload_bytes, payload_digest, first.

    ``first``: the smallest ``ord`` with the same payload (a SHA-1 and length), or the row's own where the
    payload is smaller than ``min_revisit_bytes``.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("string").alias("page"), id_order(id_col).alias("ord"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.col("payload").cast("binary"))})
    firsts = rows.groupBy("sha1", "payload_bytes").agg(F.min("ord").alias("low"))
    # Equal payloads are one key: both sides are plain shuffled inputs, which adaptive execution splits.
    joined = rows.join(firsts, ["sha1", "payload_bytes"]).withColumn("payload_digest", base32_of_hex(F.col("sha1")))
    return joined.withColumn("first", F.when(F.col("payload_bytes") >= min_revisit_bytes, F.col("low")).otherwise(F.col("ord"))).drop("low", "sha1")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write three records for each page to WARC files below ``path``.

    A record ends with two line ends, which is Spark's text writer's line separator here; so the archives
    are written by Spark itself, to whatever store it can write to.  Null html is an empty payload; a null
    url leaves the target out; line ends in a url are percent-encoded.
    """
    rows = plan_records(pages, id_col, url_col, html_col, min_revisit_bytes).withColumn("capture", F.uuid())
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("first") != F.col("ord")
    name = F.col("ord").cast("string")
    request, response = _urn(F.lit("request"), F.col("capture")), _urn(F.lit("response"), name, F.col("payload_digest"))
    common = [_line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", target)]
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    response_headers = [
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        _line("WARC-Record-ID", F.when(revisit, _urn(F.lit("revisit"), F.col("capture"))).otherwise(response)),
        _line("WARC-Concurrent-To", request),
        *common,
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, _line("WARC-Refers-To", _urn(F.lit("response"), F.col("first").cast("string"), F.col("payload_digest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
    ]
    requested = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{_CRLF}{_CRLF}"))
    records = [
        _record([F.lit("WARC-Type: request"), _line("WARC-Record-ID", request), *common, F.lit("Content-Type: application/http; msgtype=request")], requested),
        _record(response_headers, F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))),
        _record(
            [F.lit("WARC-Type: metadata"), _line("WARC-Record-ID", _urn(F.lit("metadata"), F.col("capture"))), _line("WARC-Concurrent-To", request), *common, F.lit("Content-Type: application/warc-fields")],
            F.concat_ws("", _line("page-id", F.col("page")), F.lit(_CRLF)),
        ),
    ]
    rows.select(F.explode(F.array(*records)).alias("value")).write.option("lineSep", _CRLF * 2).option("compression", compression).option("maxRecordsPerFile", 30_000).text(path)


_RECORD = "type string, record_id string, concurrent_to string, refers_to string, target string, page long, payload_bytes long, payload_digest string"


def _records(source: io.BufferedIOBase, with_payload: bool) -> Iterator[tuple]:
    while True:
        line = source.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        headers = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = source.read(int(headers["content-length"]))
        kind, page, size, digest, payload = headers.get("warc-type"), None, None, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, computed = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                if digest not in (None, computed):
                    raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
                digest, payload = computed, body
            else:
                size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        elif kind == "metadata":
            page = next((int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.startswith(b"page-id:")), None)
        yield (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), page, size, digest) + ((payload,) if with_payload else ())


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives below ``path``; a file is read record by record, plain or
    gzip, in one or many members."""
    schema = _RECORD + (", payload binary" if with_payload else "")
    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = io.BytesIO(content.as_buffer())
                source = gzip.open(raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows: list[tuple] = []
                size = 0
                for record in _records(source, with_payload):
                    rows.append(record)
                    size += 200 + (record[6] or 0) * with_payload
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: transaction, request, response, metadata, revisited_page.

    Records name each other in either direction, directly or through one more record: a record belongs to
    the transaction of the record that it is concurrent to.  Of several records of one kind in a
    transaction the one with the smallest identifier stays.  A record without an identifier is left out;
    kinds that a transaction lacks are null.  revisited_page is the page of the response a revisit refers to.
    """
    known = records.where("record_id is not null")
    heads = known.where("concurrent_to is not null").groupBy("record_id").agg(F.min("concurrent_to").alias("head"))
    # A record that names no other looks for itself, which finds nothing: no null key gathers them all.
    linked = known.withColumn("__to", F.coalesce("concurrent_to", "record_id")).join(heads.withColumnRenamed("record_id", "__to"), "__to", "left")
    own = F.struct("record_id", *[c for c in records.columns if c != "record_id"])
    keyed = linked.select(F.when(F.col("concurrent_to").isNull(), F.col("record_id")).otherwise(F.coalesce("head", "concurrent_to")).alias("transaction"), F.col("type"), own.alias("record"))

    def of(*kinds: str) -> Column:
        return F.min_by(F.when(F.col("type").isin(*kinds), F.col("record")), F.when(F.col("type").isin(*kinds), F.col("record.record_id")))

    captures = keyed.groupBy("transaction").agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))
    pages = captures.where("response.type = 'response'").groupBy(F.col("response.record_id").alias("refers")).agg(F.min("metadata.page").alias("revisited_page"))
    return captures.withColumn("refers", F.coalesce("response.refers_to", F.concat(F.lit("none "), "transaction"))).join(pages, "refers", "left").drop("refers")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and assemble the captures.

    Returns one row per page: ``id_col``, payload_bytes, payload_digest, record_type, refers_to.  Null html
    is an empty payload, with a digest like any other.  A null identifier sorts last and stays null.  Rows
    that repeat the smallest identifier of a payload are all responses.  An empty table gives no rows.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, url_col, html_col, min_revisit_bytes)
    captures = assemble(read_records(pages.sparkSession, path))
    return captures.select(
        F.col("metadata.page").alias(id_col),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", F.nullif("revisited_page", F.lit(MAX_LONG))).alias("refers_to"),
    )
