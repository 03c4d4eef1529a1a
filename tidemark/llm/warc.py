"""WARC writing, reading and transaction assembly.

Each page is a capture of three records: a response (or a revisit), the request
and a metadata record, the latter two naming the first in WARC-Concurrent-To.
The archives are gzipped WARC/1.1 files, written by Spark's text sink with the
record separator as line end; a file holds at most FILE_RECORDS records.
Reading streams gzipped files of any size through Spark's text source, cut at the
separator, and puts them together again record by record, so a task holds a batch of
pieces and one record, never a file; only archives that are not gzipped (which Spark
would split inside records) are read as one value each.  Assembly joins the records
of a capture through the concurrent-to identifiers into one nested row.

Of equal payloads of at least MIN_REVISIT bytes the record of the smallest page_id
is the response (null ids last, then input order), the others revisit it.  A null
html is an empty payload, a null url an empty target; line breaks in a url are
written as %0D and %0A.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut

MIN_REVISIT = 100
FILE_RECORDS = 15_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
RECORD = "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, block_type string, payload_bytes bigint, payload_digest string, fields map<string,string>"


def _record_id(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), row.cast("string")))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: str | Column, row: Column, uri: Column, block: Column, block_type: str, extra: Column) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    own = "capture" if not isinstance(kind, str) else kind
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), name, F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(own, row),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), uri, F.lit(CRLF), extra,
        F.lit(f"Content-Type: {block_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """One capture per row of ``pages`` (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select("page_id", uri.alias("uri"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"), F.monotonically_increasing_id().alias("row"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    order = rows.where(f"bytes >= {MIN_REVISIT}").select("digest", "page_id", "row")
    repeated = order.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.row").alias("original"))
    rows = rows.join(repeated, "digest", "left")
    revisits = F.col("original").isNotNull() & (F.col("original") != F.col("row"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(CRLF))
    refers = F.when(revisits, F.concat(F.lit("WARC-Refers-To: "), _record_id("capture", F.col("original")), F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}"))).otherwise("")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), _record_id("capture", F.col("row")), F.lit(CRLF))
    records = F.array(
        _record(F.when(revisits, "revisit").otherwise("response"), F.col("row"), F.col("uri"), F.concat(head, F.when(revisits, "").otherwise(F.col("html"))), "application/http; msgtype=response", F.concat(digest, refers)),
        _record("request", F.col("row"), F.col("uri"), F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF * 2}")), "application/http; msgtype=request", concurrent),
        _record("metadata", F.col("row"), F.col("uri"), F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)), "application/warc-fields", concurrent),
    )
    out = rows.select(F.explode(records).alias("value")).write.option("lineSep", CRLF * 2)
    out.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Walks a WARC stream; the block of a record is the only thing held."""
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
        if not held[:end].strip():  # a file's last piece may have got a separator too many
            del held[: end + 4]
            continue
        lines = bytes(held[:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size + 4 and more():
            pass
        if len(held) < end + 4 + size:
            raise ValueError("the archive ends inside a block")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]
        yield headers, block


def _row_of(headers: dict[str, str], block: bytes) -> tuple:
    kind, content = headers.get("warc-type"), headers.get("content-type", "")
    payload, fields = block, None
    if content.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])}
    elif content.startswith("application/warc-fields"):
        fields = {k.strip(): v.strip() for k, c, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if c}
    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if kind == "revisit":
        stated = (fields or {}).get("content-length")
        size = int(stated) if stated else None
        digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    return headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), content, size, digest, list((fields or {}).items())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(file, piece) with the separators that the reader took away; whole files have none to give back."""
    for batch in batches:
        ended = CRLF.encode() * 2 if "value" in batch.schema.names else b""
        content = batch.column("value" if ended else "content")
        for file, piece in zip(batch.column("file").to_pylist(), content, strict=True):
            yield file, piece.as_py() + ended


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
    names = [c.split()[0] for c in RECORD.replace("map<string,string>", "map").split(", ")]
    for _, pieces in groupby(_pieces(batches), itemgetter(0)):
        rows = []
        for headers, block in records_of(piece for _, piece in pieces):
            rows.append(_row_of(headers, block))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ``part-*`` files in ``path``, gzipped (``.gz``, of one member or many) or plain."""
    file = F.xxhash64("_metadata.file_path").alias("file")
    packed = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "part-*.gz").text(path)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "part-*[!z]").load(path)
    return packed.select(F.col("value").cast("binary").alias("value"), file).mapInArrow(_parse, RECORD).unionByName(plain.select("content", file).mapInArrow(_parse, RECORD))


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (null where missing).

    A record without a concurrent-to identifier is a capture of its own; of
    several records of a kind in a capture the largest by its fields counts.
    """
    body = F.struct("record_type", "record_id", "target_uri", "refers_to", "block_type", "payload_bytes", "payload_digest", F.map_entries("fields").alias("fields"))
    main = F.col("record_type").isin("response", "revisit", "resource", "conversion")
    capture = F.coalesce(F.when(main, F.col("record_id")), F.col("concurrent_to"), F.col("record_id"))
    return records.select(capture.alias("capture_id"), "record_type", body.alias("body"), main.alias("main")).groupBy("capture_id").agg(
        F.max(F.when(F.col("main"), F.col("body"))).alias("response"),
        F.max(F.when(F.col("record_type") == "request", F.col("body"))).alias("request"),
        F.max(F.when(F.col("record_type") == "metadata", F.col("body"))).alias("metadata"),
    )


def page_captures(captures: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id (of ``id_type``, that of the pages), payload_bytes, payload_digest, record_type, refers_to
    of captures written by write_archives."""
    field = F.map_from_entries("metadata.fields")["page_id"]
    flat = captures.where("response is not null").select(
        "capture_id", F.when(field != "", field).cast(id_type).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("original"),
    )
    flat = cut(flat, "captures")
    ids = flat.where("record_type = 'response'").select(F.col("capture_id").alias("original"), F.col("page_id").alias("refers_to"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_id"]
    # only captures that refer to one are joined: the others would all meet at the null key
    alone = flat.where("original is null").withColumn("refers_to", F.lit(None).cast(ids.schema["refers_to"].dataType))
    return flat.where("original is not null").join(ids, "original", "left").select(*out).unionByName(alone.select(*out))
