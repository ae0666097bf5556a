"""Content-addressed WARC archive.

Each distinct payload is stored once under its SHA-256; the exact head of each record (WARC and HTTP header lines) is stored
apart. Records come back by joining heads to payloads, and every payload is checked against its digest on the way. ``export``
writes the records as compressed WARC files with Spark's text writer (a record ends in two CRLF, which is the line separator
there), and ``read_files`` parses such files by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemeter.session import shared_folder

#: RFC 4648.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LINE = "\r\n"
_RECORD_END = "\r\n\r\n"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string: 5 hex digits are 4 letters."""
    digest = F.sha1(text)
    parts = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """One record per row: page_id, record_type, refers_to, digest (SHA-256), head, payload_bytes.

    Of the rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the smallest id are responses and the
    others revisit that id; smaller payloads are all responses. A null payload counts as empty; a null id is never the
    smallest beside others. Line breaks in a URL are percent-encoded; a null URL leaves out its header.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.unhex(F.sha2(payload, 256)).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("sha1"),
    )
    keep = rows.groupBy("digest").agg(F.min("page_id").alias("keep_id"))
    first = (F.col("payload_bytes") < min_revisit_bytes) | F.col("page_id").eqNullSafe(F.col("keep_id"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "), F.col("payload_bytes"), F.lit(_RECORD_END))
    rows = rows.join(keep, "digest").withColumn("record_type", F.when(first, "response").otherwise("revisit"))
    rows = rows.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("keep_id")))
    block = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block),
    ]
    head = F.concat(F.concat_ws(_LINE, *lines), F.lit(_RECORD_END), http)
    return rows.select("page_id", "record_type", "refers_to", "digest", "payload_bytes", head.alias("head"))


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write ``folder/heads`` (one row per record) and ``folder/payloads`` (one row per distinct payload)."""
    records(pages, id_col, url_col, payload_col, min_revisit_bytes).write.parquet(f"{folder}/heads")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    distinct = pages.select(F.unhex(F.sha2(payload, 256)).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    distinct.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: page_id, record. Only responses carry their payload, which must have the digest it is stored under."""
    heads, payloads = spark.read.parquet(f"{folder}/heads"), spark.read.parquet(f"{folder}/payloads")
    sound = F.when(F.unhex(F.sha2(F.col("payload"), 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not have its digest")))
    payloads = payloads.select("digest", sound.alias("payload"))
    full = heads.where("record_type = 'response'").join(payloads, "digest").select("page_id", F.concat("head", "payload").alias("record"))
    return full.unionByName(heads.where("record_type <> 'response'").select("page_id", F.col("head").alias("record")))


def export(restored: DataFrame, folder: str, records_per_file: int = 5_000) -> None:
    """WARC files, gzipped, of at most ``records_per_file`` records each."""
    restored.select("record").write.option("lineSep", _RECORD_END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(folder)


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header lines and block of each record of one file; bodies are cut by Content-Length, never by their content."""
    held = b""
    ended = False

    def more() -> bool:
        nonlocal held, ended
        piece = next(chunks, None)
        ended = piece is None
        held += piece or b""
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("a WARC record is cut short")
            return
        head = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        while len(held) < stop + 4 and more():
            pass
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where its length says")
        yield head, held[end + 4 : stop]
        held = held[stop + 4 :]


def _inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    while data:
        inflate = zlib.decompressobj(31)
        while data and not inflate.eof:
            yield inflate.decompress(data, size)
            data = inflate.unconsumed_tail or inflate.unused_data


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = lambda urn: None if urn is None or urn == "<urn:page:none>" else int(urn[len("<urn:page:") : -1])
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for head, block in _parse(_inflated(content.as_py())):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what its head says")
                kept = payload.decode() if head["WARC-Type"] == "response" else None
                out.append((page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], page(head.get("WARC-Refers-To")), kept))
                if len(out) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES, strict=True)], names=_NAMES)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES, strict=True)], names=_NAMES)


_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Records of WARC files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (responses only)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(_rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html), restore and export the records, and read the files."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    archive(pages, f"{folder}/store", min_revisit_bytes=min_revisit_bytes)
    export(restore(spark, f"{folder}/store"), f"{folder}/warc")
    return read_files(spark, f"{folder}/warc")
