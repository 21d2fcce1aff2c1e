"""WARC archives: one capture per page as request, response (or revisit) and
metadata records, and their assembly back into one nested row per capture.

Archives are written by Spark's text sink (each row a record, the record
separator as line separator), so they are committed like any table on any
store; they are read as whole files and framed by Content-Length, so payloads
may hold anything.  Files are bounded by records in proportion to the mean
record size, and compressed by the sink.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 32 << 20  # mean size of an archive before compression
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
# Fixed values of the format.
VERSION = b"WARC/1.1"
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URI_SAFE = "!#$%&'()*+,/:;=?@[]-._~"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def _urn(*parts: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts))).urn}>"


def write_captures(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Writes archives of ``pages`` to the folder ``path``.

    Of equal payloads of at least ``least`` bytes the capture with the least
    id is a response, the others are revisits of it; null ids come last and
    rows with the same id are captures of their own.  A null payload is empty,
    a null url gives no target.
    """
    row = F.monotonically_increasing_id()  # place in the input, which names the records
    rows = pages.select(F.col(id_column).cast("string").alias("id"), F.col(id_column).alias("_n"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"), row.alias("row"))
    rows = rows.withColumn("key", F.when(F.length("payload") >= least, F.sha2("payload", 256)))
    n, size = rows.agg(F.count("*"), F.sum(F.length("payload") + 1500)).first()
    first = F.min(F.struct(F.col("_n").isNull(), "_n", F.col("row").alias("row")))
    groups = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), first.alias("f")).where("n > 1")
    known = groups.select(F.col("key").alias("_key"), F.col("f.row").alias("origin"))
    marked = rows.join(known, F.col("key") == F.col("_key"), "left").select("id", "url", "payload", "row", F.when(F.col("origin") != F.col("row"), F.col("origin")).alias("origin"))

    def records(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 256):
                out = []
                for r in frame.slice(at, 256).to_pylist():
                    payload, own = r["payload"], _urn("capture", r["row"])
                    target = None if r["url"] is None else quote(r["url"], safe=URI_SAFE)
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    again = r["origin"] is not None
                    shared = [("WARC-Target-URI", target), ("WARC-Date", DATE)]
                    out.append(_record([
                        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
                        ("WARC-Profile", REVISIT if again else None), ("WARC-Refers-To", _urn("capture", r["origin"]) if again else None),
                        ("Content-Type", "application/http; msgtype=response")], http if again else http + payload))
                    out.append(_record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", r["row"])), ("WARC-Concurrent-To", own), *shared,
                                        ("Content-Type", "application/http; msgtype=request")], f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode()))
                    fields = "" if r["id"] is None else f"page: {r['id']}\r\n"
                    out.append(_record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", r["row"])), ("WARC-Concurrent-To", own), *shared,
                                        ("Content-Type", "application/warc-fields")], fields.encode()))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    per_file = max(3, int(3 * FILE_BYTES * n / size)) if n else 3
    text = marked.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _frames(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers by lower-case name, block) of each record; a broken one raises."""
    view, at = memoryview(data), 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        begin = stop + 4
        end = begin + int(headers["content-length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length than it states")
        yield headers, view[begin:end]
        at = end + 4


RECORD = "type string, id string, concurrent_to string, refers_to string, target string, date string, http string, payload binary, payload_bytes long, payload_digest string, fields map<string,string>"


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (gzip or plain).

    The payload's length and digest are those of the stored bytes; for a
    revisit, which stores none, those its headers state.  ``payloads``: also
    return the bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("content")

    def parse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("date", pa.string()), ("http", pa.string()),
                            ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
        for frame in frames:
            for content in frame.column(0):
                data = content.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    parts = []
                    while data:  # one member or one per record
                        unzip = zlib.decompressobj(31)
                        parts.append(unzip.decompress(data))
                        data = unzip.unused_data
                    data = b"".join(parts)
                rows = []
                for h, block in _frames(data):
                    kind = h.get("warc-type")
                    row = {"type": kind, "id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target": h.get("warc-target-uri"), "date": h.get("warc-date")}
                    raw = bytes(block)
                    if kind in ("response", "revisit", "request"):
                        head, _, body = raw.partition(b"\r\n\r\n")
                        row["http"] = head.decode()
                        if kind == "response":
                            row |= {"payload": body if payloads else None, "payload_bytes": len(body), "payload_digest": digest(body)}
                        elif kind == "revisit":
                            named = dict(x.lower().split(":", 1) for x in row["http"].split("\r\n")[1:])
                            row |= {"payload_bytes": int(named["content-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:")}
                    elif h.get("content-type") == "application/warc-fields":
                        row["fields"] = [tuple(y.strip() for y in x.split(":", 1)) for x in raw.decode().split("\r\n") if ":" in x]
                    rows.append(row)
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``id``, ``capture`` (the response or revisit),
    ``request``, ``metadata``, ``n_requests`` and ``n_metadata``.

    Requests and metadata meet their capture through WARC-Concurrent-To.  Of
    several, the one with the least record id is shown and all are counted;
    those of no capture, and other record types, give no row.
    """
    def beside(kind: str, *columns: str | Column) -> DataFrame:
        one = F.min_by(F.struct("id", *columns), "id").alias(kind)
        return records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias(f"_{kind}")).agg(one, F.count("*").alias(f"n_{kind}"))

    capture = F.struct("type", "target", "date", "http", "payload", "payload_bytes", "payload_digest", "refers_to")
    out = records.where(F.col("type").isin("response", "revisit")).select("id", capture.alias("capture"))
    for part in (beside("request", "target", "date", "http"), beside("metadata", "target", "date", "fields")):
        out = out.join(part, F.col("id") == F.col(part.columns[0]), "left").drop(part.columns[0])
    return out.select("id", "capture", "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))
