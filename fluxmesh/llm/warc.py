"""WARC archives: one gzip member per record, read back by byte ranges.

Writing: every page becomes a ``response`` record, or a ``revisit`` record if an equal payload belongs to a page with
a smaller id; each task writes one archive. Reading: archives are cut into byte ranges; a task scans its range for the
gzip magic, accepts a position only if the member decodes to a whole WARC record (header, declared length, end mark),
and then follows the members one after another. A record belongs to the range its first byte lies in, so ranges can
begin anywhere and no record is read twice.

Rows: a null payload is empty; a page without an id is written, is never referred to and never refers; pages that
share the smallest id of a payload are all responses; an empty table gives no archives and no rows. Only the id, URL
and payload columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, open_fs, scratch

SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: Duplicate payload digests are broadcast up to this many rows (about 80 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 200_000


def record_uri(page_id: int | None) -> str:
    key = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))
    return f"<urn:uuid:{key}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record: its header, and a block of HTTP headers with the payload unless it is a revisit."""
    url = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + END + block + END


def gzip_member(record: bytes) -> bytes:
    """One gzip member. A member in whose bytes another record could be seen (a stored archive) is packed otherwise."""
    for level, strategy in ((6, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_HUFFMAN_ONLY), (6, zlib.Z_FIXED), (1, zlib.Z_RLE)):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31, 9, strategy)
        out = packer.compress(record) + packer.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and decode_member(memoryview(out)[at:]) is None:
            at = out.find(MAGIC, at + 1)
        if at < 0:
            return out
    raise ValueError("every packing of this record shows another record inside")


def decode_member(data) -> tuple[bytes, int] | None:
    """(record, bytes used) if a whole, well-formed record's member starts at ``data``; else None."""
    unpack = zlib.decompressobj(31)
    try:
        head = unpack.decompress(data, 8192)
        if not head.startswith(b"WARC/1."):
            return None
        record = head + unpack.decompress(unpack.unconsumed_tail)
    except zlib.error:
        return None
    if not unpack.eof or parse_record(record) is None:
        return None
    return record, len(data) - len(unpack.unused_data)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers with lower-case names, block), or None if the length or the end mark is wrong."""
    cut = record.find(END)
    if cut < 0:
        return None
    headers = {}
    for line in record[:cut].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    block = record[cut + 4 : -4]
    if not size.isdigit() or len(block) != int(size) or record[-4:] != END:
        return None
    return headers, block


def records_in_range(source, size: int, start: int, end: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records whose first byte lies in ``[start, end)`` of an archive of ``size`` bytes."""
    at, buffer, base = start, b"", start

    def more(upto: int) -> None:
        nonlocal buffer
        while base + len(buffer) < min(size, upto):
            buffer += source.read_at(min(chunk, size - base - len(buffer)), base + len(buffer))

    while at < end:
        if at > base + chunk:
            buffer, base = buffer[at - base :], at
        more(at + chunk)
        hit = buffer.find(MAGIC, at - base)
        if hit < 0:
            at = max(at, base + len(buffer) - len(MAGIC) + 1)
            if base + len(buffer) >= size:
                return
            continue
        at = base + hit
        if at >= end:
            return
        got, have = decode_member(memoryview(buffer)[hit:]), len(buffer)
        while got is None and base + have < size and _promising(buffer[hit : hit + 65536]):
            more(base + have + max(chunk, have))
            have = len(buffer)
            got = decode_member(memoryview(buffer)[hit:])
        if got is None:
            at += 1
        else:
            yield got[0]
            at += got[1]


def _promising(data: bytes) -> bool:
    """Whether a member that could not be decoded may just not be read whole yet."""
    try:
        out = zlib.decompressobj(31).decompress(data, 16)
        return out[:7] == b"WARC/1."[: len(out)]
    except zlib.error:
        return False


def mark_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``page_id, url, payload, first_id``: ``first_id`` is set where a page with a smaller id has the same payload."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    digests = own.where(F.octet_length("payload") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = materialize(digests.where("n > 1 and first_id is not null").select("digest", "first_id"), "digests")
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    return own.join(side, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("first_id"))


def write_warc(pages: DataFrame, min_payload: int = 0, folder: str | None = None) -> list[tuple[str, int]]:
    """Write ``pages(page_id, url, html)``; returns (archive, bytes) of each task that succeeded."""
    folder = folder or scratch(pages.sparkSession, "warc")

    def write(batches):
        out = fs = path = None
        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = open_fs(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    info = b"software: fluxmesh\r\n"
                    out.write(gzip_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_uri(None)}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + END))
                out.write(gzip_member(build_record(page_id, url, payload.encode(), first, first is not None)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "size": pa.array([fs.get_file_info(path).size], pa.int64())})

    return sorted((r.uri, r.size) for r in mark_revisits(pages, min_payload).mapInArrow(write, "uri string, size long").collect())


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, archives: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """One row per page record of ``archives``. A response's length and digest are those of the bytes read."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    archives = [(uri, size) for uri, size in archives if size > 0]
    if not archives:
        return spark.createDataFrame([], schema)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for uri, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = open_fs(uri)
                rows = []
                with fs.open_input_file(path) as source:
                    for record in records_in_range(source, size, start, end):
                        headers, block = parse_record(record)
                        kind = headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        payload = block.partition(END)[2]
                        page = int(headers["x-page-id"]) if "x-page-id" in headers else None
                        if kind == "revisit":
                            row = [page, headers["warc-target-uri"], int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:"), kind, int(headers["x-refers-to-page-id"])]
                        else:
                            row = [page, headers["warc-target-uri"], len(payload), payload_digest(payload), kind, None]
                        rows.append(row + [payload] * with_payload)
                        if len(rows) == 500:
                            yield _batch(rows, names)
                            rows = []
                if rows:
                    yield _batch(rows, names)

    # The driver knows the files; their ranges are made by the executors and dealt a task each.
    files = spark.createDataFrame(archives, "uri string, size long")
    ranges = files.select("uri", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("at"))
    ranges = ranges.withColumn("upto", F.least("size", F.col("at") + split_bytes))
    return ranges.repartition(sum(-(-size // split_bytes) for _, size in archives)).mapInArrow(read, schema)


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
