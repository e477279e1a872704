"""WARC archives with an index first: write records and their index, then read what the index selects.

Each record is its own gzip member, so a record is a byte range of its file. Reading sorts the selected
ranges by file and offset, joins those that lie close, fetches each joined range once and parses the records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.files import attempt_name, opened
from quillspark.llm.skew import join_counted
from quillspark.session import new_path, partitions, staged

#: Fixed values of the format.
VERSION, PROFILE, DATE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "1970-01-01T00:00:00Z"
SPACE_FOR_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes: least payload that a revisit may stand for, size at which a file ends, widest gap that is read over, most in one read.
LEAST, FILE_BYTES, GAP, RANGE = 100, 64 << 20, 64 << 10, 8 << 20


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_FOR_IDS, f'page:{page}')}>"


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """An uncompressed record: a response with its payload, or a revisit that has only its headers."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"X-Page-Id: {'' if page is None else page}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers (the version under ``""``), HTTP headers and payload of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {"": version} | dict(x.partition(": ")[::2] for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.partition(": ")[::2] for x in http.decode().split("\r\n")[1:]), payload


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page and give the index: path, offset, length, url, digest, record_type, _id.

    Payloads are the html in UTF-8, null: empty. Of equal payloads of at least LEAST bytes, the page with
    the smallest id is a response and the others revisit it; pages that repeat that id are responses too.
    Null ids never are what others revisit unless a group has no other id; then all its pages are responses.
    Only page keys and digests are shuffled to find equal payloads; pages join just the revisits. Repeated rows are
    records of their own. A very long page is one record, which one task holds. An empty table gives an empty index;
    other columns are ignored. Ids are whole numbers.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(F.col(id_col).alias("_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    keys, _ = staged(keyed.where(F.col("bytes") >= LEAST).select("_id", "digest"), "payload-digests")
    firsts = keys.groupBy("digest").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = join_counted(keys, firsts, "digest", "n", keys.count()).where(~F.col("_id").eqNullSafe(F.col("first")))
    revisits, _ = staged(revisits.select(F.col("_id").alias("_rid"), F.col("digest").alias("_rd"), "first").distinct(), "revisits")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    rows = rows.join(revisits, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("digest") == F.col("_rd")), "left").select("_id", "url", "html", "digest", "first")
    folder = new_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["path", "offset", "length", "url", "digest", "record_type", "_id"]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        to, path = None, ""
        for batch in batches:
            out = []
            html = batch.column(2).cast(pa.binary()).to_pylist()
            for page, url, body, digest, first in zip(*(batch.column(k).to_pylist() for k in (0, 1)), html, *(batch.column(k).to_pylist() for k in (3, 4)), strict=True):
                if to is None or at >= FILE_BYTES:
                    if to:
                        to.close()
                    path = f"{folder}/{attempt_name('part', '.warc.gz')}"
                    to, at = system.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None), 0
                packed = gzip.compress(record(page, url, body, digest, first), 6, mtime=0)
                to.write(packed)
                out.append((path, at, len(packed), url, digest, "response" if first is None else "revisit", page))
                at += len(packed)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), batch.schema.field(0).type]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        if to:
            to.close()

    index = rows.mapInArrow(save, f"path string, offset bigint, length bigint, url string, digest string, record_type string, _id {kind}")
    return staged(index, "warc-index")[0]


def read(index: DataFrame, select: Column | None = None, id_col: str = "page_id", payloads: bool = False) -> DataFrame:
    """The selected records (all without select), from the archives: id_col, payload_bytes, payload_digest,
    record_type, refers_to, and payload where asked for (null for a revisit).

    A response whose payload does not have the digest that its headers state fails the read. Ids are read
    from the record's headers, as whole numbers.
    """
    chosen = index if select is None else index.where(select)
    n = partitions(index.sparkSession)
    rows = chosen.select("path", "offset", "length").repartition(n, "path").sortWithinPartitions("path", "offset")

    def whole(text: str) -> int | None:
        return int(text) if text else None

    def parse(raw: bytes) -> tuple:
        headers, http, payload = parsed(gzip.decompress(raw))
        stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        revisit = headers["WARC-Type"] == "revisit"
        if not revisit and hashlib.sha256(payload).hexdigest() != stated:
            raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not what its digest says")
        size = int(http["Content-Length"]) if revisit else len(payload)
        found = (whole(headers["X-Page-Id"]), size, stated, headers["WARC-Type"], whole(headers.get("X-Refers-To-Page-Id", "")))
        return (*found, None if revisit else payload) if payloads else found

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payloads else [])]
    names = ["_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened_path, f, waiting = "", None, []

        def flush() -> pa.RecordBatch:
            low, (last, size) = waiting[0][0], waiting[-1]
            f.seek(low)
            raw = f.read(last + size - low)
            found = [parse(raw[at - low : at - low + n]) for at, n in waiting]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (path != opened_path or at - sum(waiting[-1]) > GAP or at + size - waiting[0][0] > RANGE):
                    yield flush()
                if path != opened_path:
                    if f:
                        f.close()
                    system, name = opened(path)
                    opened_path, f = path, system.open_input_file(name)
                waiting.append((at, size))
        if waiting:
            yield flush()
        if f:
            f.close()

    schema = "_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    return rows.mapInArrow(fetch, schema).withColumnRenamed("_id", id_col)
