"""WARC archives with an index, and reads of selected records by coalesced byte ranges.

Tasks write one archive each into the shared folder, a gzip member per record, and return an index row per
record: file, offset, length, URL and digest. The index is a table of its own. Readers sort the index rows
they want by file and offset, join neighbours into one byte range and read each range once. A task that
runs again writes a file of another name, and only the files of finished tasks are in the index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.files import full_path, open_store
from hazardlens.llm.scratch import stored
from hazardlens.session import new_folder

DATE = "2024-01-01T00:00:00Z"
#: Records that lie no further apart than this are read in one go, up to ``RANGE_BYTES``.
GAP_BYTES = 64 << 10
RANGE_BYTES = 4 << 20
#: A reading task gets so many bytes of archives and so many records, or what is left.
TASK_BYTES, TASK_RECORDS = 32 << 20, 20_000
RECORD_ID = "urn:page:"
NO_ID = "urn:page-without-id"
INDEX = "page_id {kind}, url string, payload_digest string, record_type string, file string, offset bigint, length bigint"


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload_bytes, sha1 (hex), record_type and refers_to to (page_id, url, html).

    Of equal payloads of ``least_bytes`` bytes or more, the rows of the largest page_id are responses and the
    others revisit it; a null id is smaller than any. Smaller payloads are all responses. A null html is empty.
    """
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "sha1": F.sha1("html")})
    first = (sized.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(
        F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("sha1").alias("shared"), "largest"))
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return sized.join(first, F.col("sha1") == F.col("shared"), "left").select(
        "page_id", "url", "html", "payload_bytes", "sha1",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("largest")).alias("refers_to"))


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _header_text(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_uri(page_id) -> str:
    return NO_ID if page_id is None else RECORD_ID + quote(str(page_id), safe="")


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_uri(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{record_uri(refers_to)}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def _page(uri: str | None) -> str | None:
    if uri is None or uri == f"<{NO_ID}>":
        return None
    return unquote(uri.removeprefix(f"<{RECORD_ID}").removesuffix(">"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Archives every row of (page_id, url, html) and returns the stored index, one row a record.

    A null html is an empty payload, a null url leaves its header out, a null id has a record id of its own. Rows that
    repeat an id are records of their own, other columns are not kept. An empty table makes no archive and an empty index.
    """
    folder = full_path(pages.sparkSession, folder or new_folder(pages.sparkSession, "warc"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        sink, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                digest = base32_digest(row["sha1"])
                data = gzip.compress(record_bytes(row["page_id"], row["url"], row["html"].encode(), digest,
                                                  row["record_type"], row["refers_to"]), 6, mtime=0)
                sink.write(data)
                index.append((row["page_id"], row["url"], digest, row["record_type"], f"{folder}/{name}", at, len(data)))
                at += len(data)
            columns = list(zip(*index, strict=True)) if index else [[]] * 7
            kinds = [batch.schema.field("page_id").type, *[pa.string()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["page_id", "url", "payload_digest", "record_type", "file", "offset", "length"])
        if sink is not None:
            sink.close()

    records = with_record_types(pages, least_bytes).drop("payload_bytes")
    return stored(records.mapInArrow(write, INDEX.format(kind=kind)), "warc-index")


def read_records(index: DataFrame, selected: Column | None = None) -> DataFrame:
    """The selected records, read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Bytes and digest are those of the full payload, also for revisits, whose own payload is null; a response
    whose payload does not have the digest of its header is an error. An empty index, or none selected, gives no row.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    wanted = (index if selected is None else index.where(selected)).select("file", "offset", "length")
    held = wanted.agg(F.sum("length"), F.count("*")).first()
    tasks = max(1, -(-(held[0] or 0) // TASK_BYTES), -(-held[1] // TASK_RECORDS))
    # The number of ranges is given, as sizes of index rows say nothing about the bytes behind them.
    ranges = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def fetch(group: list[tuple[str, int, int]]) -> Iterator[tuple]:
        path = group[0][0]
        store, name = open_store(path)
        first, last = group[0][1], group[-1][1] + group[-1][2]
        with store.open_input_file(name) as source:
            data = source.read_at(last - first, first)
        for _, offset, length in group:
            record = parse_record(gzip.decompress(data[offset - first:offset - first + length]))
            headers = record["headers"]
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            response = headers["WARC-Type"] == "response"
            if response:
                if base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode() != digest:
                    raise ValueError(f"{path} at {offset}: the payload does not have the digest of its header")
            yield (_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), int(record["http"]["Content-Length"]),
                   digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To")),
                   record["payload"].decode() if response else None)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        group: list[tuple[str, int, int]] = []

        def out() -> pa.RecordBatch:
            columns = zip(*fetch(group), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (file != group[-1][0] or offset + length - group[0][1] > RANGE_BYTES
                              or offset - group[-1][1] - group[-1][2] > GAP_BYTES):
                    yield out()
                    group = []
                group.append((file, offset, length))
        if group:
            yield out()

    rows = ranges.mapInArrow(read, "page_id string, url string, payload_bytes bigint, payload_digest string, "
                                   "record_type string, refers_to string, payload string")
    return rows.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
