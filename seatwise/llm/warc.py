"""WARC archives: a writer with revisit records and a Python data source that reads them.

``write_archives`` gives each task a file of gzipped records (one member each, with the member's length
in the ``sl`` extra field). Of equal payloads, compared by SHA-1, length and a second hash, the page with
the largest id is a response, the others are revisits that refer to it; payloads below ``least_bytes``
are all responses. ``register`` adds the format ``warc``: it plans groups of files as partitions, takes
over predicates on record type and headers, parses the header block of a record first and skips the
payload of a record that the predicates drop, or of all records if the schema has no ``payload``.

A null html is an empty payload, a null url gives no target, a null page id never is the one referred to
unless all of its copies have none; rows that share the largest id are all responses. No rows, no file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from seatwise.llm.common import open_store, stored, whole_text

GROUP_BYTES = 128 << 20  # of files in a partition; a file is not cut
BATCH_BYTES = 8 << 20
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join([f"{f} string" for f in FIELDS]) + ", headers map<string,string>, payload_bytes long, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None, seed: str) -> str:
    """The record id of a page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>" if page_id is None else f"<urn:page:{page_id}>"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that tells its own length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1"]
    lines += [f"{k}: {' '.join(v.split())}" for k, v in headers if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_record(row: dict, date: str) -> bytes:
    """A revisit keeps the headers of its response, so that the length of the payload is known."""
    response, digest = row["response"], base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n"
    return record(
        [
            ("WARC-Type", "response" if response else "revisit"),
            ("WARC-Record-ID", page_urn(row["page_id"], f"{row['url']} {digest}")),
            ("WARC-Date", date),
            ("WARC-Target-URI", row["url"]),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Profile", None if response else PROFILE),
            ("WARC-Refers-To", None if response else page_urn(row["keep_id"], "")),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        (http + (row["html"] if response else "")).encode(),
    )


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Writes ``pages`` below ``folder``; returns the stored table of files (path, n_records)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), whole_text(html_col).alias("html")
    )
    key = [F.sha1("html").alias("sha1"), F.octet_length("html").alias("size"), F.xxhash64("html").alias("hash")]
    keepers = rows.groupBy(*key).agg(F.max("page_id").alias("keep_id"))
    marked = rows.select("*", *key).join(keepers, ["sha1", "size", "hash"])
    response = (F.col("size") < least_bytes) | F.col("page_id").eqNullSafe(F.col("keep_id"))
    marked = marked.select(
        "page_id", "url", F.when(response, F.col("html")).alias("html"), response.alias("response"), "keep_id", "sha1", "size"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", page_urn(None, path)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                    out.write(member(record(info, b"format: WARC File Format 1.1\r\n")))
                out.write(member(_page_record(row, date)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    files = stored(marked.mapInArrow(write, "path string, n_records long"), "archives")
    _drop_uncommitted(folder, {row.path for row in files.select("path").collect()})
    return files


def _drop_uncommitted(folder: str, committed: set[str]) -> None:
    """Removes files of attempts that Spark did not commit; a file name per task goes to the driver."""
    from pyarrow import fs

    store, root = open_store(folder)
    for file in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if file.path not in committed:
            store.delete_file(file.path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder or file)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.fields, self.path = schema.fieldNames(), path
        self.equal: list[tuple[str, frozenset]] = []
        self.prefixes: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo):
                self.equal.append((FIELDS[name], frozenset([f.value])))
            elif name in FIELDS and isinstance(f, In):
                self.equal.append((FIELDS[name], frozenset(f.value)))
            elif name in FIELDS and isinstance(f, StringStartsWith):
                self.prefixes.append((FIELDS[name], f.value))
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.prefixes.append((FIELDS[name], ""))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = open_store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        groups: list[Files] = []
        held = GROUP_BYTES
        for file in sorted((f for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            if held + file.size > GROUP_BYTES:
                groups.append(Files([]))
                held = 0
            groups[-1].paths.append(file.path)
            held += file.size
        return groups

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) in values for k, values in self.equal) and all(
            k in headers and headers[k].startswith(v) for k, v in self.prefixes
        )

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = open_store(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for headers, http, payload in records(file, self.wanted, "payload" in self.fields):
                    rows.append(self._row(headers, http, payload))
                    held += len(payload or b"") + 500
                    if held > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, headers: dict[str, str], http: dict[str, str], payload: bytes | None) -> dict:
        length = http.get("Content-Length", "")
        row = {f: headers.get(h) for f, h in FIELDS.items()}
        row |= {"headers": list(headers.items()), "payload_bytes": int(length) if length.isdigit() else None, "payload": payload}
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = dict.fromkeys(FIELDS, pa.string()) | {
            "headers": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "payload": pa.binary()
        }
        return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kinds[f]) for f in self.fields], self.fields)


def _headers(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip(), value.strip())
    return found


class _Member:
    """Reads the data of one record: a gzip member, or plain bytes."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        file.seek(at)
        self.raw = file.read(READ_BYTES)
        self.length, self.inflate, self.ended = None, None, not self.raw
        if self.raw[:2] == b"\x1f\x8b":
            if len(self.raw) >= 24 and self.raw[3] == 4 and self.raw[12:14] == b"sl":
                self.length = struct.unpack_from("<I", self.raw, 16)[0]
            self.inflate = zlib.decompressobj(31)
        self.read_to = at + len(self.raw)
        self.data = b""

    def more(self) -> bool:
        """Adds data; False at the end of the member or file."""
        if self.inflate is None:
            self.data += self.raw
        else:
            self.data += self.inflate.decompress(self.raw, READ_BYTES)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.ended = True
                return False
            if self.raw:
                return True
        self.file.seek(self.read_to)
        self.raw = self.file.read(READ_BYTES)
        self.read_to += len(self.raw)
        self.ended = not self.raw
        return not self.ended

    def until(self, size: int) -> bytes:
        parts, held = [self.data], len(self.data)
        while held < size:
            self.data = b""
            on = self.more()
            parts.append(self.data)
            held += len(self.data)
            if not on:
                break
        self.data = b"".join(parts)
        return self.data[:size]

    def end(self, size: int) -> int:
        """Where the next record starts; a member that tells its length is not decoded for this."""
        if self.inflate is None:
            return self.at + size
        if self.length:
            return self.at + self.length
        while not self.ended:
            self.data = b""
            self.more()
        return self.read_to - len(self.inflate.unused_data)


def records(file, wanted, with_payload: bool) -> Iterator[tuple[dict, dict, bytes | None]]:
    """(WARC headers, HTTP headers, payload) of the records that ``wanted`` keeps."""
    at, size = 0, file.size()
    while at < size:
        member = _Member(file, at)
        while b"\r\n\r\n" not in member.data and member.more():
            pass
        head, found, _ = member.data.partition(b"\r\n\r\n")
        if not found:
            if member.data.strip():
                raise ValueError(f"no record at byte {at}")
            return
        headers = _headers(head)
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        begin, length = len(head) + 4, int(headers["Content-Length"])
        if wanted(headers):
            http, payload = {}, None
            is_http = headers.get("Content-Type", "").startswith("application/http")
            if with_payload:
                block = member.until(begin + length)[begin:]
                if len(block) < length:
                    raise ValueError(f"the record at byte {at} is cut off")
                payload = block
                if is_http:
                    answer, _, payload = block.partition(b"\r\n\r\n")
                    http = _headers(answer)
                digest = headers.get("WARC-Payload-Digest", "")
                if headers.get("WARC-Type") == "response" and digest.startswith("sha1:") and digest[5:] != sha1_base32(payload):
                    raise ValueError(f"the payload at byte {at} does not have its digest")
            elif is_http:
                answer = member.until(begin + min(length, READ_BYTES))[begin:]
                http = _headers(answer.partition(b"\r\n\r\n")[0])
            yield headers, http, payload
        at = member.end(begin + length + 4)


def register(spark: SparkSession) -> None:
    """Adds the format ``warc``; predicates reach it only with this setting of Spark."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records of archives."""
    register(spark)
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1), '') AS long)")
    found = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return found.select(
        page("record_id").alias("page_id"),
        size.alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
