"""WARC files as a Spark data source, read and written.

Each record is one gzip member whose header carries the member's length, so a
reader inflates a record's headers, tests the pushed predicates on them and
jumps to the next record without inflating a payload nobody asked for.  Plain
``.warc`` files and foreign ``.warc.gz`` files are read too.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from helixframe.llm.scratch import Scratch

#: Fixed values of the format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUBFIELD = b"HL"
#: Bytes after which a writer begins a new file, and that a read partition holds about.
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20

HEADER_COLUMNS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
_FIELDS = {c: h.lower() for c, h in HEADER_COLUMNS.items()}
SCHEMA = ", ".join(f"{c} string" for c in HEADER_COLUMNS) + ", content_length long, headers map<string,string>, payload binary"
ARROW = pa.schema([(c, pa.string()) for c in HEADER_COLUMNS] + [("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def _clean(value: str) -> str:
    """Header values hold no line ends: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(row: dict) -> bytes:
    """One record in full, from the columns of SCHEMA (all but record_type may be null)."""
    payload = row.get("payload") or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] != "revisit" else b"")
    head = [VERSION]
    fields = {h: row.get(c) for c, h in HEADER_COLUMNS.items()}
    known = {h.lower() for h, v in fields.items() if v is not None} | {"content-length"}
    for name, value in dict(row.get("headers") or ()).items():
        if name.lower() not in known:  # columns go before the map, whatever case its names have
            fields[next((h for h in fields if h.lower() == name.lower()), name)] = value
    fields["Content-Type"] = fields["Content-Type"] or "application/http;msgtype=response"
    fields["WARC-Date"] = fields["WARC-Date"] or "1970-01-01T00:00:00Z"
    if row["record_type"] == "revisit":
        fields["WARC-Profile"] = IDENTICAL
    head += [f"{k}: {_clean(str(v))}".encode() for k, v in fields.items() if v is not None]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length in an extra field."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    extra = 4 + 8
    total = 10 + 2 + extra + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", extra) + SUBFIELD + struct.pack("<HQ", 8, total) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Files get their names on commit; an attempt that raises deletes its own.  What a lost executor leaves begins with "_", which readers skip."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in batches:
                columns = [c for c in batch.schema.names]
                for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    member = gzip_member(build_record(dict(zip(columns, row, strict=True))))
                    if out is None or size + len(member) > FILE_BYTES:
                        if out:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/_{names[-1]}", compression=None), 0
                    out.write(member)
                    size += len(member)
        except BaseException:
            if out:
                out.close()
            for name in names:
                if fs.get_file_info(f"{root}/_{name}").is_file:
                    fs.delete_file(f"{root}/_{name}")
            raise
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages):
        fs, root = _filesystem(self.path)
        if self.overwrite:
            for x in _list(self.path):
                fs.delete_file(x)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages):
        fs, root = _filesystem(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(f"{root}/_{name}")


def _list(path: str) -> list[str]:
    from pyarrow import fs as pafs

    fs, root = _filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path) and not re.search(r"/[_.][^/]*$", f.path))


def parse_headers(head: bytes) -> dict[str, str]:
    """Headers by lower-case name, as names are the same in any case; values of a repeated one are joined by a comma."""
    pairs: list[list[str]] = []
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and pairs:  # a continued value
            pairs[-1][1] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            k, v = line.split(b":", 1)
            pairs.append([k.strip().decode("utf-8", "replace").lower(), v.strip().decode("utf-8", "replace")])
    out: dict[str, str] = {}
    for name, value in pairs:
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _payload(block: bytes, headers: dict[str, str]) -> bytes:
    if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class _Stream:
    """Bytes of a plain or foreign compressed file, in order."""

    def __init__(self, raw, packed: bool):
        self.raw, self.packed, self.have = raw, packed, b""
        self.inflate = zlib.decompressobj(31) if packed else None

    def more(self) -> bool:
        if self.packed:
            data = self.inflate.unused_data or self.raw.read(1 << 20)
            if not data:
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.have += self.inflate.decompress(data)
            return True
        data = self.raw.read(1 << 20)
        self.have += data
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.have.find(mark)) < 0:
            if not self.more():
                return None
        out, self.have = self.have[:at], self.have[at + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        parts, left = [], n
        while True:
            got, self.have = self.have[:left], self.have[left:]
            left -= len(got)
            if keep:
                parts.append(got)
            if not left or not self.more():
                return b"".join(parts)


def records(fs, path: str, wanted, payload: bool):
    """(headers, payload or None) of the records whose headers ``wanted`` accepts."""
    with fs.open_input_file(path) as f:
        start = f.read(16)
        f.seek(0)
        if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == SUBFIELD:
            size, at = f.size(), 0
            while at < size:
                f.seek(at)
                chunk = f.read(4096)
                (total,) = struct.unpack_from("<Q", chunk, 16)
                inflate = zlib.decompressobj(-15)
                head, fed = b"", chunk[24:]
                while (end := head.find(b"\r\n\r\n")) < 0:
                    piece = inflate.decompress(fed, 2048)
                    fed = inflate.unconsumed_tail or f.read(4096)
                    if not piece and (inflate.eof or not fed):
                        raise ValueError(f"{path}: no end of headers at {at}")
                    head += piece
                headers = parse_headers(head[:end])
                if wanted(headers):
                    body = None
                    if payload:
                        rest = fed + f.read(max(0, at + total - f.tell()))
                        block = head[end + 4 :] + inflate.decompress(rest)
                        body = _payload(block[: int(headers["content-length"])], headers)
                    yield headers, body
                at += total
            return
        s = _Stream(f, start[:2] == b"\x1f\x8b")
        while (head := s.until(b"\r\n\r\n")) is not None:
            headers = parse_headers(head.lstrip(b"\r\n"))
            if not headers:
                continue
            take = wanted(headers)
            block = s.take(int(headers.get("content-length", 0)), take and payload)
            s.until(b"\r\n\r\n")
            if take:
                yield headers, _payload(block, headers) if payload else None


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = _FIELDS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self):
        fs, _ = _filesystem(self.path)
        groups, size = [[]], 0
        for x in fs.get_file_info(_list(self.path)):
            if groups[-1] and size + x.size > FILE_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [_Files(g) for g in groups]

    def read(self, partition):
        fs, _ = _filesystem(self.path)

        def wanted(h):
            return all(v is not None and (v in x if how == "in" else v.startswith(x)) for v, how, x in ((h.get(n), how, x) for n, how, x in self.tests))

        rows, size = [], 0
        for path in partition.paths:
            for h, body in records(fs, path, wanted, self.payload):
                rows.append([h.get(n) for n in _FIELDS.values()] + [int(h.get("content-length", 0)), list(h.items()), body])
                size += 512 + len(body or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder or file)`` and ``df.write.format("warc").save(folder)``.

    The keys of ``headers`` are in lower case.  Option ``payload=false`` leaves every payload null and inflates none.
    Equality, IN and prefix predicates on the header columns are pushed down.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Payloads below this many bytes are never replaced by a revisit.
LEAST_REVISIT = 100
#: Rows of repeated digests up to which they are broadcast (about 100 bytes each).
BROADCAST_ROWS = 50_000


def with_roles(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``pages`` (page_id, url, html) to WARC rows; equal payloads of 100 bytes or more become revisits."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.length("payload").cast("long")})
    first = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = scratch.keep(first, "repeated")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = rows.join(first, "digest", "left")
    repeat = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    headers = F.map_filter(
        F.create_map(
            F.lit("X-Page-Id"), F.col("page_id").cast("string"),
            F.lit("X-Payload-Length"), F.col("bytes").cast("string"),
            F.lit("X-Refers-To-Page-Id"), F.when(repeat, F.col("first").cast("string")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select(
        F.when(repeat, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(repeat, record_id(F.col("first"))).alias("refers_to"),
        headers.alias("headers"),
        F.when(~repeat, F.col("payload")).alias("payload"),
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write a record per page and read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to; for
    a response the first two come from the payload that was read.  Null html is
    an empty payload, a null url gives no target header, and a page without an
    id is a response.  Rows that repeat a page_id are written once each.  A
    payload of any length is one record.  Other columns are ignored.  An empty
    table gives no rows.
    """
    register(spark)
    scratch = Scratch(spark, "warc")
    where = scratch.path("archive")
    with_roles(pages, scratch).write.format("warc").mode("append").save(where)
    back = spark.read.format("warc").load(where)
    revisit = F.col("record_type") == "revisit"
    return back.select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"),
        F.when(revisit, F.col("headers")["x-payload-length"].cast("long")).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.col("headers")["x-refers-to-page-id"].cast("long").alias("refers_to"),
    )
