"""FASTA and FASTQ as a data source that splits.

A file is planned as byte ranges.  A task looks for the first record that
begins behind its range's first byte and reads on until one begins behind the
range, so a record belongs to the range that holds the byte before it.
Block-gzip is read from block to block in the same way.  Tests of name and
length are taken by the reader: what they rule out is never decoded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from helixframe.sources.files import Owned, lines

NAME = "helixframe_sequences"
SCHEMA = "split int, at long, name string, sub_head string, seq string, quality string, length long"
COUNTS = "split int, n long"
#: Bases of a batch of records, about.
BATCH = 4_000_000


class Range(InputPartition):
    def __init__(self, number: int, path: str, low: int, high: int):
        self.number, self.path, self.low, self.high = number, path, low, high


def fastq_records(source: Owned) -> Iterator[tuple[bytes, list[bytes], bytes]]:
    """(header, sequence lines, quality) of a range's records.  Blank lines between records don't count."""
    rows = lines(source)
    ahead: list[tuple[int, bytes]] = []
    if source.low:
        next(rows, None)
        # a header is an @ line whose next but one is a + line: after a quality that begins with @ comes a header, then bases
        ahead = [r for _, r in zip(range(3), rows, strict=False)]
        while len(ahead) == 3 and not (ahead[0][1][:1] == b"@" and ahead[2][1][:1] == b"+"):
            ahead = [*ahead[1:], *([r] if (r := next(rows, None)) else [])]
        if len(ahead) < 3:
            return

    def line():
        return ahead.pop(0) if ahead else next(rows, None)

    while (head := line()) is not None:
        if source.size is not None and head[0] > source.size:
            return
        if not head[1].strip():
            continue
        seq, plus, quality = (x[1].rstrip(b"\r") if (x := line()) else None for _ in range(3))
        name = head[1].rstrip(b"\r")
        # a last empty quality may lack its line's end
        quality = b"" if quality is None and seq == b"" and plus is not None else quality
        if name[:1] != b"@" or plus is None or plus[:1] != b"+" or quality is None or len(quality) != len(seq):
            raise ValueError(f"bad FASTQ record: {name.decode('utf-8', 'replace')}")
        yield name[1:], [seq], quality


def fasta_records(source: Owned) -> Iterator[tuple[bytes, list[bytes], None]]:
    """(header, sequence lines, None) of a range's records.  A record without header and bases doesn't count."""
    rows = lines(source)
    if source.low:
        next(rows, None)
    name, body = None, []
    for at, line in rows:
        if line[:1] == b">":
            if name is not None and (name.strip() or any(x.strip() for x in body)):
                yield name, body, None
            name, body = None, []
            if source.size is not None and at > source.size:
                return
            name = line[1:].rstrip(b"\r")
        elif name is not None:
            body.append(line)
    if name is not None and (name.strip() or any(x.strip() for x in body)):
        yield name, body, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.ranges = json.loads(options["ranges"])
        self.records = {"fasta": fasta_records, "fastq": fastq_records}[options["kind"]]
        self.counts = options.get("counts") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kind = {EqualTo: "in", EqualNullSafe: "in", In: "in", StringStartsWith: "starts", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
            value = getattr(f, "value", None)
            if kind == "in":
                value = tuple(value) if isinstance(f, In) else (value,)
            if isinstance(f, IsNotNull) and column in ("name", "length"):
                continue  # neither is ever null
            if value is None or (kind == "in" and None in value) or not ((column == "name" and kind in ("in", "starts")) or (column == "length" and kind in ("in", ">", ">=", "<", "<="))):
                yield f
            else:
                self.tests.append((column, kind, value))

    def partitions(self):
        return [Range(*r) for r in self.ranges] or [Range(0, "", 0, 0)]

    def _wanted(self, column: str, value) -> bool:
        for c, kind, x in self.tests:
            if c == column:
                ok = value in x if kind == "in" else value.startswith(x) if kind == "starts" else value > x if kind == ">" else value >= x if kind == ">=" else value < x if kind == "<" else value <= x
                if not ok:
                    return False
        return True

    def read(self, partition):
        if not partition.path:  # nothing but empty files
            return
        source = Owned(partition.path, partition.low, partition.high)
        if self.counts:
            n = sum(1 for _ in self.records(source))
            yield pa.RecordBatch.from_arrays([pa.array([partition.number], pa.int32()), pa.array([n], pa.int64())], ["split", "n"])
            return
        rows, size = [], 0
        for at, (head, body, quality) in enumerate(self.records(source)):
            parts = head.decode("utf-8", "replace").split(None, 1)
            name = parts[0] if parts and not head[:1].isspace() else ""
            if not self._wanted("name", name):
                continue
            seq = body[0] if quality is not None else b"".join(b"".join(body).split())
            if not self._wanted("length", len(seq)):
                continue
            rest = head.decode("utf-8", "replace")[len(name) :].strip()
            rows.append((partition.number, at, name, rest, seq.decode(), None if quality is None else quality.decode("latin-1"), len(seq)))
            size += len(seq) + 100
            if size >= BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


class SequenceSource(DataSource):
    """Options: kind (fasta or fastq), ranges (as ``files.ranges`` plans them, as JSON), counts."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return COUNTS if self.options.get("counts") == "true" else SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
