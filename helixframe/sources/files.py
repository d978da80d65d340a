"""Files as byte ranges: planning on the driver through Spark's file systems, reading in tasks through pyarrow."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession

#: Bytes that are read at once.
CHUNK = 1 << 20
#: Magic, method and flags of a gzip member with an extra field, and the mark of block-gzip in that field.
_MEMBER, _BLOCK = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


class File(NamedTuple):
    path: str
    size: int


def list_files(spark: SparkSession, paths: list[str]) -> list[File]:
    """Files that paths, folders and patterns name, in order of their paths; hidden ones and markers are left out."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        found = fs.globStatus(path)
        if not found:
            raise FileNotFoundError(p)
        own = []
        for status in found:
            inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            own += [File(s.getPath().toString(), s.getLen()) for s in inner if not s.isDirectory() and s.getPath().getName()[0] not in "._"]
        out += sorted(own)
    return out


def opened(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return where.open_input_file(name)


def ranges(files: list[File], most: int) -> list[tuple[int, str, int, int]]:
    """(number, path, from, to) of ranges of about ``most`` bytes; a file without bytes has none."""
    out = []
    for f in files:
        n = max(1, -(-f.size // most))
        out += [(f.path, f.size * k // n, f.size * (k + 1) // n) for k in range(n) if f.size]
    return [(k, *r) for k, r in enumerate(out)]


def block_size(head: bytes) -> int:
    """Compressed bytes of the gzip block that begins here; 0 where none does."""
    if len(head) >= 18 and head[:4] == _MEMBER and head[12:16] == _BLOCK:
        return int.from_bytes(head[16:18], "little") + 1
    return 0


class Owned:
    """The bytes of a file from a range on.  ``size`` says how many of them the range owns, once that is known."""

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high
        self.size: int | None = None

    def chunks(self) -> Iterator[bytes]:
        with opened(self.path) as f:
            head = f.read(18)
            if head[:2] != b"\x1f\x8b":
                self.size = self.high - self.low
                f.seek(self.low)
                while data := f.read(CHUNK):
                    yield data
            elif block_size(head):
                yield from self._blocks(f)
            elif self.low == 0:
                # other gzip files don't split: their first range has them whole
                self.size = 1 << 62
                f.seek(0)
                yield from _inflated(f)

    def _blocks(self, f) -> Iterator[bytes]:
        at, end = self._first_block(f, self.low), f.size()
        done = 0
        while at < end:
            if at >= self.high and self.size is None:
                self.size = done
            f.seek(at)
            n = block_size(head := f.read(18))
            if not n:
                raise ValueError(f"{self.path}: no gzip block at {at}")
            data = zlib.decompress(head + f.read(n - 18), 31)
            done += len(data)
            yield data
            at += n
        if self.size is None:
            self.size = done

    @staticmethod
    def _first_block(f, low: int) -> int:
        """Where the first block at or behind ``low`` begins: a header that others follow."""
        f.seek(low)
        window = f.read(1 << 17)
        at = -1
        while (at := window.find(_MEMBER, at + 1)) >= 0:
            here, hops = at, 0
            while here + 18 <= len(window) and (n := block_size(window[here : here + 18])) and hops < 3:
                here, hops = here + n, hops + 1
            if hops == 3 or (hops and (here + 18 > len(window) or low + here == f.size())):
                return low + at
        return f.size()


def _inflated(f) -> Iterator[bytes]:
    inflate, rest = zlib.decompressobj(31), b""
    while data := rest or f.read(CHUNK):
        out = inflate.decompress(data)
        rest = inflate.unused_data
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        if out:
            yield out


def lines(source: Owned) -> Iterator[tuple[int, bytes]]:
    """(place from the range's begin, line without its end) of whole lines; the first may be the rest of one."""
    at, rest = 0, b""
    for data in source.chunks():
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for line in parts:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest
