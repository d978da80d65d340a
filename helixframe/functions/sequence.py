"""Column expressions over base strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEGAL = "^[ACGTacgt]*$"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def fetch(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Bases start..end of the forward strand, or their reverse complement."""
    part = F.substring(seq, start + 1, end - start)
    return F.when(strand == 0, part).otherwise(reverse_complement(part))


def kmers(seq: Column, k: int, stride: int = 1) -> Column:
    """Array of k-mers at every ``stride``-th start; empty where the sequence is shorter than k."""
    last = F.length(seq) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(seq, i + 1, F.lit(k)))


# Two bits a base, of either case.
BASES = "ACGT"
_CODE = np.full(256, 4, np.uint8)
for _bits, _base in enumerate(BASES):
    _CODE[[ord(_base), ord(_base.lower())]] = _bits
#: Bases whose k-mers are worked out at once.
BLOCK = 1_000_000


def rolling_words(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k-mer that starts at each base as a number, whether all its bases are A, C, G or T), k up to 31.

    Words of 1, 2, 4, ... bases are put together, so it takes log2 k passes.
    """
    code = _CODE[data]
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    n = max(len(data) - k + 1, 0)
    word, size, out, done = (code & 3).astype(np.int64), 1, np.zeros(len(data), np.int64), 0
    while size <= k:
        if k & size:
            # the words made so far stand before this one
            ahead = np.zeros_like(word)
            ahead[: max(len(word) - done, 0)] = word[done:]
            out, done = (out << (2 * size)) | ahead, done + size
        after = np.zeros_like(word)
        after[: max(len(word) - size, 0)] = word[size:]
        word, size = (word << (2 * size)) | after, 2 * size
    return out[:n], bad[k : k + n] == bad[:n]


def packed_kmers(reads: DataFrame, k: int, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """``reads`` (read_id, seq) to read_id, pos, kmer (two bits a base): each ``stride``-th start, none that holds another letter than ACGT.

    Linear in the bases.  Null and short sequences give no row.
    """
    if not 0 < k <= 31:
        raise ValueError("k must be from 1 to 31")

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
            if not batch.num_rows:
                continue
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
            a = 0
            while a < len(column):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + block, "right")) - 1)
                # a block of several reads, or a part of a long one
                step = max(block - block % stride, stride) if b == a + 1 else 1 << 62
                for low in range(0, max(int(ends[b] - ends[a]), 1), step):
                    high = int(min(ends[b], ends[a] + low + step + k - 1))
                    word, fine = rolling_words(data[ends[a] + low : high], k)
                    size = np.diff(ends[a : b + 1]) if b > a + 1 else np.array([high - ends[a] - low])
                    n = np.maximum((size - k) // stride + 1, 0) * (size >= k)
                    row = np.repeat(np.arange(b - a), n)
                    pos = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * stride
                    at = pos + np.repeat(ends[a:b] - ends[a], n)
                    keep = np.flatnonzero(fine[at])
                    for c in range(0, len(keep), block):
                        some = keep[c : c + block]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[some] + a)), pa.array(pos[some] + low), pa.array(word[at[some]])], ["read_id", "pos", "kmer"])
                a = b

    return reads.select(F.col("read_id").cast("long"), F.col("seq").cast("string")).mapInArrow(run, "read_id long, pos long, kmer long")


def cigar_identity(cigar: Column) -> Column:
    """Percent of ``=`` or ``M`` columns in a CIGAR string; null without columns."""
    number = lambda ops: F.aggregate(F.transform(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), 1), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    every = number("MIDX=")
    return F.when(every > 0, F.lit(100.0) * number("M=") / every)
