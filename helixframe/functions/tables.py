"""Table functions for SQL text, registered by ``register``.

``alignment_tags`` works on a row and is used with LATERAL; ``worst_windows``
takes a table in batches, as its rows lie: PARTITION BY isn't needed, and a call
a key costs more than its rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

_OPS = re.compile(r"(\d+)([=XID])")
#: Target bases that are looked at at once, beyond a first cigar.
BASES = 1_000_000


@udtf(returnType="t_pos long, delta int, base string, p_t_pos long, p_delta int, p_base string")
class AlignmentTags:
    """Columns of an aligned pair: position on the target, place within an insertion, base, and the same of the column before.  A null gives no row."""

    def eval(self, q_aln: str, s_aln: str, sbeg: int):
        if q_aln is None or s_aln is None or sbeg is None:
            return
        before, at, delta = (-1, 0, "-"), sbeg - 1, 0
        for q, s in zip(q_aln, s_aln, strict=False):
            at, delta = (at, delta + 1) if s == "-" else (at + 1, 0)
            yield at, delta, q, *before
            before = (at, delta, q)


def worst_window(cigar: str, width: int) -> tuple[int, int] | None:
    """(errors, start) of the first window of ``width`` target bases with the most errors; None where the target is shorter.

    A mismatch or deletion is an error at its base; an insertion adds its bases
    to the target base that follows it, and none at the target's end.
    """
    ops = [(int(n), op) for n, op in _OPS.findall(cigar or "")]
    size = sum(n for n, op in ops if op != "I")
    if size < width:
        return None
    error, at = np.zeros(size + 1, np.int64), 0
    for n, op in ops:
        if op == "I":
            error[at] += n
        else:
            error[at : at + n] += op in "XD"
            at += n
    upto = np.concatenate([[0], np.cumsum(error[:size])])
    sums = upto[width:] - upto[:-width]
    k = int(np.argmax(sums))
    return int(sums[k]), k


def _ops(cigars: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, letter) of every operation (``\\d+[=XID]``) of some cigars."""
    ends = np.frombuffer(cigars.buffers()[1], np.int64)[cigars.offset : cigars.offset + len(cigars) + 1]
    data = np.frombuffer(cigars.buffers()[2], np.uint8)[ends[0] : ends[-1]] if cigars.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    digit = (data >= 48) & (data <= 57)
    at = np.flatnonzero(np.isin(data, np.frombuffer(b"=XID", np.uint8)))
    row = np.searchsorted(ends, at, "right") - 1
    # a number begins after what is no digit, in its own row
    other = np.maximum.accumulate(np.where(digit, -1, np.arange(len(data))))
    first = np.maximum(np.where(at > 0, other[at - 1] + 1, 0), ends[row])
    at, row, first = (x[first < at] for x in (at, row, first))
    number = np.zeros(len(at), np.int64)
    for place in range(int((at - first).max(initial=0))):
        low = at - 1 - place
        number += np.where(low >= first, (data[np.maximum(low, 0)].astype(np.int64) - 48) * 10**place, 0)
    return row, number, data[at]


def _counted(row: np.ndarray, number: np.ndarray, letter: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(errors, start) by row, of rows whose ``size`` is ``width`` or more; rows lie one after the other in one array."""
    room = size + 1  # an insertion at a target's end has a place that no window reaches
    begin = np.cumsum(room) - room
    step = np.where(letter == ord("I"), 0, number)
    own = np.cumsum(step) - step
    at = begin[row] + own - (np.cumsum(size) - size)[row]
    moves = np.zeros(int(room.sum()) + 1, np.int64)
    wrong, more = np.isin(letter, np.frombuffer(b"XD", np.uint8)), letter == ord("I")
    np.add.at(moves, at[wrong], 1)
    np.add.at(moves, at[wrong] + number[wrong], -1)
    error = np.cumsum(moves)[:-1]
    np.add.at(error, at[more], number[more])
    upto = np.concatenate([[0], np.cumsum(error)])
    windows = size - width + 1
    head = np.cumsum(windows) - windows
    k = np.arange(int(windows.sum())) - np.repeat(head - begin, windows)
    sums = upto[k + width] - upto[k]
    most = np.maximum.reduceat(sums, head)
    hits = np.flatnonzero(sums == np.repeat(most, windows))
    return most, hits[np.searchsorted(hits, head)] - head


def worst_windows(cigars, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, errors, start): ``worst_window`` of many cigars at once, without those whose target is shorter."""
    if width < 1:
        raise ValueError("width must be positive")
    row, number, letter = _ops(pa.array(cigars, pa.large_string()).fill_null("") if isinstance(cigars, list) else cigars.cast(pa.large_string()).fill_null(""))
    size = np.zeros(len(cigars), np.int64)
    np.add.at(size, row, np.where(letter == ord("I"), 0, number))
    long = size >= width
    kept = np.flatnonzero(long)
    if not len(kept):
        return kept, np.zeros(0, np.int64), np.zeros(0, np.int64)
    use = long[row]
    row, number, letter, size = (np.cumsum(long) - 1)[row[use]], number[use], letter[use], size[kept]
    found = []
    # so many rows at once that their bases fit
    block = (np.cumsum(size) - size) // BASES
    for a, b in zip(cuts := np.flatnonzero(np.diff(block, prepend=-1)), [*cuts[1:], len(size)], strict=True):
        i, j = np.searchsorted(row, [a, b])
        found.append(_counted(row[i:j] - a, number[i:j], letter[i:j], size[a:b], width))
    return kept, *(np.concatenate(x) for x in zip(*found, strict=True))


@arrow_udtf(returnType="id string, errors long, start long")
class WorstWindows:
    """``worst_windows`` of the rows (id, cigar) of a table."""

    def eval(self, rows: pa.RecordBatch, width: pa.Array):
        kept, errors, starts = worst_windows(rows.column(1), width[0].as_py())
        if len(kept):
            yield pa.table({"id": rows.column(0).cast(pa.string()).take(pa.array(kept)), "errors": pa.array(errors), "start": pa.array(starts)})


def register(spark: SparkSession) -> None:
    """Make ``alignment_tags`` and ``worst_windows`` known to SQL."""
    spark.udtf.register("alignment_tags", AlignmentTags)
    spark.udtf.register("worst_windows", WorstWindows)
