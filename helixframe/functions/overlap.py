"""Column expressions over overlap rows (see ``schema.OVERLAP_COLUMNS``).

All are plain Catalyst expressions, so filters on them stay in the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_strand() -> Column:
    return F.col("a_strand") == F.col("b_strand")


def aligned_length() -> Column:
    """Mean of both spans, an integer."""
    return F.expr("(a_end - a_start + b_end - b_start) div 2")


def _hangs() -> tuple[Column, Column, Column, Column]:
    return F.col("a_start"), F.col("a_len") - F.col("a_end"), F.col("b_start"), F.col("b_len") - F.col("b_end")


def location(tolerance=0) -> Column:
    """How read a lies against read b, with ends compared up to ``tolerance``.

    A dovetail needs one outer end of each read to be free; which ends depends
    on the relative strand.  Whole-read cases need both ends of one read.
    """
    t = F.lit(tolerance)
    a0, a1, b0, b1 = _hangs()
    # ends that are met, that leave bases over, or at least don't reach past the read
    met = {k: (v >= -t) & (v <= t) for k, v in (("a0", a0), ("a1", a1), ("b0", b0), ("b1", b1))}
    free = {k: v > t for k, v in (("a0", a0), ("a1", a1), ("b0", b0), ("b1", b1))}
    within = {r: (x >= -t) & (y >= -t) for r, x, y in (("a", a0, a1), ("b", b0, b1))}
    a_whole, b_whole = met["a0"] & met["a1"], met["b0"] & met["b1"]
    a_head, a_tail = met["a0"] & free["a1"], free["a0"] & met["a1"]  # which part of the read is aligned
    b_head, b_tail = met["b0"] & free["b1"], free["b0"] & met["b1"]
    same = same_strand()
    return (
        F.when(b_head & F.when(same, a_tail).otherwise(a_head), "Left")
        .when(b_tail & F.when(same, a_head).otherwise(a_tail), "Right")
        .when(a_whole & b_whole, "Equal")
        .when(b_whole & within["a"], "Containing")
        .when(a_whole & within["b"], "Contained")
        .otherwise("Abnormal")
    )


def location_from(read: Column, tolerance=0) -> Column:
    """The location as ``read`` sees it: as it is for a, mirrored for b."""
    loc = location(tolerance)
    mirrored = (
        F.when(loc == "Containing", "Contained")
        .when(loc == "Contained", "Containing")
        .when((loc == "Left") & same_strand(), "Right")
        .when((loc == "Right") & same_strand(), "Left")
        .otherwise(loc)
    )
    return F.when(read == F.col("a_id"), loc).otherwise(mirrored)


def _shapes() -> list[tuple[Column, Column, Column, int, int]]:
    """(size, a's hang, b's hang, a's end mask, b's end mask) of the four ways two reads can overlap, in order of preference."""
    a0, a1, b0, b1 = _hangs()
    same = same_strand()
    first_b, second_b = F.when(same, b1).otherwise(b0), F.when(same, b0).otherwise(b1)
    none = F.lit(-1)
    return [
        (F.greatest(a0, first_b), a0, first_b, F.lit(1), F.when(same, 2).otherwise(1)),
        (F.greatest(a1, second_b), a1, second_b, F.lit(2), F.when(same, 1).otherwise(2)),
        (F.greatest(a0, a1), F.greatest(a0, a1), none, F.lit(3), F.lit(0)),
        (F.greatest(b0, b1), none, F.greatest(b0, b1), F.lit(0), F.lit(3)),
    ]


def _of_least(column: int) -> Column:
    shapes = _shapes()
    least = F.least(*[s[0] for s in shapes])
    out = F.when(shapes[0][0] == least, shapes[0][column])
    for s in shapes[1:]:
        out = out.when(s[0] == least, s[column])
    return out


def overhangs() -> tuple[Column, Column]:
    """Overhang of a and of b under the shape that leaves least unaligned; -1 where the shape has none."""
    return _of_least(1).cast("long"), _of_least(2).cast("long")


def overhang_masks() -> tuple[Column, Column]:
    """Which ends the least shape calls overhanging: 1 start, 2 end, 3 both, 0 none."""
    return _of_least(3).cast("int"), _of_least(4).cast("int")


def overhangs_at(tolerance=0) -> tuple[Column, Column]:
    """Overhangs that the location at ``tolerance`` implies; -1 where it has none."""
    a0, a1, b0, b1 = _hangs()
    loc, same = location(tolerance), same_strand()
    a = F.when(loc == "Left", F.when(same, a1).otherwise(a0)).when(loc == "Right", F.when(same, a0).otherwise(a1)).when(loc.isin("Contained", "Equal"), F.greatest(a0, a1)).otherwise(-1)
    b = F.when(loc == "Left", b0).when(loc == "Right", b1).when(loc.isin("Containing", "Equal"), F.greatest(b0, b1)).otherwise(-1)
    return a.cast("long"), b.cast("long")


def map_position(position: Column, source: str, target: str) -> Column:
    """A position on read ``source`` ("a" or "b") as one on ``target``: scaled inside the alignment, shifted outside."""
    s0, s1, t0, t1 = F.col(f"{source}_start"), F.col(f"{source}_end"), F.col(f"{target}_start"), F.col(f"{target}_end")
    into = lambda n: F.call_function("div", n * (t1 - t0), s1 - s0)
    forward = F.when(position < s0, t0 + (position - s0)).when(position < s1, t0 + into(position - s0)).otherwise(t1 + (position - s1))
    backward = F.when(position > s1, t0 - (position - s1)).when(position > s0, t0 - into(position - s1)).otherwise(t1 - (position - s0))
    return F.when(same_strand(), forward).otherwise(backward)


def record_type(boundary=0) -> Column:
    """Contained, Contains, Overlap or None by unmapped ends, without regard to strand."""
    a0, a1, b0, b1 = (h <= boundary for h in _hangs())
    return F.when(a0 & a1, "Contained").when(b0 & b1, "Contains").when((a1 & b0) | (b1 & a0), "Overlap").otherwise("None")


def is_good(hang=200) -> Column:
    return record_type(hang) != "None"


def covers_fully(least_span, tail) -> Column:
    """Containment, or a dovetail whose span on a is long enough; a free inner end rules the overlap out at once."""
    a0, a1, b0, b1 = (h <= tail for h in _hangs())
    long_ = F.col("a_end") - F.col("a_start") >= least_span
    return (
        F.when((a0 & a1) | (b0 & b1), True)
        .when(a1 & ~b0, False)
        .when(a1 & long_, True)
        .when(b1 & ~a0, False)
        .when(b1 & long_, True)
        .otherwise(False)
    )


def is_qualified(least_span=2000, tail=20) -> Column:
    """Containment, or a dovetail whose outer ends meet and whose span on a is long enough; coordinates are taken on the forward strand."""
    own = lambda r, e: F.when(F.col(f"{r}_strand") == 1, F.col(f"{r}_len") - F.col(f"{r}_{'end' if e == 'start' else 'start'}")).otherwise(F.col(f"{r}_{e}"))
    a0, a1, b0, b1 = own("a", "start"), F.col("a_len") - own("a", "end"), own("b", "start"), F.col("b_len") - own("b", "end")
    long_ = F.col("a_end") - F.col("a_start") >= least_span
    ends = lambda tail_, head: (tail_ <= tail) & (head <= tail) & long_
    clash = ((a1 <= tail) & (b0 > tail)) | ((b1 <= tail) & (a0 > tail) & ~ends(a1, b0))
    return ((a0 <= tail) & (a1 <= tail)) | ((b0 <= tail) & (b1 <= tail)) | (~clash & (ends(a1, b0) | ends(b1, a0)))


def maps_enough(least_span, ratio) -> Column:
    a, b = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
    return (a >= least_span) | (b >= least_span) | (a >= F.col("a_len") * ratio) | (b >= F.col("b_len") * ratio)


def ends_agree(tolerance) -> Column:
    """Whether the alignment reaches an end of either read on both sides (CheckEnd)."""
    a0, a1, b0, b1 = _hangs()
    flip = lambda strand, x, y: F.when(F.col(strand) == 0, x).otherwise(y)
    head_free = (flip("a_strand", a0, a1) > tolerance) & (flip("b_strand", b0, b1) > tolerance)
    tail_free = (flip("a_strand", a1, a0) > tolerance) & (flip("b_strand", b1, b0) > tolerance)
    return ~(head_free | tail_free)


def consensus_weight() -> Column:
    """Weight of an alignment in a consensus, from its identity."""
    e = (F.lit(100.0) - F.col("identity")) / 200.0
    return (1.0 - e) * (1.0 - e) + e * e / 3.0
