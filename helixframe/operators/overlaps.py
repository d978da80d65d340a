"""Relational operators over overlap rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.overlap import aligned_length, location, overhang_masks, same_strand
from helixframe.schema import OVERLAP_COLUMNS

#: What breaks ties of aligned length, so that no ranking depends on arrival.
_TIES = ("a_id", "b_id", "b_strand", "a_start", "a_end", "b_start", "b_end", "identity", "a_strand")


def longer_first() -> list:
    return [aligned_length().desc(), *[F.col(c).asc() for c in _TIES]]


def with_location(overlaps: DataFrame, tolerance: int = 0, name: str = "loc") -> DataFrame:
    """The location as a generated column: whatever reads it several times doesn't work it out again."""
    return overlaps.select("*", F.inline(F.array(F.struct(location(tolerance).alias(name)))))


def swap_roles(overlaps: DataFrame) -> DataFrame:
    """Read a becomes b and b becomes a."""
    turned = {"a": "b", "b": "a"}
    return overlaps.select(*[F.col(f"{turned[c[0]]}{c[1:]}").alias(c) if c[:2] in ("a_", "b_") else F.col(c) for c in overlaps.columns])


def both_roles(overlaps: DataFrame, key: str = "b_id", partitions: int | None = None) -> DataFrame:
    """Each overlap under both reads, placed by the second: what a per-read operator needs."""
    rows = overlaps.unionByName(swap_roles(overlaps))
    return rows.repartition(partitions, key) if partitions else rows


def normalise_strand(overlaps: DataFrame, anchor: str = "a") -> DataFrame:
    """Mirror both reads of rows whose ``anchor`` read is reversed, so that it is forward.

    Coordinates here are on each strand's own direction: a mirrored start is
    the length less the end.
    """
    flip = F.col(f"{anchor}_strand") == 1
    new = {}
    for r in "ab":
        new[f"{r}_strand"] = F.when(flip, 1 - F.col(f"{r}_strand")).otherwise(F.col(f"{r}_strand"))
        new[f"{r}_start"] = F.when(flip, F.col(f"{r}_len") - F.col(f"{r}_end")).otherwise(F.col(f"{r}_start"))
        new[f"{r}_end"] = F.when(flip, F.col(f"{r}_len") - F.col(f"{r}_start")).otherwise(F.col(f"{r}_end"))
    return overlaps.withColumns(new)


def simple_filter(overlaps: DataFrame, min_identity=70.0, min_length=2500, max_length=2**31 - 1, min_aligned=2500, max_overhang=1000) -> DataFrame:
    keep = (F.col("identity") >= min_identity) & (F.col("a_id") != F.col("b_id"))
    keep &= F.col("a_len").between(min_length, max_length) & F.col("b_len").between(min_length, max_length)
    return overlaps.where(keep & (aligned_length() >= min_aligned) & (location(max_overhang) != "Abnormal"))


def raw_filter(overlaps: DataFrame, min_identity: float = 70.0, max_overhang: int = 1000, min_aligned: int = 2500) -> DataFrame:
    """What limits are worked out from."""
    return overlaps.where((F.col("identity") >= min_identity) & (aligned_length() >= min_aligned) & (location(max_overhang) != "Abnormal"))


def threshold_filter(overlaps: DataFrame, limits: DataFrame, both: bool = True) -> DataFrame:
    """Keep overlaps within their reads' own limits.

    ``limits``: read_id, identity_limit, left_limit, right_limit.  With ``both``
    an overlap must reach both reads' identity limits, else either one.  A read
    without limits sets none.
    """
    mask_a, mask_b = overhang_masks()
    rows = overlaps
    for r in "ab":
        own = limits.select(F.col("read_id").alias(f"{r}_id"), *[F.col(c).alias(f"{r}_{c}") for c in ("identity_limit", "left_limit", "right_limit")])
        rows = rows.join(own, f"{r}_id", "left")
    reaches = [F.coalesce(F.col("identity") >= F.col(f"{r}_identity_limit"), F.lit(True)) for r in "ab"]
    keep = (reaches[0] & reaches[1]) if both else (reaches[0] | reaches[1])
    for r, mask in (("a", mask_a), ("b", mask_b)):
        over_l = (mask.bitwiseAND(1) != 0) & (F.col(f"{r}_start") > F.col(f"{r}_left_limit"))
        over_r = (mask.bitwiseAND(2) != 0) & (F.col(f"{r}_len") - F.col(f"{r}_end") > F.col(f"{r}_right_limit"))
        keep &= ~F.coalesce(over_l | over_r, F.lit(False))
    return rows.where(keep).select(*overlaps.columns)


def snap_ends(overlaps: DataFrame, tolerance: int) -> DataFrame:
    """Move ends that lie within the tolerance of a read's end onto it.

    Where one read's end is near, its partner moves by as much; where both are
    near, both go to their ends.  Rows that already fit, or that don't fit at the
    tolerance, stay.
    """
    act = (location(0) == "Abnormal") & (location(tolerance) != "Abnormal")
    t, same = F.lit(tolerance), same_strand()
    c = {k: F.col(k) for k in OVERLAP_COLUMNS}

    def pair(a: str, b: str):
        """New values of an end of a and the end of b that it meets ("start" or "end" each)."""
        gap = lambda r, e: c[f"{r}_start"] if e == "start" else c[f"{r}_len"] - c[f"{r}_end"]
        limit = lambda r, e: F.lit(0) if e == "start" else c[f"{r}_len"]
        moved = lambda r, e, by: c[f"{r}_{e}"] - by if e == "start" else c[f"{r}_{e}"] + by
        near_a, near_b = gap("a", a) <= t, gap("b", b) <= t
        new_a = F.when(near_a, limit("a", a)).when(near_b, moved("a", a, gap("b", b))).otherwise(c[f"a_{a}"])
        new_b = F.when(near_b, limit("b", b)).when(near_a, moved("b", b, gap("a", a))).otherwise(c[f"b_{b}"])
        return new_a, new_b

    # same strand: starts meet starts; opposite strands: a's start meets b's end
    s_as, s_bs = pair("start", "start")
    s_ae, s_be = pair("end", "end")
    o_as, o_be = pair("start", "end")
    o_ae, o_bs = pair("end", "start")
    new = {"a_start": (s_as, o_as), "a_end": (s_ae, o_ae), "b_start": (s_bs, o_bs), "b_end": (s_be, o_be)}
    # one generated row: later filters on the new ends stay behind it, instead of being
    # rewritten over these expressions again and again
    ends = F.struct(*[F.when(act, F.when(same, s).otherwise(o)).otherwise(c[k]).alias(k) for k, (s, o) in new.items()])
    rest = [k for k in overlaps.columns if k not in new]
    return overlaps.select(*rest, F.inline(F.array(ends))).select(*overlaps.columns)


def dedupe_pairs(overlaps: DataFrame) -> DataFrame:
    """The longest overlap of each unordered pair of reads."""
    w = Window.partitionBy(F.least("a_id", "b_id"), F.greatest("a_id", "b_id")).orderBy(*longer_first())
    return overlaps.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def best_n_per_end(overlaps: DataFrame, n: int = 10) -> DataFrame:
    """Dovetails that are among the ``n`` longest at an end of at least one of their reads."""
    rows = with_location(overlaps, 0, "__loc").where(F.col("__loc").isin("Left", "Right"))
    keep = []
    for r in ("a_id", "b_id"):
        turned = (F.col(r) != F.col("a_id")) & same_strand()
        end = F.when(turned, F.when(F.col("__loc") == "Left", "Right").otherwise("Left")).otherwise(F.col("__loc"))
        keep.append(rows.select("*", F.col(r).alias("__read"), end.alias("__end")).drop("__loc"))
    w = Window.partitionBy("__read", "__end").orderBy(*longer_first())
    kept = keep[0].unionByName(keep[1]).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n)
    return kept.drop("__read", "__end", "__rank").distinct()


def top_by_identity(overlaps: DataFrame, n: int = 300, min_identity: float = 90.0) -> DataFrame:
    """At most ``n`` overlaps of each b read: where there are more, first those below the identity go, then the lowest."""
    w = Window.partitionBy("b_id")
    rows = overlaps.withColumn("__n", F.count("*").over(w)).where((F.col("__n") <= n) | (F.col("identity") >= min_identity))
    best = F.row_number().over(w.orderBy(F.desc("identity"), *longer_first()))
    return rows.withColumn("__rank", best).where(F.col("__rank") <= n).drop("__n", "__rank")


def top_candidates(candidates: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` best candidates of each ``key`` by score, ties by ids, directions and offsets."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "qid", "qdir", "qbeg", "sbeg", "sid")
    return candidates.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def drop_reads(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Overlaps neither of whose reads is listed in ``reads`` (read_id)."""
    ids = reads.select("read_id").distinct()
    return overlaps.join(ids.withColumnRenamed("read_id", "a_id"), "a_id", "left_anti").join(ids.withColumnRenamed("read_id", "b_id"), "b_id", "left_anti").select(*overlaps.columns)


def touching(overlaps: DataFrame, left: int, right: int) -> DataFrame:
    """Overlaps with either of two reads, and whether the other read overlaps both (``common``)."""
    other = F.when(F.col("a_id").isin(left, right), F.col("b_id")).otherwise(F.col("a_id"))
    mine = F.when(F.col("a_id").isin(left, right), F.col("a_id")).otherwise(F.col("b_id"))
    rows = overlaps.where(F.col("a_id").isin(left, right) | F.col("b_id").isin(left, right)).withColumns({"other": other, "mine": mine})
    both = rows.groupBy("other").agg(F.count_distinct("mine").alias("__n"))
    return rows.join(both, "other").withColumn("common", F.col("__n") == 2).drop("__n", "mine")


def compare_sets(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Pairs of reads of both sets: x, y, status (both, moved, left, right).

    Each side counts with its longest overlap of the pair; ``both`` needs all
    four coordinates, seen from the smaller read id, within the tolerance.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        turned = F.col("a_id") <= F.col("b_id")
        cut = lambda k: [F.when(turned, F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")), F.when(turned, F.col(f"b_{k}")).otherwise(F.col(f"a_{k}"))]
        values = [v for k in ("start", "end") for v in cut(k)]
        return dedupe_pairs(df).select(F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y"), *[v.alias(f"{s}{i}") for i, v in enumerate(values)])

    rows = side(left, "l").join(side(right, "r"), ["x", "y"], "full")
    near = F.lit(True)
    for i in range(4):
        near = near & (F.abs(F.col(f"l{i}") - F.col(f"r{i}")) <= tolerance)
    status = F.when(F.col("r0").isNull(), "left").when(F.col("l0").isNull(), "right").when(near, "both").otherwise("moved")
    return rows.select("x", "y", status.alias("status"))


def remap_ids(overlaps: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (read_id, new_id): overlaps of reads that are listed, under their new ids."""
    out = overlaps
    for r in "ab":
        own = ids.select(F.col("read_id").alias(f"{r}_id"), F.col("new_id").alias(f"__{r}"))
        out = out.join(own, f"{r}_id").withColumn(f"{r}_id", F.col(f"__{r}")).drop(f"__{r}")
    return out.select(*overlaps.columns)


def by_subject(overlaps: DataFrame, min_identity: float, partitions: int | None = None) -> DataFrame:
    """Overlaps of enough identity under both of their reads, placed by the second."""
    return both_roles(overlaps.where(F.col("identity") >= min_identity), "b_id", partitions)


def without_names(overlaps: DataFrame, names: DataFrame, reads: DataFrame) -> DataFrame:
    """Overlaps neither of whose reads (read_id, name) is named in ``names`` (name)."""
    return drop_reads(overlaps, reads.join(names.select("name").distinct(), "name", "left_semi").select("read_id"))


#: Largest score of a packed candidate.
TOP_SCORE = 1_000_000


def pack_candidates(candidates: DataFrame) -> DataFrame:
    """What a packed candidate keeps: both directions, whether its seed is its beginning, the bounded score, ids and spans, in seven numbers."""
    flags = F.col("sdir").bitwiseAND(1) * 4 + F.col("qdir").bitwiseAND(1) * 2 + (F.col("qoff") == F.col("qbeg")).cast("long")
    return candidates.select((flags * (1 << 24) + F.least("score", F.lit(TOP_SCORE))).cast("long").alias("head"), "sid", "sbeg", "send", "qid", "qbeg", "qend")


def unpack_candidates(packed: DataFrame) -> DataFrame:
    """Candidates from ``pack_candidates``; a seed that was not the beginning comes out as the end."""
    flag = lambda bit: F.shiftright("head", 24 + bit).bitwiseAND(1)
    first = flag(0) == 1
    return packed.select(
        "qid", "sid", F.col("head").bitwiseAND((1 << 24) - 1).alias("score"), flag(1).alias("qdir"), "qbeg", "qend", F.when(first, F.col("qbeg")).otherwise(F.col("qend")).alias("qoff"),
        flag(2).alias("sdir"), "sbeg", "send", F.when(first, F.col("sbeg")).otherwise(F.col("send")).alias("soff"),
    )


def worst_error_window(alignments: DataFrame, key: str = "id", width: int = 100) -> DataFrame:
    """``alignments`` (key, cigar of =XID) to the most errors in ``width`` target bases: key, errors, start.

    A mismatch or deletion is an error at its base, an insertion adds its bases to
    the target base that follows it.  The first of equal windows counts; a target
    shorter than the width has none.
    """
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)([=XID])"), 0)
    rows = alignments.select(key, F.posexplode(ops).alias("i", "op")).select(key, "i", F.expr("cast(substring(op, 1, length(op) - 1) as bigint)").alias("n"), F.expr("right(op, 1)").alias("op"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.when(F.col("op") != "I", F.col("n")).otherwise(0)).over(before), F.lit(0)))
    size = rows.where("op <> 'I'").groupBy(key).agg(F.sum("n").alias("size"))
    single = rows.where("op in ('X', 'D')").select(key, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("pos"), F.lit(1).cast("long").alias("e"))
    errors = single.union(rows.where("op = 'I'").select(key, F.col("at").alias("pos"), F.col("n").alias("e"))).join(size, key).where("pos < size and size >= %d" % width)
    errors = errors.groupBy(key, "size", "pos").agg(F.sum("e").alias("e"))
    # a window that begins at an error, or ends with the target, holds as many as any
    span = Window.partitionBy(key).orderBy("pos").rangeBetween(-(width - 1), 0)
    best = errors.select(key, "pos", F.sum("e").over(span).alias("errors"))
    w = Window.partitionBy(key).orderBy(F.desc("errors"), "pos")
    found = best.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, "errors", F.greatest(F.col("pos") - width + 1, F.lit(0)).alias("start"))
    clean = size.where(F.col("size") >= width).join(found.select(key), key, "left_anti").select(key, F.lit(0).cast("long").alias("errors"), F.lit(0).cast("long").alias("start"))
    return found.unionByName(clean)
