"""Where reads are cut: complete reads, chimeras, and the largest covered range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import intervals as I  # noqa: E741
from helixframe.operators.overlaps import longer_first

END = 20


def complete_reads(overlaps: DataFrame, min_identity: float = 90.0, end: int = END) -> DataFrame:
    """b reads that some good alignment spans to within ``end`` of both ends: read_id, size."""
    span = (F.col("b_start") <= end) & (F.col("b_len") - F.col("b_end") <= end)
    return overlaps.where((F.col("identity") >= min_identity) & span).groupBy(F.col("b_id").alias("read_id")).agg(F.max("b_len").alias("size"))


def chimeric_reads(overlaps: DataFrame, min_identity: float = 90.0) -> DataFrame:
    """b reads on which two or more a reads map once on each strand as a chimera would: read_id, left, right.

    Of each a read the best row of both strands is looked at.  It is a chimera
    where both rows share 90 % of a, and either b is covered without much
    overlap, or a is whole and the two places on b lie within 1000 bases.
    """
    good = overlaps.where(F.col("identity") >= min_identity)
    w = Window.partitionBy("b_id", "a_id", "a_strand").orderBy(*longer_first())
    top = good.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    side = lambda s, p: top.where(F.col("a_strand") == s).select("b_id", "a_id", *[F.col(c).alias(f"{p}_{c}") for c in ("a_start", "a_end", "b_start", "b_end")], *([F.col("a_len"), F.col("b_len")] if s == 0 else []))
    r = side(0, "f").join(side(1, "r"), ["b_id", "a_id"])
    first = lambda q: (F.col(f"f_{q}_start") < F.col(f"r_{q}_start"))
    at = lambda q, e, left: F.when(first(q) == F.lit(left), F.col(f"f_{q}_{e}")).otherwise(F.col(f"r_{q}_{e}"))
    for q in "ab":
        for n, left in (("l", True), ("r", False)):
            for e in ("start", "end"):
                r = r.withColumn(f"{n}_{q}_{e}", at(q, e, left))
    ov1, ov2 = F.col("l_a_end") - F.col("l_a_start"), F.col("r_a_end") - F.col("r_a_start")
    share = F.greatest(F.col("l_a_end") - F.col("r_a_start"), F.lit(0))
    alike = (F.least(ov1, ov2) >= F.greatest(ov1, ov2) * 0.9) & (share >= ov1 * 0.9) & (share >= ov2 * 0.9)
    t1, t2 = F.col("l_b_end") - F.col("l_b_start"), F.col("r_b_end") - F.col("r_b_start")
    between = F.col("r_b_start") - F.col("l_b_end")  # below zero: they overlap
    covered = F.col("r_b_end") - F.col("l_b_start") - F.greatest(between, F.lit(0))
    one = (covered >= F.col("b_len") * 0.9) & ((between >= 0) | ((-between < t1 * 0.4) & (-between < t2 * 0.4)))
    two = (ov1 >= F.col("a_len") * 0.9) & (ov2 >= F.col("a_len") * 0.9) & (F.abs(between) <= 1000)
    hit = r.where(alike & (one | two))
    many = hit.groupBy("b_id").agg(F.count("*").alias("__n")).where("__n > 1").select("b_id")
    ends = hit.join(many, "b_id").select("b_id", "a_id", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("f_b_start").alias("lo"), F.col("f_b_end").alias("hi")), F.struct(F.lit(1).alias("s"), F.col("r_b_start").alias("lo"), F.col("r_b_end").alias("hi")))).alias("e")).select("b_id", "a_id", "e.*")
    best = F.row_number().over(Window.partitionBy("b_id").orderBy((F.col("lo") - F.col("hi")).asc(), "a_id", "s"))
    return ends.withColumn("__r", best).where("__r = 1 and hi > lo").select(F.col("b_id").alias("read_id"), F.col("lo").alias("left"), F.col("hi").alias("right"))


def trim_decision(overlaps: DataFrame, min_identity: float = 90.0, min_overlap: int = 1, min_coverage: int = 1, min_size: int = 1000) -> DataFrame:
    """By b read: left, right, size and how it was decided: complete, chimeric or covered; ranges below ``min_size`` are left out."""
    spans = overlaps.select(F.col("b_id").alias("read_id"), F.col("b_start").alias("lo"), F.col("b_end").alias("hi"))
    size = overlaps.groupBy(F.col("b_id").alias("read_id")).agg(F.max("b_len").alias("size"))
    whole = complete_reads(overlaps, min_identity).select("read_id", F.lit(True).alias("__whole"))
    chim = chimeric_reads(overlaps, min_identity).select("read_id", F.col("left").alias("__cl"), F.col("right").alias("__cr"))
    cover = I.largest_cover_range(spans, "read_id", min_overlap, min_coverage)
    rows = size.join(whole, "read_id", "left").join(chim, "read_id", "left").join(cover, "read_id", "left")
    left = F.when(F.col("__whole"), 0).when(F.col("__cl").isNotNull(), F.col("__cl")).otherwise(F.col("left"))
    right = F.when(F.col("__whole"), F.col("size")).when(F.col("__cl").isNotNull(), F.col("__cr")).otherwise(F.col("right"))
    how = F.when(F.col("__whole"), "complete").when(F.col("__cl").isNotNull(), "chimeric").otherwise("covered")
    return rows.select("read_id", left.cast("long").alias("left"), right.cast("long").alias("right"), "size", how.alias("how")).where(F.col("right") - F.col("left") >= min_size)


def split_reads(reads: DataFrame, ranges: DataFrame, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(complete, trimmed) reads: those whose range reaches both ends, and the others cut to theirs."""
    rows = reads.join(ranges.select("read_id", "left", "right", "size"), "read_id")
    full = (F.col("left") <= end) & (F.col("size") - F.col("right") <= end)
    cut = F.substring("seq", F.col("left").cast("int") + 1, (F.col("right") - F.col("left")).cast("int"))
    return rows.where(full).select(*reads.columns), rows.where(~full).withColumn("seq", cut).select(*reads.columns)
