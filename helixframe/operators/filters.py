"""The overlap filter chain: each step states a reason, none mutates a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.overlap import same_strand
from helixframe.operators import intervals as I  # noqa: E741
from helixframe.operators import overlaps as O  # noqa: E741
from helixframe.operators import statistics as S
from helixframe.plans.store import Store


def per_read_intervals(overlaps: DataFrame) -> DataFrame:
    """Aligned ranges of both reads of each overlap: read_id, len, lo, hi."""
    pick = lambda r: overlaps.select(F.col(f"{r}_id").alias("read_id"), F.col(f"{r}_len").alias("len"), F.col(f"{r}_start").alias("lo"), F.col(f"{r}_end").alias("hi"))
    return pick("a").unionByName(pick("b"))


def read_coverage(overlaps: DataFrame, pad: int = 0) -> DataFrame:
    return I.coverage(per_read_intervals(overlaps), "read_id", "len", pad)


def contained_reads(overlaps: DataFrame) -> DataFrame:
    """read_id and the smallest id that contains it; of equal reads the larger id is contained."""
    loc = F.col("__loc")
    inner = F.when(loc == "Contained", F.col("a_id")).when(loc == "Containing", F.col("b_id")).when(loc == "Equal", F.greatest("a_id", "b_id"))
    outer = F.when(loc == "Contained", F.col("b_id")).when(loc == "Containing", F.col("a_id")).when(loc == "Equal", F.least("a_id", "b_id"))
    rows = O.with_location(overlaps, 0, "__loc").select(inner.alias("read_id"), outer.alias("container")).where(F.col("read_id").isNotNull() & (F.col("read_id") != F.col("container")))
    return rows.groupBy("read_id").agg(F.min("container").alias("container"))


def _needs(loc: Column) -> Column:
    """Array of (x is a, end, exceeding) checks that an overlap must pass, by location and strand.

    A location names the ends at which a, and at which b, must meet the other's
    neighbours; ``far`` asks for neighbours beyond the other read's long free end.
    """
    far = {(r, e): (F.col(f"{r}_start") if e == 0 else F.col(f"{r}_len") - F.col(f"{r}_end")) > 2000 for r in "ab" for e in (0, 1)}
    same = same_strand()

    def need(read: str, end: int, other_end: Column | None) -> Column:
        return F.struct(F.lit(read == "a").alias("of_a"), F.lit(end).alias("end"), (F.lit(False) if other_end is None else other_end).alias("far"))

    def across(read: str, end: int) -> Column:
        """Beyond the other read: its same end on one strand, its other end on opposite strands."""
        other = "b" if read == "a" else "a"
        return need(read, end, F.when(same, far[other, end]).otherwise(far[other, 1 - end]))

    none = F.lit(None).cast("struct<of_a:boolean,end:int,far:boolean>")
    pick = lambda *cases: F.coalesce(*[F.when(c, v) for c, v in cases], none)
    left, right, whole_b, whole_a, equal = (loc == x for x in ("Left", "Right", "Containing", "Contained", "Equal"))
    plain = (loc == "Abnormal")
    slots = [
        pick((equal | plain, need("a", 0, None)), ((right & same) | whole_a | (left & ~same), across("a", 0))),
        pick((equal | plain, need("a", 1, None)), ((left & same) | whole_a | (right & ~same), across("a", 1))),
        pick((equal, need("b", 0, None)), (left | whole_b, across("b", 0))),
        pick((equal, need("b", 1, None)), (right | whole_b, across("b", 1))),
    ]
    return F.array_compact(F.array(*slots))


def neighbours(overlaps: DataFrame, max_overhang: int) -> DataFrame:
    """Both directions of each overlap with what support needs: read, other, and whether each end qualifies, near or far."""

    def side(r: str, o: str) -> DataFrame:
        head, tail = F.col(f"{r}_start"), F.col(f"{r}_len") - F.col(f"{r}_end")
        o_head, o_tail = F.col(f"{o}_start"), F.col(f"{o}_len") - F.col(f"{o}_end")
        same = same_strand()
        return overlaps.select(
            F.col(f"{r}_id").alias("read"), F.col(f"{o}_id").alias("other"),
            (head <= max_overhang).alias("near0"), (tail <= max_overhang).alias("near1"),
            (F.when(same, o_head).otherwise(o_tail) > max_overhang).alias("far0"), (F.when(same, o_tail).otherwise(o_head) > max_overhang).alias("far1"),
        )

    return side("a", "b").unionByName(side("b", "a"))


def lacking_support(overlaps: DataFrame, least: int, max_overhang: int = 500) -> DataFrame:
    """Overlaps (one a pair) for which some end has fewer than ``least`` common neighbours that reach it.

    Of an overlap (x, y) only the read with fewer neighbours lists them, and the
    other is asked whether it has them too.  So a hub of degree d never makes
    d * d rows: with m overlaps there are some m ** 1.5 rows at most.
    """
    near = neighbours(overlaps, max_overhang)
    degree = near.groupBy("read").agg(F.count("*").alias("n"))
    placed = O.with_location(overlaps, 0, "__loc")
    rows = placed.select("a_id", "b_id", F.explode(_needs(F.col("__loc"))).alias("n")).select("a_id", "b_id", "n.*")
    rows = rows.select("a_id", "b_id", F.when(F.col("of_a"), F.col("a_id")).otherwise(F.col("b_id")).alias("x"), F.when(F.col("of_a"), F.col("b_id")).otherwise(F.col("a_id")).alias("y"), "end", "far")
    ranked = rows.join(degree.select(F.col("read").alias("x"), F.col("n").alias("nx")), "x").join(degree.select(F.col("read").alias("y"), F.col("n").alias("ny")), "y")
    own = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") <= F.col("y")))
    asked = ranked.select("a_id", "b_id", "x", "y", "end", "far", own.alias("own"), F.when(own, F.col("x")).otherwise(F.col("y")).alias("read"), F.when(own, F.col("y")).otherwise(F.col("x")).alias("hub"))
    ok = F.when(F.col("end") == 0, F.when(F.col("far"), F.col("far0")).otherwise(F.col("near0"))).otherwise(F.when(F.col("far"), F.col("far1")).otherwise(F.col("near1")))
    # what reaches the end is known where x lists: before the second join if x itself is asked, else after it
    keys = ["a_id", "b_id", "x", "end"]
    met = asked.join(near, "read").where((F.col("other") != F.col("y")) & (~F.col("own") | ok)).select(*keys, "far", "own", "hub", "other")
    met = met.join(near.withColumnRenamed("read", "hub"), ["hub", "other"]).where(F.col("own") | ok).groupBy(*keys).agg(F.count("*").alias("n"))
    checked = rows.select(*keys).join(met, keys, "left")
    return checked.where(F.coalesce("n", F.lit(0)) < F.greatest(F.lit(least), F.lit(0))).select("a_id", "b_id").distinct()


def coverage_limits(cov: DataFrame, discard: float = 0.01) -> DataFrame:
    """One row: max_coverage and max_difference that all but ``discard`` percent of reads keep."""
    top = S.percentile_of(cov, "max_coverage", 100 - discard).select(F.col("percentile").alias("most"))
    diff = S.percentile_of(cov.withColumn("d", F.col("max_coverage") - F.col("min_coverage")), "d", 100 - discard).select(F.col("percentile").alias("spread"))
    return top.crossJoin(F.broadcast(diff))


def coverage_trough(cov: DataFrame, column: str = "min_coverage") -> int:
    """Runs a job: the histogram is small (one row a coverage value) and is read on the driver."""
    bins = {int(r[0]): int(r[1]) for r in cov.groupBy(column).count().collect()}
    return S.first_trough(bins) if bins else 0


REASONS = ("Simple", "Local", "Duplicate", "FilteredRead", "LackOfSupport", "BestN")


def coverage_bounds(cov: DataFrame, discard: float, min_coverage: int | None, max_coverage: int | None, max_difference: int | None) -> tuple[int, int, int]:
    """(least, most, largest difference) of coverage that a read may have; what isn't given comes from the reads themselves."""
    found = coverage_limits(cov, discard).first()  # one row
    pick = lambda given, own: given if given is not None else int(own or 0)
    least = min_coverage if min_coverage is not None else coverage_trough(cov)
    return least, pick(max_coverage, found["most"]), pick(max_difference, found["spread"])


def badly_covered(cov: DataFrame, least: int, most: int, difference: int) -> DataFrame:
    """Reads (read_id) below the least coverage, above the most, or whose coverage differs too much."""
    return cov.where((F.col("min_coverage") < least) | (F.col("max_coverage") > most) | (F.col("max_coverage") - F.col("min_coverage") > difference)).select("read_id")


def reasons(
    spark: SparkSession, overlaps: DataFrame, min_identity: float | None = None, max_overhang: int | None = None, raw_identity: float = 70.0, raw_overhang: int = 1000,
    min_length: int = 2500, min_aligned: int = 2500, coverage: int = 40, low_coverage: int = 25, both: bool = True,
    min_coverage: int | None = None, max_coverage: int | None = None, max_difference: int | None = None, discard: float = 0.01, best_n: int = 10,
) -> DataFrame:
    """All overlaps with ``reason``: null if kept, else the first step that drops it.

    Limits that aren't given come from overlaps within the raw limits: identity
    and overhang over all reads, then for each read.  Steps: simple limits;
    limits of either read (``both``: of both); the longest of each pair; ends
    snapped; reads with too low, too high or too uneven coverage, looked at twice,
    the second time with the first time's upper bounds; support at both ends;
    reads that others contain; the best of each read end.
    """
    store = Store(spark, "filter")  # a pass between steps is written once, as several later ones read it
    raw = O.raw_filter(overlaps, raw_identity, raw_overhang, min_aligned)
    if min_identity is None or max_overhang is None:
        found = S.global_limits(S.read_info(raw)).first()  # one row
        min_identity = found["min_identity"] if min_identity is None else min_identity
        max_overhang = found["max_overhang"] if max_overhang is None else max_overhang
    limits = store.keep(S.read_limits(raw, min_identity, max_overhang, coverage, low_coverage), "limits")
    simple = store.keep(O.simple_filter(overlaps, min_identity, min_length, min_aligned=min_aligned, max_overhang=max_overhang).distinct(), "simple")
    local = store.keep(O.threshold_filter(simple, limits, both), "local")
    one = store.keep(O.dedupe_pairs(local), "one")
    left = store.keep(O.snap_ends(one, max_overhang), "snapped")
    cov = store.keep(read_coverage(left), "coverage")
    least, most, difference = coverage_bounds(cov, discard, min_coverage, max_coverage, max_difference)
    first = least
    for turn in range(2):
        if turn:
            cov = store.keep(read_coverage(left), "coverage")
            least = coverage_bounds(cov, discard, min_coverage, most, difference)[0]
        left = store.keep(O.drop_reads(left, badly_covered(cov, least, most, difference)), "covered")
    weak = lacking_support(left, max(0, first - 1), max_overhang)
    held = store.keep(left.join(weak, ["a_id", "b_id"], "left_anti").select(*overlaps.columns), "held")
    free = store.keep(O.drop_reads(held, contained_reads(held).select("read_id")), "free")
    best = store.keep(O.best_n_per_end(free, best_n), "best")
    pair, key = ["a_id", "b_id"], list(overlaps.columns)
    flag = lambda d, name: d.select(*pair).distinct().withColumn(name, F.lit(True))
    rows = overlaps
    for d, name in ((simple, "__s"), (local, "__t"), (one, "__o")):
        rows = rows.join(d.withColumn(name, F.lit(True)), key, "left")
    for d, name in ((left, "__l"), (held, "__h"), (free, "__f"), (best, "__b")):
        rows = rows.join(flag(d, name), pair, "left")
    steps = (("__s", "Simple"), ("__t", "Local"), ("__o", "Duplicate"), ("__l", "FilteredRead"), ("__h", "LackOfSupport"), ("__f", "FilteredRead"), ("__b", "BestN"))
    reason = F.coalesce(*[F.when(F.col(c).isNull(), name) for c, name in steps])
    return rows.select(*key, reason.alias("reason"))


def sole_full_mapping(overlaps: DataFrame, end: int = 100, ratio: float = 0.6, least_identity: float = 90.0, exclude: DataFrame | None = None) -> DataFrame:
    """Overlaps whose a read maps fully exactly once; b's strand is normalised to forward.

    Fully: a or b whole, or a dovetail over 60 % of either read.
    """
    rows = overlaps if exclude is None else overlaps.join(exclude.select(F.col("read_id").alias("a_id")).distinct(), "a_id", "left_anti").select(*overlaps.columns)
    own = lambda r, e: F.when(F.col(f"{r}_strand") == 1, F.col(f"{r}_len") - F.col(f"{r}_{'end' if e == 'start' else 'start'}")).otherwise(F.col(f"{r}_{e}"))
    whole = lambda r: (F.col(f"{r}_start") <= end) & (F.col(f"{r}_len") - F.col(f"{r}_end") <= end)
    a0, a1, b0, b1 = own("a", "start"), own("a", "end"), own("b", "start"), own("b", "end")
    much = (a1 - a0 >= F.col("a_len") * ratio) | (b1 - b0 >= F.col("b_len") * ratio)
    dove = ((F.col("a_len") - a1 <= end) & (b0 <= end)) | ((F.col("b_len") - b1 <= end) & (a0 <= end))
    full = rows.where(whole("a") | whole("b") | (dove & much))
    one = full.groupBy("a_id").agg(F.count("*").alias("__n")).where("__n = 1").select("a_id")
    keep = full.join(one, "a_id", "left_semi").where(F.col("identity") >= least_identity)
    flip = F.col("b_strand") == 1
    return keep.withColumns({"a_strand": F.when(flip, 1 - F.col("a_strand")).otherwise(F.col("a_strand")), "b_strand": F.lit(0).cast("long")}).select(*overlaps.columns)
