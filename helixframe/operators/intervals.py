"""Sweeps and joins over half-open intervals.

A sweep has two levels.  Positions are cut into bins of ``WIDTH``; each bin is
summed up by a row, a window over these few rows gives what stands before a
bin, and windows over (key, bin) do the rest.  So a long sequence is the work
of many tasks, and no window holds all events of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bin of a sweep.
WIDTH = 1 << 16
#: Intervals of one side that a bucket of a join holds before it is salted.
HOT = 20_000


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def scanned(rows: DataFrame, key: str | list[str], at: str, value: Column, out: str, how: str = "sum", inclusive: bool = True, width: int = WIDTH) -> DataFrame:
    """Adds ``out``: the sum (or max) of ``value`` over the key's rows up to this one in the order of ``at``; null where no row counts.

    ``at`` is unique within a key.  Sums start at 0 only where a row counts.
    """
    keys, f = _keys(key), {"sum": F.sum, "max": F.max}[how]
    binned = rows.withColumns({"__value": value, "__bin": F.floor(F.col(at) / width)})
    totals = binned.groupBy(*keys, "__bin").agg(f("__value").alias("__total"))
    before = totals.select(*keys, "__bin", f("__total").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    last = Window.currentRow if inclusive else -1
    within = f("__value").over(Window.partitionBy(*keys, "__bin").orderBy(at).rowsBetween(Window.unboundedPreceding, last))
    joined = binned.withColumn("__within", within).join(before, [*keys, "__bin"])
    both = F.greatest("__before", "__within") if how == "max" else F.when(F.coalesce("__before", "__within").isNotNull(), F.coalesce("__before", F.lit(0)) + F.coalesce("__within", F.lit(0)))
    return joined.withColumn(out, both).drop("__value", "__bin", "__within", "__before")


def following(rows: DataFrame, key: str | list[str], at: str, out: str, width: int = WIDTH) -> DataFrame:
    """Adds ``out``: the next larger ``at`` of the key (unique within it), null after the last."""
    keys = _keys(key)
    binned = rows.withColumn("__bin", F.floor(F.col(at) / width))
    firsts = binned.groupBy(*keys, "__bin").agg(F.min(at).alias("__first"))
    later = firsts.select(*keys, "__bin", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__bin")).alias("__later"))
    within = F.lead(at).over(Window.partitionBy(*keys, "__bin").orderBy(at))
    return binned.withColumn("__within", within).join(later, [*keys, "__bin"]).withColumn(out, F.coalesce("__within", "__later")).drop("__bin", "__within", "__later")


def as_of(left: DataFrame, right: DataFrame, at: str, bins: int = 10_000) -> DataFrame:
    """``left`` with the columns of the last ``right`` row whose ``at`` is not larger; null before the first.

    ``right`` is unique in ``at``.  Both sides are cut into ``bins`` ranges; what
    stands before a range comes from a row a range.
    """
    found = right.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    low, width = found["a"] or 0, max(1, ((found["b"] or 0) - (found["a"] or 0)) // bins)
    bin_ = F.floor((F.greatest(F.least(F.col(at), F.lit((found["b"] or 0) + 1)), F.lit(low - 1)) - low) / width)
    r = right.select(bin_.alias("__bin"), F.col(at).alias("__at"), F.struct(at, *[c for c in right.columns if c != at]).alias("__row"))
    lasts = r.groupBy("__bin").agg(F.max("__row").alias("__row"))
    l = left.select(bin_.alias("__bin"), F.col(at).alias("__at"), F.struct(*left.columns).alias("__left"))  # noqa: E741
    every = lasts.unionByName(l.select("__bin").distinct(), allowMissingColumns=True).groupBy("__bin").agg(F.max("__row").alias("__row"))
    before = every.select("__bin", F.last("__row", True).over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    order = Window.partitionBy("__bin").orderBy("__at", F.col("__left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = r.unionByName(l, allowMissingColumns=True).withColumn("__row", F.last("__row", True).over(order)).where("__left is not null")
    got = F.coalesce("__row", "__before")
    return rows.join(before, "__bin").select("__left.*", *[got[c].alias(c) for c in right.columns if c != at])


def _steps(intervals: DataFrame, keys: list[str], lo: Column, hi: Column, *more: Column) -> DataFrame:
    """Changes of depth, one row a position: keys, pos, step."""
    ends = [F.struct(lo.alias("pos"), F.lit(1).alias("step")), F.struct(hi.alias("pos"), F.lit(-1).alias("step")), *more]
    return intervals.select(*keys, F.explode(F.array(*ends)).alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.step").alias("step"))


def coverage(intervals: DataFrame, key: str, length: str, pad: int = 0, width: int = WIDTH) -> DataFrame:
    """By ``key``: least and largest number of intervals (lo, hi) over positions 0..length-1.

    Intervals grow by ``pad`` on both sides within the read.  Events at one
    position are summed before the sweep, so a deep stack is one row.
    """
    lo, hi = F.greatest(F.col("lo") - pad, F.lit(0)), F.least(F.col("hi") + pad, F.col(length))
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("step"))
    depth = scanned(_steps(intervals, [key, length], lo, hi, zero), [key, length], "pos", F.col("step"), "depth", width=width)
    return depth.where(F.col("pos") < F.col(length)).groupBy(key).agg(F.min("depth").alias("min_coverage"), F.max("depth").alias("max_coverage"))


def depth_intervals(intervals: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Maximal ranges of constant depth above zero: key, lo, hi, depth."""
    steps = _steps(intervals, [key], F.col("lo"), F.col("hi")).where("step <> 0")
    rows = following(scanned(steps, key, "pos", F.col("step"), "depth", width=width), key, "pos", "hi", width)
    return rows.where("depth > 0").select(key, F.col("pos").alias("lo"), "hi", "depth")


def merge_intervals(intervals: DataFrame, key: str, min_overlap: int = 0, width: int = WIDTH) -> DataFrame:
    """Intervals joined where the next lies within, or overlaps by ``min_overlap`` or more: key, lo, hi, n."""
    # those that begin together are one island, whatever their order: the longest says whether it is a new one
    rows = intervals.groupBy(key, "lo").agg(F.max("hi").alias("hi"), F.count("*").alias("n"))
    rows = scanned(rows, key, "lo", F.col("hi"), "__reach", "max", False, width)
    joins = (F.col("hi") <= F.col("__reach")) | (F.col("__reach") - min_overlap >= F.col("lo"))
    rows = scanned(rows, key, "lo", F.when(F.col("__reach").isNull() | ~joins, 1).otherwise(0), "__island", width=width)
    return rows.groupBy(key, "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("__island")


def deep_ranges(intervals: DataFrame, key: str, least: int, width: int = WIDTH) -> DataFrame:
    """Maximal ranges with depth ``least`` or more (1 at least): key, lo, hi."""
    steps = _steps(intervals, [key], F.col("lo"), F.col("hi")).where("step <> 0")
    rows = scanned(steps, key, "pos", F.col("step"), "depth", width=width)
    deep, was = F.col("depth") >= least, F.col("depth") - F.col("step") >= least
    # crossings alternate, so the next one after a beginning is its end
    crossings = following(rows.where(deep != was), key, "pos", "hi", width)
    return crossings.where(deep).select(key, F.col("pos").alias("lo"), "hi")


def _levels(rows: DataFrame) -> DataFrame:
    """Adds ``__level``: buckets of 4 ** level positions are no shorter than the interval."""
    size = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double")
    return rows.withColumn("__level", F.ceil(F.log2(size) / 2).cast("int"))


def _registered(rows: DataFrame, others: list[int]) -> DataFrame:
    """A row for each bucket (at most two a level) in which an interval can meet one of the ``others``' levels or of its own."""
    levels = F.array_distinct(F.concat(F.array("__level"), F.filter(F.array(*[F.lit(x) for x in others]), lambda x: x > F.col("__level"))))
    rows = rows.withColumn("__at", F.explode(levels)).withColumn("__size", F.pow(F.lit(4.0), F.col("__at")).cast("long"))
    first, last = F.floor(F.col("lo") / F.col("__size")), F.floor((F.greatest(F.col("hi"), F.col("lo") + 1) - 1) / F.col("__size"))
    return rows.withColumn("__first", first).withColumn("__bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, key: str | list[str], hot: int = HOT, least: int = 1) -> DataFrame:
    """Pairs of a left and a right interval (lo, hi) of one key that share ``least`` positions or more, each pair once.

    The right's lo and hi come as r_lo and r_hi; other columns must differ.
    An interval stands in the buckets of its own length's level, and in those of
    longer levels that the other side has, two at most each; a pair meets on the
    longer one's level, in the first bucket both share.  So disjoint intervals
    hardly meet, whatever a key holds.  Buckets of more than ``hot`` left
    intervals are salted.
    """
    keys = _keys(key)
    left = _levels(left)
    right = _levels(right.withColumnsRenamed({"lo": "r_lo", "hi": "r_hi"}).withColumns({"lo": F.col("r_lo"), "hi": F.col("r_hi")}))
    # there are some thirty levels at most
    ours, theirs = ([r[0] for r in x.select("__level").distinct().collect()] for x in (left, right))
    l, r = _registered(left, theirs), _registered(right, ours)  # noqa: E741
    place = [*keys, "__at", "__bucket"]
    crowds = l.groupBy(*place).count().where(F.col("count") > hot).select(*place, F.ceil(F.col("count") / hot).cast("int").alias("__salts"))
    l = l.join(crowds, place, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("lo", "hi"), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")  # noqa: E741
    r = r.join(crowds, place, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    r = r.select(*place, "__salt", F.col("__first").alias("__r_first"), F.col("__level").alias("__r_level"), *[c for c in r.columns if c not in (*place, "lo", "hi", "__salt", "__first", "__level", "__size")])
    shared = F.least("hi", "r_hi") - F.greatest("lo", "r_lo")
    met = l.join(r, [*place, "__salt"]).where((shared >= least) & (F.col("__at") == F.greatest("__level", "__r_level")) & (F.col("__bucket") == F.greatest("__first", "__r_first")))
    return met.drop(*[c for c in met.columns if c.startswith("__") and c not in keys])


def intersect_intervals(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Non-empty intersections of two lists of each key."""
    met = overlap_join(left.select(key, "lo", "hi"), right.select(key, "lo", "hi"), key)
    return met.select(key, F.greatest("lo", "r_lo").alias("lo"), F.least("hi", "r_hi").alias("hi"))


def largest_cover_range(intervals: DataFrame, key: str, min_overlap: int = 1, min_coverage: int = 1) -> DataFrame:
    """By key: the longest range that merged intervals share with deep ranges, the first of equals: key, left, right."""
    merged = merge_intervals(intervals, key, min_overlap).select(key, "lo", "hi")
    if min_coverage > 0:
        merged = intersect_intervals(merged, deep_ranges(intervals, key, min_coverage), key)
    best = F.row_number().over(Window.partitionBy(key).orderBy((F.col("lo") - F.col("hi")).asc(), "lo"))
    return merged.withColumn("__rank", best).where("__rank = 1").select(key, F.col("lo").alias("left"), F.col("hi").alias("right"))


def gaps(intervals: DataFrame, key: str, length: str, least: int, width: int = WIDTH) -> DataFrame:
    """What intervals (lo, hi) leave of 0..length in pieces of ``least`` or more: key, lo, hi."""
    edges = intervals.select(key, "lo", "hi").union(intervals.select(key, F.col(length).alias("lo"), F.col(length).alias("hi")).distinct())
    edges = scanned(edges.groupBy(key, "lo").agg(F.max("hi").alias("hi")), key, "lo", F.col("hi"), "__reach", "max", False, width)
    rows = edges.select(key, F.coalesce("__reach", F.lit(0)).alias("lo"), F.col("lo").alias("hi"))
    return rows.where(F.col("hi") - F.col("lo") >= F.greatest(F.lit(least), F.lit(1)))


def group_by_gap(rows: DataFrame, keys: list[str], position: str, gap: int = 1000) -> DataFrame:
    """``grp`` from 0: a new group where a position is more than ``gap`` after the one before."""
    w = Window.partitionBy(*keys).orderBy(position)
    starts = F.when(F.col(position) - F.lag(position).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("__start", starts).withColumn("grp", F.sum("__start").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__start")


def best_window(rows: DataFrame, keys: list[str], position: str, score: str, tie: str, width: int = 1000) -> DataFrame:
    """By keys: the window of ``width`` positions, ending at a row, with the largest score; the first of equals.

    A window's rows are those within the width before its end row, in
    (position, tie) order; rows at the end row's position that sort after it don't count.
    Of the rows at one position only the best prefix can win, so each position
    becomes a row; what stands before it is a difference of running sums, exact for integer scores.
    """
    within = Window.partitionBy(*keys, position).orderBy(tie).rowsBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy(*keys, position).orderBy(tie)
    parts = rows.select(*keys, position, F.col(score).alias("__v"), F.coalesce(F.sum(score).over(within), F.lit(0)).alias("__s"), F.count(score).over(within).alias("__n"), F.row_number().over(at).alias("__k"))
    places = parts.groupBy(*keys, position).agg(F.coalesce(F.sum("__v"), F.lit(0)).alias("__all"), F.count("__v").alias("__count"), F.max(F.struct(F.col("__s").alias("s"), (-F.col("__k")).alias("k"), F.col("__n").alias("n"))).alias("__own"))
    line = Window.partitionBy(*keys).orderBy(position)

    def before(c: str) -> Column:
        """The sum over positions less than this one and within the width of it; positions that are null stand alone."""
        upto = lambda w: F.coalesce(F.sum(c).over(w), F.lit(0))
        return F.when(F.col(position).isNull(), F.lit(0)).otherwise(upto(line.rowsBetween(Window.unboundedPreceding, -1)) - upto(line.rangeBetween(Window.unboundedPreceding, -width - 1)))

    out = places.withColumns({"__s": before("__all"), "__n": before("__count")})
    out = out.withColumns({"score": F.when(F.col("__n") + F.col("__count") > 0, F.col("__s") + F.col("__own.s")), "n": F.col("__n") + F.col("__own.n")})
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), position))
    return out.withColumn("__best", best).where("__best = 1").select(*keys, F.col(position).alias("end_position"), "score", "n")
