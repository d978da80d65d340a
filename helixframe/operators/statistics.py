"""Robust weighted statistics, by group or over all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.overlap import overhang_masks, overhangs
from helixframe.plans.store import Store
from helixframe.schema import MAD_TO_SD, MEAN_DEVIATION_TO_SD


def weighted_median(rows: DataFrame, value: str, weight: str | Column, keys: list[str], out: str = "median", whole_total: bool = False) -> DataFrame:
    """By ``keys``: the first value, upwards, at which the weights reach half their sum.

    Equal values are summed first, so a group's window holds distinct values
    only.  ``whole_total`` cuts the sum to an integer after each value, as an
    integer accumulator does.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    bins = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.sum(w).alias("__w"))
    total = F.sum(F.floor("__w") if whole_total else F.col("__w")).over(Window.partitionBy(*(keys or [F.lit(0)])))
    upto = F.sum("__w").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    found = bins.select(*keys, "__v", (upto * 2 >= total).alias("__reached")).where("__reached")
    return found.groupBy(*keys).agg(F.min("__v").alias(out))


def weighted_median_all(rows: DataFrame, value: str, weight: str | Column, out: str = "median", upper: bool = False) -> DataFrame:
    """The weighted median of all rows without one task that sees all values; with ``upper`` more than half must be reached.

    Values are summed in ranges whose bounds are quantile estimates; the range
    in which the half is reached is then the only one that is looked at closely.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    bins = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.sum(w).alias("__w"))
    cuts = bins.agg(F.percentile_approx("__v", [i / 256 for i in range(1, 256)], 10000).alias("__cuts"))
    placed = bins.crossJoin(F.broadcast(cuts)).withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    ranges = placed.groupBy("__bin").agg(F.sum("__w").alias("__bw"))  # 256 rows
    before = F.coalesce(F.sum("__bw").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("__bin", "__bw", before.alias("__before"), F.sum("__bw").over(Window.partitionBy(F.lit(0))).alias("__total"))
    reached = lambda x: x * 2 > F.col("__total") if upper else x * 2 >= F.col("__total")
    hit = ranges.where(reached(F.col("__before") + F.col("__bw"))).orderBy("__bin").limit(1)
    upto = F.col("__before") + F.sum("__w").over(Window.partitionBy("__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(hit), "__bin").select("__v", reached(upto).alias("__reached")).where("__reached").agg(F.min("__v").alias(out))


def weighted_mad(rows: DataFrame, value: str, weight: str | Column, keys: list[str]) -> DataFrame:
    """By ``keys``: weighted ``median`` and the weighted median of distances from it, ``mad``."""
    middle = weighted_median(rows, value, weight, keys) if keys else weighted_median_all(rows, value, weight)
    near = rows.join(middle, keys) if keys else rows.crossJoin(F.broadcast(middle))
    near = near.withColumn("__d", F.abs(F.col(value) - F.col("median")))
    spread = weighted_median(near, "__d", weight, keys, "mad") if keys else weighted_median_all(near, "__d", weight, "mad")
    return middle.join(spread, keys) if keys else middle.crossJoin(F.broadcast(spread))


def weighted_mean_deviation(rows: DataFrame, value: str, weight: str | Column, keys: list[str]) -> DataFrame:
    """By ``keys``: weighted ``mean`` and weighted mean of distances from it, ``deviation``."""
    w = F.col(weight) if isinstance(weight, str) else weight
    mean = rows.groupBy(*keys).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("mean"))
    near = rows.join(mean, keys) if keys else rows.crossJoin(F.broadcast(mean))
    return near.groupBy(*keys, "mean").agg((F.sum(F.abs(F.col(value) - F.col("mean")) * w) / F.sum(w)).alias("deviation"))


def median_mad(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """By ``keys``: unweighted upper median and upper median of distances (no interpolation)."""
    def upper(df: DataFrame, v: str, out: str) -> DataFrame:
        bins = df.where(F.col(v).isNotNull()).groupBy(*keys, F.col(v).alias("__v")).agg(F.count("*").alias("__n"))
        by = Window.partitionBy(*keys)
        upto = F.sum("__n").over(by.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("__n").over(by)
        return bins.select(*keys, "__v", (upto > F.floor(total / 2)).alias("__r")).where("__r").groupBy(*keys).agg(F.min("__v").alias(out))

    middle = upper(rows, value, "median")
    near = rows.join(middle, keys).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    return middle.join(upper(near, "__d", "mad"), keys)


def percentile_of(rows: DataFrame, value: str, percent: float) -> DataFrame:
    """One row, ``percentile``: the least value with at least that percent of rows at or below it."""
    bins = rows.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    return bins.select("__v", (upto >= total * percent / 100.0).alias("__r")).where("__r").agg(F.min("__v").alias("percentile"))


def first_trough(counts: dict[int, int], last: int = 100, width: int = 9, tolerance: float = 0.3) -> int:
    """The value in the first valley of a histogram of small integers (``counts`` by value).

    The histogram is smoothed by sums over ``width`` bins.  The valley is the
    first place, from the first peak on and within ``last`` bins, where the sums
    stop falling; in its ``width`` bins the lowest is looked for, and of the bins
    up to ``width`` before the place the first that is higher than that by
    ``tolerance`` of it at most is returned.
    """
    low, high = min(counts), max(counts)
    n = max(high - low + 1, last) + 2 * width
    bins = np.zeros(n, np.int64)
    for value, count in counts.items():
        bins[value - low] = count
    sums = np.convolve(bins, np.ones(width, np.int64), "valid")
    falls = np.flatnonzero(np.diff(bins[: max(last // 10, 1)]) < 0)
    peak = int(falls[0]) if len(falls) else 0
    stop = min(high - low + width, last)
    rises = np.flatnonzero(np.diff(sums[peak:stop]) >= 0)
    valley = peak + int(rises[0]) if len(rises) else max(stop - 1, peak)
    floor_ = bins[valley : valley + width].min()
    lowest = valley + int(np.argmin(bins[valley : valley + width]))
    near = np.flatnonzero(bins[max(0, valley - width) : valley + width] <= floor_ * (1 + tolerance))
    return low + (max(0, valley - width) + int(near[0]) if len(near) else lowest)


def read_ends(overlaps: DataFrame) -> DataFrame:
    """Two rows an overlap, one for each read: read_id, len, identity, span, overhang, other_id."""
    a, b = overhangs()
    rows = overlaps.withColumns({"__a": a, "__b": b})
    pick = lambda r, o: rows.select(
        F.col(f"{r}_id").alias("read_id"), F.col(f"{r}_len").alias("len"), "identity",
        (F.col(f"{r}_end") - F.col(f"{r}_start")).alias("span"), F.col(f"__{r}").alias("overhang"), F.col(f"{o}_id").alias("other_id"),
    )
    return pick("a", "b").unionByName(pick("b", "a"))


def read_info(overlaps: DataFrame) -> DataFrame:
    """By read: length, overlaps, identity weighted by span, largest overhang (0 if none)."""
    ends = read_ends(overlaps)
    return ends.groupBy("read_id").agg(
        F.max("len").alias("len"),
        F.count("*").alias("count"),
        (F.sum(F.col("identity") * F.col("span")) / F.sum("span")).alias("identity"),
        F.greatest(F.max("overhang"), F.lit(0)).alias("overhang"),
    )


def global_limits(info: DataFrame, low: float = 90.0, high: int = 500, identity=(98.0, 6.0), overhang=(30.0, 6.0)) -> DataFrame:
    """One row from ``read_info``: ``min_identity`` and ``max_overhang`` by weighted median and MAD over reads, longer reads weighing more."""
    i = weighted_mad(info, "identity", "len", []).select((F.least(F.lit(identity[0]), "median") - identity[1] * MAD_TO_SD * F.col("mad")).alias("i"))
    o = weighted_mad(info.withColumn("overhang", F.col("overhang").cast("double")), "overhang", "len", []).select((F.greatest(F.lit(overhang[0]), "median") + overhang[1] * MAD_TO_SD * F.col("mad")).alias("o"))
    return i.crossJoin(F.broadcast(o)).select(F.greatest("i", F.lit(low)).alias("min_identity"), F.least(F.floor("o"), F.lit(high)).cast("long").alias("max_overhang"))


def local_identity_limits(overlaps: DataFrame, coverage: int = 40, low_coverage: int = 25, least: float = 90.0, deviation=(99.0, 6.0)) -> DataFrame:
    """By read: the identity limit from its best overlaps up to a budget of bases (read_id, identity_limit)."""
    upper = max(2 * low_coverage, int(coverage * 1.5))
    score = F.col("identity") * F.col("span")
    # any order-keeping bins would do; a null score comes last
    rows = read_ends(overlaps).withColumn("__bin", F.coalesce(F.floor(F.log(F.greatest(score, F.lit(1.0))) * 64), F.lit(-1)))
    store = Store(overlaps.sparkSession, "budgets")
    sums = store.keep(rows.groupBy("read_id", "__bin").agg(F.max("len").alias("__len"), F.sum("span").alias("__span")), "sums")
    budget = sums.groupBy("read_id").agg(F.max("__len").alias("__len"), F.sum("__span").alias("__all"))
    # a bin is looked at closely where those above it leave some of the budget
    above = F.coalesce(F.sum("__span").over(Window.partitionBy("read_id").orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.max("__len").over(Window.partitionBy("read_id"))
    open_ = store.keep(sums.select("read_id", "__bin", (above < upper * most).alias("__open")).where("__open").select("read_id", "__bin"), "open")
    w = Window.partitionBy("read_id").orderBy(score.desc(), F.desc("span"), "other_id").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.join(_small(open_), ["read_id", "__bin"], "left_semi").withColumn("__upto", F.sum("span").over(w))
    # the row that reaches the upper budget is left out, and those after it
    used = store.keep(near.where(F.col("__upto") < upper * F.col("len")).select("read_id", "identity", "span"), "used")
    stat = weighted_mad(used, "identity", "span", ["read_id"])
    limit = F.greatest(F.least(F.lit(deviation[0]), "median") - deviation[1] * MAD_TO_SD * F.col("mad"), F.lit(least))
    enough = F.col("__all") >= low_coverage * F.col("__len")
    return budget.join(stat, "read_id", "left").select("read_id", F.when(enough & F.col("median").isNotNull(), limit).otherwise(least).alias("identity_limit"))


def _small(written: DataFrame, rows: int = 100_000) -> DataFrame:
    """``written`` (a pass on disk, so that it is cheap to count), broadcast while it is small."""
    return F.broadcast(written) if written.count() <= rows else written


def local_overhang_limits(hangs: DataFrame, low_count: int = 25, high_count: int = 60, most: int = 500, deviation=(10.0, 6.0)) -> DataFrame:
    """``hangs`` (read_id, overhang, span, other_id) to read_id, overhang_limit; the relatively smallest overhangs decide."""
    # the rank alone, so that each task drops what it knows to come later before it is shuffled
    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(F.col("overhang") / F.col("span"), "overhang", "other_id"))
    first = hangs.withColumn("__rank", rank).where(F.col("__rank") <= high_count)
    store = Store(hangs.sparkSession, "hangs")
    counts = store.keep(hangs.groupBy("read_id").agg(F.count("*").alias("__n")), "counts")
    enough = counts.where(F.col("__n") >= low_count).select("read_id")
    used = store.keep(first.join(enough, "read_id", "left_semi").select("read_id", F.col("overhang").cast("double").alias("overhang"), "span"), "used")
    stat = weighted_mad(used, "overhang", "span", ["read_id"]).join(weighted_mean_deviation(used, "overhang", "span", ["read_id"]), "read_id")
    by_mad = F.greatest(F.lit(deviation[0]), "median") + deviation[1] * MAD_TO_SD * F.col("mad")
    by_mean = F.greatest(F.lit(deviation[0]), "mean") + deviation[1] * MEAN_DEVIATION_TO_SD * F.col("deviation")
    limit = F.least(F.when(F.col("mad") >= 1e-10, by_mad).otherwise(by_mean), F.lit(float(most)))
    return counts.select("read_id").join(stat, "read_id", "left").select("read_id", F.coalesce(limit, F.lit(float(most))).alias("overhang_limit"))


def end_hangs(overlaps: DataFrame) -> DataFrame:
    """Ends that an overlap leaves hanging, under the shape that leaves least: read_id, end (0 start, 1 end), overhang, span, other_id."""
    rows = overlaps.withColumns(dict(zip(("__a", "__b"), overhang_masks(), strict=True)))
    parts = []
    for r, o in ("ab", "ba"):
        for end, hang in ((0, F.col(f"{r}_start")), (1, F.col(f"{r}_len") - F.col(f"{r}_end"))):
            own = rows.where(F.col(f"__{r}").bitwiseAND(1 << end) != 0)
            parts.append(own.select(F.col(f"{r}_id").alias("read_id"), F.lit(end).alias("end"), hang.alias("overhang"), (F.col(f"{r}_end") - F.col(f"{r}_start")).alias("span"), F.col(f"{o}_id").alias("other_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_limits(overlaps: DataFrame, min_identity: float = 90.0, max_overhang: int = 500, coverage: int = 40, low_coverage: int = 25) -> DataFrame:
    """By read: identity_limit, left_limit and right_limit, from its own overlaps, none looser than the limits given."""
    high = max(2 * low_coverage, int(coverage * 1.5))
    out = local_identity_limits(overlaps, coverage, low_coverage, min_identity)
    hangs = end_hangs(overlaps)
    for end, name in ((0, "left_limit"), (1, "right_limit")):
        own = local_overhang_limits(hangs.where(F.col("end") == end), low_coverage, high, max_overhang)
        out = out.join(own.withColumnRenamed("overhang_limit", name), "read_id", "left").withColumn(name, F.coalesce(name, F.lit(float(max_overhang))))
    return out


def identity_cutoff(alignments: DataFrame, key: str = "template", most: int = 15) -> DataFrame:
    """``alignments`` (key, identity, rank) to key, cutoff: mean less five deviations of the better 70 %; 0 below five."""
    first = alignments.where(F.col("rank") <= most)
    w = Window.partitionBy(key)
    rows = first.withColumns({"__r": F.row_number().over(w.orderBy(F.desc("identity"), "rank")), "__n": F.count("*").over(w)})
    used = rows.where((F.col("__n") < 8) | (F.col("__r") <= F.floor(F.col("__n") * 0.7)))
    stat = used.groupBy(key).agg(F.max("__n").alias("n"), F.avg("identity").alias("m"), F.stddev_pop("identity").alias("s"))
    return stat.select(key, F.when(F.col("n") < 5, 0.0).otherwise(F.col("m") - 5 * F.col("s")).alias("cutoff"))


def identity_report(overlaps: DataFrame) -> DataFrame:
    """One row: mean, sd, upper median, and upper median distance from it, of identity; overlaps weigh equally."""
    base = overlaps.agg(F.avg("identity").alias("mean"), F.stddev_pop("identity").alias("sd"))
    middle = upper_median_all(overlaps, "identity", "median")
    near = overlaps.crossJoin(F.broadcast(middle)).select(F.abs(F.col("identity") - F.col("median")).alias("__d"))
    return base.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(upper_median_all(near, "__d", "mad")))


def upper_median_all(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The upper median of all rows: the value at place n / 2 from 0."""
    return weighted_median_all(rows, value, F.lit(1), out, upper=True)
