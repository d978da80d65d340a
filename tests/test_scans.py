"""Two-level sweeps, interval joins and the budget scan against plain Python, and what their plans may not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import budget, reads
from helixframe.operators import intervals as I  # noqa: E741
from helixframe.plans import store

SPANS = "k long, lo long, hi long"


def plain_parts(lengths, bases):
    out, total, part = [], 0, 0
    for n in lengths:
        out.append(part)
        total += n
        if total >= bases:
            total, part = 0, part + 1
    return out


@pytest.mark.parametrize("bases,per_range", [(1, 3), (50, 1), (50, 7), (400, 5), (400, 64), (10**6, 9)])
def test_budget_scan(spark, bases, per_range):
    rng = np.random.default_rng(bases + per_range)
    lengths = rng.integers(0, 40, 300).tolist()
    ids = np.sort(rng.choice(5000, 300, replace=False)).tolist()
    df = spark.createDataFrame([(i, "A" * n if n % 5 else ("" if n else None)) for i, n in zip(ids, lengths, strict=True)], "read_id long, seq string")
    want = plain_parts([n if n % 5 else 0 for n in lengths], bases)
    assert [r.part for r in reads.split_by_budget(df, bases, per_range=per_range).orderBy("read_id").collect()] == want


def test_step_functions_compose():
    rng = np.random.default_rng(2)
    for _ in range(300):
        bases = int(rng.integers(1, 60))
        n = rng.integers(0, 30, rng.integers(2, 25))
        cut = int(rng.integers(1, len(n)))
        f = budget.composed(budget.range_steps(n[:cut], bases), budget.range_steps(n[cut:], bases))
        assert f["lo"][0] == 0 and f["hi"][-1] == bases and (f["lo"][1:] == f["hi"][:-1]).all()
        for s in range(bases):
            total, parts = s, 0
            for x in n.tolist():
                total += x
                if total >= bases:
                    total, parts = 0, parts + 1
            k = int(np.searchsorted(f["hi"], s, "right"))
            assert (f["value"][k] + (s if f["adds"][k] else 0), f["parts"][k]) == (total, parts)


def test_budget_of_nothing(spark):
    assert reads.split_by_budget(spark.createDataFrame([], "read_id long, seq string"), 5).count() == 0


def test_volumes_of_one_read_with_the_id_0(spark):
    one = spark.createDataFrame([(0, "A")], "read_id long, seq string")
    assert [r.read_id for r in reads.merge_volumes([one, one.limit(0), one, one]).orderBy("read_id").collect()] == [0, 1, 2]


def spans(rng, n, keys, reach, longest):
    lo = rng.integers(0, reach, n)
    return [(int(k), int(a), int(a + b)) for k, a, b in zip(rng.integers(0, keys, n), lo, rng.integers(1, longest, n), strict=True)]


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_two_level_sweeps(spark, width):
    rows = spans(np.random.default_rng(width), 400, 3, 900, 60)
    df = spark.createDataFrame(rows, SPANS)
    depth = {k: np.zeros(1000, int) for k in range(3)}
    for k, a, b in rows:
        depth[k][a:b] += 1
    got = {k: np.zeros(1000, int) for k in range(3)}
    for r in I.depth_intervals(df, "k", width).collect():
        got[r.k][r.lo : r.hi] += r.depth
    assert all((got[k] == depth[k]).all() for k in range(3))
    cov = {r.k: (r.min_coverage, r.max_coverage) for r in I.coverage(df.withColumn("len", F.lit(960).cast("long")), "k", "len", width=width).collect()}
    assert cov == {k: (depth[k][:960].min(), depth[k][:960].max()) for k in range(3)}
    deep = set()
    for k in range(3):
        edge = np.diff(np.concatenate([[0], depth[k] >= 5, [0]]).astype(int))
        deep |= {(k, int(a), int(b)) for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)}
    assert {tuple(r) for r in I.deep_ranges(df, "k", 5, width).select("k", "lo", "hi").collect()} == deep
    for overlap in (0, 10):
        want = []
        for k in range(3):
            cur = None
            for a, b in sorted(((a, b) for kk, a, b in rows if kk == k), key=lambda x: (x[0], -x[1])):
                if cur and (b <= cur[1] or cur[1] - overlap >= a):
                    cur = [cur[0], max(cur[1], b), cur[2] + 1]
                    want[-1] = (k, *cur)
                else:
                    cur = [a, b, 1]
                    want.append((k, *cur))
        assert sorted(tuple(r) for r in I.merge_intervals(df, "k", overlap, width).select("k", "lo", "hi", "n").collect()) == sorted(want)
    left = {(r.k, r.lo, r.hi) for r in I.gaps(df.withColumn("len", F.lit(1000).cast("long")), "k", "len", 1, width).collect()}
    want = set()
    for k in range(3):
        edge = np.diff(np.concatenate([[0], depth[k] == 0, [0]]).astype(int))
        want |= {(k, int(a), int(b)) for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)}
    assert left == want


def test_no_window_holds_all_events_of_a_key(spark):
    plan = I.depth_intervals(spark.createDataFrame([(1, 2, 3)], SPANS), "k")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__bin" in line.split("windowspecdefinition")[-1] and ("__total" in line or "__first" in line or "__bin#" in line.split("],")[1]) for line in windows)


@pytest.mark.parametrize("hot", [3, 10_000])
def test_overlap_join(spark, hot):
    rng = np.random.default_rng(hot)
    a = spans(rng, 200, 2, 3000, 40) + [(0, 0, 3000), (1, 100, 2000), (0, 5, 6)]
    b = spans(rng, 200, 2, 3000, 5) + [(0, 0, 3000), (0, 1024, 1025), (1, 1023, 1025), (0, 5, 6)]
    got = sorted((r.k, r.lo, r.hi, r.r_lo, r.r_hi) for r in I.overlap_join(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), "k", hot).collect())
    assert got == sorted((k, x, y, u, v) for k, x, y in a for kk, u, v in b if k == kk and x < v and u < y)


def test_disjoint_intervals_of_one_key_hardly_meet(spark):
    n = 100_000
    left = spark.range(n).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 100).alias("lo"), (F.col("id") * 100 + 60).alias("hi"))
    right = left.withColumns({"lo": F.col("lo") + 30, "hi": F.col("hi") + 30})
    met = I.overlap_join(left, right, "k")
    assert met.count() == n
    # rows that the equi-join makes before the condition: a small multiple of the intervals
    l, r = I._registered(I._levels(left), [3]), I._registered(I._levels(right), [3])  # noqa: E741
    assert l.join(r, ["k", "__at", "__bucket"]).count() < 20 * n


def test_stored_tables_can_be_cleared(spark):
    store.clear(spark)
    kept = store.Store(spark, "clearing").keep(spark.range(3), "x")
    assert kept.count() == 3 and store.clear(spark) == 1 and store.clear(spark) == 0
    with pytest.raises(Exception, match="(?i)does not exist|not found|no such file"):
        kept.count()


def length_stats_of(spark, seqs, f):
    return f(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")).first().asDict()


def test_length_statistics_with_empty_reads(spark):
    got = length_stats_of(spark, ["A" * 6, "", "A" * 2, "", None], reads.length_statistics)
    assert got == {"count": 5, "total": 8, "mean": 1, "median": 0, "max": 6, "min": 0, "n25": 6, "l25": 1, "n50": 6, "l50": 1, "n75": 6, "l75": 1}
    empty = length_stats_of(spark, ["", ""], reads.length_statistics)
    assert (empty["total"], empty["n50"], empty["l25"], empty["l75"]) == (0, 0, 1, 1)


def test_n_statistics_with_empty_reads(spark):
    got = length_stats_of(spark, ["A" * 6, "", "A" * 2, "", None], reads.n_statistics)
    assert got == {"count": 5, "total": 8, "max": 6, "min": 0, "n25": 6, "l25": 1, "n50": 6, "l50": 1, "n75": 2, "l75": 2}
    assert length_stats_of(spark, ["", ""], reads.n_statistics) == {"count": 2, "total": 0, "max": 0, "min": 0, **dict.fromkeys(("n25", "l25", "n50", "l50", "n75", "l75"))}
    assert reads.n_statistics(spark.createDataFrame([], "read_id long, seq string")).first()["count"] == 0


def plain_best_window(rows, width):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((p, t, v) for k, p, t, v in rows if k == key)
        best = None
        for i, (p, _, _) in enumerate(own):
            held = [v for q, _, v in own[: i + 1] if q >= p - width and v is not None]
            if best is None or sum(held) > best[1]:
                best = (p, sum(held), len(held))
        out[key] = best
    return out


@pytest.mark.parametrize("seed", range(3))
def test_best_window(spark, seed):
    rng = np.random.default_rng(seed)
    # negative scores, many rows at one position, none that counts
    rows = [(int(k), int(p), i, None if v == 5 else int(v)) for i, (k, p, v) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 40, 300), rng.integers(-9, 9, 300), strict=True))]
    df = spark.createDataFrame(rows, "k long, pos long, id long, v long")
    for width in (0, 3, 25):
        got = {r.k: (r.end_position, r.score, r.n) for r in I.best_window(df, ["k"], "pos", "v", "id", width).collect()}
        assert got == plain_best_window(rows, width)


def test_best_window_slides_over_no_rows(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "k long, pos long, id long, v long")
    plan = I.best_window(df, ["k"], "pos", "v", "id")._jdf.queryExecution().optimizedPlan().toString()
    # frames begin where the partition does: each row is added once
    assert plan.count("unboundedpreceding") == plan.count("specifiedwindowframe") > 0


def test_identity_limits_look_at_few_bins(spark):
    from helixframe.operators import statistics as S
    from helixframe.schema import OVERLAPS

    rng = np.random.default_rng(4)
    rows = [(0, i, float(rng.integers(60, 100)), 0, 0, int(rng.integers(50, 900)), 1000, 0, 0, 500, 5000) for i in range(1, 3000)]
    got = {r.read_id: r.identity_limit for r in S.local_identity_limits(spark.createDataFrame(rows, OVERLAPS), 4, 2, 10.0).collect()}
    # the best overlaps of read 0 within six times its length, by hand
    best, upto = [], 0
    for i, span in sorted(((r[2], r[5]) for r in rows), key=lambda x: (-x[0] * x[1], -x[1])):
        if (upto := upto + span) >= 6 * 1000:
            break
        best.append((i, span))

    def median(pairs):
        half, total = sum(w for _, w in pairs) / 2, 0
        return next(v for v, w in sorted(pairs) if (total := total + w) >= half)

    middle = median(best)
    assert got[0] == pytest.approx(max(min(99.0, middle) - 6 * 1.4826 * median([(abs(i - middle), w) for i, w in best]), 10.0))
    root = [x for x in store._written[spark.sparkContext.applicationId] if "/budgets-" in x][-1]
    count = lambda n: spark.read.parquet(f"{root}/{n}").where("read_id = 0").count()
    assert count("002-open") < count("001-sums") / 5
