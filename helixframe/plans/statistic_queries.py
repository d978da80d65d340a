"""Registered queries over statistics, intervals and windows of overlap rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import bridge, filters, trim
from helixframe.operators import intervals as I  # noqa: E741
from helixframe.operators import statistics as S
from helixframe.plans.fixtures import overlaps
from helixframe.plans.overlap_queries import HANGS, LONGER, OVERHANG_A, OVERHANG_B, WITH

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ENDS = f"""{HANGS}, t AS (SELECT *, {OVERHANG_A} AS oa, {OVERHANG_B} AS ob FROM m),
en AS (SELECT a_id AS read_id, a_len AS len, identity, a_end - a_start AS span, oa AS overhang, b_id AS other_id FROM t
  UNION ALL SELECT b_id, b_len, identity, b_end - b_start, ob, a_id FROM t)"""
INFO = """inf AS (SELECT read_id, max(len) AS len, count(*) AS count, sum(identity * span) / CAST(sum(span) AS DOUBLE) AS identity, greatest(max(overhang), 0) AS overhang FROM en GROUP BY read_id)"""


@query(f"{WITH}, {ENDS}, {INFO} SELECT read_id, len, count, round(identity, 6) AS identity, overhang FROM inf")
def read_info(spark, sf):
    return S.read_info(overlaps(spark, sf)).withColumn("identity", F.round("identity", 6))


def median_sql(out: str, source: str, value: str, weight: str, key: str | None, name: str) -> str:
    """CTEs that end in ``out`` (key, name): the weighted median as a cumulative sum over distinct values."""
    by, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    return f"""{out}_b AS (SELECT {by}{value} AS v, sum({weight}) AS w FROM {source} GROUP BY {by}{value}),
{out}_c AS (SELECT *, sum(w) OVER ({part}ORDER BY v ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER ({part}) AS t FROM {out}_b),
{out} AS (SELECT {by}min(v) AS {name} FROM {out}_c WHERE u * 2 >= t {f'GROUP BY {key}' if key else ''})"""


_MED = median_sql("md", "en", "identity", "span", "read_id", "median")
_DEV = "dv AS (SELECT en.read_id, abs(identity - median) AS d, span FROM en JOIN md ON md.read_id = en.read_id)"
_MAD = f"{_MED}, {_DEV}, {median_sql('mm', 'dv', 'd', 'span', 'read_id', 'mad')}"


@query(f"{WITH}, {ENDS}, {_MED} SELECT read_id, median FROM md")
def weighted_median(spark, sf):
    return S.weighted_median(S.read_ends(overlaps(spark, sf)), "identity", "span", ["read_id"])


@query(f"{WITH}, {ENDS}, {_MAD} SELECT md.read_id, median, mad FROM md JOIN mm ON mm.read_id = md.read_id")
def weighted_mad(spark, sf):
    return S.weighted_mad(S.read_ends(overlaps(spark, sf)), "identity", "span", ["read_id"])


@query(
    f"""{WITH}, {ENDS}, mn AS (SELECT read_id, sum(identity * span) / CAST(sum(span) AS DOUBLE) AS mean FROM en GROUP BY read_id)
SELECT en.read_id, round(any_value(mean), 6) AS mean, round(sum(abs(identity - mean) * span) / sum(span), 6) AS deviation FROM en JOIN mn ON mn.read_id = en.read_id GROUP BY en.read_id"""
)
def weighted_mean_deviation(spark, sf):
    rows = S.weighted_mean_deviation(S.read_ends(overlaps(spark, sf)), "identity", "span", ["read_id"])
    return rows.select("read_id", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def upper_sql(out: str, source: str, value: str, name: str) -> str:
    return f"""{out} AS (SELECT read_id, min(v) AS {name} FROM (SELECT read_id, {value} AS v, row_number() OVER (PARTITION BY read_id ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY read_id) AS n FROM {source}) WHERE i = n // 2 GROUP BY read_id)"""


@query(
    f"""{WITH}, {ENDS}, {upper_sql('um', 'en', 'span', 'median')}, ud AS (SELECT en.read_id, abs(span - median) AS d FROM en JOIN um ON um.read_id = en.read_id), {upper_sql('uu', 'ud', 'd', 'mad')}
SELECT um.read_id, median, mad FROM um JOIN uu ON uu.read_id = um.read_id"""
)
def median_mad(spark, sf):
    return S.median_mad(S.read_ends(overlaps(spark, sf)), "span", ["read_id"])


@query(
    f"""{WITH}, {ENDS}, {INFO}, {median_sql('gi', 'inf', 'identity', 'len', None, 'med')}, gd AS (SELECT abs(identity - med) AS d, len FROM inf, gi), {median_sql('gm', 'gd', 'd', 'len', None, 'mad')},
{median_sql('hi', 'inf', 'overhang', 'len', None, 'med')}, hd AS (SELECT abs(overhang - med) AS d, len FROM inf, hi), {median_sql('hm', 'hd', 'd', 'len', None, 'mad')}
SELECT round(greatest(least(98.0::DOUBLE, gi.med) - 6 * 1.4826::DOUBLE * gm.mad, 90.0), 6) AS min_identity, CAST(least(floor(greatest(30.0::DOUBLE, hi.med) + 6 * 1.4826::DOUBLE * hm.mad), 500) AS BIGINT) AS max_overhang FROM gi, gm, hi, hm"""
)
def global_limits(spark, sf):
    return S.global_limits(S.read_info(overlaps(spark, sf))).withColumn("min_identity", F.round("min_identity", 6))


@query(
    f"""{WITH}, {ENDS}, up AS (SELECT *, sum(span) OVER (PARTITION BY read_id ORDER BY identity * span DESC, span DESC, other_id ROWS UNBOUNDED PRECEDING) AS u FROM en),
us AS (SELECT * FROM up WHERE u < 60 * len), bg AS (SELECT read_id, max(len) AS len, sum(span) AS al FROM en GROUP BY read_id),
{median_sql('li', 'us', 'identity', 'span', 'read_id', 'med')}, ld AS (SELECT us.read_id, abs(identity - med) AS d, span FROM us JOIN li ON li.read_id = us.read_id), {median_sql('lm', 'ld', 'd', 'span', 'read_id', 'mad')}
SELECT bg.read_id, round(CASE WHEN al >= 25 * bg.len AND med IS NOT NULL THEN greatest(least(99.0::DOUBLE, med) - 6 * 1.4826::DOUBLE * mad, 80.0) ELSE 80.0 END, 6) AS identity_limit
FROM bg LEFT JOIN li ON li.read_id = bg.read_id LEFT JOIN lm ON lm.read_id = bg.read_id"""
)
def local_identity_limits(spark, sf):
    return S.local_identity_limits(overlaps(spark, sf), least=80.0).withColumn("identity_limit", F.round("identity_limit", 6))


IV = "iv AS (SELECT a_id AS read_id, a_len AS len, a_start AS lo, a_end AS hi FROM o UNION ALL SELECT b_id, b_len, b_start, b_end FROM o)"
COV = f"""{IV}, ev AS (SELECT read_id, len, pos, sum(st) AS st FROM (SELECT read_id, len, lo AS pos, 1 AS st FROM iv UNION ALL SELECT read_id, len, hi, -1 FROM iv UNION ALL SELECT read_id, len, 0, 0 FROM iv) GROUP BY 1, 2, 3),
cv AS (SELECT read_id, CAST(min(d) AS BIGINT) AS min_coverage, CAST(max(d) AS BIGINT) AS max_coverage FROM (SELECT read_id, len, pos, sum(st) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS d FROM ev) WHERE pos < len GROUP BY read_id)"""


@query(f"{WITH}, {COV} SELECT * FROM cv")
def coverage_minmax(spark, sf):
    return filters.read_coverage(overlaps(spark, sf))


@query(f"{WITH}, {COV}, pc AS (SELECT max_coverage AS v, row_number() OVER (ORDER BY max_coverage) AS i, count(*) OVER () AS n FROM cv) SELECT min(v) AS percentile FROM pc WHERE i >= n * 99 / 100.0")
def coverage_percentile(spark, sf):
    return S.percentile_of(filters.read_coverage(overlaps(spark, sf)), "max_coverage", 99)


@query(
    f"""{WITH}, {COV}, x AS (SELECT row_number() OVER (ORDER BY max_coverage) AS i, row_number() OVER (ORDER BY max_coverage - min_coverage) AS j, count(*) OVER () AS n, max_coverage AS v, max_coverage - min_coverage AS w FROM cv)
SELECT min(CASE WHEN i >= n * 99.99 / 100.0 THEN v END) AS most, min(CASE WHEN j >= n * 99.99 / 100.0 THEN w END) AS spread FROM x"""
)
def coverage_limits(spark, sf):
    return filters.coverage_limits(filters.read_coverage(overlaps(spark, sf)))


@query()
def coverage_trough(spark, sf):
    cov = filters.read_coverage(overlaps(spark, sf))
    return spark.createDataFrame([(filters.coverage_trough(cov),)], "trough long")


DEPTH = """dp AS (SELECT read_id, lo, hi, depth FROM (SELECT read_id, pos AS lo, lead(pos) OVER (PARTITION BY read_id ORDER BY pos) AS hi, CAST(sum(st) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth
  FROM (SELECT read_id, pos, sum(st) AS st FROM (SELECT read_id, lo AS pos, 1 AS st FROM sp UNION ALL SELECT read_id, hi, -1 FROM sp) GROUP BY 1, 2 HAVING sum(st) <> 0)) WHERE depth > 0)"""
SPANS = "sp AS (SELECT b_id AS read_id, b_start AS lo, b_end AS hi, b_len AS len FROM o)"


def _spans(spark, sf):
    return overlaps(spark, sf).select(F.col("b_id").alias("read_id"), F.col("b_start").alias("lo"), F.col("b_end").alias("hi"), F.col("b_len").alias("len"))


@query(f"{WITH}, {SPANS}, {DEPTH} SELECT * FROM dp")
def depth_intervals(spark, sf):
    return I.depth_intervals(_spans(spark, sf), "read_id")


#: Spans are numbered once, and both windows go by that number, so equal spans can't change places.
MERGE = """ms AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY lo, hi DESC) AS rn FROM sp),
mr AS (SELECT *, max(hi) OVER (PARTITION BY read_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rc FROM ms),
mi AS (SELECT *, sum(CASE WHEN rc IS NULL OR NOT (hi <= rc OR rc - 50 >= lo) THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS isl FROM mr),
mg AS (SELECT read_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM mi GROUP BY read_id, isl)"""


@query(f"{WITH}, {SPANS}, {MERGE} SELECT * FROM mg")
def merge_intervals(spark, sf):
    return I.merge_intervals(_spans(spark, sf), "read_id", 50)


def cover_sql(spans: str, overlap: int, depth: int) -> str:
    return f"""{spans}, {DEPTH}, {MERGE.replace('rc - 50', f'rc - {overlap}')},
dq AS (SELECT read_id, lo, hi, CASE WHEN lag(hi) OVER (PARTITION BY read_id ORDER BY lo) = lo THEN 0 ELSE 1 END AS nw FROM dp WHERE depth >= {depth}),
dr AS (SELECT read_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(nw) OVER (PARTITION BY read_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS isl FROM dq) GROUP BY read_id, isl),
xs AS (SELECT mg.read_id, greatest(mg.lo, dr.lo) AS lo, least(mg.hi, dr.hi) AS hi FROM mg JOIN dr ON mg.read_id = dr.read_id AND mg.lo < dr.hi AND dr.lo < mg.hi),
lc AS (SELECT read_id, lo AS left, hi AS right FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY lo - hi, lo) AS rn FROM xs) WHERE rn = 1)""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')


@query(f"{WITH}, {cover_sql(SPANS, 50, 2)} SELECT * FROM lc")
def largest_cover_range(spark, sf):
    return I.largest_cover_range(_spans(spark, sf), "read_id", 50, 2)


@query(f"{WITH}, {cover_sql(SPANS, 50, 2)} SELECT read_id, lo, hi FROM xs")
def intersect_intervals(spark, sf):
    s = _spans(spark, sf)
    return I.intersect_intervals(I.merge_intervals(s, "read_id", 50), I.deep_ranges(s, "read_id", 2), "read_id")


@query(
    f"""{WITH}, {SPANS}, ed AS (SELECT read_id, lo, hi FROM sp UNION ALL SELECT DISTINCT read_id, len, len FROM sp),
gp AS (SELECT read_id, coalesce(max(hi) OVER (PARTITION BY read_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, lo AS hi FROM ed) SELECT * FROM gp WHERE hi - lo >= 200"""
)
def uncovered_gaps(spark, sf):
    return I.gaps(_spans(spark, sf), "read_id", "len", 200)


_WHOLE = "wh AS (SELECT b_id AS read_id, max(b_len) AS size FROM o WHERE identity >= 90 AND b_start <= 20 AND b_len - b_end <= 20 GROUP BY b_id)"


@query(f"{WITH}, {_WHOLE} SELECT * FROM wh")
def complete_reads(spark, sf):
    return trim.complete_reads(overlaps(spark, sf))


CHIM = f"""tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b_id, a_id, s ORDER BY {LONGER}) AS rn FROM (SELECT *, (a_start + b_start) % 2 AS s FROM o WHERE identity >= 90)) WHERE rn = 1),
pr AS (SELECT f.b_id, f.a_id, f.a_len, f.b_len, f.b_start AS fb0, f.b_end AS fb1, r.b_start AS rb0, r.b_end AS rb1,
  CASE WHEN f.a_start < r.a_start THEN f.a_start ELSE r.a_start END AS la0, CASE WHEN f.a_start < r.a_start THEN f.a_end ELSE r.a_end END AS la1,
  CASE WHEN f.a_start < r.a_start THEN r.a_start ELSE f.a_start END AS ra0, CASE WHEN f.a_start < r.a_start THEN r.a_end ELSE f.a_end END AS ra1,
  CASE WHEN f.b_start < r.b_start THEN f.b_start ELSE r.b_start END AS lb0, CASE WHEN f.b_start < r.b_start THEN f.b_end ELSE r.b_end END AS lb1,
  CASE WHEN f.b_start < r.b_start THEN r.b_start ELSE f.b_start END AS xb0, CASE WHEN f.b_start < r.b_start THEN r.b_end ELSE f.b_end END AS xb1
  FROM tp f JOIN tp r ON f.b_id = r.b_id AND f.a_id = r.a_id AND f.s = 0 AND r.s = 1),
ht AS (SELECT * FROM (SELECT *, greatest(la1 - ra0, 0) AS sh, xb0 - lb1 AS gap FROM pr) WHERE least(la1 - la0, ra1 - ra0) >= greatest(la1 - la0, ra1 - ra0) * 0.9 AND sh >= (la1 - la0) * 0.9 AND sh >= (ra1 - ra0) * 0.9
  AND ((xb1 - lb0 - greatest(gap, 0) >= b_len * 0.9 AND (gap >= 0 OR (-gap < (lb1 - lb0) * 0.4 AND -gap < (xb1 - xb0) * 0.4))) OR (la1 - la0 >= a_len * 0.9 AND ra1 - ra0 >= a_len * 0.9 AND abs(gap) <= 1000))),
mn AS (SELECT b_id FROM ht GROUP BY b_id HAVING count(*) > 1),
es AS (SELECT b_id, a_id, 0 AS s, fb0 AS lo, fb1 AS hi FROM ht WHERE b_id IN (SELECT b_id FROM mn) UNION ALL SELECT b_id, a_id, 1, rb0, rb1 FROM ht WHERE b_id IN (SELECT b_id FROM mn)),
ch AS (SELECT b_id AS read_id, lo AS "left", hi AS "right" FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY lo - hi, a_id, s) AS rn FROM es) WHERE rn = 1 AND hi > lo)"""


def _two_strands(spark, sf):
    """The fixture's a reads are all forward; half of them are taken as reverse here, by their coordinates."""
    return overlaps(spark, sf).withColumn("a_strand", (F.col("a_start") + F.col("b_start")) % 2)


@query(f"{WITH}, {CHIM} SELECT * FROM ch")
def chimeric_reads(spark, sf):
    return trim.chimeric_reads(_two_strands(spark, sf))


_TRIM_SPANS = "sp AS (SELECT b_id AS read_id, b_start AS lo, b_end AS hi, b_len AS len FROM o)"


@query(
    f"""{WITH}, {_WHOLE}, {CHIM}, {cover_sql(_TRIM_SPANS, 1, 1)}, sz AS (SELECT b_id AS read_id, max(b_len) AS size FROM o GROUP BY b_id)
SELECT read_id, CAST(l AS BIGINT) AS "left", CAST(r AS BIGINT) AS "right", size, how FROM (SELECT sz.read_id, CASE WHEN wh.read_id IS NOT NULL THEN 0 ELSE coalesce(ch."left", lc."left") END AS l, CASE WHEN wh.read_id IS NOT NULL THEN sz.size ELSE coalesce(ch."right", lc."right") END AS r, sz.size,
  CASE WHEN wh.read_id IS NOT NULL THEN 'complete' WHEN ch.read_id IS NOT NULL THEN 'chimeric' ELSE 'covered' END AS how
FROM sz LEFT JOIN wh ON wh.read_id = sz.read_id LEFT JOIN ch ON ch.read_id = sz.read_id LEFT JOIN lc ON lc.read_id = sz.read_id) WHERE r - l >= 1000"""
)
def trim_decision(spark, sf):
    return trim.trim_decision(_two_strands(spark, sf))


ROWS = "w AS (SELECT a_id, b_strand, b_start AS pos, identity AS score, row_number() OVER (ORDER BY a_id, b_id, identity, a_start, a_end, b_strand, b_start, b_end) AS id FROM (SELECT DISTINCT * FROM o))"


def _scored(spark, sf):
    """Distinct rows, dealt out once by where they stand; what follows it in the SQL's numbering breaks ties."""
    o = overlaps(spark, sf).repartition("a_id", "b_strand", "b_start").distinct()
    return o.select("a_id", "b_strand", F.col("b_start").alias("pos"), F.col("identity").alias("score"), F.struct("b_id", "identity", "a_start", "a_end").alias("id"))


@query(
    f"""{WITH}, {ROWS}, q AS (SELECT a_id, b_strand, pos, score, id, row_number() OVER (PARTITION BY a_id, b_strand ORDER BY pos, id) AS rn FROM w),
s AS (SELECT x.a_id, x.b_strand, x.pos, x.rn, CAST(sum(y.score) AS BIGINT) AS score, count(*) AS n FROM q x JOIN q y ON y.a_id = x.a_id AND y.b_strand = x.b_strand AND y.rn <= x.rn AND y.pos >= x.pos - 1000 GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY a_id, b_strand ORDER BY score DESC, rn) AS k FROM s) SELECT a_id, b_strand, pos AS end_position, score, n FROM b WHERE k = 1"""
)
def best_window_1000(spark, sf):
    return I.best_window(_scored(spark, sf), ["a_id", "b_strand"], "pos", "score", "id", 1000)


@query(
    f"""{WITH}, d AS (SELECT DISTINCT a_id, b_strand, b_start AS pos FROM o),
g AS (SELECT *, sum(CASE WHEN pos - lp > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY a_id, b_strand ORDER BY pos) AS grp FROM (SELECT *, lag(pos) OVER (PARTITION BY a_id, b_strand ORDER BY pos) AS lp FROM d))
SELECT a_id, b_strand, CAST(grp AS BIGINT) AS grp, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g GROUP BY 1, 2, 3"""
)
def gap_groups_1000(spark, sf):
    rows = overlaps(spark, sf).select("a_id", "b_strand", F.col("b_start").alias("pos")).distinct()
    return I.group_by_gap(rows, ["a_id", "b_strand"], "pos", 1000).groupBy("a_id", "b_strand", "grp").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


@query(f"{WITH}, mp AS (SELECT DISTINCT a_id AS read_id, b_id % 50 AS contig FROM o) SELECT x.contig AS c0, y.contig AS c1, count(*) AS n_reads FROM mp x JOIN mp y ON x.read_id = y.read_id AND x.contig < y.contig GROUP BY 1, 2")
def shared_read_pairs(spark, sf):
    return bridge.shared_reads(overlaps(spark, sf).select(F.col("a_id").alias("read_id"), (F.col("b_id") % 50).alias("contig")))


@query(
    f"""{WITH}, dv AS (SELECT abs(identity - m) AS d, row_number() OVER (ORDER BY abs(identity - m)) - 1 AS i, count(*) OVER () AS n FROM o, (SELECT v AS m FROM (SELECT identity AS v, row_number() OVER (ORDER BY identity) - 1 AS i, count(*) OVER () AS n FROM o) WHERE i = n // 2) q)
SELECT round(avg(identity), 6) AS mean, round(stddev_pop(identity), 6) AS sd, (SELECT v FROM (SELECT identity AS v, row_number() OVER (ORDER BY identity) - 1 AS i, count(*) OVER () AS n FROM o) WHERE i = n // 2) AS median, (SELECT d FROM dv WHERE i = n // 2) AS mad FROM o"""
)
def identity_report(spark, sf):
    return S.identity_report(overlaps(spark, sf)).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "median", "mad")


@query(
    f"""{WITH}, rk AS (SELECT a_id AS template, identity, row_number() OVER (PARTITION BY a_id ORDER BY {LONGER}) AS rank FROM o), fs AS (SELECT * FROM rk WHERE rank <= 15),
us AS (SELECT template, identity, n FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY identity DESC, rank) AS r, count(*) OVER (PARTITION BY template) AS n FROM fs) WHERE n < 8 OR r <= floor(n * 0.7))
SELECT template, round(CASE WHEN max(n) < 5 THEN 0.0 ELSE avg(identity) - 5 * stddev_pop(identity) END, 6) AS cutoff FROM us GROUP BY template"""
)
def identity_cutoff(spark, sf):
    from pyspark.sql import Window

    from helixframe.operators.overlaps import longer_first

    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(*longer_first()))
    rows = overlaps(spark, sf).withColumn("rank", rank).where("rank <= 15").select(F.col("a_id").alias("template"), "identity", "rank")
    return S.identity_cutoff(rows).withColumn("cutoff", F.round("cutoff", 6))


