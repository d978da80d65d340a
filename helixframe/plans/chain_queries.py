"""Registered queries over the limits of the overlap filter and over the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import overlap as X
from helixframe.operators import filters
from helixframe.operators import overlaps as O  # noqa: E741
from helixframe.operators import statistics as S
from helixframe.plans.fixtures import OVERLAPS_SQL, overlaps
from helixframe.plans.overlap_queries import _OWN, _WEAK, ALEN, ALL, HANGS, WITH, best_sql, dedupe_sql, loc_sql, snap_sql
from helixframe.plans.statistic_queries import ENDS, INFO, median_sql
from helixframe.plans.store import Store

QUERIES, SQL = {}, {}


def query_into(queries: dict, texts: dict):
    """A decorator factory that registers a query and its SQL."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            return f

        return add

    return query


query = query_into(QUERIES, SQL)


MASKS = """k AS (SELECT *, CASE shape WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS ma,
  CASE shape WHEN 0 THEN CASE WHEN a_strand = b_strand THEN 2 ELSE 1 END WHEN 1 THEN CASE WHEN a_strand = b_strand THEN 1 ELSE 2 END WHEN 2 THEN 0 ELSE 3 END AS mb FROM m),
eh AS (SELECT a_id AS read_id, 0 AS e, a_start AS oh, a_end - a_start AS span, b_id AS other_id FROM k WHERE ma & 1 <> 0
 UNION ALL SELECT a_id, 1, a_len - a_end, a_end - a_start, b_id FROM k WHERE ma & 2 <> 0
 UNION ALL SELECT b_id, 0, b_start, b_end - b_start, a_id FROM k WHERE mb & 1 <> 0
 UNION ALL SELECT b_id, 1, b_len - b_end, b_end - b_start, a_id FROM k WHERE mb & 2 <> 0)"""


def hang_limit_sql(out: str, end: int, most: str) -> str:
    """CTEs that end in ``out`` (read_id, lim)."""
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY oh / CAST(span AS DOUBLE), oh, other_id) AS rk, count(*) OVER (PARTITION BY read_id) AS n FROM eh WHERE e = {end}),
{out}_u AS (SELECT read_id, CAST(oh AS DOUBLE) AS oh, span FROM {out}_r WHERE n >= 25 AND rk <= 60),
{median_sql(f'{out}_m', f'{out}_u', 'oh', 'span', 'read_id', 'med')}, {out}_d AS (SELECT u.read_id, abs(oh - med) AS d, span FROM {out}_u u JOIN {out}_m m ON m.read_id = u.read_id), {median_sql(f'{out}_x', f'{out}_d', 'd', 'span', 'read_id', 'mad')},
{out}_a AS (SELECT read_id, sum(oh * span) / CAST(sum(span) AS DOUBLE) AS mean FROM {out}_u GROUP BY read_id),
{out}_v AS (SELECT u.read_id, sum(abs(oh - mean) * span) / CAST(sum(span) AS DOUBLE) AS dev FROM {out}_u u JOIN {out}_a a ON a.read_id = u.read_id GROUP BY u.read_id),
{out} AS (SELECT i.read_id, coalesce(least(CASE WHEN mad >= 1e-10 THEN greatest(10.0::DOUBLE, med) + 6 * 1.4826::DOUBLE * mad ELSE greatest(10.0::DOUBLE, mean) + 6 * 1.253::DOUBLE * dev END, {most}), {most}) AS lim
  FROM (SELECT DISTINCT read_id FROM eh WHERE e = {end}) i LEFT JOIN {out}_m m ON m.read_id = i.read_id LEFT JOIN {out}_x x ON x.read_id = i.read_id LEFT JOIN {out}_a a ON a.read_id = i.read_id LEFT JOIN {out}_v v ON v.read_id = i.read_id)"""


@query(f"{WITH}, {HANGS}, {MASKS}, {hang_limit_sql('hl', 0, '500.0::DOUBLE')} SELECT read_id, round(lim, 6) AS overhang_limit FROM hl")
def local_overhang_limits(spark, sf):
    rows = S.end_hangs(overlaps(spark, sf)).where("end = 0")
    return S.local_overhang_limits(rows).withColumn("overhang_limit", F.round("overhang_limit", 6))


def read_limits_sql(ident: str, hang: str) -> str:
    """CTEs from ``o`` that end in ``rl`` (read_id, il, ll, lr); the limits given are scalar expressions."""
    return f"""{ENDS}, {MASKS},
up AS (SELECT *, sum(span) OVER (PARTITION BY read_id ORDER BY identity * span DESC, span DESC, other_id ROWS UNBOUNDED PRECEDING) AS u FROM en),
us AS (SELECT * FROM up WHERE u < 60 * len), bg AS (SELECT read_id, max(len) AS len, sum(span) AS al FROM en GROUP BY read_id),
{median_sql('li', 'us', 'identity', 'span', 'read_id', 'med')}, ld AS (SELECT us.read_id, abs(identity - med) AS d, span FROM us JOIN li ON li.read_id = us.read_id), {median_sql('lm', 'ld', 'd', 'span', 'read_id', 'mad')},
{hang_limit_sql('hl', 0, hang)}, {hang_limit_sql('hr', 1, hang)},
rl AS (SELECT bg.read_id, CASE WHEN al >= 25 * bg.len AND li.med IS NOT NULL THEN greatest(least(99.0::DOUBLE, li.med) - 6 * 1.4826::DOUBLE * lm.mad, {ident}) ELSE {ident} END AS il, coalesce(hl.lim, {hang}) AS ll, coalesce(hr.lim, {hang}) AS lr
  FROM bg LEFT JOIN li ON li.read_id = bg.read_id LEFT JOIN lm ON lm.read_id = bg.read_id LEFT JOIN hl ON hl.read_id = bg.read_id LEFT JOIN hr ON hr.read_id = bg.read_id)"""


def within_sql(source: str) -> str:
    """Rows of ``source`` (with masks ma, mb) that their reads' limits allow."""
    return f"""SELECT x.* FROM {source} x LEFT JOIN rl p ON p.read_id = a_id LEFT JOIN rl q ON q.read_id = b_id
WHERE coalesce(identity >= p.il, true) AND coalesce(identity >= q.il, true)
 AND NOT coalesce((ma & 1 <> 0 AND a_start > p.ll) OR (ma & 2 <> 0 AND a_len - a_end > p.lr), false) AND NOT coalesce((mb & 1 <> 0 AND b_start > q.ll) OR (mb & 2 <> 0 AND b_len - b_end > q.lr), false)"""


@query(f"{WITH}, {read_limits_sql('93.0::DOUBLE', '100.0::DOUBLE')} SELECT read_id, round(il, 6) AS identity_limit, round(ll, 6) AS left_limit, round(lr, 6) AS right_limit FROM rl")
def read_limits(spark, sf):
    out = S.read_limits(overlaps(spark, sf), 93.0, 100)
    return out.select("read_id", *[F.round(c, 6).alias(c) for c in ("identity_limit", "left_limit", "right_limit")])


@query(f"{WITH}, {read_limits_sql('93.0::DOUBLE', '100.0::DOUBLE')} SELECT {ALL} FROM ({within_sql('k')})")
def threshold_filter(spark, sf):
    o = overlaps(spark, sf)
    # written, so that Spark knows how few they are and joins them without shuffling overlaps
    return O.threshold_filter(o, Store(spark, "limits").keep(S.read_limits(o, 93.0, 100), "limits"))


_RAW = f"o0 AS ({OVERLAPS_SQL}), o AS (SELECT * FROM o0 WHERE identity >= 70 AND {ALEN} >= 600 AND {loc_sql(100)} <> 'Abnormal')"
_GL = f"""{INFO}, {median_sql('gi', 'inf', 'identity', 'len', None, 'med')}, gd AS (SELECT abs(identity - med) AS d, len FROM inf, gi), {median_sql('gm', 'gd', 'd', 'len', None, 'mad')},
gl AS (SELECT greatest(least(98.0::DOUBLE, gi.med) - 6 * 1.4826::DOUBLE * gm.mad, 90.0) AS mi FROM gi, gm)"""


def cover_of(out: str, source: str) -> str:
    return f"""{out}_i AS (SELECT a_id AS rd, a_len AS len, a_start AS lo, a_end AS hi FROM {source} UNION ALL SELECT b_id, b_len, b_start, b_end FROM {source}),
{out}_e AS (SELECT rd, len, pos, sum(st) AS st FROM (SELECT rd, len, lo AS pos, 1 AS st FROM {out}_i UNION ALL SELECT rd, len, hi, -1 FROM {out}_i UNION ALL SELECT rd, len, 0, 0 FROM {out}_i) GROUP BY 1, 2, 3),
{out} AS (SELECT rd, min(d) AS low, max(d) AS top FROM (SELECT rd, len, pos, sum(st) OVER (PARTITION BY rd ORDER BY pos ROWS UNBOUNDED PRECEDING) AS d FROM {out}_e) WHERE pos < len GROUP BY rd)"""


_BAD = "SELECT rd FROM {0}, cl WHERE low < 3 OR top > most OR top - low > spread"
_FR = f"""WITH {_RAW}, {read_limits_sql('(SELECT mi FROM gl)', '100.0::DOUBLE').replace('up AS (', _GL + ', up AS (', 1)},
si AS (SELECT DISTINCT {ALL} FROM o0 WHERE identity >= (SELECT mi FROM gl) AND a_id <> b_id AND a_len BETWEEN 2500 AND 2147483647 AND b_len BETWEEN 2500 AND 2147483647 AND {ALEN} >= 600 AND {loc_sql(100)} <> 'Abnormal'),
{MASKS.split('eh AS (')[0].replace('k AS (', 'sk AS (').replace('FROM m)', 'FROM sm)').rstrip().rstrip(',')},
lo AS (SELECT {ALL} FROM ({within_sql('sk')})),
un AS ({dedupe_sql('lo')}), sn AS ({snap_sql('un')}),
{cover_of('c1', 'sn')}, cl AS (SELECT min(CASE WHEN i >= n * 99.0 / 100.0 THEN v END) AS most, min(CASE WHEN j >= n * 99.0 / 100.0 THEN w END) AS spread FROM (SELECT row_number() OVER (ORDER BY top) AS i, row_number() OVER (ORDER BY top - low) AS j, count(*) OVER () AS n, top AS v, top - low AS w FROM c1)),
b1 AS ({_BAD.format('c1')}), s1 AS (SELECT * FROM sn WHERE a_id NOT IN (SELECT rd FROM b1) AND b_id NOT IN (SELECT rd FROM b1)),
{cover_of('c2', 's1')}, b2 AS ({_BAD.format('c2')}), s AS (SELECT *, {loc_sql(0)} AS loc FROM s1 WHERE a_id NOT IN (SELECT rd FROM b2) AND b_id NOT IN (SELECT rd FROM b2)),
{_WEAK} 2), hd AS (SELECT * FROM s WHERE (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM wk)),
inn AS (SELECT CASE loc WHEN 'Contained' THEN a_id WHEN 'Containing' THEN b_id ELSE greatest(a_id, b_id) END AS rd FROM hd WHERE loc IN ('Contained', 'Containing', 'Equal')),
fr AS (SELECT {ALL} FROM hd WHERE a_id NOT IN (SELECT rd FROM inn) AND b_id NOT IN (SELECT rd FROM inn)), bn AS ({best_sql('fr', 3)})"""
_FR = _FR.replace("sk AS (", HANGS.replace("h AS (", "sh AS (").replace("FROM o)", "FROM si)").replace("g AS (", "sg AS (").replace("FROM h)", "FROM sh)").replace("m AS (", "sm AS (").replace("FROM g)", "FROM sg)") + ", sk AS (", 1)


@query(
    f"""{_FR} SELECT {ALL}, CASE WHEN ({ALL}) NOT IN (SELECT ({ALL}) FROM si) THEN 'Simple' WHEN ({ALL}) NOT IN (SELECT ({ALL}) FROM lo) THEN 'Local' WHEN ({ALL}) NOT IN (SELECT ({ALL}) FROM un) THEN 'Duplicate'
 WHEN (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM s) THEN 'FilteredRead' WHEN (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM hd) THEN 'LackOfSupport' WHEN (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM fr) THEN 'FilteredRead'
 WHEN (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM bn) THEN 'BestN' END AS reason FROM o0"""
)
def filter_reasons(spark, sf):
    """All steps of the chain; overlaps of the fixture are short, so the aligned length and the overhang are given."""
    return filters.reasons(spark, overlaps(spark, sf), max_overhang=100, raw_overhang=100, min_aligned=600, min_coverage=3, discard=1.0, best_n=3)


@query(
    f"""{WITH}, w AS (SELECT *, {_OWN['a', 'start']} AS p, {_OWN['a', 'end']} AS q, {_OWN['b', 'start']} AS u, {_OWN['b', 'end']} AS v FROM o)
SELECT a_id, b_id, b_strand, a_start, a_end, b_start, b_end, CASE WHEN p <= 20 AND a_len - q <= 20 THEN true WHEN u <= 20 AND b_len - v <= 20 THEN true WHEN a_len - q <= 20 AND u > 20 THEN false
 WHEN a_len - q <= 20 AND q - p >= 700 THEN true WHEN b_len - v <= 20 AND p > 20 THEN false WHEN b_len - v <= 20 AND q - p >= 700 THEN true ELSE false END AS qualified FROM w"""
)
def qualified_overlap(spark, sf):
    return overlaps(spark, sf).select("a_id", "b_id", "b_strand", "a_start", "a_end", "b_start", "b_end", X.is_qualified(700, 20).alias("qualified"))
