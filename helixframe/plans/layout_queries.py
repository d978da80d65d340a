"""Registered queries over reads that lie on one line: their overlaps, their mappings to contigs, and folded reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import bridge, filters, graph, trim
from helixframe.operators import overlaps as O  # noqa: E741
from helixframe.plans import statistic_queries as Q
from helixframe.plans.chain_queries import query_into
from helixframe.plans.fixtures import FOLDED_SQL, LAYOUT_SQL, SHORT, folded, layout, mapped, mapped_sql
from helixframe.plans.overlap_queries import _EDGE, _OWN, ALEN, ALL, best_sql, loc_sql, snap_sql
from helixframe.plans.statistic_queries import median_sql
from helixframe.plans.store import Store

QUERIES, SQL = {}, {}
query = query_into(QUERIES, SQL)
_L = f"WITH o AS ({LAYOUT_SQL})"
_M = f"WITH o AS ({mapped_sql()})"
_S = f"WITH o AS ({mapped_sql(SHORT)})"


@query(f"{_L} SELECT {ALL} FROM o")
def layout_overlaps(spark, sf):
    return layout(spark, sf)


@query(f"WITH o AS ({FOLDED_SQL}), {Q.CHIM.replace('(a_start + b_start) % 2 AS s', 'a_strand AS s')} SELECT * FROM ch")
def chimeric_folds(spark, sf):
    return trim.chimeric_reads(folded(spark, sf))


@query(
    f"""{_M}, w AS (SELECT *, {_OWN['a', 'start']} AS p, {_OWN['a', 'end']} AS q, {_OWN['b', 'start']} AS u, {_OWN['b', 'end']} AS v FROM o),
f AS (SELECT * FROM w WHERE (a_start <= 100 AND a_len - a_end <= 100) OR (b_start <= 100 AND b_len - b_end <= 100)
  OR (((a_len - q <= 100 AND u <= 100) OR (b_len - v <= 100 AND p <= 100)) AND (q - p >= a_len * 0.6 OR v - u >= b_len * 0.6))),
k AS (SELECT a_id FROM f GROUP BY a_id HAVING count(*) = 1)
SELECT a_id, b_id, identity, CASE WHEN b_strand = 1 THEN 1 - a_strand ELSE a_strand END AS a_strand, a_start, a_end, a_len, CAST(0 AS BIGINT) AS b_strand, b_start, b_end, b_len
FROM f WHERE a_id IN (SELECT a_id FROM k) AND identity >= 90"""
)
def sole_mappings(spark, sf):
    return filters.sole_full_mapping(mapped(spark, sf))


_INNER = f"""(SELECT CASE loc WHEN 'Contained' THEN a_id WHEN 'Containing' THEN b_id ELSE greatest(a_id, b_id) END FROM (SELECT *, {loc_sql(0)} AS loc FROM o) WHERE loc IN ('Contained', 'Containing', 'Equal'))"""
_FREE = f"{_L}, fr AS (SELECT {ALL} FROM o WHERE a_id NOT IN {_INNER} AND b_id NOT IN {_INNER}), s AS (SELECT *, {loc_sql(0)} AS loc FROM fr)"


def _free(spark, sf):
    o = layout(spark, sf)
    return O.drop_reads(o, filters.contained_reads(o))


@query(f"{_FREE}, bn AS ({best_sql('fr', 3)}) SELECT {ALL} FROM bn")
def layout_best_n(spark, sf):
    return O.best_n_per_end(_free(spark, sf), 3)


@query(
    f"""{_FREE}, {_EDGE}, t AS (SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst WHERE abs(x.length + y.length - z.length) <= 10 AND x.length < z.length),
g AS (SELECT src, dst FROM t UNION SELECT -dst, -src FROM t) SELECT src, dst, length, identity, overlap FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM g)"""
)
def layout_reduced(spark, sf):
    return graph.reduce(graph.edges(_free(spark, sf)), 10)


@query(
    f"""{_FREE}, {_EDGE}, n AS (SELECT dst, count(*) AS c FROM e GROUP BY dst), w AS (SELECT e.src, e.dst FROM e WHERE e.src NOT IN (SELECT dst FROM n) AND e.dst IN (SELECT dst FROM n WHERE c > 1)),
v AS (SELECT src, dst FROM w UNION SELECT -dst, -src FROM w) SELECT src, dst, length, identity, overlap FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM v)"""
)
def spur_edges(spark, sf):
    """One round."""
    return graph.remove_spurs(spark, graph.edges(_free(spark, sf)), 1)


_AT = """CASE loc WHEN 'Left' THEN CASE WHEN a_strand = b_strand THEN a_len - a_end ELSE a_start END WHEN 'Right' THEN CASE WHEN a_strand = b_strand THEN a_start ELSE a_len - a_end END WHEN 'Contained' THEN greatest(a_start, a_len - a_end) WHEN 'Equal' THEN greatest(a_start, a_len - a_end) ELSE -1 END"""
_BT = "CASE loc WHEN 'Left' THEN b_start WHEN 'Right' THEN b_len - b_end WHEN 'Containing' THEN greatest(b_start, b_len - b_end) WHEN 'Equal' THEN greatest(b_start, b_len - b_end) ELSE -1 END"
_CI = f"""x AS (SELECT *, {loc_sql(0)} AS loc, CAST(floor(identity * ({ALEN})) AS BIGINT) AS score FROM o WHERE identity > 80 AND {ALEN} >= 2000 AND {loc_sql(500)} NOT IN ('Abnormal', 'Contained')),
z AS (SELECT a_id AS read_id, identity, score, {_AT} AS hang, a_end - a_start AS span, a_len AS len FROM x UNION ALL SELECT b_id, identity, score, {_BT}, b_end - b_start, b_len FROM x),
ci AS (SELECT read_id, (max({{'s': score, 'i': identity}})).i AS identity, max(score) AS score, CAST(max(hang) AS BIGINT) AS overhang, count(*) FILTER (WHERE hang >= 0) AS hangs, count(*) AS count, CAST(sum(span) AS BIGINT) AS aligned, max(len) AS len FROM z GROUP BY read_id)"""


@query(f"{_M}, {_CI} SELECT * FROM ci")
def contig_read_info(spark, sf):
    return bridge.contig_read_info(mapped(spark, sf))


@query(
    f"""{_M}, {_CI}, {median_sql('im', 'ci', 'identity', 'score', None, 'med')}, jd AS (SELECT abs(identity - med) AS d, score FROM ci, im), {median_sql('jm', 'jd', 'd', 'score', None, 'mad')},
{median_sql('om', 'ci', 'overhang', 'len', None, 'med')}, pd AS (SELECT abs(overhang - med) AS d, len FROM ci, om), {median_sql('pm', 'pd', 'd', 'len', None, 'mad')}
SELECT round(im.med - 6 * 1.4826::DOUBLE * jm.mad, 6) AS min_identity, CAST(floor(om.med + 6 * 1.4826::DOUBLE * pm.mad) AS BIGINT) AS max_overhang FROM im, jm, om, pm"""
)
def bridge_limits(spark, sf):
    return bridge.bridge_limits(bridge.contig_read_info(mapped(spark, sf))).withColumn("min_identity", F.round("min_identity", 6))


def _alignments(spark, sf):
    """Mappings as rows of reads on contigs."""
    return mapped(spark, sf, SHORT).select(
        F.col("a_id").alias("read_id"), F.col("b_id").alias("contig"), F.col("a_start").alias("r_start"), F.col("a_end").alias("r_end"), F.col("b_start").alias("c_start"), F.col("b_end").alias("c_end"),
        F.col("b_len").alias("c_len"), F.col("b_strand").cast("int").alias("strand"), F.floor("identity").cast("long").alias("score"),
    )


_PL = """y AS (SELECT a_id AS read_id, b_id AS contig, a_start AS r0, a_end AS r1, b_start AS c0, b_end AS c1, b_len AS cl, b_strand AS st, CAST(floor(identity) AS BIGINT) AS sc FROM o),
pr AS (SELECT x.contig AS c0, y.contig AS c1, x.read_id, CASE WHEN x.st = y.st THEN 0 ELSE 1 END AS strand, x.sc + y.sc AS score, y.cl AS c1_len, y.st AS yst, y.r0 AS yr0, y.c0 AS yc0, y.c1 AS yc1,
  CASE WHEN x.st = 0 THEN x.r0 - x.c0 ELSE x.r1 + x.c0 END AS p0, CASE WHEN x.st = 0 THEN x.r0 - x.c0 + x.cl ELSE x.r1 + x.c0 - x.cl END AS p1 FROM y x JOIN y ON x.read_id = y.read_id AND x.contig < y.contig),
pl AS (SELECT c0, c1, read_id, strand, CASE WHEN yst = 0 THEN yc0 + p0 - yr0 ELSE yc1 - (p0 - yr0) END AS start, CASE WHEN yst = 0 THEN yc0 + p1 - yr0 ELSE yc1 - (p1 - yr0) END AS "end", c1_len, score FROM pr)"""


@query(f'{_S}, {_PL} SELECT c0, c1, read_id, strand, start, "end", c1_len, score FROM pl')
def projected_links(spark, sf):
    return bridge.projected_links(_alignments(spark, sf))


_GG = f"""{_S}, {_PL}, lk AS (SELECT c0, c1, strand, read_id, least(start, "end") AS lo, greatest(start, "end") AS hi, c1_len, score FROM pl),
md AS (SELECT c0, c1, strand, (list_sort(list(lo)))[count(*) // 2 + 1] AS lo, (list_sort(list(hi)))[count(*) // 2 + 1] AS hi, count(DISTINCT read_id) AS support, any_value(c1_len) AS l1, -(max({{'s': score, 'r': -read_id}})).r AS read_id FROM lk GROUP BY 1, 2, 3),
cl AS (SELECT *, CASE WHEN abs(lo) <= 100 AND abs(hi - l1) <= 100 THEN 'Equal' WHEN lo >= -100 AND hi <= l1 + 100 THEN 'Contained' WHEN lo <= 100 AND hi >= l1 - 100 THEN 'Containing' WHEN lo < 0 THEN 'Left' ELSE 'Right' END AS loc FROM md)"""


@query(f"{_GG} SELECT c0, c1, strand, lo, hi, support, read_id, l1, loc FROM cl")
def contig_links(spark, sf):
    return _contig_links(spark, sf)


def _contig_links(spark, sf):
    a = _alignments(spark, sf)
    return bridge.contig_links(bridge.projected_links(a), a.select("contig", F.col("c_len").alias("len")).distinct())


_CE = f"""{_GG}, gn AS (SELECT CASE loc WHEN 'Containing' THEN c1 WHEN 'Contained' THEN c0 ELSE greatest(c0, c1) END AS c FROM cl WHERE loc IN ('Containing', 'Contained', 'Equal')),
dv AS (SELECT *, CASE WHEN strand = 0 THEN c0 + 1 ELSE -(c0 + 1) END AS own, c1 + 1 AS oth FROM cl WHERE loc IN ('Left', 'Right') AND c0 NOT IN (SELECT c FROM gn) AND c1 NOT IN (SELECT c FROM gn)),
ev AS (SELECT CASE loc WHEN 'Left' THEN own ELSE oth END AS src, CASE loc WHEN 'Left' THEN oth ELSE own END AS dst, CASE loc WHEN 'Left' THEN l1 - hi ELSE hi - l1 END AS ahead, CASE loc WHEN 'Left' THEN -lo ELSE lo END AS back, support, read_id FROM dv),
ce AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY support DESC, length, read_id) AS rn FROM (SELECT src, dst, ahead AS length, support, read_id FROM ev UNION ALL SELECT -dst, -src, back, support, read_id FROM ev)) WHERE rn = 1)"""


@query(f"{_CE} SELECT src, dst, length, support, read_id FROM ce")
def contig_edges(spark, sf):
    return bridge.contig_edges(_contig_links(spark, sf))


@query(
    f"""{_CE}, rd AS (SELECT src, dst, read_id FROM (SELECT ev.src, ev.dst, lk.read_id FROM (SELECT CASE loc WHEN 'Left' THEN own ELSE oth END AS src, CASE loc WHEN 'Left' THEN oth ELSE own END AS dst, c0, c1, strand FROM dv) ev JOIN lk ON lk.c0 = ev.c0 AND lk.c1 = ev.c1 AND lk.strand = ev.strand)),
rr AS (SELECT src, dst, read_id FROM rd UNION SELECT -dst, -src, read_id FROM rd),
tw AS (SELECT x.src, x.dst AS mid, y.dst FROM ce x JOIN ce y ON y.src = x.dst JOIN ce z ON z.src = x.src AND z.dst = y.dst WHERE abs(x.length + y.length - z.length) <= 2000 AND x.src <> y.dst),
sh AS (SELECT DISTINCT tw.src, tw.mid, tw.dst FROM tw JOIN rr p ON p.src = tw.src AND p.dst = tw.dst JOIN rr q ON q.src = tw.src AND q.dst = tw.mid AND q.read_id = p.read_id JOIN rr r ON r.src = tw.mid AND r.dst = tw.dst AND r.read_id = p.read_id)
SELECT src, mid AS dst FROM sh UNION SELECT mid, dst FROM sh"""
)
def covered_contig_edges(spark, sf):
    """Reads and lengths of edges stand for the gaps: of three edges the steps are compared by their new bases."""
    # each is read several times by what follows: unless written, their joins would be planned and run for every time
    store = Store(spark, "covered")
    links = store.keep(_contig_links(spark, sf), "links")
    e = store.keep(bridge.contig_edges(links), "edges")
    own = F.when(F.col("strand") == 0, F.col("c0") + 1).otherwise(-(F.col("c0") + 1))
    left = F.col("loc") == "Left"
    ways = links.where(left | (F.col("loc") == "Right")).select("c0", "c1", "strand", F.when(left, own).otherwise(F.col("c1") + 1).alias("src"), F.when(left, F.col("c1") + 1).otherwise(own).alias("dst"))
    r = bridge.projected_links(_alignments(spark, sf)).select("c0", "c1", "strand", "read_id").join(ways, ["c0", "c1", "strand"]).select("src", "dst", "read_id")
    r = store.keep(r.union(r.select(-F.col("dst"), -F.col("src"), "read_id")).distinct(), "reads")
    return bridge.covered_edges(e, e.select("src", "dst", F.col("length").alias("gap")), r)


@query(
    f"""{_S}, {_PL}, w AS (SELECT DISTINCT c0, c1, strand, score, start AS position, CASE WHEN start < 0 THEN 1 ELSE 0 END AS e0, CASE WHEN (start < 0) = (strand = 0) THEN 0 ELSE 1 END AS e1, 1 AS support FROM pl),
q AS (SELECT *, row_number() OVER (PARTITION BY c0, e0 ORDER BY support DESC, score DESC, c0, c1, position, strand) AS r0, row_number() OVER (PARTITION BY c1, e1 ORDER BY support DESC, score DESC, c0, c1, position, strand) AS r1 FROM w)
SELECT c0, c1, strand, position, score, support FROM q WHERE r0 = 1 AND r1 = 1"""
)
def best_links(spark, sf):
    rows = bridge.projected_links(_alignments(spark, sf)).select("c0", "c1", "strand", F.col("start").alias("position"), "score", F.lit(1).alias("support"))
    return bridge.best_links(rows)


@query(
    f"""{_L}, t AS (SELECT a_id % 40 AS g, a_start AS e0, a_start + 2000 AS e1, a_start + (b_start % 300) AS r0, a_start + 2100 - (b_end % 400) AS r1 FROM o),
ar AS (SELECT g, sum(e0) // count(*) AS lo, sum(e1) // count(*) AS hi FROM t GROUP BY g),
ps AS (SELECT g, p FROM ar, unnest(range(800, CAST(hi - lo - 800 AS BIGINT))) AS u(p) WHERE hi - lo > 1600),
dp AS (SELECT ps.g, ps.p, count(t.g) AS d FROM ps JOIN ar ON ar.g = ps.g LEFT JOIN t ON t.g = ps.g AND t.r0 - ar.lo <= ps.p AND ps.p < t.r1 - ar.lo GROUP BY 1, 2)
SELECT g FROM dp GROUP BY g HAVING min(d) > 5"""
)
def covered_groups(spark, sf):
    t = layout(spark, sf).selectExpr("a_id % 40 as g", "a_start as expect_lo", "a_start + 2000 as expect_hi", "a_start + (b_start % 300) as real_lo", "a_start + 2100 - (b_end % 400) as real_hi")
    return bridge.covered_groups(t, ["g"], 800, 5)


@query(f"{_L}, s AS ({snap_sql('o')}) SELECT a_id, b_id, {loc_sql(0)} AS loc FROM s")
def layout_locations(spark, sf):
    return O.with_location(O.snap_ends(layout(spark, sf), 100), 0).select("a_id", "b_id", "loc")
