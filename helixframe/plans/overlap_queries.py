"""Registered queries over overlap rows, one expression or operator each."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import overlap as X
from helixframe.operators import filters, graph
from helixframe.operators import overlaps as O  # noqa: E741
from helixframe.plans.fixtures import OVERLAPS_SQL, overlaps, table

QUERIES, SQL = {}, {}
KEY = ["a_id", "b_id", "b_strand", "a_start", "a_end", "b_start", "b_end"]
_KEY = ", ".join(KEY)
ALL = "a_id, b_id, identity, a_strand, a_start, a_end, a_len, b_strand, b_start, b_end, b_len"
WITH = f"WITH o AS ({OVERLAPS_SQL})"
ALEN = "(a_end - a_start + b_end - b_start) // 2"
LONGER = f"{ALEN} DESC, a_id, b_id, b_strand, a_start, a_end, b_start, b_end, identity, a_strand"


def near(value: str, target: str, t: int) -> str:
    return f"(CASE WHEN {value} < {target} - {t} THEN -1 WHEN {value} > {target} + {t} THEN 1 ELSE 0 END)"


def loc_sql(t: int) -> str:
    a0, a1, b0, b1 = near("a_start", "0", t), near("a_end", "a_len", t), near("b_start", "0", t), near("b_end", "b_len", t)
    return f"""CASE
 WHEN a_strand = b_strand AND {a0} > 0 AND {a1} = 0 AND {b0} = 0 AND {b1} < 0 THEN 'Left'
 WHEN a_strand = b_strand AND {a0} = 0 AND {a1} < 0 AND {b0} > 0 AND {b1} = 0 THEN 'Right'
 WHEN a_strand <> b_strand AND {a0} = 0 AND {a1} < 0 AND {b0} = 0 AND {b1} < 0 THEN 'Left'
 WHEN a_strand <> b_strand AND {a0} > 0 AND {a1} = 0 AND {b0} > 0 AND {b1} = 0 THEN 'Right'
 WHEN {a0} = 0 AND {a1} = 0 AND {b0} = 0 AND {b1} = 0 THEN 'Equal'
 WHEN {a0} >= 0 AND {a1} <= 0 AND {b0} = 0 AND {b1} = 0 THEN 'Containing'
 WHEN {a0} = 0 AND {a1} = 0 AND {b0} >= 0 AND {b1} <= 0 THEN 'Contained'
 ELSE 'Abnormal' END"""


def seen_sql(read: str, t: int) -> str:
    loc = loc_sql(t)
    return f"""(SELECT CASE WHEN {read} = a_id THEN l WHEN l = 'Containing' THEN 'Contained' WHEN l = 'Contained' THEN 'Containing'
 WHEN l = 'Left' AND a_strand = b_strand THEN 'Right' WHEN l = 'Right' AND a_strand = b_strand THEN 'Left' ELSE l END FROM (SELECT {loc} AS l))"""


#: h0..h3: unaligned bases under the four shapes, in order of preference.
HANGS = """h AS (SELECT *, a_start AS a0, a_len - a_end AS a1, b_start AS b0, b_len - b_end AS b1 FROM o),
g AS (SELECT *, greatest(a0, CASE WHEN a_strand = b_strand THEN b1 ELSE b0 END) AS h0, greatest(a1, CASE WHEN a_strand = b_strand THEN b0 ELSE b1 END) AS h1, greatest(a0, a1) AS h2, greatest(b0, b1) AS h3 FROM h),
m AS (SELECT *, CASE least(h0, h1, h2, h3) WHEN h0 THEN 0 WHEN h1 THEN 1 WHEN h2 THEN 2 ELSE 3 END AS shape FROM g)"""
OVERHANG_A = "CASE shape WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN h2 ELSE -1 END"
OVERHANG_B = "CASE shape WHEN 0 THEN CASE WHEN a_strand = b_strand THEN b1 ELSE b0 END WHEN 1 THEN CASE WHEN a_strand = b_strand THEN b0 ELSE b1 END WHEN 2 THEN -1 ELSE h3 END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{WITH} SELECT {_KEY}, {ALEN} AS aligned FROM o")
def aligned_length(spark, sf):
    return overlaps(spark, sf).select(*KEY, X.aligned_length().alias("aligned"))


@query(f"{WITH} SELECT {_KEY}, {loc_sql(100)} AS loc FROM o")
def location(spark, sf):
    return overlaps(spark, sf).select(*KEY, X.location(100).alias("loc"))


@query(f"{WITH} SELECT {_KEY}, {seen_sql('b_id', 100)} AS loc FROM o")
def location_from_read(spark, sf):
    return overlaps(spark, sf).select(*KEY, X.location_from(F.col("b_id"), 100).alias("loc"))


@query(f"{WITH}, {HANGS} SELECT {_KEY}, {OVERHANG_A} AS a_overhang, {OVERHANG_B} AS b_overhang FROM m")
def overhang(spark, sf):
    a, b = X.overhangs()
    return overlaps(spark, sf).select(*KEY, a.alias("a_overhang"), b.alias("b_overhang"))


@query(
    f"""{WITH}, l AS (SELECT *, {loc_sql(100)} AS loc FROM o)
SELECT {_KEY}, CASE WHEN loc = 'Left' THEN CASE WHEN a_strand = b_strand THEN a_len - a_end ELSE a_start END WHEN loc = 'Right' THEN CASE WHEN a_strand = b_strand THEN a_start ELSE a_len - a_end END
  WHEN loc IN ('Contained', 'Equal') THEN greatest(a_start, a_len - a_end) ELSE -1 END AS a_overhang,
  CASE loc WHEN 'Left' THEN b_start WHEN 'Right' THEN b_len - b_end WHEN 'Containing' THEN greatest(b_start, b_len - b_end) WHEN 'Equal' THEN greatest(b_start, b_len - b_end) ELSE -1 END AS b_overhang FROM l"""
)
def overhang_by_location(spark, sf):
    a, b = X.overhangs_at(100)
    return overlaps(spark, sf).select(*KEY, a.alias("a_overhang"), b.alias("b_overhang"))


@query(
    f"""{WITH}, {HANGS} SELECT {_KEY}, CAST(CASE shape WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS INTEGER) AS a_mask,
  CAST(CASE shape WHEN 0 THEN CASE WHEN a_strand = b_strand THEN 2 ELSE 1 END WHEN 1 THEN CASE WHEN a_strand = b_strand THEN 1 ELSE 2 END WHEN 2 THEN 0 ELSE 3 END AS INTEGER) AS b_mask FROM m"""
)
def overhang_mask(spark, sf):
    a, b = X.overhang_masks()
    return overlaps(spark, sf).select(*KEY, a.alias("a_mask"), b.alias("b_mask"))


def _map_sql(p: str) -> str:
    return f"""CASE WHEN a_strand = b_strand THEN CASE WHEN {p} < a_start THEN b_start + ({p} - a_start) WHEN {p} < a_end THEN b_start + ({p} - a_start) * (b_end - b_start) // (a_end - a_start) ELSE b_end + ({p} - a_end) END
 ELSE CASE WHEN {p} > a_end THEN b_start - ({p} - a_end) WHEN {p} > a_start THEN b_start - ({p} - a_end) * (b_end - b_start) // (a_end - a_start) ELSE b_end - ({p} - a_start) END END"""


@query(f"{WITH} SELECT {_KEY}, {_map_sql('0')} AS head, {_map_sql('a_len')} AS tail, {_map_sql('(a_len // 2)')} AS middle FROM o")
def map_coords(spark, sf):
    at = lambda p: X.map_position(p, "a", "b")
    return overlaps(spark, sf).select(*KEY, at(F.lit(0)).alias("head"), at(F.col("a_len")).alias("tail"), at(F.expr("a_len div 2")).alias("middle"))


_TYPE = """CASE WHEN a_start <= {0} AND a_len - a_end <= {0} THEN 'Contained' WHEN b_start <= {0} AND b_len - b_end <= {0} THEN 'Contains'
 WHEN a_len - a_end <= {0} AND b_start <= {0} THEN 'Overlap' WHEN b_len - b_end <= {0} AND a_start <= {0} THEN 'Overlap' ELSE 'None' END"""


@query(f"{WITH} SELECT {_KEY}, {_TYPE.format(50)} AS kind FROM o")
def m4_type(spark, sf):
    return overlaps(spark, sf).select(*KEY, X.record_type(50).alias("kind"))


@query(f"{WITH} SELECT {_KEY}, {_TYPE.format(200)} <> 'None' AS good FROM o")
def good_overlap(spark, sf):
    return overlaps(spark, sf).select(*KEY, X.is_good(200).alias("good"))


@query(
    f"""{WITH} SELECT {_KEY}, CASE WHEN a_start <= 100 AND a_len - a_end <= 100 THEN true WHEN b_start <= 100 AND b_len - b_end <= 100 THEN true
 WHEN a_len - a_end <= 100 AND b_start > 100 THEN false WHEN a_len - a_end <= 100 AND a_end - a_start >= 1000 THEN true
 WHEN b_len - b_end <= 100 AND a_start > 100 THEN false WHEN b_len - b_end <= 100 AND a_end - a_start >= 1000 THEN true ELSE false END AS full_cov FROM o"""
)
def full_cov(spark, sf):
    return overlaps(spark, sf).select(*KEY, X.covers_fully(1000, 100).alias("full_cov"))


@query(f"{WITH} SELECT {_KEY}, (a_end - a_start >= 2000 OR b_end - b_start >= 2000 OR a_end - a_start >= a_len * 0.4 OR b_end - b_start >= b_len * 0.4) AS enough FROM o")
def mapping_range(spark, sf):
    return overlaps(spark, sf).select(*KEY, X.maps_enough(2000, 0.4).alias("enough"))


@query(
    f"""{WITH}, e AS (SELECT *, CASE WHEN a_strand = 0 THEN a_start ELSE a_len - a_end END AS ah, CASE WHEN a_strand = 0 THEN a_len - a_end ELSE a_start END AS ta,
  CASE WHEN b_strand = 0 THEN b_start ELSE b_len - b_end END AS bh, CASE WHEN b_strand = 0 THEN b_len - b_end ELSE b_start END AS tb FROM o)
SELECT {_KEY}, NOT ((ah > 50 AND bh > 50) OR (ta > 50 AND tb > 50)) AS agree FROM e"""
)
def ends_agree(spark, sf):
    return overlaps(spark, sf).select(*KEY, X.ends_agree(50).alias("agree"))


_SIMPLE = f"identity >= 92 AND a_id <> b_id AND a_len BETWEEN 3000 AND 9000 AND b_len BETWEEN 3000 AND 9000 AND {ALEN} >= 600 AND {loc_sql(100)} <> 'Abnormal'"


@query(f"{WITH} SELECT {ALL} FROM o WHERE {_SIMPLE}")
def simple_filter(spark, sf):
    return O.simple_filter(overlaps(spark, sf), 92, 3000, 9000, 600, 100)


#: One end of each read (ends of a and of b that meet) under a tolerance of 100.
def _pair_sql(a: str, b: str) -> tuple[str, str]:
    gap = lambda r, e: f"{r}_start" if e == "start" else f"({r}_len - {r}_end)"
    edge = lambda r, e: "0" if e == "start" else f"{r}_len"
    move = lambda r, e, g: f"{r}_{e} - {g}" if e == "start" else f"{r}_{e} + {g}"
    new_a = f"CASE WHEN {gap('a', a)} <= 100 THEN {edge('a', a)} WHEN {gap('b', b)} <= 100 THEN {move('a', a, gap('b', b))} ELSE a_{a} END"
    new_b = f"CASE WHEN {gap('b', b)} <= 100 THEN {edge('b', b)} WHEN {gap('a', a)} <= 100 THEN {move('b', b, gap('a', a))} ELSE b_{b} END"
    return new_a, new_b


_SAS, _SBS = _pair_sql("start", "start")
_SAE, _SBE = _pair_sql("end", "end")
_OAS, _OBE = _pair_sql("start", "end")
_OAE, _OBS = _pair_sql("end", "start")


def snap_sql(source: str) -> str:
    pick = lambda s, o, c: f"CASE WHEN NOT act THEN {c} WHEN a_strand = b_strand THEN {s} ELSE {o} END AS {c}"
    return f"""SELECT a_id, b_id, identity, a_strand, {pick(_SAS, _OAS, 'a_start')}, {pick(_SAE, _OAE, 'a_end')}, a_len, b_strand, {pick(_SBS, _OBS, 'b_start')}, {pick(_SBE, _OBE, 'b_end')}, b_len
FROM (SELECT *, ({loc_sql(0)} = 'Abnormal' AND {loc_sql(100)} <> 'Abnormal') AS act FROM {source})"""


@query(f"{WITH} {snap_sql('o')}")
def snap_ends(spark, sf):
    return O.snap_ends(overlaps(spark, sf), 100)


_SWAPPED = "b_id AS a_id, a_id AS b_id, identity, b_strand AS a_strand, b_start AS a_start, b_end AS a_end, b_len AS a_len, a_strand AS b_strand, a_start AS b_start, a_end AS b_end, a_len AS b_len"


@query(f"{WITH} SELECT {ALL} FROM o UNION ALL SELECT {_SWAPPED} FROM o")
def both_roles(spark, sf):
    return O.both_roles(overlaps(spark, sf))


@query(
    f"""{WITH} SELECT a_id, b_id, CASE WHEN b_strand = 1 THEN 1 - a_strand ELSE a_strand END AS a_strand, CASE WHEN b_strand = 1 THEN a_len - a_end ELSE a_start END AS a_start,
  CASE WHEN b_strand = 1 THEN a_len - a_start ELSE a_end END AS a_end, CASE WHEN b_strand = 1 THEN 0 ELSE b_strand END AS b_strand, CASE WHEN b_strand = 1 THEN b_len - b_end ELSE b_start END AS b_start,
  CASE WHEN b_strand = 1 THEN b_len - b_start ELSE b_end END AS b_end FROM o"""
)
def normalise_strand(spark, sf):
    return O.normalise_strand(overlaps(spark, sf), "b").drop("identity", "a_len", "b_len")


@query(f"{WITH} SELECT {_KEY}, round((1 - e) * (1 - e) + e * e / 3.0, 6) AS weight FROM (SELECT *, (100.0 - identity) / 200.0 AS e FROM (SELECT a_id, b_id, CAST(identity AS DOUBLE) AS identity, b_strand, a_start, a_end, b_start, b_end FROM o))")
def cns_weight(spark, sf):
    return overlaps(spark, sf).select(*KEY, F.round(X.consensus_weight(), 6).alias("weight"))


def dedupe_sql(source: str) -> str:
    return f"SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY least(a_id, b_id), greatest(a_id, b_id) ORDER BY {LONGER}) AS rn FROM {source}) WHERE rn = 1"


@query(f"{WITH} {dedupe_sql('o')}")
def dedupe_pairs(spark, sf):
    return O.dedupe_pairs(overlaps(spark, sf))


def best_sql(source: str, n: int) -> str:
    loc = loc_sql(0)
    return f"""SELECT DISTINCT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY rd, en ORDER BY {LONGER}) AS rn FROM (
  SELECT *, a_id AS rd, loc AS en FROM (SELECT *, {loc} AS loc FROM {source}) WHERE loc IN ('Left', 'Right')
  UNION ALL SELECT *, b_id AS rd, CASE WHEN b_id = a_id OR a_strand <> b_strand THEN loc WHEN loc = 'Left' THEN 'Right' ELSE 'Left' END AS en FROM (SELECT *, {loc} AS loc FROM {source}) WHERE loc IN ('Left', 'Right'))) WHERE rn <= {n}"""


@query(f"{WITH}, s AS ({snap_sql('o')}) {best_sql('s', 10)}")
def best_n_per_end(spark, sf):
    return O.best_n_per_end(O.snap_ends(overlaps(spark, sf), 100), 10)


@query(
    f"""{WITH}, c AS (SELECT *, count(*) OVER (PARTITION BY b_id) AS cnt FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY identity DESC, {LONGER}) AS rn FROM c WHERE cnt <= 100 OR identity >= 93) SELECT {ALL} FROM k WHERE rn <= 100"""
)
def top_m4_by_identity(spark, sf):
    return O.top_by_identity(overlaps(spark, sf), 100, 93)


@query(f"{WITH} SELECT {ALL} FROM o WHERE a_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND b_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def drop_filtered_reads(spark, sf):
    return O.drop_reads(overlaps(spark, sf), table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("read_id")))


@query(
    f"""{WITH}, t AS (SELECT *, CASE WHEN a_id IN (7, 11) THEN b_id ELSE a_id END AS other, CASE WHEN a_id IN (7, 11) THEN a_id ELSE b_id END AS mine FROM o WHERE a_id IN (7, 11) OR b_id IN (7, 11)),
n AS (SELECT other, count(DISTINCT mine) AS n FROM t GROUP BY other) SELECT {ALL}, t.other, n.n = 2 AS common FROM t JOIN n ON n.other = t.other"""
)
def common_neighbours(spark, sf):
    return O.touching(overlaps(spark, sf), 7, 11)


def _side_sql(name: str, source: str) -> str:
    pick = lambda k: f"CASE WHEN a_id <= b_id THEN a_{k} ELSE b_{k} END AS {k}0, CASE WHEN a_id <= b_id THEN b_{k} ELSE a_{k} END AS {k}1"
    return f"{name} AS (SELECT least(a_id, b_id) AS x, greatest(a_id, b_id) AS y, {pick('start')}, {pick('end')} FROM ({dedupe_sql(source)}))"


@query(
    f"""{WITH}, p AS (SELECT * FROM o WHERE identity >= 94), q AS (SELECT * FROM o WHERE identity <= 96), {_side_sql('l', 'p')}, {_side_sql('r', 'q')}
SELECT coalesce(l.x, r.x) AS x, coalesce(l.y, r.y) AS y, CASE WHEN r.x IS NULL THEN 'left' WHEN l.x IS NULL THEN 'right'
  WHEN abs(l.start0 - r.start0) <= 50 AND abs(l.start1 - r.start1) <= 50 AND abs(l.end0 - r.end0) <= 50 AND abs(l.end1 - r.end1) <= 50 THEN 'both' ELSE 'moved' END AS status
FROM l FULL JOIN r ON l.x = r.x AND l.y = r.y"""
)
def compare_sets(spark, sf):
    o = overlaps(spark, sf)
    return O.compare_sets(o.where("identity >= 94"), o.where("identity <= 96"), 50)


@query(
    f"""{WITH}, m AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS new_id FROM (SELECT a_id AS read_id FROM o WHERE a_len >= 4000 UNION SELECT b_id FROM o WHERE b_len >= 4000))
SELECT x.new_id AS a_id, y.new_id AS b_id, identity, a_strand, a_start, a_end, a_len, b_strand, b_start, b_end, b_len FROM o JOIN m x ON x.read_id = a_id JOIN m y ON y.read_id = b_id"""
)
def remap_ids(spark, sf):
    from helixframe.operators.reads import renumber

    o = overlaps(spark, sf)
    kept = o.where("a_len >= 4000").select(F.col("a_id").alias("read_id")).union(o.where("b_len >= 4000").select("b_id")).distinct()
    ids = renumber(kept, "read_id", first=0)
    return O.remap_ids(o, ids)


_PARTS = f"""{WITH}, sn AS ({snap_sql(f"({dedupe_sql('o')})")}), s AS (SELECT *, {loc_sql(0)} AS loc FROM sn WHERE a_id <> b_id)"""


def _snapped(spark, sf):
    return O.snap_ends(O.dedupe_pairs(overlaps(spark, sf)), 100).where("a_id <> b_id")


@query(
    f"""{_PARTS} SELECT read_id, min(container) AS container FROM (
  SELECT CASE loc WHEN 'Contained' THEN a_id WHEN 'Containing' THEN b_id ELSE greatest(a_id, b_id) END AS read_id, CASE loc WHEN 'Contained' THEN b_id WHEN 'Containing' THEN a_id ELSE least(a_id, b_id) END AS container
  FROM s WHERE loc IN ('Contained', 'Containing', 'Equal')) GROUP BY read_id"""
)
def contained_reads(spark, sf):
    return filters.contained_reads(_snapped(spark, sf))


def _need(x: str, y: str, end: int, far: str) -> str:
    return f"{{'x': {x}, 'y': {y}, 'e': {end}, 'far': {far}}}"


_H = {(r, e): (f"{r}_start > 2000" if e == 0 else f"{r}_len - {r}_end > 2000") for r in "ab" for e in (0, 1)}


def _list(*needs) -> str:
    return "[" + ", ".join(_need(*n) for n in needs) + "]"


_A, _B = "a_id", "b_id"
_NEEDS = f"""CASE
 WHEN loc = 'Left' AND a_strand = b_strand THEN {_list((_A, _B, 1, _H['b', 1]), (_B, _A, 0, _H['a', 0]))}
 WHEN loc = 'Right' AND a_strand = b_strand THEN {_list((_A, _B, 0, _H['b', 0]), (_B, _A, 1, _H['a', 1]))}
 WHEN loc = 'Containing' AND a_strand = b_strand THEN {_list((_B, _A, 0, _H['a', 0]), (_B, _A, 1, _H['a', 1]))}
 WHEN loc = 'Contained' AND a_strand = b_strand THEN {_list((_A, _B, 0, _H['b', 0]), (_A, _B, 1, _H['b', 1]))}
 WHEN loc = 'Left' THEN {_list((_A, _B, 0, _H['b', 1]), (_B, _A, 0, _H['a', 1]))}
 WHEN loc = 'Right' THEN {_list((_A, _B, 1, _H['b', 0]), (_B, _A, 1, _H['a', 0]))}
 WHEN loc = 'Containing' THEN {_list((_B, _A, 0, _H['a', 1]), (_B, _A, 1, _H['a', 0]))}
 WHEN loc = 'Contained' THEN {_list((_A, _B, 0, _H['b', 1]), (_A, _B, 1, _H['b', 0]))}
 WHEN loc = 'Equal' THEN {_list((_A, _B, 0, 'false'), (_A, _B, 1, 'false'), (_B, _A, 0, 'false'), (_B, _A, 1, 'false'))}
 ELSE {_list((_A, _B, 0, 'false'), (_A, _B, 1, 'false'))} END"""


def _side_nbr(r: str, o: str) -> str:
    return f"""SELECT {r}_id AS rd, {o}_id AS other, {r}_start <= 100 AS near0, {r}_len - {r}_end <= 100 AS near1,
 CASE WHEN a_strand = b_strand THEN {o}_start ELSE {o}_len - {o}_end END > 100 AS far0, CASE WHEN a_strand = b_strand THEN {o}_len - {o}_end ELSE {o}_start END > 100 AS far1 FROM s"""


_WEAK = f"""nb AS ({_side_nbr('a', 'b')} UNION ALL {_side_nbr('b', 'a')}),
nd AS (SELECT a_id, b_id, n.x AS x, n.y AS y, n.e AS e, n.far AS far FROM (SELECT a_id, b_id, unnest({_NEEDS}) AS n FROM s)),
mt AS (SELECT nd.a_id, nd.b_id, nd.x, nd.e, count(*) AS n FROM nd JOIN nb ON nb.rd = nd.x AND nb.other <> nd.y JOIN nb c ON c.rd = nd.y AND c.other = nb.other
  WHERE CASE WHEN nd.e = 0 THEN CASE WHEN nd.far THEN nb.far0 ELSE nb.near0 END ELSE CASE WHEN nd.far THEN nb.far1 ELSE nb.near1 END END GROUP BY 1, 2, 3, 4),
wk AS (SELECT DISTINCT nd.a_id, nd.b_id FROM nd LEFT JOIN mt ON mt.a_id = nd.a_id AND mt.b_id = nd.b_id AND mt.x = nd.x AND mt.e = nd.e WHERE coalesce(mt.n, 0) < """


@query(f"{_PARTS}, {_WEAK} 40) SELECT a_id, b_id FROM wk")
def support_join(spark, sf):
    return filters.lacking_support(_snapped(spark, sf), 40, 100)


_OWN = {(r, e): f"CASE WHEN {r}_strand = 1 THEN {r}_len - {r}_{'end' if e == 'start' else 'start'} ELSE {r}_{e} END" for r in "ab" for e in ("start", "end")}


@query(
    f"""{WITH}, w AS (SELECT *, {_OWN['a', 'start']} AS p, {_OWN['a', 'end']} AS q, {_OWN['b', 'start']} AS u, {_OWN['b', 'end']} AS v FROM o),
f AS (SELECT * FROM w WHERE (a_start <= 100 AND a_len - a_end <= 100) OR (b_start <= 100 AND b_len - b_end <= 100)
  OR (((a_len - q <= 100 AND u <= 100) OR (b_len - v <= 100 AND p <= 100)) AND (q - p >= a_len * 0.6 OR v - u >= b_len * 0.6))),
k AS (SELECT a_id FROM f GROUP BY a_id HAVING count(*) = 1)
SELECT a_id, b_id, identity, CASE WHEN b_strand = 1 THEN 1 - a_strand ELSE a_strand END AS a_strand, a_start, a_end, a_len, CAST(0 AS BIGINT) AS b_strand, b_start, b_end, b_len
FROM f WHERE a_id IN (SELECT a_id FROM k) AND identity >= 90"""
)
def polish_filter(spark, sf):
    return filters.sole_full_mapping(overlaps(spark, sf))


_EDGE = f"""e0 AS (SELECT CASE WHEN loc = 'Left' AND a_strand = b_strand THEN a_id + 1 WHEN loc = 'Right' AND a_strand = b_strand THEN -a_id - 1 WHEN loc = 'Left' THEN -a_id - 1 ELSE a_id + 1 END AS src,
  CASE WHEN loc = 'Left' AND a_strand = b_strand THEN b_id + 1 WHEN loc = 'Right' AND a_strand = b_strand THEN -b_id - 1 WHEN loc = 'Left' THEN b_id + 1 ELSE -b_id - 1 END AS dst,
  CASE WHEN loc = 'Left' THEN b_len - b_end ELSE b_start END AS ahead,
  CASE WHEN a_strand = b_strand THEN CASE WHEN loc = 'Left' THEN a_start ELSE a_len - a_end END ELSE CASE WHEN loc = 'Left' THEN a_len - a_end ELSE a_start END END AS back, identity, a_end - a_start AS overlap FROM s WHERE loc IN ('Left', 'Right')),
e1 AS (SELECT src, dst, ahead AS length, identity, overlap FROM e0 UNION ALL SELECT -dst, -src, back, identity, overlap FROM e0),
e AS (SELECT src, dst, length, identity, overlap FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY overlap DESC, length, identity) AS rn FROM e1) WHERE rn = 1)"""


@query(f"{_PARTS}, {_EDGE} SELECT * FROM e")
def string_edges(spark, sf):
    return graph.edges(_snapped(spark, sf))


@query(f"{_PARTS}, {_EDGE} SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst WHERE abs(x.length + y.length - z.length) <= 500 AND x.length < z.length")
def transitive_2path(spark, sf):
    return graph.transitive(graph.edges(_snapped(spark, sf)), 500)


@query(
    f"""{_PARTS}, {_EDGE} SELECT src, dst, length, identity, overlap FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY overlap DESC, identity DESC, length, abs(dst), dst) AS r0,
  row_number() OVER (PARTITION BY dst ORDER BY overlap DESC, identity DESC, length, abs(src), src) AS r1 FROM e) WHERE r0 = 1 AND r1 = 1"""
)
def best_edges(spark, sf):
    return graph.best_edges(graph.edges(_snapped(spark, sf)))
