"""Registered queries over records: raw reads, candidates, aligned strings, pieces and volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.sequence import fetch
from helixframe.operators import bridge, kernels, kmers, trim
from helixframe.operators import overlaps as O  # noqa: E741
from helixframe.operators import reads as R
from helixframe.plans.chain_queries import query_into
from helixframe.plans.fixtures import LAYOUT_SQL, READS_SQL, layout, overlaps, reads, references, table
from helixframe.plans.overlap_queries import ALL, WITH
from helixframe.plans.read_queries import _SEEDS
from helixframe.plans.store import new_folder
from helixframe.sources import volumes as V

QUERIES, SQL = {}, {}
query = query_into(QUERIES, SQL)
_R = f"WITH r AS ({READS_SQL})"
#: Documents as raw reads: other letters and wrong quality lengths are among them.
_RAW = """WITH w AS (SELECT doc_id AS read_id, upper(substring(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 1, 400)) AS t FROM documents),
x AS (SELECT read_id, CASE WHEN read_id % 3 = 0 THEN t ELSE regexp_replace(t, '[^ACGT]', 'A', 'g') END AS seq FROM w),
q AS (SELECT read_id, seq, repeat('!', CAST(length(seq) - CASE WHEN read_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER)) AS quality FROM x)"""


def _raw(spark, sf):
    t = F.upper(F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), 1, 400))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), t.alias("t"))
    rows = rows.select("read_id", F.when(F.col("read_id") % 3 == 0, F.col("t")).otherwise(F.regexp_replace("t", "[^ACGT]", "A")).alias("seq"))
    return rows.withColumn("quality", F.expr("repeat('!', cast(length(seq) - case when read_id % 7 = 0 then 1 else 0 end as int))"))


@query(f"{_RAW} SELECT read_id, length(seq) AS len, length(seq) >= 200 AS kept FROM q WHERE regexp_full_match(seq, '[ACGTacgt]*') AND length(quality) = length(seq)")
def raw_reads_split(spark, sf):
    kept, garbage = R.split_raw(_raw(spark, sf), 200)
    pick = lambda d, v: d.select("read_id", F.length("seq").cast("long").alias("len"), F.lit(v).alias("kept"))
    return pick(kept, True).unionByName(pick(garbage, False))


@query(f"{_RAW} SELECT read_id, CAST(i AS BIGINT) AS position, substring(seq, i + 1, 1) AS base FROM q, unnest(range(0, length(seq))) AS u(i) WHERE NOT regexp_full_match(substring(seq, i + 1, 1), '[ACGTacgt]')")
def illegal_bases(spark, sf):
    return R.illegal_bases(_raw(spark, sf)).select("read_id", F.col("position").cast("long").alias("position"), "base")


@query(f"{_R} SELECT read_id, CASE WHEN read_id % 2 = 0 THEN substring(seq, 11, 90) ELSE translate(reverse(substring(seq, 11, 90)), 'ACGT', 'TGCA') END AS part FROM r")
def fetch_sequence(spark, sf):
    return reads(spark, sf).select("read_id", fetch(F.col("seq"), F.lit(10), F.lit(100), F.col("read_id") % 2).alias("part"))


@query(f"{_R} SELECT read_id, CAST(regexp_extract('x' || (read_id * 37) % 1000 || '_' || read_id, '([0-9]+)', 1) AS BIGINT) AS number FROM r")
def id_in_name(spark, sf):
    return reads(spark, sf).select("read_id", R.id_in_name(F.concat(F.lit("x"), (F.col("read_id") * 37) % 1000, F.lit("_"), F.col("read_id"))).alias("number"))


@query(f"{WITH} SELECT a_id, b_id, a_start, a_end, b_start, b_end, '(' || a_start || '_' || a_end || '_' || (a_end - a_start) || '_' || a_len || '_' || b_id || '_' || b_start || '_' || identity || '.00)' AS header FROM o")
def corrected_header(spark, sf):
    c = F.col
    return overlaps(spark, sf).select("a_id", "b_id", "a_start", "a_end", "b_start", "b_end", R.corrected_header(c("a_start"), c("a_end"), c("a_end") - c("a_start"), c("a_len"), c("b_id"), c("b_start"), c("identity")).alias("header"))


_C = f"""{WITH}, c AS (SELECT a_id AS qid, b_id AS sid, (a_start * 977 + b_end * 31) % 2000000 AS score, a_strand AS qdir, a_start AS qbeg, a_end AS qend, CASE WHEN a_end % 2 = 0 THEN a_start ELSE a_start + 7 END AS qoff, a_len AS qsize,
 b_strand AS sdir, b_start AS sbeg, b_end AS send, CASE WHEN a_end % 2 = 0 THEN b_start ELSE b_start + 7 END AS soff, b_len AS ssize FROM o)"""


def _candidates(spark, sf):
    return overlaps(spark, sf).selectExpr(
        "a_id as qid", "b_id as sid", "(a_start * 977 + b_end * 31) % 2000000 as score", "a_strand as qdir", "a_start as qbeg", "a_end as qend", "case when a_end % 2 = 0 then a_start else a_start + 7 end as qoff", "a_len as qsize",
        "b_strand as sdir", "b_start as sbeg", "b_end as send", "case when a_end % 2 = 0 then b_start else b_start + 7 end as soff", "b_len as ssize",
    )


@query(f"{_C} SELECT qid, sid, least(score, 1000000) AS score, qdir, qbeg, qend, CASE WHEN qoff = qbeg THEN qbeg ELSE qend END AS qoff, sdir, sbeg, send, CASE WHEN qoff = qbeg THEN sbeg ELSE send END AS soff FROM c")
def packed_candidates(spark, sf):
    """Packed and unpacked again."""
    return O.unpack_candidates(O.pack_candidates(_candidates(spark, sf)))


@query(f"{_C}, k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, qid, qdir, qbeg, sbeg, sid) AS rn FROM (SELECT DISTINCT * FROM c)) SELECT qid, sid, score, qdir, qbeg, qend FROM k WHERE rn <= 30")
def top_candidates(spark, sf):
    return O.top_candidates(_candidates(spark, sf).distinct(), "sid", 30).select("qid", "sid", "score", "qdir", "qbeg", "qend")


@query(f"{_C}, k AS (SELECT *, row_number() OVER (PARTITION BY qid, sid, qdir ORDER BY score DESC, qbeg, sbeg, qend, send) AS rn FROM c) SELECT qid, sid, qdir, score, qbeg, sbeg, qend, send FROM k WHERE rn = 1")
def best_of_each_pair(spark, sf):
    return kernels.uncontained(_candidates(spark, sf)).select("qid", "sid", "qdir", "score", "qbeg", "sbeg", "qend", "send")


@query(
    f"""{_SEEDS}, b AS (SELECT qid, qdir, sid, soff // 2000 AS block, qoff, min(soff) AS soff FROM seeds GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, qdir, sid, block ORDER BY qoff) AS rn FROM b) WHERE rn <= 40),
c AS (SELECT x.qid, x.qdir, x.sid, x.block, x.qoff, x.soff, count(y.qoff) AS support FROM k x LEFT JOIN k y ON y.qid = x.qid AND y.qdir = x.qdir AND y.sid = x.sid AND y.block = x.block
  AND (x.qoff - y.qoff) * (x.soff - y.soff) > 0 AND abs((x.soff - y.soff) / CAST(nullif(x.qoff - y.qoff, 0) AS DOUBLE) - 1) < 0.25 GROUP BY 1, 2, 3, 4, 5, 6)
SELECT qid, qdir, sid, block, qoff, soff, support FROM (SELECT *, row_number() OVER (PARTITION BY qid, qdir, sid, block ORDER BY support DESC, qoff, soff) AS rn FROM c) WHERE rn = 1"""
)
def seed_support(spark, sf):
    return kmers.seed_support(kmers.reference_seeds(reads(spark, sf), references(spark, sf)))


#: Each read's first 60 bases beside a changed copy, column by column.
_ALN = f"""{_R}, p AS (SELECT read_id, substring(seq, 1, 60) AS a, regexp_replace(regexp_replace(substring(seq, 1, 60), 'ACG', 'A-G', 'g'), 'TT', 'TC', 'g') AS b FROM r WHERE length(seq) >= 60),
l AS (SELECT read_id % 50 AS sid, read_id AS qid, 0 AS qdir, 90.0::DOUBLE + read_id % 10 AS identity, read_id % 13 AS sbeg, CASE WHEN read_id % 2 = 0 THEN a ELSE b END AS q_aln, CASE WHEN read_id % 2 = 0 THEN b ELSE a END AS s_aln FROM p)"""


def _aligned(spark, sf):
    a = F.substring("seq", 1, 60)
    b = F.regexp_replace(F.regexp_replace(a, "ACG", "A-G"), "TT", "TC")
    even = F.col("read_id") % 2 == 0
    return reads(spark, sf).where(F.length("seq") >= 60).select((F.col("read_id") % 50).alias("sid"), F.col("read_id").alias("qid"), F.lit(0).alias("qdir"), (90.0 + F.col("read_id") % 10).alias("identity"), (F.col("read_id") % 13).alias("sbeg"), F.when(even, a).otherwise(b).alias("q_aln"), F.when(even, b).otherwise(a).alias("s_aln"))


@query(
    f"""{_ALN}, c AS (SELECT sid, qid, sbeg, (1 - (100 - identity) / 200) ** 2 + ((100 - identity) / 200) ** 2 / 3 AS weight, CAST(i AS BIGINT) AS i, substring(q_aln, i + 1, 1) AS base, substring(s_aln, i + 1, 1) AS t FROM l, unnest(range(0, length(q_aln))) AS u(i)),
d AS (SELECT *, sbeg - 1 + sum(CASE WHEN t <> '-' THEN 1 ELSE 0 END) OVER w AS t_pos, max(CASE WHEN t <> '-' THEN i END) OVER w AS last FROM c WINDOW w AS (PARTITION BY qid ORDER BY i ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, CASE WHEN t = '-' THEN i - coalesce(last, -1) ELSE 0 END AS delta FROM d),
f AS (SELECT *, coalesce(lag(t_pos) OVER w, -1) AS p_t_pos, coalesce(lag(delta) OVER w, 0) AS p_delta, coalesce(lag(base) OVER w, '-') AS p_base FROM e WINDOW w AS (PARTITION BY qid ORDER BY i))
SELECT sid, CAST(t_pos AS BIGINT) AS t_pos, delta, base, CAST(p_t_pos AS BIGINT) AS p_t_pos, p_delta, p_base, round(sum(weight), 6) AS weight, count(*) AS n FROM f GROUP BY ALL"""
)
def column_counts(spark, sf):
    return kernels.column_counts(_aligned(spark, sf)).withColumn("weight", F.round("weight", 6))


_CIG = "(40 + a_id % 30) || '=' || (1 + b_id % 3) || 'X' || (a_start % 60 + 1) || '=' || (1 + a_len % 4) || 'I' || (b_start % 50 + 5) || '=' || (1 + b_end % 5) || 'D' || (a_end % 70 + 20) || '='"


_ID = "a_id || '_' || b_id || '_' || a_start || '_' || a_end || '_' || b_start || '_' || b_end || '_' || b_strand"


@query(
    f"""{WITH}, g AS (SELECT DISTINCT {_ID} AS id, {_CIG} AS cigar FROM o),
t AS (SELECT id, i, CAST(regexp_extract(op, '[0-9]+') AS BIGINT) AS n, right(op, 1) AS op FROM (SELECT id, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[=XID]'), 1) AS i, unnest(regexp_extract_all(cigar, '[0-9]+[=XID]')) AS op FROM g)),
p AS (SELECT *, coalesce(sum(CASE WHEN op <> 'I' THEN n ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM t),
z AS (SELECT id, sum(n) AS size FROM p WHERE op <> 'I' GROUP BY id), e AS (SELECT id, low + j AS pos, 1 AS e FROM p, unnest(range(0, n)) AS u(j) WHERE op IN ('X', 'D') UNION ALL SELECT id, low, n FROM p WHERE op = 'I'),
b AS (SELECT z.id, z.j AS pos, coalesce(sum(e.e), 0) AS e FROM (SELECT id, unnest(range(0, CAST(size AS BIGINT))) AS j FROM z WHERE size >= 100) z LEFT JOIN e ON e.id = z.id AND e.pos = z.j GROUP BY 1, 2),
s AS (SELECT id, pos, sum(e) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS errors FROM b) SELECT id, CAST(max(errors) AS BIGINT) AS errors FROM s GROUP BY id"""
)
def worst_error_window(spark, sf):
    rows = overlaps(spark, sf).select(F.expr(_ID).alias("id"), F.expr(_CIG).alias("cigar")).distinct()
    return O.worst_error_window(rows).select("id", "errors")


@query(f"WITH o AS ({LAYOUT_SQL}), r AS (SELECT DISTINCT b_id AS read_id, b_len AS size, (b_id * 7) % 60 AS lo, b_len - (b_id * 11) % 60 AS hi FROM o) SELECT read_id, CASE WHEN lo <= 20 AND size - hi <= 20 THEN 'complete' ELSE 'trimmed' END AS kind, CASE WHEN lo <= 20 AND size - hi <= 20 THEN size ELSE hi - lo END AS len FROM r")
def trim_split(spark, sf):
    o = layout(spark, sf).select("b_id", "b_len").distinct()
    ranges = o.selectExpr("b_id as read_id", "(b_id * 7) % 60 as left", "b_len - (b_id * 11) % 60 as right", "b_len as size")
    own = o.select(F.col("b_id").alias("read_id"), F.expr("repeat('A', cast(b_len as int))").alias("seq"))
    whole, cut = trim.split_reads(own, ranges)
    pick = lambda d, k: d.select("read_id", F.lit(k).alias("kind"), F.length("seq").cast("long").alias("len"))
    return pick(whole, "complete").unionByName(pick(cut, "trimmed"))


@query(f"{WITH} SELECT a_id % 100 AS qid, a_start + (a_id // 100) * 5000 AS qbeg, a_end + (a_id // 100) * 5000 AS qend, b_id % 100 AS sid, b_start + (b_id // 100) * 5000 AS sbeg, b_end + (b_id // 100) * 5000 AS send FROM o WHERE a_id % 100 <> b_id % 100")
def from_pieces(spark, sf):
    o = overlaps(spark, sf)
    pieces = o.select(F.col("a_id").alias("piece")).union(o.select("b_id")).distinct().selectExpr("piece", "piece % 100 as read_id", "piece div 100 * 5000 as start")
    hits = o.select(F.col("a_id").alias("qid"), F.col("a_start").alias("qbeg"), F.col("a_end").alias("qend"), F.col("b_id").alias("sid"), F.col("b_start").alias("sbeg"), F.col("b_end").alias("send"))
    return bridge.from_pieces(hits, pieces)


@query(f"{_R} SELECT read_id, length(seq) AS len FROM r UNION ALL SELECT read_id + (SELECT max(read_id) + 1 FROM r), length(seq) FROM r")
def merged_volumes(spark, sf):
    v = reads(spark, sf)
    return R.merge_volumes([v, v]).select("read_id", F.length("seq").cast("long").alias("len"))


@query(f"{WITH} SELECT {ALL} FROM o WHERE identity >= 97 UNION ALL SELECT b_id, a_id, identity, b_strand, b_start, b_end, b_len, a_strand, a_start, a_end, a_len FROM o WHERE identity >= 97")
def by_subject(spark, sf):
    return O.by_subject(overlaps(spark, sf), 97)


@query(f"{WITH} SELECT {ALL} FROM o WHERE a_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) AND b_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def without_names(spark, sf):
    """Reads are named by part keys, of which those of large parts are listed."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("read_id"), F.concat(F.lit("read-"), "p_partkey").alias("name"), "p_size")
    return O.without_names(overlaps(spark, sf), parts.where("p_size > 25"), parts)


@query(f"{_R} SELECT read_id, length(seq) AS len, md5(seq) AS bases FROM r")
def packed_volumes(spark, sf):
    """Through volumes of two-bit bases and back."""
    where = new_folder(spark, "volumes")
    V.write_volumes(reads(spark, sf), where, 1_000_000)
    return V.read_volumes(spark, where).select("read_id", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("bases"))


@query(f"{_C} SELECT qid, sid, score, qdir, qbeg, qend, qoff, qsize, sdir, sbeg, send, soff, ssize FROM c")
def binary_candidates(spark, sf):
    """Through fixed-width binary records and back."""
    where = new_folder(spark, "candidates")
    V.write_records(_candidates(spark, sf), where)
    return V.read_records(spark, where)


@query(
    f"""{_R}, i AS (SELECT read_id, length(seq) AS len, CAST(sum(length(seq)) OVER (ORDER BY read_id ROWS UNBOUNDED PRECEDING) - length(seq) AS BIGINT) AS start FROM r),
q AS (SELECT l_orderkey * 7 + l_linenumber AS id, l_orderkey * 31 + l_linenumber * 977 AS "offset" FROM lineitem),
m AS (SELECT q.*, i.read_id, i.start, i.len FROM q ASOF LEFT JOIN (SELECT * FROM i WHERE len > 0) i ON q."offset" >= i.start)
SELECT id, "offset", CASE WHEN "offset" < start + len THEN read_id END AS read_id, CASE WHEN "offset" < start + len THEN "offset" - start END AS place FROM m"""
)
def offset_to_read(spark, sf):
    offsets = table(spark, sf, "lineitem").selectExpr("l_orderkey * 7 + l_linenumber as id", "l_orderkey * 31 + l_linenumber * 977 as offset")
    return V.reads_at(offsets, V.starts(reads(spark, sf)))
