"""Reads and overlaps made from tables that hold neither, for tests and registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def _as_bases(text: str):
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), _LETTERS, _BASES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), _as_bases("text").alias("seq"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), _as_bases("text").alias("seq"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap rows of every class and strand, computed from order lines."""
    t = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 500 as a_id", "l_partkey % 500 as b_id", "l_orderkey * 31 + l_partkey * 17 + l_linenumber as h",
        "cast(l_quantity as bigint) % 2 as b_strand", "90 + cast(round(l_discount * 100) as bigint) as identity",
    )
    t = t.selectExpr("*", "3000 + (a_id * 7919) % 7000 as a_len", "3000 + (b_id * 7919) % 7000 as b_len", "500 + h % 1900 as span", "(h % 7) * 20 as oh", "h % 5 as kind")
    k = F.col("kind")
    start = F.expr("case kind when 0 then a_len - oh - span when 1 then oh when 2 then oh when 3 then 100 else 400 end")
    end = F.expr("case kind when 0 then a_len - oh when 1 then oh + span when 2 then a_len - oh when 3 then 100 + span else 400 + span end")
    t = t.withColumns({"a_start": start, "a_end": end})
    head = (k == 0) == (F.col("b_strand") == 0)
    b_start = F.when(k.isin(0, 1) & head, F.col("oh")).when(k.isin(0, 1), F.expr("b_len - oh - span")).when(k == 2, F.expr("oh div 2")).when(k == 3, F.col("oh")).otherwise(400)
    t = t.withColumn("b_start", b_start)
    b_end = F.when(k.isin(0, 1), F.expr("b_start + span")).when(k == 3, F.expr("b_len - oh")).otherwise(F.expr("least(b_len, b_start + a_end - a_start)"))
    t = t.withColumns({"b_end": b_end, "a_strand": F.lit(0).cast("long")})
    names = ["a_id", "b_id", "identity", "a_strand", "a_start", "a_end", "a_len", "b_strand", "b_start", "b_end", "b_len"]
    # generated rows, so that what reads them isn't rewritten over the expressions above
    return t.select(F.inline(F.array(F.struct(*names))))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with places on one long line, one a customer: id, p0, p1 (half-open), rev (which strand they show)."""
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_custkey * 400 + (c_custkey * 7919) % 200 as p0", "3000 + (c_custkey * 104729) % 2500 as size", "(c_custkey * 31) % 7 % 2 as rev")
    return t.selectExpr("id", "p0", "p0 + size as p1", "rev")


def _on_read(r: str, lo: str, hi: str) -> list[str]:
    """Where the stretch lo..hi of the line stands on read r."""
    return [f"case when {r}_rev = 0 then {lo} - {r}_p0 else {r}_p1 - {hi} end as {r}_start", f"case when {r}_rev = 0 then {hi} - {r}_p0 else {r}_p1 - {lo} end as {r}_end", f"{r}_p1 - {r}_p0 as {r}_len"]


_PAIR = ["a_id", "b_id", "90.0D + (a_id * 13 + b_id * 7) % 10 as identity", "0L as a_strand", *_on_read("a", "lo", "hi"), "cast(case when a_rev = b_rev then 0 else 1 end as bigint) as b_strand", *_on_read("b", "lo", "hi")]


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of at least 500 bases between ``placed`` reads up to 14 ids apart: geometry that fits together."""
    p = placed(spark, sf_dir)
    near = p.selectExpr(*[f"{c} as a_{c}" for c in p.columns], "explode(sequence(id + 1, id + 14)) as b_id")
    pairs = near.join(p.selectExpr("id as b_id", "p0 as b_p0", "p1 as b_p1", "rev as b_rev"), "b_id").selectExpr("*", "greatest(a_p0, b_p0) as lo", "least(a_p1, b_p1) as hi").where("hi - lo >= 500")
    rows = pairs.selectExpr(*_PAIR)
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


#: Bases of a contig that holds several reads, and of one that a read may reach across.
CONTIG, SHORT = 9000, 1800


def mapped(spark: SparkSession, sf_dir: str, contig: int = CONTIG) -> DataFrame:
    """``placed`` reads (a) on contigs (b) of ``contig`` bases of the line, each contig 300 bases longer than its share."""
    p = placed(spark, sf_dir).selectExpr("id as a_id", "p0 as a_p0", "p1 as a_p1", "rev as a_rev", f"explode(sequence(greatest((p0 - 300) div {contig}, 0L), p1 div {contig})) as b_id")
    p = p.selectExpr("*", f"b_id * {contig} as b_p0", f"(b_id + 1) * {contig} + 300 as b_p1", "(b_id % 3) div 2 as b_rev").selectExpr("*", "greatest(a_p0, b_p0) as lo", "least(a_p1, b_p1) as hi").where("hi - lo >= 100")
    rows = p.selectExpr(*_PAIR)
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reads (a) on each folded read (b), once on each strand, with gaps of many sizes."""
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey as b_id", "explode(sequence(1, 3)) as k", "(c_custkey * 37) % 900 as e")
    t = t.selectExpr("*", "explode(array(0, 1)) as s")
    rows = t.selectExpr(
        "b_id + k as a_id", "b_id", "90.0D + k as identity", "cast(s as bigint) as a_strand", "cast(k * 10 as bigint) as a_start", "2000L as a_end", "2000L as a_len",
        "0L as b_strand", "case s when 0 then e else 2000L + e div 2 end as b_start", "case s when 0 then 2000L + (e % 7) * 40 else 4000L end as b_end", "4000L as b_len",
    )
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _sql(expr: str) -> str:
    return expr.replace("90.0D", "90.0::DOUBLE").replace("0L as", "0::BIGINT as")


_PLACED = "SELECT c_custkey AS id, c_custkey * 400 + (c_custkey * 7919) % 200 AS p0, c_custkey * 400 + (c_custkey * 7919) % 200 + 3000 + (c_custkey * 104729) % 2500 AS p1, (c_custkey * 31) % 7 % 2 AS rev FROM customer"
_PAIR_SQL = ", ".join(map(_sql, _PAIR))
PLACED_SQL = _PLACED
LAYOUT_SQL = f"""SELECT {_PAIR_SQL} FROM (SELECT a.id AS a_id, a.p0 AS a_p0, a.p1 AS a_p1, a.rev AS a_rev, b.id AS b_id, b.p0 AS b_p0, b.p1 AS b_p1, b.rev AS b_rev, greatest(a.p0, b.p0) AS lo, least(a.p1, b.p1) AS hi
 FROM ({_PLACED}) a JOIN ({_PLACED}) b ON b.id BETWEEN a.id + 1 AND a.id + 14) WHERE hi - lo >= 500"""


def mapped_sql(contig: int = CONTIG) -> str:
    return f"""SELECT {_PAIR_SQL} FROM (SELECT *, greatest(a_p0, b_p0) AS lo, least(a_p1, b_p1) AS hi FROM (SELECT id AS a_id, p0 AS a_p0, p1 AS a_p1, rev AS a_rev, b_id, b_id * {contig} AS b_p0, (b_id + 1) * {contig} + 300 AS b_p1, (b_id % 3) // 2 AS b_rev
 FROM ({_PLACED}) p, unnest(range(greatest((p0 - 300) // {contig}, 0), p1 // {contig} + 1)) AS u(b_id))) WHERE hi - lo >= 100"""


FOLDED_SQL = """SELECT c_custkey + k AS a_id, c_custkey AS b_id, 90.0::DOUBLE + k AS identity, s AS a_strand, k * 10 AS a_start, 2000 AS a_end, 2000 AS a_len, 0 AS b_strand,
 CASE s WHEN 0 THEN (c_custkey * 37) % 900 ELSE 2000 + ((c_custkey * 37) % 900) // 2 END AS b_start, CASE s WHEN 0 THEN 2000 + ((c_custkey * 37) % 900) % 7 * 40 ELSE 4000 END AS b_end, 4000 AS b_len
 FROM customer, (VALUES (1), (2), (3)) AS x(k), (VALUES (0), (1)) AS y(s)"""
READS_SQL = f"""SELECT doc_id AS read_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{_BASES}') AS seq FROM documents"""
REFERENCES_SQL = f"""SELECT item_id AS read_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{_BASES}') AS seq FROM benchmark"""
OVERLAPS_SQL = """
SELECT a_id, b_id, identity, CAST(0 AS BIGINT) AS a_strand, a_start, a_end, a_len, b_strand, b_start,
       CASE WHEN kind IN (0, 1) THEN b_start + span WHEN kind = 3 THEN b_len - oh ELSE least(b_len, b_start + a_end - a_start) END AS b_end, b_len
FROM (SELECT *,
        CASE kind WHEN 0 THEN a_len - oh - span WHEN 1 THEN oh WHEN 2 THEN oh WHEN 3 THEN 100 ELSE 400 END AS a_start,
        CASE kind WHEN 0 THEN a_len - oh WHEN 1 THEN oh + span WHEN 2 THEN a_len - oh WHEN 3 THEN 100 + span ELSE 400 + span END AS a_end,
        CASE WHEN kind IN (0, 1) AND (kind = 0) = (b_strand = 0) THEN oh WHEN kind IN (0, 1) THEN b_len - oh - span
             WHEN kind = 2 THEN oh // 2 WHEN kind = 3 THEN oh ELSE 400 END AS b_start
      FROM (SELECT *, 3000 + (a_id * 7919) % 7000 AS a_len, 3000 + (b_id * 7919) % 7000 AS b_len, 500 + h % 1900 AS span, (h % 7) * 20 AS oh, h % 5 AS kind
            FROM (SELECT l_orderkey % 500 AS a_id, l_partkey % 500 AS b_id, l_orderkey * 31 + l_partkey * 17 + l_linenumber AS h,
                         CAST(l_quantity AS BIGINT) % 2 AS b_strand, 90 + CAST(round(l_discount * 100) AS BIGINT) AS identity FROM lineitem)))
"""
