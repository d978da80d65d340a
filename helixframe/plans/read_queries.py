"""Registered queries over reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.operators import bridge, kmers
from helixframe.operators import reads as R
from helixframe.plans.fixtures import READS_SQL, REFERENCES_SQL, reads, references, table

QUERIES, SQL = {}, {}
_R = f"WITH r AS ({READS_SQL})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{_R} SELECT read_id, length(seq) AS len FROM r WHERE length(seq) >= 300 AND regexp_full_match(seq, '[ACGTacgt]*')")
def reads_legal_minlen(spark, sf):
    return R.legal_min_length(reads(spark, sf), 300).select("read_id", F.length("seq").cast("long").alias("len"))


BUDGET = 500_000


@query(
    f"""{_R}, h AS (SELECT length(seq) AS len, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT len, sum(len * n) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS total FROM h),
k AS (SELECT coalesce(max(CASE WHEN total >= {BUDGET} THEN len END), min(len)) AS cutoff FROM c)
SELECT read_id, length(seq) AS len FROM r, k WHERE length(seq) >= cutoff"""
)
def longest_by_base_budget(spark, sf):
    return R.longest_by_budget(reads(spark, sf), BUDGET).select("read_id", F.length("seq").cast("long").alias("len"))


@query(
    f"""{_R}, s AS (SELECT length(seq) AS len, sum(length(seq)) OVER (ORDER BY length(seq) DESC, read_id ROWS UNBOUNDED PRECEDING) AS accu,
  row_number() OVER (ORDER BY length(seq) DESC, read_id) AS rn, sum(length(seq)) OVER () AS total FROM r)
SELECT count(*) AS count, CAST(max(total) AS BIGINT) AS total, max(len) AS max, min(len) AS min,
  max(CASE WHEN accu > 0.25 * total THEN len END) AS n25, min(CASE WHEN accu > 0.25 * total THEN rn END) AS l25,
  max(CASE WHEN accu > 0.50 * total THEN len END) AS n50, min(CASE WHEN accu > 0.50 * total THEN rn END) AS l50,
  max(CASE WHEN accu > 0.75 * total THEN len END) AS n75, min(CASE WHEN accu > 0.75 * total THEN rn END) AS l75 FROM s"""
)
def n50_strict(spark, sf):
    return R.n_statistics(reads(spark, sf))


@query(
    f"""{_R}, s AS (SELECT length(seq) AS len, sum(length(seq)) OVER (ORDER BY length(seq) DESC, read_id ROWS UNBOUNDED PRECEDING) AS accu,
  row_number() OVER (ORDER BY length(seq) DESC, read_id) AS rn, CAST(sum(length(seq)) OVER () AS BIGINT) AS total, count(*) OVER () AS cnt FROM r)
SELECT max(cnt) AS count, max(total) AS total, max(total // cnt) AS mean, max(CASE WHEN rn = cnt // 2 + 1 THEN len END) AS median, max(len) AS max, min(len) AS min,
  max(CASE WHEN accu >= total // 4 THEN len END) AS n25, min(CASE WHEN accu >= total // 4 THEN rn END) AS l25,
  max(CASE WHEN accu >= total // 2 THEN len END) AS n50, min(CASE WHEN accu >= total // 2 THEN rn END) AS l50,
  max(CASE WHEN accu >= total // 4 * 3 THEN len END) AS n75, min(CASE WHEN accu >= total // 4 * 3 THEN rn END) AS l75 FROM s"""
)
def length_stats(spark, sf):
    return R.length_statistics(reads(spark, sf))


@query(f"{_R} SELECT read_id, row_number() OVER (ORDER BY read_id) AS new_id, length(seq) AS len FROM r WHERE length(seq) >= 300")
def renumber(spark, sf):
    rows = reads(spark, sf).where(F.length("seq") >= 300)
    return R.renumber(rows, "read_id").select("read_id", "new_id", F.length("seq").cast("long").alias("len"))


@query(f"{_R} SELECT read_id, translate(reverse(seq), 'ACGT', 'TGCA') AS seq FROM r")
def revcomp(spark, sf):
    return reads(spark, sf).select("read_id", reverse_complement(F.col("seq")).alias("seq"))


@query(
    f"""{_R}, t AS (SELECT read_id, length(seq) AS n FROM r)
SELECT r.read_id, CAST(i AS BIGINT) AS part, CAST(i * 5000 AS BIGINT) AS start,
  length(CASE WHEN i = g.k - 1 THEN substring(seq, i * 5000 + 1) ELSE substring(seq, i * 5000 + 1, 5000) END) AS len
FROM r, (SELECT read_id, greatest(n // 5000 + CASE WHEN n % 5000 > 1000 THEN 1 ELSE 0 END, 1) AS k FROM t) g, unnest(range(0, g.k)) AS u(i) WHERE g.read_id = r.read_id"""
)
def contig_pieces(spark, sf):
    return bridge.split_contigs(reads(spark, sf), 5000).select("read_id", F.col("part").cast("long").alias("part"), "start", F.length("seq").cast("long").alias("len"))


@query(f"{_R} SELECT r.read_id, length(seq) AS len FROM r WHERE read_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled_reads_semi(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("read_id"))
    return reads(spark, sf).join(good, "read_id", "left_semi").select("read_id", F.length("seq").cast("long").alias("len"))


@query(f"{_R} SELECT r.read_id, length(seq) AS len FROM r WHERE read_id NOT IN (SELECT doc_id FROM labels)")
def labelled_reads_anti(spark, sf):
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("read_id"))
    return reads(spark, sf).join(known, "read_id", "left_anti").select("read_id", F.length("seq").cast("long").alias("len"))


@query(
    # a step a part: a part ends with the first read by which the sum since the part before has the budget
    f"""WITH RECURSIVE r AS ({READS_SQL}), n AS MATERIALIZED (SELECT read_id, length(seq) AS len, row_number() OVER (ORDER BY read_id) AS rn, sum(length(seq)) OVER (ORDER BY read_id ROWS UNBOUNDED PRECEDING) AS upto FROM r),
f AS (SELECT CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS rn, CAST(0 AS HUGEINT) AS upto
  UNION ALL SELECT f.part + 1, min(n.rn), min(n.upto) FROM f JOIN n ON n.upto >= f.upto + 100000 AND n.rn > f.rn GROUP BY f.part)
SELECT f.part, min(read_id) AS first, max(read_id) AS last, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM (SELECT *, lead(rn) OVER (ORDER BY part) AS nxt FROM f) f JOIN n ON n.rn > f.rn AND n.rn <= coalesce(nxt, n.rn) GROUP BY f.part"""
)
def reads_split_by_budget(spark, sf):
    rows = R.split_by_budget(reads(spark, sf), 100_000)
    return rows.groupBy("part").agg(F.min("read_id").alias("first"), F.max("read_id").alias("last"), F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"))


_K = f"{_R}, k AS (SELECT read_id, CAST(i AS BIGINT) AS pos, substring(seq, i + 1, 15) AS kmer FROM r, unnest(range(0, length(seq) - 14)) AS u(i) WHERE length(seq) >= 15)"


@query(f"{_K} SELECT n, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) GROUP BY n")
def kmer_counts(spark, sf):
    return kmers.counts(reads(spark, sf), 15).groupBy("n").agg(F.count("*").alias("kmers"))


MOST, STRIDE = 500, 10
_PAIRS = "count(*) AS seeds, min(q.pos) AS q_first, max(q.pos) AS q_last, min(s.pos) AS s_first, max(s.pos) AS s_last"
_RARE = f"rare AS (SELECT kmer FROM k GROUP BY kmer HAVING count(*) <= {MOST})"


@query(
    f"""{_K}, {_RARE}, s AS (SELECT * FROM k WHERE kmer IN (SELECT kmer FROM rare))
SELECT q.read_id AS qid, s.read_id AS sid, {_PAIRS} FROM k q JOIN s ON q.kmer = s.kmer AND s.read_id < q.read_id WHERE q.pos % {STRIDE} = 0 GROUP BY 1, 2"""
)
def kmer_pairs(spark, sf):
    return kmers.pairs(reads(spark, sf), 15, STRIDE, MOST)


@query(
    f"""{_K}, {_RARE}, s AS (SELECT * FROM k WHERE kmer IN (SELECT kmer FROM rare)),
q AS (SELECT read_id, pos, kmer, 0 AS qdir FROM k WHERE pos % {STRIDE} = 0
  UNION ALL SELECT read_id, CAST(i AS BIGINT), substring(rc, i + 1, 15), 1 FROM (SELECT read_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM r), unnest(range(0, length(rc) - 14, {STRIDE})) AS u(i) WHERE length(rc) >= 15)
SELECT q.read_id AS qid, s.read_id AS sid, q.qdir AS qdir, {_PAIRS} FROM q JOIN s ON q.kmer = s.kmer AND s.read_id < q.read_id GROUP BY 1, 2, 3"""
)
def kmer_pairs_both_strands(spark, sf):
    return kmers.pairs(reads(spark, sf), 15, STRIDE, MOST, both_strands=True)


_REF = f"ref AS ({REFERENCES_SQL})"


@query(
    f"""{_R}, {_REF}, s AS (SELECT read_id, CAST(i AS BIGINT) AS pos, substring(seq, i + 1, 10) AS kmer FROM ref, unnest(range(0, length(seq) - 9)) AS u(i) WHERE length(seq) >= 10),
q AS (SELECT read_id, CAST(i AS BIGINT) AS pos, substring(seq, i + 1, 10) AS kmer FROM r, unnest(range(0, length(seq) - 9, 6)) AS u(i) WHERE length(seq) >= 10),
cq AS (SELECT kmer, count(*) AS n FROM q GROUP BY 1), cs AS (SELECT kmer, count(*) AS n FROM s GROUP BY 1),
ok AS (SELECT cq.kmer FROM cq JOIN cs ON cq.kmer = cs.kmer WHERE cq.n <= 20 AND cs.n <= 20 AND cq.n * cs.n <= 20)
SELECT q.read_id AS qid, s.read_id AS sid, q.pos AS qoff, s.pos AS soff FROM q JOIN s ON q.kmer = s.kmer WHERE q.kmer IN (SELECT kmer FROM ok)"""
)
def kmer_merge_capped(spark, sf):
    return kmers.merge_pairs(reads(spark, sf), references(spark, sf), 10, 6, 20)


_SEEDS = f"""{_R}, {_REF}, s0 AS (SELECT read_id, CAST(i AS BIGINT) AS pos, substring(seq, i + 1, 15) AS kmer FROM ref, unnest(range(0, length(seq) - 14)) AS u(i) WHERE length(seq) >= 15),
s AS (SELECT * FROM s0 WHERE kmer IN (SELECT kmer FROM s0 GROUP BY kmer HAVING count(*) <= 500)),
q AS (SELECT read_id, CAST(i AS BIGINT) AS pos, d AS qdir, substring(t, i + 1, 15) AS kmer FROM (SELECT read_id, seq AS t, 0 AS d FROM r UNION ALL SELECT read_id, translate(reverse(seq), 'ACGT', 'TGCA'), 1 FROM r), unnest(range(0, length(t) - 14, 5)) AS u(i) WHERE length(t) >= 15),
seeds AS (SELECT q.read_id AS qid, q.qdir, s.read_id AS sid, q.pos AS qoff, s.pos AS soff FROM q JOIN s ON q.kmer = s.kmer)"""


@query(f"{_SEEDS} SELECT * FROM seeds")
def ref_mapping_seeds(spark, sf):
    return kmers.reference_seeds(reads(spark, sf), references(spark, sf))


@query(
    f"""{_SEEDS}, b AS (SELECT qid, qdir, sid, soff // 200 AS block, least(count(DISTINCT qoff), 40) AS score FROM seeds GROUP BY 1, 2, 3, 4)
SELECT b.*, CAST(b.score + coalesce(p.score, 0) AS BIGINT) AS with_before FROM b LEFT JOIN b p ON p.qid = b.qid AND p.qdir = b.qdir AND p.sid = b.sid AND p.block = b.block - 1"""
)
def seed_block_scores(spark, sf):
    return kmers.block_scores(kmers.reference_seeds(reads(spark, sf), references(spark, sf)), 200)


@query(
    f"""{_SEEDS}, b AS (SELECT qid, qdir, sid, soff // 200 AS block, least(count(DISTINCT qoff), 40) AS score FROM seeds GROUP BY 1, 2, 3, 4)
SELECT * FROM (SELECT b.*, CAST(b.score + coalesce(p.score, 0) AS BIGINT) AS with_before FROM b LEFT JOIN b p ON p.qid = b.qid AND p.qdir = b.qdir AND p.sid = b.sid AND p.block = b.block - 1) WHERE score >= 2 AND with_before >= 4"""
)
def candidate_blocks(spark, sf):
    return kmers.candidate_blocks(kmers.reference_seeds(reads(spark, sf), references(spark, sf)), 200, 2)


@query(f"{_K} SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS seed_pairs FROM (SELECT count(*) AS n FROM k GROUP BY kmer HAVING count(*) <= 500)")
def kmer_expected_pairs(spark, sf):
    return kmers.expected_pairs(reads(spark, sf), 15, 500)
