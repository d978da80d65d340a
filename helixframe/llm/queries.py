"""The operators of this subpackage as registered queries, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.scratch import table

MIN_SITES = 10


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.vectors import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "embeddings"), 0.93)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.quality import classify

    return classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(spark, vectors, vectors.where("vec_id % 100 = 0"), 10)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(spark, docs).drop("text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.linededup import remove_boilerplate

    out = remove_boilerplate(spark, table(spark, sf_dir, "documents"), MIN_SITES)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.minhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), 85)


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.repeats import remove_repeats

    return remove_repeats(spark, table(spark, sf_dir, "documents"), 100)


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.recompression import remove_windows

    return remove_windows(spark, table(spark, sf_dir, "documents"), 35)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.spelling import variants

    return variants(spark, table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.filteraudit import audit

    return audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""

OP6_SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AS bad FROM l LEFT JOIN b ON l.line = b.line),
d AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(kept) AS BIGINT) AS n_kept, sha256(kept) AS kept_sha256 FROM d
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
             min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, {
        'A': len(words) < 200,
        'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(w.doc_id > first_id, false)} AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: map_extract(MAP {'A': fails.A, 'B': fails.B, 'C': fails.C, 'D': fails.D, 'E': fails.E}, x)[1]) AS failing, count(*) AS n
      FROM f GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM a p, a q, a r, a s, a t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
g AS (SELECT part, good, toxic, failing, n, filter_order, coalesce(list_min([strpos(filter_order, x) for x in failing]), 6) AS failed FROM m, o),
c AS (SELECT part, filter_order, step,
        CAST(coalesce(sum(n) FILTER (WHERE failed > step), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (WHERE failed = step), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (WHERE failed < step AND list_contains(failing, filter_order[step])), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (WHERE failing = [filter_order[step]]), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(n) FILTER (WHERE failed = step AND good), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(n) FILTER (WHERE failed = step AND toxic), 0) AS BIGINT) AS toxic_lost
      FROM g, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step) GROUP BY part, filter_order, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_embedding_dedup, op2_quality, op3_nearest, op4_warc, op5_mixing, op6_line_dedup, op7_packing, op8_licenses, op9_minhash, op10_suffix_array, op11_recompression, op12_spelling, op13_filter_audit]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op6_line_dedup": OP6_SQL, "op13_filter_audit": OP13_SQL}
