"""Cross-site boilerplate lines, found by HyperLogLog sketches of their sites.

DataFrame functions only.  Each line hash gets a sketch of the sites it stands
on; sketches merge in partial and final aggregation.  Lines whose estimate is
near the threshold get an exact distinct count before any line is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.scratch import Scratch

#: log2 of the sketch's registers: a standard error of about 1.6 %.
LOG_REGISTERS = 12
#: Six standard errors: estimates farther than this from the threshold decide alone.
BAND = 0.1


#: Line hashes that a join broadcasts at most (8 bytes each); more are dealt out in so many lanes a line.
BROADCAST_LINES, LANES = 100_000, 16


def standing(hashed: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of ``hashed`` (__id, h, ...) whose line is in the written table ``few`` (h, each once).

    Counted first: few lines are broadcast, so no row of ``hashed`` moves.  Else
    the join goes by line and lane, so that a line on very many pages isn't one task's.
    """
    if few.count() <= BROADCAST_LINES:
        return hashed.join(F.broadcast(few), "h", "left_semi")
    dealt = few.withColumn("__lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    lane = F.pmod(F.xxhash64("__id"), F.lit(LANES)).cast("int")
    return hashed.withColumn("__lane", lane).join(dealt, ["h", "__lane"], "left_semi").drop("__lane")


def boilerplate_lines(hashed: DataFrame, min_sites: int, scratch: Scratch) -> DataFrame:
    """``hashed`` (__id, h, site) to the line hashes that stand on at least ``min_sites`` distinct sites."""
    spread = hashed.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("about"))
    spread = scratch.keep(spread.where(F.col("about") >= int(min_sites * (1 - BAND)) - 1), "spread")
    sure = spread.where(F.col("about") > min_sites * (1 + BAND) + 1).select("h")
    near = spread.where(F.col("about") <= min_sites * (1 + BAND) + 1).select("h")
    # lines that aren't near the threshold leave first, so only near ones are counted by line and site
    exact = standing(hashed, near).select("h", "site").distinct().groupBy("h").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("h")
    return sure.union(exact)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """Take out of every text each line that stands on ``min_sites`` or more distinct sites.

    Lines end at a line feed and are compared as they stand; lines of spaces
    alone are never removed.  All copies go, within a document too.  Returns all
    columns of ``docs`` with the new ``text`` (and ``n_chars``, where there is
    one), and ``n_lines`` and ``n_removed``.  Null text stays null with one
    line; a null site counts as no site; documents whose id is null or
    repeated are treated like others.  An empty table gives no rows.
    """
    scratch = Scratch(spark, "linededup")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    hashed = docs.select(F.col("doc_id").alias("__id"), F.col(site).alias("site"), F.explode(lines).alias("line"))
    hashed = scratch.keep(hashed.where(F.trim("line") != "").select("__id", "site", F.xxhash64("line").alias("h")), "lines")
    flagged = scratch.keep(boilerplate_lines(hashed.withColumn("site", F.col("site").cast("string")), min_sites, scratch), "flagged")
    bad = standing(hashed, flagged).groupBy("__id").agg(F.collect_set("h").alias("__bad"))
    kept = F.filter(lines, lambda x: ~(F.array_contains(F.col("__bad"), F.xxhash64(x)) & (F.trim(x) != "")))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = docs.select(*names).join(bad, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    out = out.withColumn("__kept", F.when(F.col("__bad").isNotNull(), kept))
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    new = {"text": text, "n_lines": F.size(lines).cast("long"), "n_removed": F.when(F.col("__kept").isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    out = out.withColumns(new)
    return out.select(*names, "n_lines", "n_removed")
