"""Selection, numbering and length statistics of reads (read_id, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import LEGAL, reverse_complement
from helixframe.operators.budget import split_by_budget as split_by_budget


def legal_min_length(reads: DataFrame, least: int) -> DataFrame:
    return reads.where((F.length("seq") >= least) & F.col("seq").rlike(LEGAL))


def split_raw(reads: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(kept, garbage): well-formed reads of ``least`` bases or more, and well-formed shorter ones; others are dropped."""
    formed = reads.where(F.col("seq").rlike(LEGAL) & (F.col("quality").isNull() | (F.length("quality") == F.length("seq")))) if "quality" in reads.columns else reads.where(F.col("seq").rlike(LEGAL))
    return formed.where(F.length("seq") >= least), formed.where(F.length("seq") < least)


def illegal_bases(reads: DataFrame) -> DataFrame:
    """A row for each base outside ACGT: read_id, position from 0, base."""
    chars = F.posexplode(F.split("seq", "")).alias("position", "base")
    return reads.where(~F.col("seq").rlike(LEGAL)).select("read_id", chars).where(~F.col("base").rlike("^[ACGTacgt]?$"))


def _histogram(reads: DataFrame) -> DataFrame:
    """Reads by length.  Windows below run over lengths, of which there are few, never over reads."""
    return reads.groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n"))


def longest_cutoff(reads: DataFrame, bases: int) -> DataFrame:
    """One row, ``cutoff``: the length at which the longest reads first reach ``bases``, else the least length."""
    longer = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = _histogram(reads).select("len", F.sum(F.col("len") * F.col("n")).over(longer).alias("total"))
    return reach.agg(F.coalesce(F.max(F.when(F.col("total") >= bases, F.col("len"))), F.min("len")).alias("cutoff"))


def longest_by_budget(reads: DataFrame, bases: int) -> DataFrame:
    """The longest reads that together reach ``bases``; all reads of the last length are kept."""
    return reads.crossJoin(F.broadcast(longest_cutoff(reads, bases))).where(F.length("seq") >= F.col("cutoff")).drop("cutoff")


def n_statistics(reads: DataFrame, genome_size: int | None = None) -> DataFrame:
    """count, total, max, min, n25..n75, l25..l75; a level is passed when the sum is strictly above its share."""
    h = _histogram(reads)
    total = F.lit(genome_size).cast("long") if genome_size else F.sum(F.col("len") * F.col("n")).over(Window.partitionBy(F.lit(0)))
    before = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    rows = h.select("len", "n", total.alias("total"), F.coalesce(F.sum(F.col("len") * F.col("n")).over(before), F.lit(0)).alias("bases"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("reads"))
    out = [F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.max("total").alias("total"), F.max("len").cast("long").alias("max"), F.min("len").cast("long").alias("min")]
    for level in (25, 50, 75):
        goal = F.col("total") * level / 100.0
        passed = F.col("bases") + F.col("len") * F.col("n") > goal
        # reads of this length that must be added until the sum passes the goal; reads without bases add none (null here)
        need = F.floor(F.try_divide(goal - F.col("bases"), F.col("len"))) + 1
        out += [F.max(F.when(passed, F.col("len"))).cast("long").alias(f"n{level}"), F.min(F.when(passed, F.col("reads") + F.greatest(need, F.lit(1)))).cast("long").alias(f"l{level}")]
    return rows.agg(*out)


def length_statistics(reads: DataFrame) -> DataFrame:
    """The second set of statistics: integer quarters reached with ``>=``, integer mean, upper median."""
    h = _histogram(reads)
    before = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    rows = h.select(
        "len", "n",
        F.sum(F.col("len") * F.col("n")).over(whole).alias("total"), F.sum("n").over(whole).alias("count"),
        F.coalesce(F.sum(F.col("len") * F.col("n")).over(before), F.lit(0)).alias("bases"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("reads"),
    )
    quarter = F.expr("total div 4")
    out = [
        F.max("count").alias("count"), F.max("total").alias("total"), F.max(F.expr("total div count")).alias("mean"),
        F.max(F.when(F.col("reads") + F.col("n") > F.expr("count div 2"), F.col("len"))).cast("long").alias("median"),
        F.max("len").cast("long").alias("max"), F.min("len").cast("long").alias("min"),
    ]
    for level, goal in ((25, quarter), (50, F.expr("total div 2")), (75, quarter * 3)):
        reached = F.col("bases") + F.col("len") * F.col("n") >= goal
        # reads without bases add none (null here)
        need = F.ceil(F.try_divide(goal - F.col("bases"), F.col("len")))
        out += [F.max(F.when(reached, F.col("len"))).cast("long").alias(f"n{level}"), F.min(F.when(reached, F.col("reads") + F.greatest(need, F.lit(1)))).cast("long").alias(f"l{level}")]
    return rows.agg(*out)


def renumber(rows: DataFrame, key: str, out: str = "new_id", first: int = 1, width: int = 1 << 16) -> DataFrame:
    """Consecutive numbers in the order of an integer key, without bringing all rows to one task.

    Rows are ranked within ranges of ``width`` keys; a small table of range
    sizes gives each range's offset.  Keys should be unique.
    """
    binned = rows.withColumn("__bin", F.floor(F.col(key) / width))
    sizes = binned.groupBy("__bin").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__bin", F.coalesce(F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__bin").orderBy(key))
    return binned.withColumn("__rank", rank).join(offsets, "__bin").withColumn(out, (F.col("__offset") + F.col("__rank") - 1 + first).cast("long")).drop("__bin", "__rank", "__offset")


def id_in_name(name: Column) -> Column:
    """The first run of digits of a header."""
    return F.regexp_extract(name, r"(\d+)", 1).cast("long")


def reorder_by_name(reads: DataFrame) -> DataFrame:
    return reads.orderBy(id_in_name(F.col("name")), "name")


def corrected_header(left: Column, right: Column, corrected: Column, original: Column, candidates: Column, overlaps: Column, cutoff: Column) -> Column:
    return F.format_string("(%d_%d_%d_%d_%d_%d_%.2f)", *(c.cast("long") for c in (left, right, corrected, original, candidates, overlaps)), cutoff.cast("double"))


def with_reverse(reads: DataFrame) -> DataFrame:
    """Each read on both strands: ``strand`` 0 as it is, 1 its reverse complement."""
    return reads.withColumn("strand", F.lit(0)).unionByName(reads.withColumn("seq", reverse_complement(F.col("seq"))).withColumn("strand", F.lit(1)))


def merge_volumes(volumes: list[DataFrame], key: str = "read_id") -> DataFrame:
    """Volumes one after the other: the ids of each are moved beyond those before it."""
    out, offset = None, 0
    for v in volumes:
        moved = v.withColumn(key, F.col(key) + F.lit(offset))
        out = moved if out is None else out.unionByName(moved)
        last = v.agg(F.max(key)).first()[0]
        offset += 0 if last is None else last + 1
    return out
