"""How five filters interact: every order of them replayed over every document.

Documents are reduced to five flags once.  The flags are crossed with the 120
orders of the filters (a table of 120 rows, so its broadcast is bounded), each
order is exploded into its five steps, and the step of a document's first
failure decides what every step counts.  Counts are combined in the tasks that
make the rows, so a part's 600 rows a task are all that is shuffled.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.scratch import Scratch

LETTERS = "ABCDE"
#: White space of the word pattern: space and the controls 9 to 13.
SPACE = r"[ \t\n\x0B\f\r]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def flags(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) to doc_id, part, digest and ``fails``: bit k is set where filter k fails, but for E."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    rows = rows.withColumn("words", words).withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words"))})
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    bits = [F.col("n") < 200, 100 * F.col("distinct") < 50 * F.col("n"), 100 * upper.cast("long") > 3 * F.length("text").cast("long"), F.col("text").rlike(r"[#$%&*|]")]
    fails = sum(((b.cast("int") * F.lit(1 << k)) for k, b in enumerate(bits)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), fails.alias("fails"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Sets bit E where a smaller doc_id has the same text.

    The first id of each text is aggregated in the tasks first and then met by
    text and id together, so a text that a third of all rows share spreads over
    all tasks.
    """
    known = rows.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = known.join(first, ["digest", "doc_id"], "left").withColumn("fails", F.when(F.col("first"), F.col("fails")).otherwise(F.col("fails") + 16)).drop("first")
    return known.unionByName(rows.where("doc_id is null"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``; of repeated labels one that says 1 counts."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    known = rows.where("doc_id is not null").join(said, "doc_id", "left")
    return known.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders with the filters' bits in turn."""
    rows = [("".join(LETTERS[k] for k in p), [1 << k for k in p]) for p in itertools.permutations(range(len(LETTERS)))]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(rows: DataFrame) -> DataFrame:
    """``rows`` (part, fails, good, toxic) to one row per part, order and step."""
    spark = rows.sparkSession
    crossed = rows.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).crossJoin(F.broadcast(orders(spark)))
    bit = [F.col("bits")[k] for k in range(5)]
    failed = F.lit(6)
    for k in reversed(range(5)):
        failed = F.when(F.col("fails").bitwiseAND(bit[k]) != 0, k + 1).otherwise(failed)
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", failed.alias("failed"), F.posexplode("bits").alias("place", "bit"))
    steps = steps.withColumn("step", F.col("place") + 1)
    here = F.col("failed") == F.col("step")
    counted = steps.groupBy("part", "filter_order", "step", "bit").agg(
        F.count_if(F.col("failed") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("fails").bitwiseAND(F.col("bit")) != 0) & (F.col("failed") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows a group: the counts, not documents
    return counted.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang) and labels (doc_id, quality, toxic) to counts per part, filter_order and step.

    Null text is empty and null lang the part ''.  A row that repeats counts as
    often as it stands; rows of one doc_id with one text aren't copies of each
    other.  A document without an id has no smaller id, so it never fails E,
    nor makes others fail it, and has no label.  Texts of any length are read
    whole.  Other columns are ignored.  No document, no row.
    """
    scratch = Scratch(spark, "filteraudit")
    rows = scratch.keep(flags(docs.select("doc_id", "text", "lang")), "flags")
    return replay(with_labels(with_copies(rows), labels.select("doc_id", "quality", "toxic")))
