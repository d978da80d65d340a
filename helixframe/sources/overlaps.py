"""Text forms of overlap rows: m4, m4a, paf and ovl, and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.schema import CANDIDATE_COLUMNS, OVERLAP_COLUMNS

# The columns of each form, in file order.
LAYOUTS = {
    "m4": "a b identity score a_strand a_start a_end a_len b_strand b_start b_end b_len",
    "m4a": "a b identity score a_strand a_start a_end a_len b_strand b_start b_end b_len",
    "paf": "a a_len a_start a_end strand b b_len b_start b_end matches block quality",
    "ovl": "a b score identity a_strand a_start a_end a_len b_strand b_start b_end b_len",
}
_NUMBERS = ("strand", "start", "end", "len")


def _fields(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Fields split at spaces and tabs; a row with too few fails the read."""
    names = LAYOUTS[form].split()
    parts = F.split(F.trim("value"), r"[ \t]+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("f"))
    checked = F.when(F.size("f") >= len(names), F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"short {form} row: "), F.array_join("f", " "))))
    rows = rows.select(checked.alias("f"))
    return rows.select(*[F.element_at("f", i + 1).alias(n) for i, n in enumerate(names)])


def read_overlaps(spark: SparkSession, path: str, form: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Overlap rows with 0-based ids and a score.

    ``form`` is taken from the suffix where it isn't given.  m4 ids are 1-based;
    m4a and paf hold names, which ``names`` (read_id, name) maps to ids.  m4 and
    m4a rows are turned so that a is forward; their score is the negative mean span.
    """
    form = form or path.removesuffix(".gz").rsplit(".", 1)[-1]
    rows = _fields(spark, path, form)
    if form == "paf":
        rows = rows.withColumns({"a_strand": F.when(F.col("strand") == "-", 1).otherwise(0), "b_strand": F.lit(0), "identity": 100.0 * F.col("matches").cast("double") / F.col("block").cast("double"), "score": -F.col("block").cast("long")})
    rows = rows.withColumns({f"{r}_{n}": F.col(f"{r}_{n}").cast("long") for r in "ab" for n in _NUMBERS} | {"identity": F.col("identity").cast("double")})
    if form in ("m4a", "paf"):
        if names is None:
            raise ValueError(f"{form} rows hold names: give a table of names")
        for r in "ab":
            rows = rows.join(names.select(F.col("name").alias(r), F.col("read_id").alias(f"{r}_id")), r)
    else:
        rows = rows.withColumns({f"{r}_id": F.col(r).cast("long") - (1 if form == "m4" else 0) for r in "ab"})
    if form in ("m4", "m4a"):
        rows = rows.withColumn("score", -F.expr("(a_end - a_start + b_end - b_start) div 2"))
        flip = F.col("a_strand") == 1
        rows = rows.withColumns({"b_strand": F.when(flip, 1 - F.col("b_strand")).otherwise(F.col("b_strand")), "a_strand": F.lit(0).cast("long")})
    return rows.select(*OVERLAP_COLUMNS, F.col("score").cast("long").alias("score"))


def write_overlaps(overlaps: DataFrame, path: str, form: str = "m4", names: DataFrame | None = None, mode: str = "errorifexists", where=None) -> None:
    """m4 with 1-based ids, or m4a with names; ``where`` is a predicate on the rows, ``mode`` "append" adds."""
    if form not in ("m4", "m4a"):
        raise ValueError(f"{form} can be read but not written")
    rows = overlaps if where is None else overlaps.where(where)
    if form == "m4a":
        for r in "ab":
            rows = rows.join(names.select(F.col("read_id").alias(f"{r}_id"), F.col("name").alias(r)), f"{r}_id")
    else:
        rows = rows.withColumns({r: F.col(f"{r}_id") + 1 for r in "ab"})
    score = F.col("score") if "score" in rows.columns else -F.expr("(a_end - a_start + b_end - b_start) div 2")
    out = [F.col("a"), F.col("b"), F.format_string("%.4f", F.col("identity").cast("double")), score, *[F.col(c) for c in LAYOUTS["m4"].split()[4:]]]
    rows.select(F.concat_ws(" ", *[c.cast("string") for c in out]).alias("value")).write.mode(mode).text(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"[ \t]+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts.alias("f")).select(*[F.element_at("f", i + 1).cast("long").alias(c) for i, c in enumerate(CANDIDATE_COLUMNS)])


def write_candidates(candidates: DataFrame, path: str, mode: str = "errorifexists") -> None:
    candidates.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in CANDIDATE_COLUMNS]).alias("value")).write.mode(mode).text(path)
