"""FASTA and FASTQ, plain or gzip, as read tables (see ``schema.READS``)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.sources.files import list_files, ranges
from helixframe.sources.splitting import NAME, SequenceSource


def _paths(spark: SparkSession, path: str | list[str]) -> list[str]:
    """A path, several, or a ``.fofn``/``.list`` file that names one a line."""
    out: list[str] = []
    for p in [path] if isinstance(path, str) else path:
        if p.endswith((".fofn", ".list")):
            out += [r[0].strip() for r in spark.read.text(p).collect() if r[0].strip()]  # a list of files
        else:
            out.append(p)
    return out


#: Splits whose numbers of records are broadcast at most; more are joined by a shuffle of counts and rows.
FEW_SPLITS = 200_000


def split_records(spark: SparkSession, path: str | list[str], kind: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Records as the source gives them: split, at (from 0 in the split), name, sub_head, seq, quality, length."""
    return _loaded(spark, json.dumps(ranges(list_files(spark, _paths(spark, path)), split_bytes)), kind)


def _loaded(spark: SparkSession, planned: str, kind: str, counts: bool = False) -> DataFrame:
    spark.dataSource.register(SequenceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).options(kind=kind, ranges=planned, counts=str(counts).lower()).load()


def _read(spark: SparkSession, path: str | list[str], kind: str, split_bytes: int, tests: list[Column]) -> DataFrame:
    planned = ranges(list_files(spark, _paths(spark, path)), split_bytes)
    text = json.dumps(planned)
    n = _loaded(spark, text, kind, True)
    # a row a split is all that is ordered in one task; no sequence is shuffled
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = n.select("split", before.alias("__before"))
    rows = _loaded(spark, text, kind)
    for t in tests:
        rows = rows.where(t)
    rows = rows.join(F.broadcast(offsets) if len(planned) <= FEW_SPLITS else offsets, "split")
    return rows.select((F.col("__before") + F.col("at")).cast("long").alias("read_id"), "name", "sub_head", "seq", "quality")


def read_fasta(spark: SparkSession, path: str | list[str], split_bytes: int = 64 << 20, *tests: Column) -> DataFrame:
    """Records that begin with ``>`` at the start of a line; sequence lines are joined.

    read_id counts records from 0 in the order of paths and records; those
    without header and bases don't count.  Plain and block-gzip files split,
    other gzip files are a task's each.  ``tests`` (columns of ``name`` and
    ``length``) are taken by the reader and leave ids as they are.
    """
    return _read(spark, path, "fasta", split_bytes, list(tests))


def read_fastq(spark: SparkSession, path: str | list[str], split_bytes: int = 64 << 20, *tests: Column) -> DataFrame:
    """Four-line records, as ``read_fasta``.  A record whose header, separator or quality length is wrong fails the read."""
    return _read(spark, path, "fastq", split_bytes, list(tests))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """By name: ``.fastq``/``.fq`` (and ``.gz``) as FASTQ, Parquet folders as they are, everything else as FASTA."""
    stem = path.removesuffix(".gz")
    if stem.endswith((".fastq", ".fq")):
        return read_fastq(spark, path)
    if stem.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_fasta(spark, path)


def write_fasta(reads: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none", name: Column | None = None) -> None:
    """One record a row: ``>name sub_head``, then the sequence on one line."""
    head = F.coalesce(name if name is not None else F.col("name"), F.col("read_id").cast("string")) if "name" in reads.columns or name is not None else F.col("read_id").cast("string")
    rest = F.when(F.coalesce(F.col("sub_head"), F.lit("")) != "", F.concat(F.lit(" "), F.col("sub_head"))).otherwise("") if "sub_head" in reads.columns else F.lit("")
    reads.select(F.concat(F.lit(">"), head, rest, F.lit("\n"), F.col("seq")).alias("value")).write.mode(mode).option("compression", compression).text(path)


def write_names(reads: DataFrame, path: str) -> None:
    reads.select("read_id", "name").write.mode("overwrite").csv(path, sep="\t", compression="gzip")
