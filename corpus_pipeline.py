"""A training corpus from raw documents: five stages, each one operator over all its predecessor kept.

Every stage but the last returns the columns of ``docs``, of any names and
number beside doc_id, text, lang and source.  An empty table gives no rows.
Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import linededup, minhash, mixing, packing, quality
from helixframe.llm.queries import MIN_SITES, tokenizer_path
from helixframe.llm.scratch import Scratch, table

#: Percent of shared five-word shingles from which documents are near copies.
NEAR_PERCENT = 80
#: Shares by source, language and topic are lifted to this power, and this part of the tokens is drawn.
MIX_POWER, MIX_FRACTION = 0.8, 0.9
SEQUENCE_TOKENS = 2048


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts.

    Null, empty and wordless texts are rejected; rows that repeat a text are
    decided alike; a null doc_id is decided like any.
    """
    return quality.classify(spark, docs).where("keep").select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites.

    A null text stays null, and a null source is no site; every copy of a line
    goes, in repeated rows too.
    """
    return linededup.remove_boilerplate(spark, docs, MIN_SITES).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Rows that repeat a doc_id stay or go together.  Rows without a doc_id, and
    texts without words, are copies of nothing and stay.
    """
    copies = minhash.near_duplicates(spark, docs, NEAR_PERCENT).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked source, language and topic weights.

    A null source or language is a value of its own; documents without tokens
    go with their cell; rows that repeat a doc_id are drawn together.
    """
    return mixing.mix(spark, docs, power=MIX_POWER, fraction=MIX_FRACTION).where("selected").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in training sequences.

    A null or empty text is one piece, the id that ends a document; repeated
    rows are packed each, and a null doc_id is carried.
    """
    return packing.pack(spark, docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("minhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the classifier's training nor the joint effect of the stages after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's rows are written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
