"""The stages, each against what its operator alone decides, and the whole run."""

import corpus_pipeline
from helixframe.llm import minhash, quality
from helixframe.llm.scratch import table


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
    ids = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, sf_dir).collect()}
    assert ids == {r.doc_id for r in quality.classify(spark, docs).where("keep").collect()}
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert near == {r.doc_id for r in minhash.near_duplicates(spark, docs, corpus_pipeline.NEAR_PERCENT).where("kept").collect()}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert rows and max(fill.values()) <= corpus_pipeline.SEQUENCE_TOKENS


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, an empty table, and columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, h long, topic string"
    text = "A plain line of words that says little. " * 12
    rows = [(1, text, "en", "s", 1, True, 5, "t"), (1, text, "en", "s", 1, True, 5, "t"), (2, text, None, None, None, None, None, None), (None, text + "More.", "en", "s", 1, True, 5, "t"), (None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, False, 0, "")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        for table_ in (docs, docs.limit(0)):
            out = stage(spark, table_, "")
            n = out.count()
            if table_ is not docs:
                assert n == 0, name
            elif name != "best-fit packing":
                assert out.columns == docs.columns and n <= len(rows), name
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == [(False, 1), (False, 1), (False, 3), (True, 0), (True, 0)]
    assert corpus_pipeline.keep_good(spark, docs.where("doc_id = 3 or text is null"), "").count() == 0
