"""The language stage leaves out no text with a letter, labelled or not."""

import corpus_pipeline
from reprise.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "a text with letters", None, "a", 19), (2, "это текст на языке которого никто не учил", None, "a", 41), (3, "42", None, "a", 2), (4, None, None, "b", None),
        (5, "", None, "b", 0), (None, "x", None, "b", 1), (2, "日", None, None, 1)]
LETTERS = {(1, ROWS[0][1]), (2, ROWS[1][1]), (None, "x"), (2, "日")}


def kept(df):
    return {(r.doc_id, r.text) for r in df.collect()}


def test_texts_stay_where_no_language_was_learned(spark):
    assert kept(corpus_pipeline.language(spark, spark.createDataFrame(ROWS, SCHEMA), "")) == LETTERS
    named = spark.createDataFrame([(i, None, "en", "a", None) for i in range(9)] + ROWS, SCHEMA)  # labels without a text
    assert kept(corpus_pipeline.language(spark, named, "")) == LETTERS


def test_an_unlabelled_table_reaches_the_last_stage(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert {1, 2} <= {r.doc_id for r in docs.collect()}


def test_a_limit_on_the_score_holds_for_learned_languages(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en", "a", 22) for i in range(9)] + ROWS, SCHEMA)
    filters = langid.learn(docs)
    assert kept(langid.known_language(docs, filters, 0.5)) == {(i, "the cat sat on the mat") for i in range(9)}
    assert kept(langid.known_language(docs, filters)) == LETTERS | {(i, "the cat sat on the mat") for i in range(9)}
