"""Texts of one or two lines are windows of their own."""

import corpus_pipeline as P
from graphloom.llm import line_dedup as D


def test_copies_of_short_texts_are_cut(spark):
    rows = [(1, "a long line"), (2, "a long line"), (3, "x\ny"), (4, "x\ny"), (5, "y"), (6, " "), (7, " "), (8, None), (9, "a\nb\nc"), (10, "a\nb\nc\nd"), (11, "a long line\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in D.dedup_lines(df).collect()}
    assert got == {**{i: (t, 0) for i, t in rows}, 2: ("", 1), 4: ("", 2), 10: ("d", 3)}


def test_the_pipeline_cuts_them(spark, docs_schema):
    docs = spark.createDataFrame([(k, "one line of text", "en", "s", 16) for k in (1, 2)], docs_schema)
    assert [r["doc_id"] for r in dict(P.STAGES)["line_dedup"](spark, docs, "").collect()] == [1]
