"""Texts in slices, encoded once, and postings of the asked terms alone."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lorebase.functions import slices
from lorebase.operators import ranking, search, textindex
from lorebase.operators.answering import HashingEmbedder
from lorebase.sources import files


def test_slices_keep_all_texts_in_order(monkeypatch):
    monkeypatch.setattr(slices, "SLICE_TEXT", 5)
    texts = pd.Series(["ab", "cde", None, "", "fghijklm", "n"])
    parts = [p.tolist() for p in slices.slices(texts)]
    assert len(parts) > 2 and sum(parts, []) == texts.tolist()
    assert list(slices.slices(pd.Series([], dtype=object))) == []


def test_texts_are_encoded_once(spark):
    texts = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "id long, body string")
    chunks = search.embedded(texts, F.col("body"), HashingEmbedder(8), "v")
    asked = texts.where("id = 1").select(F.col("id").alias("query_id"), F.lit([0.0] * 7 + [1.0]).alias("q"))
    held = chunks.where(ranking.vectors.directed(F.col("v")))
    assert held._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.id for r in ranking.vector_top(asked, chunks).collect()] == [1]
    assert [np.count_nonzero(r.v) > 0 for r in chunks.orderBy("id").collect()] == [True, False, False]


def test_pages_of_any_kind_are_read(spark):
    pages = spark.createDataFrame([(1, "<article><p>a</p></article>"), (2, None), (3, "<p>b</p>")], "page_id long, html string")
    assert [r.paragraphs for r in files.html_sections(pages).orderBy("page_id").collect()] == [["a"], None, None]


def test_lexical_posts_asked_terms_alone(spark):
    chunks = spark.createDataFrame([(1, "A title", "one two three"), (2, "Other", "three four")], "id long, section_title string, body string")
    asked = spark.createDataFrame([(1, "three OR title")], "query_id long, question string")
    wanted = textindex.asked_terms(asked)
    assert sorted(wanted) == ["three", "titl"]
    made = textindex.postings(chunks, wanted=wanted)
    assert sorted((r.term, r.id, r.positions) for r in made.collect()) == [("three", 1, [5]), ("three", 2, [2]), ("titl", 1, [2])]
    whole = [tuple(r) for r in textindex.top(asked, textindex.postings(chunks)).orderBy("rank").collect()]
    assert whole == [tuple(r) for r in search.lexical(asked, chunks).orderBy("rank").collect()]


def test_parents_are_rows_by_place():
    from lorebase.operators import evidence

    place, up = np.array([3, 7, 1_000_001]), np.array([7, -1, -2])
    assert evidence.parent_rows(place, up).tolist() == [1, -1, -2]
