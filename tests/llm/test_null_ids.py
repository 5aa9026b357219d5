"""A row without an id does not stand for its copies."""

from lorebase.llm import jaccard


def test_null_copy_keeps_links_of_its_class(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, text), (5, text), (6, near), (7, "far from it all there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.groups(docs, 3, 90).collect()}
    assert got == {None: 5, 5: 5, 6: 5, 7: 7}
