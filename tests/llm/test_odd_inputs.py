"""Every operator on nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import bitcodes, byte_bpe, decontaminate, hostgraph, interpolation, jaccard, licences, pathratio, repeats, toxicity

LONG = " ".join(f"w{i % 977} Été{i % 13}" for i in range(40_000))
ROWS = [(1, "a b c d e f g. All rights reserved."), (1, "a b c d e f g. All rights reserved."), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, LONG), (None, "a b c d e"), (None, None), (7, "a b c d e f g. All rights reserved.")]
#: Names that the operators use inside themselves.
CLASH = ("id", "n", "text2", "token", "block", "bucket", "component", "score", "spans", "key", "x", "y", "host", "rule", "ids", "held_out2", "rank", "slice", "toxic")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def vocabulary():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def bench(spark):
    return spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (None, "a b c d e f"), (4, " ".join(LONG.split()[50_000:50_030]))], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")


OPERATORS = {
    "decontaminate": lambda s, df: decontaminate.matches(df, bench(s)),
    "clean": lambda s, df: decontaminate.clean(df, bench(s)).select("doc_id", "text"),
    "toxicity": lambda s, df: toxicity.scored(df, toxicity.fit(df, labels(s))),
    "without_toxic": lambda s, df: toxicity.without_toxic(df, labels(s)).select("doc_id", "text"),
    "jaccard": lambda s, df: jaccard.groups(df, 3, 90),
    "repeats": lambda s, df: repeats.without_repeats(df),
    "byte_bpe": lambda s, df: byte_bpe.encode(df, *vocabulary(), with_ids=False),
    "licences": lambda s, df: licences.scan(df),
    "interpolation": lambda s, df: interpolation.scores(df, F.col("doc_id") == 6),
    "pathratio": lambda s, df: pathratio.main_text(df.withColumns({"page_id": F.col("doc_id"), "url": F.col("text"), "html": F.col("text")})).drop("url"),
    "hostgraph": lambda s, df: hostgraph.judge(df.withColumns({"page_id": F.col("doc_id"), "url": F.concat(F.lit("http://h/"), F.col("doc_id")), "html": F.col("text")})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    """Extra columns change nothing, equal rows have equal results, and all rows are answered."""
    run = OPERATORS[name]
    want, got = run(spark, plain(spark)), run(spark, odd)
    assert want.columns == got.columns
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect()))
    if name not in ("decontaminate", "clean", "without_toxic"):
        assert len(rows) == len(ROWS)
    assert run(spark, plain(spark).limit(0)).count() == 0


def test_what_odd_rows_give(spark, odd):
    hits = {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, bench(spark)).collect()}
    assert hits >= {(1, 1), (7, 1), (5, 4), (6, 4)} and not {i for i, _ in hits} & {2, 3, 4}
    parts = {r.doc_id: r.component_id for r in jaccard.groups(odd, 3, 90).collect() if r.doc_id is not None}
    assert parts == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 1}
    cut = {r.doc_id: r for r in repeats.without_repeats(odd).collect() if r.doc_id is not None}
    assert cut[6].n_removed == cut[6].n_words == 80_000 and cut[2].n_words == cut[3].n_words == cut[4].n_words == 0
    marks = {r.doc_id: r.licences for r in licences.scan(odd).collect()}
    assert marks[1] == marks[7] == ["all-rights-reserved"] and marks[5] == []


def test_long_labelled_texts_are_learnt_from(spark):
    """Documents of 10 kB and more carry all there is to learn."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]

    def text(bad, size):
        out = list(rng.choice(words, size))
        for at in rng.integers(0, size, 12) if bad else ():
            out[at] = f"vile{at % 3}"
        return " ".join(out)

    rows = [(i, text(i % 2, 3000 if i else 250_000)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, marks)).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(80, 120))


def test_a_long_document_with_hits_far_apart(spark):
    item = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, f"{item} " + "filler text " * 300_000 + item)], "doc_id long, text string")
    got = decontaminate.matches(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.start_word, r.similarity) for r in got] == [(0, 1.0)]


def test_repeated_vectors_and_queries(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in ("key", "dim", "code", "norm", "low", "limit", "vector")))
    got = [(r.query_id, r["rank"], r.vec_id) for r in bitcodes.nearest(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 1), (100, 2, 1), (100, 3, 2)]


def test_many_unrelated_members_of_one_list(spark, monkeypatch):
    """A shingle that stands first in thousands of unrelated documents, and a group of copies among them."""
    monkeypatch.setattr(jaccard, "PART", 16)
    rng = np.random.default_rng(2)
    rows = [(i, "the same three " + " ".join(rng.choice(5000, 3).astype(str))) for i in range(3000)]
    rows += [(5000 + i, " ".join(rng.permutation([f"p{j}" for j in range(40)])[:2]) + " " + " ".join(f"q{j}" for j in range(60) if j != i % 50)) for i in range(120)]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in sets:
        for j in sets if i >= 5000 else ():
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    for i in (i for i in sets if i < 5000):
        assert len(sets[i]) <= 4
    equal = {}
    for i in sorted(sets):
        if i < 5000:
            up[i] = equal.setdefault(frozenset(sets[i]), i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard.groups(df, 3, 80).collect()} == {i: root(i) for i in sets}
