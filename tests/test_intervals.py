"""Joins of points with intervals, validity on a day, and numbered trees, against plain comparisons."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.operators import intervals


def test_every_point_meets_every_interval_that_holds_it_once(spark):
    rng = np.random.default_rng(6)
    points = [(i, int(p)) for i, p in enumerate(rng.integers(-300, 300, 150))] + [(150, None), (151, 0), (152, -1), (153, 1 << 41)]
    spans = [(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(-320, 300, 120), rng.integers(-3, 200, 120), strict=True))] + [(120, None, 5), (121, 5, None), (122, -(1 << 40), 1 << 42), (123, 0, 1), (124, -1, 0), (125, 7, 7)]
    got = intervals.held(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "i long, a long, b long"), "at", "a", "b")
    want = [(p, i) for p, at in points for i, a, b in spans if None not in (at, a, b) and a <= at < b]
    assert sorted((r.p, r.i) for r in got.collect()) == sorted(want)


def test_no_nested_loop_compares_points_with_intervals(spark):
    points, spans = spark.range(100).select(F.col("id").alias("at")), spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    plan = intervals.held(points, spans, "at", "a", "b")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    # the only nested loop takes the few lengths of blocks to each point
    assert plan.count("CartesianProduct") == 0 and plan.count("NestedLoopJoin") <= 1
    assert "_block" in plan and ("SortMergeJoin" in plan or "HashJoin" in plan)


def test_the_newest_edition_valid_on_each_day(spark):
    day = dt.date
    editions = [("e1", "a", day(2020, 1, 1), day(2021, 1, 1)), ("e2", "a", day(2020, 6, 1), None), ("e3", "a", day(2020, 7, 1), day(2020, 8, 1)), ("e4", "b", day(2020, 1, 1), None), ("e5", "a", None, None), ("e6", "a", day(2020, 6, 1), None)]
    asked = [(1, "a", day(2020, 5, 31)), (2, "a", day(2020, 6, 1)), (3, "a", day(2020, 7, 31)), (4, "a", day(2020, 8, 1)), (5, "a", day(2019, 12, 31)), (6, "c", day(2020, 7, 1)), (7, "a", day(2500, 1, 1)), (8, "a", None)]
    got = intervals.as_of(spark.createDataFrame(asked, "q long, book string, day date"), spark.createDataFrame(editions, "edition string, book string, effective_from date, effective_until date"), "q", "day", "edition", ["book"])
    assert {r.q: (r.edition, r.n) for r in got.collect()} == {1: ("e1", 1), 2: ("e6", 3), 3: ("e3", 4), 4: ("e6", 3), 5: (None, 0), 6: (None, 0), 7: ("e6", 2), 8: (None, 0)}


def forest(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, None if i < 3 or rng.random() < 0.05 else int(rng.integers(0, i)), "b") for i in range(n)]


@pytest.mark.parametrize("rows", [forest(60, 1), [(i, i - 1 if i else None, "b") for i in range(40)], [(i, 0 if i else None, "b") for i in range(30)], [(1, None, "x"), (1, None, "y"), (2, 1, "y")]])
def test_ancestors_of_any_depth(spark, rows):
    up = {(b, i): u for i, u, b in rows}

    def line(b, i):
        out = []
        while (i := up[(b, i)]) is not None:
            out.append(i)
        return out

    tree = intervals.numbered(spark.createDataFrame(rows, "id long, parent long, rulebook_id string"))
    assert tree.count() == len(rows) and tree.where("root IS NULL OR first < 0 OR last <= first").count() == 0
    got = sorted((r.rulebook_id, r.id, r.above, r.ancestor) for r in intervals.ancestors(tree).collect())
    assert got == sorted((b, i, k + 1, a) for i, _, b in rows for k, a in enumerate(line(b, i)))


def test_rings_and_orphans_have_no_root(spark):
    rows = [(1, None), (2, 1), (3, 4), (4, 5), (5, 3), (6, 4), (7, 99), (8, 7), (9, 9)]
    tree = intervals.numbered(spark.createDataFrame([(*r, "b") for r in rows], "id long, parent long, rulebook_id string"))
    assert {r.id for r in tree.where("root IS NULL").collect()} == {3, 4, 5, 6, 7, 8, 9}
    assert [(r.id, r.ancestor) for r in intervals.ancestors(tree).collect()] == [(2, 1)]
    assert intervals.numbered(spark.createDataFrame([], "id long, parent long, rulebook_id string")).count() == 0


def test_many_page_ranges_meet_pages_by_equality(spark):
    from lorebase.operators import layout

    pages = spark.range(-5, 1000).select(F.col("id").alias("page"))
    chapters = spark.createDataFrame([(i * 7, i * 7 + 6, f"c{i}") for i in range(120)], "first_page long, last_page long, chapter string")
    got = layout.chapter_of(pages, chapters)
    assert {(r.page, r.chapter) for r in got.collect()} == {(p, f"c{p // 7}") for p in range(840)}


def test_intervals_do_not_pass_through_the_driver(spark):
    points = spark.createDataFrame([(1, 5)], "p long, at long")
    spans = spark.createDataFrame([(7, 3, 9)], "i long, lo long, hi long")
    met = intervals.held(points, spans, "at", "lo", "hi")
    assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
    assert [(r.p, r.i) for r in met.collect()] == [(1, 7)]
