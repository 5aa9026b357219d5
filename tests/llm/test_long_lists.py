"""Long posting lists of the near-duplicate join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import jaccard


def test_sets_with_one_common_token_do_not_meet_again(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "common_cells", lambda profiles, cells: np.zeros(cells, np.uint8))  # a common token may come first
    docs = spark.createDataFrame([(i, f"same common phrase {' '.join(f'w{i}x{j}' for j in range(6))}") for i in range(60)], "doc_id long, text string")
    with jaccard.scratch(spark):
        join = jaccard.Join(docs, 3, 90, "doc_id", "text")
        found = join.candidates()
        members = found.where("y IS NULL").select("token", "x", "need")
        assert members.select("x").distinct().count() > 3
        links = spark.createDataFrame([], "x bigint, y bigint")
        assert join.across(members, links) is None


@pytest.mark.parametrize("long", [3, 4])
def test_pairs_lack_what_long_lists_can_hold(spark, long):
    counted = spark.createDataFrame([(1, 2, 1, 4), (1, 3, 1, 4), (5, 6, 4, 4), (5, 7, 3, 4)], "x bigint, y bigint, times int, need int")
    members = spark.createDataFrame([(t, x, 4) for x in (1, 2) for t in range(long)] + [(0, 3, 4)], "token bigint, x bigint, need int")
    assert {tuple(r) for r in jaccard.enough_shared(counted, members).collect()} == {(1, 2), (5, 6)}
    assert jaccard.heavy(members).select(F.col("x")).distinct().count() == (0 if long < 4 else 2)
