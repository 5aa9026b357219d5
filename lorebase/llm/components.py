"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.tables import release, settle


#: Edges, both ways, that one task joins at most; beyond it they are joined by rounds.
SMALL = 400_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a small table of edges, in one task."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while up.setdefault(a, a) != a:
            up[a] = a = up[up[a]]
        return a

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(x), root(y)
            if a != b:
                up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (x, y); the component is its smallest id.

    A graph of at most ``SMALL`` edges is joined in one task.  Of larger ones each round every id takes the smallest label among its neighbours and its label's
    label, so labels shrink at the speed of doubling paths; labels are settled in the
    shared folder after each.
    """
    both = settle(edges.select("x", "y").union(edges.select(F.col("y"), F.col("x"))).where("x <> y").distinct())
    if both.limit(SMALL + 1).count() <= SMALL:
        out = settle(both.coalesce(1).mapInArrow(joined, "id bigint, component bigint"))
        release(both)
        return out
    labels = settle(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        near = both.join(labels, both.y == labels.id).groupBy(F.col("x").alias("of")).agg(F.min("component").alias("near"))
        step = settle(labels.join(near, labels.id == near.of).select("id", "component", F.least("component", "near").alias("low")))
        up = step.select(F.col("id").alias("at"), F.col("low").alias("above"))
        jumped = settle(step.join(up, step.low == up.at, "left").select("id", "component", F.least("low", F.coalesce("above", "low")).alias("next")))
        moved = not jumped.where("next < component").isEmpty()
        release(labels, step)
        labels = jumped.select("id", F.col("next").alias("component"))
        labels.__dict__["settled_path"] = jumped.__dict__["settled_path"]
        if not moved:
            release(both)
            return labels
