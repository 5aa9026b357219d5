"""Intervals that hold points, by joins on equality: validity on each row's own day, editions as of it, and ancestors of any depth.

An interval is parted into the fewest blocks of 1, 2, 4, ... numbers that start at
multiples of their length, two of each length at most; a point lies in one block of
each length.  So point and interval meet on (length, block), once, without comparing
every pair and without a filter afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators import scratch

#: Blocks have up to two to the power of this many numbers: all whole numbers of 64 bits but the very last.
LEVELS = 62


def _shifted(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def _blocks(start: Column, end: Column) -> Column:
    """(level, block) of each block of the numbers from ``start`` until before ``end``."""
    levels = F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int") + 1))
    low = lambda n: -_shifted(-start, n)  # noqa: E731 - rounded up
    high = lambda n: _shifted(end, n)
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    at = lambda n, block, holds: F.when((low(n) < high(n)) & holds, F.struct(n.alias("level"), block.alias("block")))
    return F.array_compact(F.flatten(F.transform(levels, lambda n: F.array(at(n, low(n), odd(low(n))), at(n, high(n) - 1, odd(high(n)))))))


def held(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    """Each point beside each interval that holds it: ``start`` <= ``point`` < ``end``, whole numbers, and equal in the columns ``by``.

    Null points, starts and ends, and empty intervals hold nothing.  Other columns of the two sides need different names.
    """
    by = by or []
    some = intervals.where(F.col(start) < F.col(end)).withColumn("_at", F.explode(_blocks(F.col(start).cast("bigint"), F.col(end).cast("bigint")))).select("*", F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block")).drop("_at")
    used = some.select("_level").distinct()
    n = F.col("_level")
    many = points.where(F.col(point).isNotNull()).join(F.broadcast(used), how="cross")  # LEVELS + 2 rows at most
    return many.withColumn("_block", _shifted(F.col(point).cast("bigint"), n)).join(some.hint("merge"), [*by, "_level", "_block"]).drop("_level", "_block")


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")


def valid(questions: DataFrame, editions: DataFrame, day: str, by: list[str] | None = None, open_end: str = "9999-12-31") -> DataFrame:
    """Each question beside the editions (effective_from, effective_until) that are valid on its own ``day``; an edition without an end is valid for ever, one without a start never."""
    spans = editions.withColumns({"_from": day_number(F.col("effective_from")), "_until": day_number(F.coalesce("effective_until", F.lit(open_end).cast("date")))})
    return held(questions.withColumn("_day", day_number(F.col(day))), spans, "_day", "_from", "_until", by).drop("_day", "_from", "_until")


def as_of(questions: DataFrame, editions: DataFrame, question: str, day: str, edition: str, by: list[str]) -> DataFrame:
    """(question, edition, n): the edition that began last of those valid on the question's day (ties to the larger edition), and how many are; null and 0 for none."""
    met = valid(questions.select(question, day, *by), editions.select(edition, "effective_from", "effective_until", *by), day, by)
    best = met.groupBy(question).agg(F.max(F.struct("effective_from", edition)).alias("best"), F.count(F.lit(1)).alias("n"))
    return questions.select(question).join(best, question, "left").select(question, F.col(f"best.{edition}").alias(edition), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


# --- trees ------------------------------------------------------------------------


def numbered(nodes: DataFrame, node: str = "id", parent: str = "parent", by: str = "rulebook_id") -> DataFrame:
    """``node``, ``by``, root, first, last: numbers of a walk round each tree, so that a node's descendants are those within its numbers.

    Nodes (unique within ``by``) whose ``parent`` is null are roots.  The walk enters a node, then its children in order,
    and leaves it; each step knows the next, and by doubling steps how far the walk's end is.  Nodes of rings and below
    them, and nodes whose parent is missing or below one that is, come back without a root.
    """
    key = nodes.select(F.col(by).alias("b"), F.col(node).alias("id"), F.col(parent).alias("up"))
    row = Window.partitionBy("b", "up").orderBy("id")
    placed = key.withColumn("next", F.when(F.col("up").isNotNull(), F.lead("id").over(row))).withColumn("eldest", F.row_number().over(row) == 1)
    eldest = placed.where("up IS NOT NULL AND eldest").select("b", F.col("up").alias("id"), F.col("id").alias("child"))
    # merge joins throughout: tables that grow with the input don't pass through the driver as broadcasts
    walk = placed.join(eldest.hint("merge"), ["b", "id"], "left")
    side = lambda which, of: F.when(of.isNotNull(), F.struct(of.alias("id"), F.lit(which).alias("out")))
    enter = walk.select("b", "id", F.lit(False).alias("out"), F.coalesce(side(False, F.col("child")), side(True, F.col("id"))).alias("to"))
    leave = walk.select("b", "id", F.lit(True).alias("out"), F.coalesce(side(False, F.col("next")), side(True, F.col("up"))).alias("to"))
    steps = enter.unionByName(leave).select("b", "id", "out", F.col("to.id").alias("to_id"), F.col("to.out").alias("to_out"), F.when(F.col("to").isNull(), F.col("id")).alias("root"), F.when(F.col("to").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("far"))
    steps = scratch.settled(steps)
    open_ = steps.where("root IS NULL").count()
    while open_:
        ahead = steps.select("b", F.col("id").alias("to_id"), F.col("out").alias("to_out"), F.col("to_id").alias("then_id"), F.col("to_out").alias("then_out"), F.col("root").alias("then_root"), F.col("far").alias("then_far"))
        met = steps.join(ahead.hint("merge"), ["b", "to_id", "to_out"], "left")
        new = scratch.settled(met.select("b", "id", "out", F.coalesce("then_id", F.when(F.col("then_far").isNull(), F.col("to_id"))).alias("to_id"), F.coalesce("then_out", F.when(F.col("then_far").isNull(), F.col("to_out"))).alias("to_out"), F.coalesce("root", "then_root").alias("root"), (F.col("far") + F.coalesce("then_far", F.lit(0))).alias("far")))
        left = new.where("root IS NULL").count()
        scratch.drop(steps)
        steps = new
        # on a walk that ends, steps twice as far from its end are known each round; none more: the rest are rings and orphans
        if left == open_:
            break
        open_ = left
    ends = steps.groupBy("b", "id").agg(F.max(F.when(~F.col("out"), F.col("far"))).alias("enter"), F.max(F.when(F.col("out"), F.col("far"))).alias("leave"), F.max("root").alias("root"))
    # numbers grow from the root's entry on
    whole = ends.join(ends.where("id = root").select("b", F.col("id").alias("root"), (F.col("enter") + 1).alias("steps")).hint("merge"), ["b", "root"], "left")
    return whole.select(F.col("id").alias(node), F.col("b").alias(by), F.when(F.col("steps").isNotNull(), F.col("root")).alias("root"), (F.col("steps") - 1 - F.col("enter")).alias("first"), (F.col("steps") - 1 - F.col("leave")).alias("last"))


def ancestors(tree: DataFrame, node: str = "id", by: str = "rulebook_id") -> DataFrame:
    """(``by``, ``node``, ancestor, above) of all nodes with a root: ancestors of any depth, ``above`` their distance."""
    rooted = tree.where("root IS NOT NULL")
    points = rooted.select(by, node, "root", F.col("first").alias("_own"))
    spans = rooted.select(by, "root", F.col(node).alias("ancestor"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    met = held(points, spans, "_own", "_first", "_last", [by, "root"]).where(F.col(node) != F.col("ancestor"))
    return met.select(by, node, "ancestor", F.row_number().over(Window.partitionBy(by, node).orderBy(F.desc("_first"))).alias("above"))
