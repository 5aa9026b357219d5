"""Measures of runs and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisoned_sum(c: Column) -> Column:
    """Null if any value is null; 0 for no values."""
    return F.when(F.count(c) < F.count(F.lit(1)), None).otherwise(F.coalesce(F.sum(c), F.lit(0)))


def first_relevant(results: DataFrame, relevant: DataFrame, case: str = "query_id", k: int = 5) -> DataFrame:
    """Per case the rank of its first relevant result among the first k, or null."""
    hits = results.where(F.col("rank") <= k).join(relevant.select(case, "id").distinct().withColumn("hit", F.lit(True)), [case, "id"], "left")
    return hits.groupBy(case).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"))


def summary(cases: DataFrame) -> DataFrame:
    """hits, mean reciprocal rank, and cases."""
    return cases.agg(
        F.count_if(F.col("first_rank").isNotNull()).alias("hits"), F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")
    )


def pass_rate(cases: DataFrame, expected: int) -> DataFrame:
    """One row: did all cases pass, and are there as many as expected?"""
    return cases.agg((F.coalesce(F.bool_and("passed"), F.lit(False)) & (F.count(F.lit(1)) == expected)).alias("passed"), F.count(F.lit(1)).alias("cases"))


def run_summary(runs: DataFrame, by: str) -> DataFrame:
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms)"), 6).alias("median_ms"), poisoned_sum(F.col("tokens")).alias("tokens")
    )


def diagnosis(results: DataFrame, cases: DataFrame, modes: DataFrame, k: int = 5) -> DataFrame:
    """A row a mode: hits among the first k, cases, mean reciprocal rank and median latency.

    ``results``: mode, query_id, id, rank.  ``cases``: query_id, expected (ids of which
    any will do).  ``modes``: mode, query_id, latency_ms of every search that was made,
    so that one without results counts as a miss.
    """
    wanted = cases.select("query_id", F.explode("expected").alias("id")).distinct()
    met = results.where(F.col("rank") <= k).join(wanted, ["query_id", "id"]).groupBy("mode", "query_id").agg(F.min("rank").alias("first_rank"))
    made = modes.join(cases.select("query_id"), "query_id").join(met, ["mode", "query_id"], "left")
    return made.groupBy("mode").agg(
        F.count("first_rank").alias("hits"), F.count(F.lit(1)).alias("cases"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms)"), 6).alias("median_ms"),
    )


def controls(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(case, passed) of answers (case, status, cited): a status that may be, and where sections are expected an answer cites one of them."""
    met = cases.join(answers, "case", "left")
    no_need = ~F.col("status").isin("answered", "judgment") | (F.coalesce(F.size("expected"), F.lit(0)) <= 0)
    cites = F.coalesce(F.arrays_overlap("cited", "expected"), F.lit(False))
    return met.select("case", F.coalesce(F.array_contains("statuses", F.col("status")) & (no_need | cites), F.lit(False)).alias("passed"))


def one_version(runs: DataFrame, by: str) -> DataFrame:
    """Per group of searches: did all read the same version, and their latencies' sum."""
    marks = F.countDistinct(F.coalesce("corpus_fingerprint", F.lit("")))
    return runs.groupBy(by).agg((marks == 1).alias("same_version"), poisoned_sum(F.col("latency_ms")).alias("latency_ms"))
