"""The run log: one record for searches and answers, checked, appended by day, read back and summed."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.operators import corpus, evaluation

FOLDER = "query_runs"
COLUMNS = [part.split(" ", 1)[0] for part in schemas.RUNS.replace("decimal(14,8)", "decimal").replace("map<string,int>", "map").split(", ")]


class RunError(ValueError):
    """A run breaks a rule of the log; nothing of its batch is written."""


def record(**known) -> dict:  # noqa: ANN003
    """A run as a row of ``schemas.RUNS``: what is not known is null, but for its id, time and empty timings."""
    unknown = set(known) - set(COLUMNS)
    if unknown:
        raise TypeError(f"the run log has no {sorted(unknown)}")
    row = {"id": str(uuid.uuid4()), "created_at": dt.datetime.now(dt.UTC), "step_timings_ms": {}} | known
    if row.get("cost_usd") is not None:
        row["cost_usd"] = Decimal(str(row["cost_usd"]))
    return {c: row.get(c) for c in COLUMNS}


def search_record(mode: str, fingerprint: str, models: Sequence[str], latency_ms: int, timings: dict[str, int]) -> dict:
    """The run of a search: it costs nothing and refuses nothing."""
    return record(competition="generic", retrieval_config=mode, corpus_fingerprint=fingerprint, model=" + ".join(models), input_tokens=0, output_tokens=0, cost_usd=0, latency_ms=latency_ms, refused=False, step_timings_ms=timings)


def append(runs: DataFrame, root: str) -> None:
    """Append rows of ``schemas.RUNS`` by day, all or none: a run that breaks a rule stops the batch."""
    runs = runs.select(*COLUMNS)
    broken = corpus.breaks(runs, corpus.run_rules()).select("id", "broken").first()
    if broken:
        raise RunError(f"run {broken.id}: {broken.broken}")
    runs.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(f"{root}/{FOLDER}")


def logger(spark: SparkSession, root: str) -> Callable[[dict], None]:
    """What an answer service calls with each run."""
    return lambda row: append(spark.createDataFrame([row], schemas.RUNS), root)


def read(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """All runs with their ``day``; ``since`` prunes the days that are read."""
    runs = spark.read.schema(f"{schemas.RUNS}, day date").parquet(f"{root}/{FOLDER}")
    return runs if since is None else runs.where(F.col("day") >= F.lit(since).cast("date"))


def rollup(runs: DataFrame) -> DataFrame:
    """Per day and outcome, per outcome, per day and for all: runs, refusals, tokens and cost (null if any is unknown), mean latency.

    ``level`` tells the four apart: 0 for a day's outcome, 1 for a day, 2 for an outcome, 3 for all.
    """
    return runs.cube("day", "outcome").agg(
        F.grouping_id("day", "outcome").cast("int").alias("level"), F.count(F.lit(1)).alias("runs"), F.count_if("refused").alias("refused"),
        evaluation.poisoned_sum(F.col("input_tokens").cast("bigint")).alias("input_tokens"), evaluation.poisoned_sum(F.col("cost_usd")).cast("double").alias("cost_usd"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"),
    )
