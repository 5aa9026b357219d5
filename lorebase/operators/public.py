"""Deterministic keyword search over the corpus, and the public answer's status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import text
from lorebase.operators import corpus, ranking

MAX_QUESTION = 1000
COMPETITIONS = ("any", "ifab")
NO_PAGE = 9999


def keyword_search(
    questions: DataFrame,
    chunks: DataFrame,
    limit: int = text.RESULT_LIMIT,
    stop_words: list[str] | None = None,
    expansions: dict[str, list[str]] | None = None,
    boosts: DataFrame | None = None,
    normal=text.normalize,  # noqa: ANN001
) -> DataFrame:
    """The best sections for each question: additive score, page, position; with excerpts.

    ``questions`` (question_id, question) are a batch; ``chunks`` have title, section,
    body, kind, page_start, section_key and position.  Normal forms are made once per
    section, scores in one pass; excerpts only for the rows that are returned.
    """
    asked = questions.select(
        "question_id",
        text.score_tokens(F.col("question"), stop_words, expansions, normal).alias("words"),
        text.original_terms(F.col("question"), stop_words, normal).alias("terms"),
        normal(text.expand(F.col("question"), expansions, normal)).alias("phrase"),
        normal(F.col("question")).alias("plain"),
    )
    forms = chunks.select("section_key", "position", "page_start", "kind", normal(F.col("title")).alias("t"), normal(F.col("section")).alias("s"), normal(F.col("body")).alias("b"))
    score = text.additive_score(F.col("words"), F.col("terms"), F.col("phrase"), F.col("t"), F.col("s"), F.col("b"), F.col("kind") == "definition")
    scored = reduce(
        DataFrame.unionByName, [forms.join(F.broadcast(part), F.lit(True)).select("question_id", "section_key", "position", "page_start", "words", "plain", score.alias("score")) for part in ranking.slices(asked, "question_id")]
    )
    if boosts is not None:
        more = F.when(F.forall("phrases", lambda p: F.contains("plain", p)), F.col("boost")).otherwise(0.0)
        extra = scored.join(corpus.small(boosts.select("section_key", "phrases", "boost")), "section_key").groupBy("question_id", "section_key").agg(F.sum(more).alias("more"))
        scored = scored.join(extra, ["question_id", "section_key"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.coalesce("page_start", F.lit(NO_PAGE)), "position")
    best = scored.where(F.col("score") > text.SCORE_FLOOR).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    bodies = chunks.select("section_key", "body")
    return best.join(bodies, "section_key").select("question_id", "rank", "section_key", "score", text.excerpt(F.col("body"), F.col("words")).alias("excerpt"))


def status(question: Column, competition: Column, on_topic: Column, n_results: Column) -> Column:
    """What the public interface answers with, in the order of its checks."""
    trimmed = F.regexp_replace(F.coalesce(question, F.lit("")), r"^\s+|\s+$", "")
    return (
        F.when((trimmed == "") | (F.length(trimmed) > MAX_QUESTION), "error")
        .when(~F.coalesce(competition, F.lit("any")).isin(*COMPETITIONS), "scope_unavailable")
        .when(~on_topic, "off_topic")
        .when(F.coalesce(n_results, F.lit(0)) == 0, "insufficient_evidence")
        .otherwise("answered")
    )


def sources(chunks: DataFrame, edition: str, checked: str) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("sections")).select("sections", F.lit(edition).alias("edition"), F.lit(checked).alias("last_checked"))
