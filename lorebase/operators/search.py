"""Search in three modes over a corpus version, and evidence for questions from it.

The unit is a batch of questions.  Every step reads one version of the corpus, so a
publication in between is seen as a changed fingerprint, not as mixed results.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions import text
from lorebase.functions.slices import slices
from lorebase.operators import corpus, evidence, ranking, scratch, snapshot, textindex
from lorebase.operators.answering import Bundle, CorpusChanged, Embedder, Reranker

MODES = ("vector", "hybrid", "hybrid-rerank")
MAX_LIMIT, MAX_QUESTION, MAX_WORDS, EACH = 20, 2000, 128, 5
WINDOW_WORDS = 254
#: Columns of a result, in order.
FIELDS = ("id", "rulebook_id", "edition", "section_key", "parent_section_key", "kind", "law_article", "section_title", "heading_path", "body", "page_start", "page_end", "source_url", "section_url")


class ConfigurationError(ValueError):
    """The search can't be made as asked."""


@dataclass(frozen=True)
class Models:
    """The parts that turn texts into numbers; ``name`` must be the one the corpus was embedded by."""

    embedder: Embedder
    reranker: Reranker | None = None
    name: str = "hashing-384"


def embedded(df: DataFrame, column: Column, embedder: Embedder, name: str = "v") -> DataFrame:
    """``df`` with the unit vector of each text, in Arrow batches on the executors."""

    @F.pandas_udf("array<double>")
    def encode(s: pd.Series) -> pd.Series:
        return pd.Series([v for texts in slices(s) for v in np.asarray(embedder.encode(texts.fillna("").tolist()), np.float64)], dtype=object)

    # a filter on the vector would else be pushed below it and encode every text once more
    return df.withColumn(name, encode.asNondeterministic()(column))


def faults(question: Column) -> Column:
    """Why a question can't be searched for, or null."""
    words = F.size(F.regexp_extract_all(question, F.lit(r"(\S+)"), F.lit(1)))
    return F.when(F.coalesce(F.regexp_replace(question, r"\s", ""), F.lit("")) == "", "empty").when(F.length(question) > MAX_QUESTION, "too long").when(words > MAX_WORDS, "too many words")


def lexical(questions: DataFrame, chunks: DataFrame, index: DataFrame | None = None, k: int = ranking.CANDIDATES) -> DataFrame:
    """(query_id, id, score, rank) by cover density of any of the question's stems.

    With a stored ``index`` (see ``textindex``) only its postings are read, and of ``chunks`` the ids; without one all
    texts are, for the places of the asked terms.
    """
    asked = questions.select("query_id", textindex.any_word(F.col("question")).alias("question"))
    if index is None:
        return textindex.top(asked, textindex.postings(chunks, wanted=textindex.asked_terms(asked)), k)
    return textindex.top(asked, index, k, chunks.select("id"))


def reranked(found: DataFrame, questions: DataFrame, chunks: DataFrame, reranker: Reranker, k: int) -> DataFrame:
    """Order the candidates by the best score of their windows."""

    @F.pandas_udf("double")
    def score(question: pd.Series, said: pd.Series) -> pd.Series:
        out = [reranker.scores(q, [t])[0] for texts in slices(said) for q, t in zip(question.loc[texts.index], texts, strict=True)]
        return pd.Series(out, dtype=float)

    texts = chunks.select("id", corpus.embedding_text(F.col("heading_path"), F.col("body")).alias("said"))
    windows = found.select("query_id", "id").join(texts, "id").select("query_id", "id", F.explode(text.windows(F.split("said", " "), WINDOW_WORDS)).alias("w"))
    scored = windows.join(questions.select("query_id", "question"), "query_id").select("query_id", "id", score("question", F.array_join("w.words", " ")).alias("score"))
    return ranking.rerank(found, scored, k)


def search(questions: DataFrame, chunks: DataFrame, models: Models, mode: str = "hybrid-rerank", limit: int = EACH, books: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, rrf_score[, rerank_score]) of each question (query_id, question).

    ``chunks`` are current ones with ``embedding``; ``index`` are their stored postings.  Questions that break a bound
    have no rows; see ``faults``.  ``books`` are checked to be embedded by ``models``.  Sections whose vector has no
    direction (as of an empty text) are found by words alone.
    """
    if mode not in MODES or not 1 <= limit <= MAX_LIMIT:
        raise ConfigurationError(f"modes are {MODES}, limits 1 to {MAX_LIMIT}")
    if mode == "hybrid-rerank" and models.reranker is None:
        raise ConfigurationError("no reranker")
    if books is not None and not books.where(~F.col("embedding_model").eqNullSafe(F.lit(models.name))).isEmpty():
        raise ConfigurationError("the corpus was embedded by another model")
    asked = questions.where(faults(F.col("question")).isNull())
    own = chunks.where(corpus.eligible(F.col("blocks"))) if "blocks" in chunks.columns else chunks
    near = ranking.vector_top(embedded(asked, F.col("question"), models.embedder, "q"), own.select("id", F.col("embedding").alias("v")))
    lists = near.select("query_id", F.lit("vector").alias("ranking"), "id", "rank")
    if mode != "vector":
        lists = lists.unionByName(lexical(asked, own, index).select("query_id", F.lit("words").alias("ranking"), "id", "rank"))
    found = ranking.fuse(lists).withColumnRenamed("score", "rrf_score")
    if mode != "hybrid-rerank":
        return found.where(F.col("rank") <= limit)
    return reranked(found, asked, own, models.reranker, limit)


def definitions(results: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Definitions that define a word of a question's results, by section key."""
    met = results.select("query_id", F.col("id").alias("to_chunk_id")).join(links.where("relation = 'defines'"), "to_chunk_id").select("query_id", F.col("from_chunk_id").alias("id")).distinct()
    return met.join(chunks, "id").orderBy("query_id", "section_key")


def collected(queries: DataFrame, chunks: DataFrame, models: Models, books: DataFrame | None = None, mode: str = "hybrid-rerank", budget: int = evidence.BUDGET, index: DataFrame | None = None) -> DataFrame:
    """Evidence of each question from its queries (question_id, part, query).

    Equal queries of a question count once; the first results of all come before the
    second ones; ancestors of any depth follow; what fits the budget stays.  A question
    whose ancestors are missing or circular has one row, with its ``fault``.
    """
    asked = queries.groupBy("question_id", "query").agg(F.min("part").alias("part"))
    asked = asked.withColumn("query_id", F.concat_ws("/", "question_id", "part"))
    found = search(asked.select("query_id", F.col("query").alias("question")), chunks, models, mode, EACH, books, index)
    rows = found.join(asked.select("query_id", "question_id", "part"), "query_id")
    placed = scratch.settled(ranking.interleave(rows.select("question_id", "part", "id", "rank"), "question_id", "part").select("question_id", "id", "place"))
    main = placed.join(chunks, "id")
    up = corpus.all_ancestors(main, chunks, ["question_id"])
    after = Window.partitionBy("question_id").orderBy("level", "rulebook_id", "section_key")
    more = up.withColumn("place", 1_000_000 + F.row_number().over(after)).select(main.columns)
    return evidence.evidence_view(evidence.pack(main.unionByName(more), budget=budget), chunks)


def loader(spark: SparkSession, root: str, models: Models, as_of: str) -> tuple[Callable[[Sequence[str]], Bundle], Callable[[str, list[str]], bool]]:
    """``load`` and ``is_fresh`` of an answer service over the published corpus at ``root``."""

    def current() -> tuple[DataFrame, DataFrame, str, DataFrame]:
        version = snapshot.open_version(spark, root)
        day = F.lit(as_of).cast("date")
        chunks = corpus.current_chunks(version["books"], version["chunks"], day)
        books = version["books"].join(chunks.select(F.col("rulebook_id").alias("id")).distinct(), "id", "left_semi")
        return books, chunks, corpus.corpus_fingerprint(books.withColumnRenamed("content_fingerprint", "fingerprint")).first().corpus_fingerprint, version["postings"]

    def load(queries: Sequence[str]) -> Bundle:
        began = time.perf_counter()
        books, chunks, mark, index = current()
        if books.isEmpty():
            return Bundle([], mark)
        asked = spark.createDataFrame([("q", i, q) for i, q in enumerate(queries)], "question_id string, part int, query string")
        rows = [r.asDict(recursive=True) for r in collected(asked, chunks, models, books, index=index).drop("question_id").collect()]
        if fault := next((r["fault"] for r in rows if r["fault"]), None):
            raise evidence.EvidenceError(fault)
        if not is_fresh(mark, [r["chunk_id"] for r in rows]):
            raise CorpusChanged
        sources = [{"id": b.id, "edition": b.edition, "last_checked_at": b.last_checked_at.isoformat() if b.last_checked_at else None} for b in books.select("id", "edition", "last_checked_at").collect()]
        load.latency_ms = round((time.perf_counter() - began) * 1000)
        for r in rows:
            del r["fault"]
        return Bundle(sorted(rows, key=lambda r: int(r["evidence_id"][1:])), mark, sources)

    def is_fresh(mark: str, ids: list[str]) -> bool:
        _, chunks, now, _ = current()
        return now == mark and chunks.where(F.col("id").isin(ids)).select("id").distinct().count() == len(set(ids))

    return load, is_fresh
