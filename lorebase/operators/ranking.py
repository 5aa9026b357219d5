"""Rankings: exact nearest vectors, weighted terms, fusion, reranking, interleaving."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import vectors

CANDIDATES, FUSION_K, TOP = 30, 60, 5
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
#: Queries that one pass over the corpus is broadcast at most.
QUERY_SLICE = 2000
#: Terms that one pass over the corpus is broadcast at most.
TERM_SLICE = 100_000
#: Distinct asked words that are broadcast as hashes, so that the postings they meet are not shuffled for them.
ASKED = 2_000_000


def top(df: DataFrame, by: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark limits the groups before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def slices(queries: DataFrame, key: str = "query_id", size: int = QUERY_SLICE) -> list[DataFrame]:
    """The queries in parts of about ``size`` rows, each small enough to be broadcast."""
    n = max(1, -(-queries.count() // size))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == s) for s in range(n)]


#: More than rounding to six places and sums of doubles in another order can hide.
NEAR_SLACK = 2e-6
#: Vectors that are multiplied with a slice of queries at once.
NEAR_ROWS = 2000


def _unit(rows: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    # by their largest component first, so that squares of very large and small ones stay numbers
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _nearest(queries: dict[int, np.ndarray], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, v, size) to (id, v, at): per query, by its place in ``queries`` of its size, what may be among the k nearest of the task's vectors so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = {size: np.full((len(q), k), np.inf) for size, q in queries.items()}
        for batch in (whole.slice(i, NEAR_ROWS) for whole in batches for i in range(0, whole.num_rows, NEAR_ROWS)):
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                if size not in queries:
                    continue
                part = batch.filter(pa.array(sizes == size))
                near = 1 - queries[size] @ _unit(part.column(1), size).T
                both = np.concatenate([bounds[size], near], axis=1)
                bounds[size] = np.partition(both, k - 1, axis=1)[:, :k]
                query, row = np.nonzero(near <= bounds[size].max(axis=1, keepdims=True) + NEAR_SLACK)
                order = np.argsort(row, kind="stable")
                row, query = row[order], query[order]
                have, starts = np.unique(row, return_index=True)
                if len(have):
                    chosen = part.take(pa.array(have))
                    at = [x.tolist() for x in np.split(query, starts[1:])]
                    yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array(at, pa.list_(pa.int32()))], names=["id", "v", "at"])

    return run


def vector_top(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, id, distance, rank) by exact cosine distance, ties by id.

    ``queries`` (query_id, q) are broadcast in slices of at most ``QUERY_SLICE`` rows;
    beyond one slice the corpus is read once for each.  Products of whole batches leave
    out what can't be among a task's nearest; the rest are compared exactly.  Vectors
    without a direction, as of empty texts, are near nothing, on both sides.
    """
    corpus = corpus.where(vectors.directed(F.col("v"))).select("id", "v", F.size("v").alias("size"))
    queries = queries.where(vectors.directed(F.col("q")))
    near = (F.round(vectors.cosine_distance(F.col("q"), F.col("v")), 6) + 0.0).alias("distance")
    kinds = {f.name: f.dataType.simpleString() for f in corpus.schema}
    found = []
    for part in slices(queries):
        rows = part.select("query_id", "q").collect()  # QUERY_SLICE, about
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r.q), []).append(r)
        blocks = {size: _unit(pa.array([[float(x) for x in r.q] for r in own], pa.list_(pa.float64())), size) for size, own in by_size.items()}
        held = corpus.mapInArrow(_nearest(blocks, k), f"id {kinds['id']}, v {kinds['v']}, at array<int>")
        placed = [(size, i, r.query_id, list(r.q)) for size, own in by_size.items() for i, r in enumerate(own)]
        asked = queries.sparkSession.createDataFrame(placed, f"size int, at int, query_id {part.schema['query_id'].dataType.simpleString()}, q {part.schema['q'].dataType.simpleString()}")
        met = held.select("id", "v", F.size("v").alias("size"), F.explode("at").alias("at")).join(F.broadcast(asked), ["size", "at"])
        found.append(top(met.select("query_id", "id", near), "query_id", [F.col("distance"), F.col("id")], k))
    return reduce(DataFrame.unionByName, found)


def postings(docs: DataFrame, words: Column, weight: float) -> DataFrame:
    """(id, term, weight): term counts of each document, weighted."""
    return docs.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg((F.count(F.lit(1)) * weight).alias("weight"))


def asked_postings(docs: DataFrame, parts: list[tuple[Column, float]], asked: DataFrame) -> DataFrame:
    """Postings of the terms in ``asked`` alone: others are dropped where they are read, before any shuffle.

    ``parts``: arrays of words with their weights.  Asked terms are broadcast in slices.
    """
    terms = asked.select("term").distinct()
    said = reduce(DataFrame.unionByName, [docs.select("id", F.explode(words).alias("term"), F.lit(weight).alias("w")) for words, weight in parts])
    met = [said.join(F.broadcast(part), "term", "left_semi") for part in slices(terms, "term", TERM_SLICE)]
    return reduce(DataFrame.unionByName, met).groupBy("id", "term").agg(F.sum("w").alias("weight"))


def lexical_top(query_terms: DataFrame, index: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, id, score, rank): weighted occurrences of the query's distinct terms, ties by id."""
    scored = query_terms.distinct().join(index, "term").groupBy("query_id", "id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return top(scored, "query_id", [F.desc("score"), F.col("id")], k)


def fuse(rankings: DataFrame, k: int = FUSION_K, keep: int = CANDIDATES) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, ranking, id, rank).

    An id counts once in each ranking, at its first place among distinct ids; ties go
    by the id as text.
    """
    first = rankings.groupBy("query_id", "ranking", "id").agg(F.min("rank").alias("place"))
    dense = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "ranking").orderBy("place")))
    fused = dense.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("place"))).alias("score"))
    return top(fused, "query_id", [F.desc("score"), F.col("id").cast("string")], keep)


def rerank(fused: DataFrame, scores: DataFrame, k: int = TOP) -> DataFrame:
    """Order by the best score of an id's windows; ties keep the fused order."""
    best = scores.groupBy("query_id", "id").agg(F.max("score").alias("rerank_score"))
    return top(fused.withColumnRenamed("rank", "fused_rank").join(best, ["query_id", "id"]), "query_id", [F.desc("rerank_score"), F.col("fused_rank")], k)


def interleave(results: DataFrame, question: str, part: str) -> DataFrame:
    """First results of all sub-questions, then their second ones, and so on; an id keeps its first place."""
    order = Window.partitionBy(question).orderBy("rank", part)
    placed = results.withColumn("place", F.row_number().over(order))
    return placed.withColumn("seen", F.row_number().over(Window.partitionBy(question, "id").orderBy("place"))).where("seen = 1").drop("seen")


def first_seen(df: DataFrame, by: str, key: list[str], position: str, name: str) -> DataFrame:
    """Number distinct keys in the order of their first position; rows keep their number."""
    start = df.withColumn("_first", F.min(position).over(Window.partitionBy(by, *key)))
    return start.withColumn(name, F.dense_rank().over(Window.partitionBy(by).orderBy("_first"))).drop("_first")
