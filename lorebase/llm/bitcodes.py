"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is encoded once: centred, rotated by one fixed random orthogonal matrix
and kept as the signs of its coordinates (packed bits) with two scalars: its norm
and the inner product of its direction with its own code.  A query's coordinates are
rounded to ``PLANES`` bits, so its inner product with a code is a sum of bit counts
of words: codes stay packed.  With the scalars that estimates the inner product of
the vectors without bias, and bounds its error by ``EPSILON`` standard widths, of the
code and of the rounding.  A candidate is measured exactly only if its lower bound on
the distance does not exceed the query's k-th smallest upper bound.

Work is dealt out by (chunk of codes, block of queries); either is bounded in size,
so neither a large table nor a vector that many rows share makes a large task.  Only
codes and scalars are dealt; vectors move for reranking alone.  Each such task
returns the candidates within its own limit, which the limit over all tasks thins
out before vectors are fetched.

Defined results: vectors that are null, all zero, or hold null or non-finite
components take no part, neither as query nor as candidate; an empty table gives no
rows; a repeated id counts as so many candidates, and a query never finds rows of
its own id; a query id that repeats asks with each of its vectors and takes a
candidate's smallest distance; ties go to the smaller id; vectors are only compared
with those of as many components, however many; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.llm.arrays import tidied
from lorebase.llm.blocks import buffers
from lorebase.llm.jaccard import SLICE, candidate_bits, id_bit
from lorebase.llm.tables import settle, table

#: Codes of a chunk and queries of a block, about.
CHUNK, BLOCK = 1 << 16, 2048
#: Width of the error bounds: recall 0.98 of unclustered vectors of 64 components, of which it reranks one in fourteen
#: (1.0: 0.92 and one in thirty; 1.6: 0.996 and one in seven).  Recall is measured in the tests.
EPSILON = 1.3
#: Bits of a query's coordinates.
PLANES = 5
SEED = 20240501


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms from the centre, and each unit vector's inner product with its code."""
    r = (x - centre) @ turn
    norm = np.linalg.norm(r, axis=1)
    own = np.abs(r).sum(1) / np.sqrt(x.shape[1]) / np.where(norm > 0, norm, 1)
    return np.packbits(r > 0, axis=1), norm, np.where(norm > 0, own, 1.0)


def words(bits: np.ndarray) -> np.ndarray:
    """Packed bytes of each row as whole 64-bit words."""
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def estimates(unit: np.ndarray, code: np.ndarray, ones: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of one rotated unit vector with all coded ones, and the standard widths of their errors."""
    dim = len(unit)
    low, steps = unit.min(), (1 << PLANES) - 1
    width = max((unit.max() - low) / steps, 1e-12)
    level = np.rint((unit - low) / width).astype(np.uint8)
    total = np.zeros(len(code), np.int64)
    for b in range(PLANES):
        plane = words(np.packbits((level >> b) & 1)[None, :])[0]
        total += np.bitwise_count(code & plane).sum(1, dtype=np.int64) << b
    signed = 2 * (width * total + low * ones) - (width * float(level.sum()) + low * dim)
    spread = np.sqrt(np.maximum(1 - own**2, 0) / max(dim - 1, 1) + width**2 / 12)
    return signed / np.sqrt(dim) / own, spread / own


def within(qid: np.ndarray, turned: np.ndarray, cid: np.ndarray, code: np.ndarray, norm: np.ndarray, own: np.ndarray, k: int, epsilon: float = EPSILON) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: candidates that may be among its k nearest here, with lower and upper bounds of squared distances."""
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    for i, (mine, q) in enumerate(zip(qid, turned, strict=True)):
        size = float(np.linalg.norm(q))
        inner, spread = estimates(q / size if size else q, code, ones, own)
        cross = 2 * size * norm
        middle, wide = size**2 + norm**2 - cross * inner, cross * spread * epsilon
        low, high = middle - wide, middle + wide
        at = np.flatnonzero(cid != mine)
        if len(at) > k:
            limit = np.partition(high[at], k - 1)[k - 1]
            at = at[low[at] <= limit + 1e-9 * (1 + abs(limit))]
        yield i, at, low[at], high[at]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: id, vector as doubles, its length, and a key of the row's values."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # forall yields null if a component is null
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim"), F.xxhash64(F.col(id_col).cast("long"), v).alias("key"), F.xxhash64(v).alias("same")
    )


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each length that occurs: one row a length reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                x = matrix(batch.column(0).filter(pa.array(dims == d)))
                yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "n": [len(x)], "total": pa.array([x.sum(0)], pa.list_(pa.float64()))})

    def whole(part: pa.Table) -> pa.Table:
        return pa.table({"dim": part.column("dim")[:1], "n": [sum(part.column("n").to_pylist())], "total": pa.array([matrix(part.column("total")).sum(0)], pa.list_(pa.float64()))})

    schema = "dim int, n bigint, total array<double>"
    found = vectors.select("vector", "dim").mapInArrow(partial, schema).groupBy("dim").applyInArrow(whole, schema)
    return {r.dim: np.array(r.total) / r.n for r in found.toLocalIterator()}


def encoded(vectors: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, key, dim and the code with its scalars of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                bits, norm, own = codes(matrix(part.column(3)), centre[d], rotation(d))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], part.column(4), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norm), pa.array(own)], names=["vec_id", "key", "dim", "same", "code", "norm", "own"])

    return vectors.select("vec_id", "key", "dim", "vector", "same").mapInArrow(run, "vec_id bigint, key bigint, dim int, same bigint, code binary, norm double, own double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of ``vectors`` to each row of ``queries`` by Euclidean distance."""
    cand, ask = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).dropDuplicates(["vec_id", "key"])
    centre = centres(cand)
    # equal rows are one with a count; of equal vectors only so many ids as could be results are dealt
    alike = F.row_number().over(Window.partitionBy("dim", "same").orderBy("vec_id"))
    single = encoded(cand, centre).groupBy("vec_id", "key", "dim", "same").agg(*[F.first(c).alias(c) for c in ("code", "norm", "own")], F.count(F.lit(1)).alias("times"))
    code = settle(single.withColumn("alike", alike).where(F.col("alike") <= k + 1).drop("alike"))
    ask = ask.where(F.col("dim").isin(list(centre))) if centre else ask.limit(0)
    sizes = code.count(), ask.count()
    chunks, blocks = (max(1, -(-n // size)) for n, size in zip(sizes, (chunk, block), strict=True))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", "key", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = (
        code.withColumn("chunk", deal(chunks, 1)).withColumn("block", every(blocks))
        .unionByName(ask.withColumn("block", deal(blocks, 2)).withColumn("chunk", every(chunks)), allowMissingColumns=True)
    )

    def local(part: pa.Table) -> pa.Table:
        asks = part.filter(part.column("vector").is_valid())
        have = part.filter(part.column("code").is_valid())
        out: list[list] = [[] for _ in range(7)]
        if asks.num_rows and have.num_rows:
            dim = asks.column("dim")[0].as_py()
            bits = np.frombuffer(b"".join(buffers(have.column("code"))), np.uint8).reshape(have.num_rows, -1)
            turned = (matrix(asks.column("vector")) - centre[dim]) @ rotation(dim)
            qid, qkey, cid, ckey = (t.column(c).to_numpy() for t in (asks, have) for c in ("vec_id", "key"))
            times = have.column("times").to_numpy()
            for i, at, low, high in within(qid, turned, cid, words(bits), have.column("norm").to_numpy(), have.column("own").to_numpy(), k):
                for column, value in zip(out, (np.full(len(at), qid[i]), np.full(len(at), qkey[i]), cid[at], ckey[at], low, high, times[at]), strict=True):
                    column.append(value)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64, np.float64, np.int64)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(out, kinds, strict=True)], names=["query_id", "asked", "vec_id", "key", "low", "high", "times"])

    found = settle(rows.groupBy("dim", "chunk", "block").applyInArrow(tidied(local), "query_id long, asked long, vec_id long, key long, low double, high double, times long"))
    # the limit over all chunks
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy("high"))
    limits = found.withColumn("r", rank).where(F.col("r") <= k).groupBy("query_id", "asked").agg(F.max("high").alias("limit"), F.count(F.lit(1)).alias("n"))
    limits = limits.select("query_id", "asked", F.when(F.col("n") < k, float("inf")).otherwise(F.col("limit") + 1e-9 * (1 + F.abs("limit"))).alias("limit"))
    pairs = settle(found.join(limits, ["query_id", "asked"]).where("low <= limit").select("query_id", "asked", "vec_id", "key", "times"))
    bits = max(SLICE, min(1 << 28, 1 << (16 * sizes[0]).bit_length()))
    wanted = vectors.sparkSession.sparkContext.broadcast(candidate_bits(pairs.select("vec_id"), bits))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            at = id_bit(batch.column(0).to_numpy(), bits)
            yield batch.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, x = batch.column(4), batch.column(5)
            d = [float(np.sqrt(np.square(np.asarray(a.values) - np.asarray(b.values)).sum())) for a, b in zip(q, x, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(d, pa.float64())], names=["query_id", "vec_id", "key", "times", "score"])

    schema = "vec_id bigint, key bigint, vector array<double>"
    originals = cand.select("vec_id", "key", "vector").mapInArrow(only, schema).dropDuplicates(["vec_id", "key"])
    asked = ask.select(F.col("vec_id").alias("query_id"), F.col("key").alias("asked"), F.col("vector").alias("q")).dropDuplicates(["query_id", "asked"])
    both = pairs.join(originals, ["vec_id", "key"]).join(asked, ["query_id", "asked"]).select("query_id", "vec_id", "key", "times", "q", "vector")
    scored = both.mapInArrow(measured, "query_id bigint, vec_id bigint, key bigint, times bigint, score double")
    scored = scored.groupBy("query_id", "vec_id", "key").agg(F.min("score").alias("score"), F.max("times").alias("times"))
    # a repeated row counts as so many candidates
    scored = scored.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))).alias("copy"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_bitcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


#: The search is approximate; recall is measured in the tests.
QUERIES = {"op10_bitcodes": op10_bitcodes}
ORACLES: dict[str, str] = {}
