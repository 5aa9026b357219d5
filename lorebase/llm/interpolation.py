"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on how
often the context was seen: contexts fall into buckets by the logarithm of their
count.  The weights are learned by expectation-maximisation on held-out counts: a
block of training texts is scored with the corpus's counts less its own.

Counts cover all training texts.  Each block of rows sends its distinct words and
bigrams with their counts to buckets of hashes, which answer with the totals; texts
meet the answers in their block, where the exchange of the texts is used again.
What reaches the driver is one fixed-size histogram.

Defined results: a null or empty text is its end token alone; with no training
text, no token is known and the score is that of the uniform estimate; equal texts
have equal scores; repeated rows each get their row; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.arrays import _BASE, mix, tidied, words_of
from lorebase.llm.blocks import block_count, block_of, bucket_bounds, bucket_count, buffers, from_low, low_bytes, packed, scattered, text_size, unpacked
from lorebase.llm.tables import settle, table

START, END = np.uint64(0x1234567), np.uint64(0xFEDCBA987654321)
#: Context buckets, and steps of the histogram (8 to a factor of 2) that EM reads.
CONTEXTS, STEPS, PER_OCTAVE = 40, 320, 8
WORD, PAIR = 0, 1
#: Bits of a bigram's hash in an exchange: estimates bear a rare collision, words' counts are by whole hashes.
PAIR_BITS = 56
#: Bytes of text in a block: what a block repeats is sent once, so larger ones send less.
BLOCK_TEXT = 9 << 20


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with end tokens, offsets of texts, and bigram hashes."""
    words = words_of(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    n = len(words.offsets) - 1
    offsets = words.offsets + np.arange(n + 1)
    t = np.empty(len(words.hashes) + n, np.uint64)
    ends = offsets[1:] - 1
    inner = np.ones(len(t), bool)
    inner[ends] = False
    t[inner] = words.hashes
    t[ends] = END
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[offsets[:-1]] = START
    return t, offsets, mix(before * np.uint64(_BASE) + (t ^ (t >> np.uint64(7))))


def _own(hashes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each token's place among them, and their training counts."""
    distinct, place = np.unique(hashes, return_inverse=True)
    return distinct, place, np.bincount(place[train], minlength=len(distinct))


def _training(part: pa.Table, offsets: np.ndarray) -> np.ndarray:
    held = part.column("held_out").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    return np.repeat(~held, np.diff(offsets))


def ask(buckets: int):  # noqa: ANN201
    """A block's distinct words and bigrams with their training counts, by bucket."""

    def run(part: pa.Table) -> pa.Table:
        t, offsets, pairs = tokens(part.column("text"))
        train = _training(part, offsets)
        rows: dict[str, list] = {"block": [], "kind": [], "bucket": [], "hashes": [], "counts": []}
        block = part.column("block")[0].as_py()
        for kind, hashes in ((WORD, t), (PAIR, pairs)):
            distinct, _, counts = _own(hashes, train)
            cuts = bucket_bounds(distinct, buckets)
            for b in range(buckets):
                i, j = cuts[b], cuts[b + 1]
                if i < j:
                    for name, value in zip(rows, (block, kind, b, low_bytes(distinct[i:j], 64 if kind == WORD else PAIR_BITS), packed(counts[i:j])), strict=True):
                        rows[name].append(value)
        return pa.table(rows, schema=pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    return run


ASKED = "block int, kind int, bucket int, hashes binary, counts binary"


def answer(part: pa.Table) -> pa.Table:
    """Totals of one bucket's hashes to every block that asked; and its distinct trained words."""
    hashes = [from_low(x) for x in buffers(part.column("hashes"))]
    counts = np.concatenate([unpacked(x) for x in buffers(part.column("counts"))])
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    kind = part.column("kind")[0].as_py()
    seen = int((total > 0).sum()) if kind == WORD else 0
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    n = part.num_rows
    return pa.table(
        {"block": part.column("block"), "kind": part.column("kind"), "bucket": part.column("bucket"), "totals": pa.array(scattered(total[place], cuts), pa.binary()), "types": pa.array([seen] + [0] * (n - 1), pa.int64())}
    )


ANSWERED = "block int, kind int, bucket int, totals binary, types bigint"


def quantised(p: np.ndarray) -> np.ndarray:
    """Steps below 1 on a logarithmic scale; the last step stands for 0."""
    with np.errstate(divide="ignore"):
        q = np.rint(-np.log2(p) * PER_OCTAVE)
    return np.where(p > 0, np.minimum(q, STEPS - 2), STEPS - 1).astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, CONTEXTS - 1), 0)


def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Totals for every token of the block's texts; for EM a histogram of its deleted estimates."""
    if texts.num_rows == 0:
        return pa.table({"id": texts.column("id"), "held_out": texts.column("held_out"), **{c: pa.array([], pa.binary()) for c in ("words", "pairs", "cells")}, **{c: pa.array([], pa.int64()) for c in ("types", "tokens", "docs")}})
    t, offsets, pairs = tokens(texts.column("text"))
    train = _training(texts, offsets)
    kinds, order = answers.column("kind").to_numpy(), answers.column("bucket").to_numpy()
    values = buffers(answers.column("totals"))
    got, own = [], []
    for kind, hashes in ((WORD, t), (PAIR, pairs)):
        distinct, place, counts = _own(hashes, train)
        rows = [i for i in np.argsort(order, kind="stable") if kinds[i] == kind]
        total = np.concatenate([unpacked(values[i]) for i in rows])
        got.append(total[place])
        own.append(counts[place])
    docs = int((~texts.column("held_out").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)).sum())
    starts = offsets[:-1]
    n_all = len(offsets) - 1
    # deleted estimates: the corpus without this block.  Contexts of a text's first token are left out.
    inner = train.copy()
    inner[starts] = False
    at = np.flatnonzero(inner)
    rest = [g.astype(np.int64) - o for g, o in zip(got, own, strict=True)]
    context, word, pair = rest[0][at - 1], rest[0][at], rest[1][at]
    ratio = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    cell = (context_bucket(context) * STEPS + quantised(np.minimum(ratio, 1.0))) * 64 + np.minimum(np.where(word > 0, np.log2(np.maximum(word, 1)) + 1, 0), 63).astype(np.int64)
    cells, many = np.unique(cell, return_counts=True)
    ids = texts.column("id").combine_chunks()
    words_bin, pairs_bin = scattered(got[0], offsets[1:-1]), scattered(got[1], offsets[1:-1])
    blank = [None] * n_all
    types = int(pc.sum(answers.column("types")).as_py() or 0)
    return pa.table(
        {
            "id": pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
            "held_out": pa.concat_arrays([texts.column("held_out").combine_chunks(), pa.nulls(1, pa.bool_())]),
            "words": pa.array([*words_bin, None], pa.binary()),
            "pairs": pa.array([*pairs_bin, None], pa.binary()),
            "cells": pa.array([*blank, np.stack([cells, many]).astype(np.int64).tobytes()], pa.binary()),
            "types": pa.array([*([0] * n_all), types], pa.int64()),
            "tokens": pa.array([*([0] * n_all), int(train.sum())], pa.int64()),
            "docs": pa.array([*([0] * n_all), docs], pa.int64()),
        }
    )


def learn(cells: np.ndarray, counts: np.ndarray, total: int, types: int, rounds: int = 60) -> np.ndarray:
    """EM for the weights of (bigram, unigram, uniform) in each context bucket."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    bucket, step, word = cells // 64 // STEPS, cells // 64 % STEPS, cells % 64
    p2 = np.where(step == STEPS - 1, 0.0, 2.0 ** (-step / PER_OCTAVE))
    p1 = np.where(word == 0, 0.0, 1.4 * 2.0 ** (word - 1.0)) / max(total, 1)
    p0 = np.full(len(cells), 1 / (types + 1))
    each = np.stack([p2, np.minimum(p1, 1.0), p0], 1)
    prior = 1.0  # of every estimate in every bucket: a bucket without held-out tokens keeps even odds
    for _ in range(rounds):
        share = weights[bucket] * each
        share *= (counts / np.maximum(share.sum(1), 1e-300))[:, None]
        new = np.full((CONTEXTS, 3), prior)
        for k in range(3):
            new[:, k] += np.bincount(bucket, share[:, k], CONTEXTS)
        new[0, 0] = 0.0
        weights = new / new.sum(1, keepdims=True)
    return weights


MET = "id {0}, held_out boolean, words binary, pairs binary, cells binary, types bigint, tokens bigint, docs bigint"


def scorer(weights: np.ndarray, total: int, types: int, docs: int, id_col: str):  # noqa: ANN201
    """mapInArrow function from totals to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [unpacked(x) for x in buffers(batch.column(2))]
            pairs = [unpacked(x) for x in buffers(batch.column(3))]
            out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
            for c, pair in zip(words, pairs, strict=True):
                word = c.astype(np.float64)
                context = np.r_[docs, word[:-1]]
                w = weights[context_bucket(context)]
                p = w[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0.0) + w[:, 1] * word / max(total, 1) + w[:, 2] / (types + 1)
                out["n_tokens"].append(len(c))
                out["n_known"].append(int((c > 0).sum()))
                out["base_score"].append(float(np.log10((word + 0.5) / (total + 0.5 * (types + 1))).sum()))
                out["score"].append(float(np.log10(p).sum()))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array([total] * n, pa.int64()), pa.array(out["base_score"], pa.float64()), pa.array(out["score"], pa.float64())],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by a model of those that are not ``held_out``."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = text_size(docs, text_col)
    blocks, buckets = block_count(size, BLOCK_TEXT), bucket_count(size)
    texts = base.withColumn("block", block_of(blocks, "id", "text")).repartition(blocks, "block")
    kind = base.schema["id"].dataType.simpleString()
    asked = texts.groupBy("block").applyInArrow(tidied(ask(buckets)), ASKED)
    answers = asked.groupBy("kind", "bucket").applyInArrow(tidied(answer), ANSWERED)
    # every answer has its types once: the sum over all blocks is the corpus's
    met = settle(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidied(meet), MET.format(kind)))
    sums = met.where("cells IS NOT NULL").agg(F.sum("types"), F.sum("tokens"), F.sum("docs")).first()
    types, total, n_docs = (int(x or 0) for x in sums)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, np.int64).reshape(2, -1) for x in buffers(batch.column(0))]
            if parts:
                cell, many = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(many)], names=["cell", "many"])

    # at most CONTEXTS * STEPS * 64 cells, whatever the input
    cells = met.where("cells IS NOT NULL").select("cells").mapInArrow(opened, "cell bigint, many bigint").groupBy("cell").agg(F.sum("many").alias("many")).toPandas()
    weights = learn(cells.cell.to_numpy(), cells.many.to_numpy(np.float64), total, types)
    out = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return met.where("cells IS NULL").select("id", "held_out", "words", "pairs").mapInArrow(scorer(weights, total, types, n_docs, id_col), out)


def op9_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


QUERIES = {"op9_interpolation": op9_interpolation}
ORACLES: dict[str, str] = {}
