"""Toxic spans by a linear-chain conditional random field.

Labels are given per document, so tokens are labelled first: a token of a toxic
document is offending if its word or one of its beginnings occurs in toxic documents
far more than chance allows (log-likelihood ratio) and hardly in others.  A chain of
two states over hashed features of each token (word, beginnings, ending) is trained
on these tokens by gradient ascent on the exact likelihood; forward-backward gives
each token's marginal.  A document's score is a logistic function of the expected
number of offending tokens and of the largest marginal; runs of tokens whose
marginal is a half or more are its offending spans.

Training is bounded by rows: labelled documents of each label, chosen by a hash of the
id, as many as ``SAMPLE`` and ``SAMPLE_TEXT`` allow, are read whole.  Executors cut them
into passages of ``PASSAGE`` words; these are all the text that reaches the driver, and
the chain is trained on all of them in batches.  The logistic function is fitted to the whole sampled
documents, of which executors return three numbers each.
Scoring covers whole texts and all rows, without a shuffle.

Defined results: null and empty texts have no tokens and the score of such a
document; with no labelled document of either label the score is 0; a document with
several labels counts as toxic if one says so; null labels are ignored; repeated
rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.llm.arrays import NON_WORD, mix, pieces, text_bytes, words_of
from lorebase.llm.tables import release, settle, table

#: Labelled documents that are learnt from at most (toxic, others), bytes of their whole texts at most, the share of these
#: bytes that one of them has at most, and words of a passage that the chain is trained on.
SAMPLE, SAMPLE_TEXT, LARGEST, PASSAGE = (700, 2800), (6 << 20, 16 << 20), 0.1, 512
PREFIXES, SUFFIXES = (4, 5), (3,)
BITS = 18
EVIDENCE, PRECISION = 24.0, 0.9
EPOCHS, RATE, DECAY, BATCH = 8, 0.4, 1e-2, 1 << 17
CHUNK = 256
#: Bytes of text whose chains are scored together: some twenty numbers a token are held.
PIECE = 1 << 20
LIMIT = 30.0


def features(texts: pa.Array):  # noqa: ANN201
    """Words, and the places of each token's features in the weight table."""
    words = words_of(texts, separators=NON_WORD, prefixes=PREFIXES, suffixes=SUFFIXES)
    mask = np.uint64((1 << BITS) - 1)
    return words, [(x & mask).astype(np.int32) for x in (words.hashes, *words.affixes)]


def _scan(m00, m01, m10, m11, r0):  # noqa: ANN001, ANN202
    """Ratios after each step of r -> (m01 + r m11) / (m00 + r m10), all steps in order."""
    n = len(m00)
    rows = -(-n // CHUNK)
    pad = rows * CHUNK - n
    a, b, c, d = (np.pad(x, (0, pad), constant_values=v).reshape(rows, CHUNK) for x, v in ((m00, 1.0), (m01, 0.0), (m10, 0.0), (m11, 1.0)))
    p, q, s, t = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for i in range(CHUNK):  # the product of each chunk's steps
        p, q, s, t = p * a[:, i] + q * c[:, i], p * b[:, i] + q * d[:, i], s * a[:, i] + t * c[:, i], s * b[:, i] + t * d[:, i]
        size = p + q + s + t
        p, q, s, t = p / size, q / size, s / size, t / size
    r = np.empty(rows)
    now = r0
    for j, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), s.tolist(), t.tolist(), strict=True)):
        r[j] = now
        now = (x + now * z) / max(w + now * y, 1e-300)
    out = np.empty((rows, CHUNK))
    for i in range(CHUNK):
        r = (b[:, i] + r * d[:, i]) / np.maximum(a[:, i] + r * c[:, i], 1e-300)
        out[:, i] = r
    return out.ravel()[:n]


def marginals(e: np.ndarray, offsets: np.ndarray, move: np.ndarray):  # noqa: ANN201
    """Forward and backward ratios and marginals of state 1.  ``e``: log odds of emissions; ``move``: 2 x 2 log potentials."""
    n = len(e)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    x = np.exp(np.clip(e, -LIMIT, LIMIT))
    t = np.exp(move)
    first = np.zeros(n, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    last = np.zeros(n, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ahead = _scan(np.where(first, 1.0, t[0, 0]), np.where(first, 1.0, t[0, 1]) * x, np.where(first, 1.0, t[1, 0]), np.where(first, 1.0, t[1, 1]) * x, 1.0)
    # from the end: b -> (t10 + t11 x b) / (t00 + t01 x b), with x of the token after
    after = np.r_[x[1:], 1.0]
    rev = slice(None, None, -1)
    back = _scan(
        np.where(last, 1.0, t[0, 0])[rev], np.where(last, 1.0, t[1, 0])[rev], np.where(last, 0.0, t[0, 1] * after)[rev], np.where(last, 0.0, t[1, 1] * after)[rev], 1.0
    )[rev]
    odds = ahead * back
    return ahead, back, odds / (1 + odds)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    move: np.ndarray
    logistic: np.ndarray

    def emissions(self, places: list[np.ndarray]) -> np.ndarray:
        e = np.full(len(places[0]), self.bias)
        for k, p in enumerate(places):
            e += self.weights[k][p]
        return e

    def summaries(self, places: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
        """Summaries of the documents that ``offsets`` bound."""
        return summary(marginals(self.emissions(places), offsets, self.move)[2], offsets)

    def score(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summaries @ self.logistic, -LIMIT, LIMIT)))


def summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: 1, logarithm of the expected number of offending tokens, largest marginal.

    Tokens that are more likely clean don't add up: a long text would be toxic by length.
    """
    n = len(offsets) - 1
    total = np.r_[0.0, np.cumsum(np.where(p >= 0.5, p, 0.0))]
    most = np.zeros(n)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        most[full] = np.maximum.reduceat(p, offsets[:-1][full])
    return np.stack([np.ones(n), np.log1p(total[offsets[1:]] - total[offsets[:-1]]), most], 1)


def offending(places: list[np.ndarray], words: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents whose word or beginning toxic documents alone use.

    Evidence is counted in distinct neighbourhoods, so a passage or document that is
    copied many times counts once; one that also stands in another document does not
    count as toxic.
    """
    owner = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    bad = toxic[owner]
    out = np.zeros(len(owner), bool)
    if not len(owner):
        return out
    around = mix(np.r_[np.uint64(1), words[:-1]] * np.uint64(3) + words) ^ mix(np.r_[words[1:], np.uint64(2)] + words)
    order = np.lexsort((bad, around))
    first = np.r_[True, around[order][1:] != around[order][:-1]]
    kept = order[first]  # one token of each neighbourhood, of an innocent document if it has one
    n1, n0 = max(int(bad[kept].sum()), 1), max(int((~bad[kept]).sum()), 1)
    for place in places[:-1]:
        a = np.bincount(place[kept][bad[kept]], minlength=1 << BITS).astype(float)
        b = np.bincount(place[kept][~bad[kept]], minlength=1 << BITS).astype(float)
        expect = (a + b) * n1 / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(a > 0, a * np.log(a / expect), 0) + np.where(b > 0, b * np.log(b / ((a + b) * n0 / (n1 + n0))), 0))
        good = (g > EVIDENCE) & (a / n1 > PRECISION / (1 - PRECISION) * b / n0)
        out |= good[place]
    return out & bad


def train(texts: pa.Array, toxic: np.ndarray) -> Model:
    """Fit the chain on token labels; the logistic function is still to be fitted."""
    words, places = features(texts)
    offsets = words.offsets
    y = offending(places, words.hashes, offsets, toxic)
    counts = np.r_[0, np.cumsum(y)]
    # passages of toxic documents without a labelled token teach nothing here
    taught = np.flatnonzero(~toxic | (counts[offsets[1:]] > counts[offsets[:-1]]))
    taught = np.random.default_rng(11).permutation(taught)
    sizes = np.diff(offsets)[taught]
    batches = np.split(taught, np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH)) + 1) if len(taught) else []
    model = Model(np.zeros((len(places), 1 << BITS)), -2.0, np.zeros((2, 2)), np.zeros(3))
    squares = [np.full_like(model.weights, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(EPOCHS):
        for part in batches:
            take = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in part])
            off = np.r_[0, np.cumsum(np.diff(offsets)[part])]
            if len(take):
                _climb(model, squares, [p[take] for p in places], off, y[take].astype(float), DECAY / len(batches))
    return model


def _climb(model: Model, squares: list, at: list[np.ndarray], off: np.ndarray, y: np.ndarray, decay: float) -> None:
    """One step on the likelihood of a batch, scaled by the gradients seen so far."""
    e = model.emissions(at)
    ahead, back, p = marginals(e, off, model.move)
    first = np.zeros(len(y), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    inner = np.flatnonzero(~first)
    wrong = y - p
    # pairs of states: forward of the one before, transition, emission and backward of this one
    t = np.exp(model.move)
    f, g = ahead[inner - 1], np.exp(np.clip(e[inner], -LIMIT, LIMIT)) * back[inner]
    joint = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] * g, t[1, 0] * f, t[1, 1] * f * g])
    joint /= joint.sum(0)
    now, before = y[inner], y[inner - 1]
    seen = np.array([((1 - before) * (1 - now)).sum(), ((1 - before) * now).sum(), (before * (1 - now)).sum(), (before * now).sum()])
    step = (seen - joint.sum(1)).reshape(2, 2)
    for k, place in enumerate(at):
        grad = np.bincount(place, wrong, 1 << BITS) - decay * model.weights[k]
        squares[0][k] += grad**2
        model.weights[k] += RATE * grad / np.sqrt(squares[0][k])
    total = wrong.sum()
    squares[1] += total**2
    model.bias += RATE * total / np.sqrt(squares[1])
    squares[2] += step**2
    model.move += RATE * step / np.sqrt(squares[2])


def logistic(x: np.ndarray, toxic: np.ndarray, class_weight: tuple[float, float]) -> np.ndarray:
    """Ridged Newton steps on the documents' summaries."""
    w = np.where(toxic, class_weight[1], class_weight[0])
    w = w / w.sum() * len(w)
    beta = np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -LIMIT, LIMIT)))
        ridge = np.diag([0.01, 0.05, 0.05])
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (w * (toxic - q)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    return beta


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts in runs of PASSAGE words."""
    for batch in batches:
        for part in pieces(batch, "text"):
            words = words_of(part.column(1), separators=NON_WORD, hashed=False)
            data, bounds = text_bytes(part.column(1))
            data = data.tobytes()
            who, cut = [], []
            for i in np.flatnonzero(words.counts()).tolist():
                heads = words.starts[words.offsets[i] : words.offsets[i + 1] : PASSAGE].tolist()
                ends = [*heads[1:], int(bounds[i + 1])]
                who += [i] * len(heads)
                cut += [data[s:e].decode("utf-8", "ignore") for s, e in zip(heads, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(who, pa.int64())), pa.array(cut, pa.string())], names=["toxic", "passage"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: tuple[int, int] = SAMPLE) -> Model | None:
    """Train on whole texts of a bounded sample of the labelled documents.

    The ids that hash lowest are taken: ``sample`` of either kind at most, and as many as ``SAMPLE_TEXT`` holds; an id whose
    texts are more than ``LARGEST`` of that is left to others.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    chosen = None
    for value, most in zip((True, False), sample, strict=True):
        part = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # sum(sample) ids at most, each with the size of all its texts
    sized = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.sum(F.octet_length("text").cast("bigint")).alias("size"))
    bound = F.when(F.col("toxic"), SAMPLE_TEXT[0]).otherwise(SAMPLE_TEXT[1])
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id"))
    fits = sized.where(F.col("size") <= bound * LARGEST).withColumn("held", so_far).where(F.col("held") <= bound).select("id", "toxic")
    taught = settle(texts.join(F.broadcast(fits), "id").select("id", "text", "toxic"))
    cut = taught.mapInArrow(passages, "toxic boolean, passage string")
    found = [cut.where(F.col("toxic") == value).orderBy(F.xxhash64("passage"), "passage").toPandas() for value in (True, False)]
    toxic = np.repeat([True, False], [len(x) for x in found])
    if not toxic.any() or toxic.all():
        return None
    model = train(pa.array([x for part in found for x in part.passage], pa.string()), toxic)
    known = summarised(taught, model).orderBy(F.xxhash64("id"), "id", "most", "amount").limit(sum(sample)).toPandas()
    release(taught)
    marks = known.toxic.to_numpy(bool)
    if not marks.any() or marks.all():
        return None
    x = np.stack([np.ones(len(known)), known.amount.to_numpy(), known.most.to_numpy()], 1)
    model.logistic = logistic(x, marks, (counts[False] / (~marks).sum(), counts[True] / marks.sum()))
    return model


def summarised(taught: DataFrame, model: Model) -> DataFrame:
    """(id, toxic, amount, most): the two summaries of each whole document."""
    ref = taught.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(ref.value)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                words, places = features(part.column(1))
                x = m.summaries(places, words.offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["id", "toxic", "amount", "most"])

    kind = taught.schema["id"].dataType.simpleString()
    return taught.mapInArrow(run, f"id {kind}, toxic boolean, amount double, most double")


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score from 0 to 1, and ``spans``: [first, after last] character of each offending run."""
    ref = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = pickle.loads(ref.value)
        for batch in batches:
            for part in pieces(batch, text_col, PIECE):
                n = part.num_rows
                score, spans = np.zeros(n), [[] for _ in range(n)]
                if m is not None:
                    words, places = features(part.column(1))
                    _, _, p = marginals(m.emissions(places), words.offsets, m.move)
                    score = m.score(summary(p, words.offsets))
                    data, bounds = text_bytes(part.column(1))
                    hot = np.flatnonzero(p >= 0.5)
                    owner = np.searchsorted(words.offsets, hot, "right") - 1
                    begin = np.r_[True, (np.diff(hot) > 1) | (np.diff(owner) > 0)] if len(hot) else np.zeros(0, bool)
                    heads = np.flatnonzero(begin)
                    chars = np.zeros(0)
                    if len(hot):
                        chars = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
                    for h, end in zip(heads, [*heads[1:], len(hot)][: len(heads)], strict=True):
                        base = chars[bounds[owner[h]] - 1] if bounds[owner[h]] else 0
                        first, last = words.starts[hot[h]], words.ends[hot[end - 1]]
                        spans[owner[h]].append([int(chars[first] - 1 - base), int(chars[last - 1] - base)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=[id_col, "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, spans array<array<int>>")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of all documents; held-out labels are not learnt from."""
    model = fit(docs, labels.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without those predicted toxic."""
    ref = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, labels.where(~held_out()), text_col=text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = pickle.loads(ref.value)
        for batch in batches:
            for part in pieces(batch, text_col, PIECE):
                if m is not None:
                    words, places = features(part.column(text_col))
                    score = m.score(summary(marginals(m.emissions(places), words.offsets, m.move)[2], words.offsets))
                    part = part.filter(pa.array(score < threshold))
                yield part

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
