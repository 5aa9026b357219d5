"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has a 64-bit SimHash of its weighted word shingles; so has every
window of a document that is as many words long as some item.  Fingerprints are
looked up by multi-index Hamming blocks: a fingerprint within ``RADIUS`` of an
item's agrees with it within ``RADIUS // BLOCKS`` bits in one block at least, and the
tables hold every block value that far from an item's, so none within the radius is
missed.  Candidates are then compared exactly: weighted Jaccard similarity of the
shingles with their counts, 0.8 or more.

A window can only be that similar if 2s/(1+s) of its shingles are shingles of the
benchmark; windows with fewer are not fingerprinted.  The benchmark is processed in
slices of bounded size, each broadcast to one pass over the documents; documents are
not shuffled.

Words are lower-cased runs of letters and digits (all bytes beyond ASCII included),
so punctuation and markup between words do not hide a passage.  An item of fewer
words than a shingle is one shingle.

Defined results: null and empty documents match nothing, nor do null items or items
without words; items of equal text all match; rows that repeat an id are one document, whose
best window is given, and so are rows without id; a very long text is
searched stretch by stretch, whole; of windows that tie the first is given; an empty
benchmark or table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.llm.arrays import NON_WORD, _BASE, mix, pieces, words_of
from lorebase.llm.tables import table

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of 64 by which the fingerprint of a match may differ, and blocks of the index.
RADIUS, BLOCKS = 19, 4
WIDTH = 64 // BLOCKS
#: Items in one slice, about; each takes some 45 kB of the index.
SLICE_ITEMS = 1000
#: Words whose windows are fingerprinted together at most.
REGION = 1 << 15


def grams(h: np.ndarray, k: int) -> np.ndarray:
    total = np.full(max(len(h) - k + 1, 0), k, np.uint64)
    for i in range(k):
        total = total * np.uint64(_BASE) + h[i : i + len(total)]
    return mix(total)


def votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    bits = np.unpackbits(mix(shingles + np.uint64(31)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int16) * 2 - 1


def fingerprint(total: np.ndarray) -> np.ndarray:
    return np.packbits(total > 0, axis=1, bitorder="little").copy().view(np.uint64).ravel()


class Index:
    """A slice of the benchmark: items by length, their fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, str]], k: int = SHINGLE, similarity: float = SIMILARITY):
        self.k, self.similarity = k, similarity
        words = words_of(pa.array([t for _, t in items], pa.string()), separators=NON_WORD)
        self.ids, self.sizes, self.sets, prints, known = [], [], [], [], []
        for i, (item, _) in enumerate(items):
            h = words.hashes[words.offsets[i] : words.offsets[i + 1]]
            if not len(h):
                continue
            g = grams(h, min(k, len(h)))
            self.ids.append(item)
            self.sizes.append(len(h))
            self.sets.append(Counter(g.tolist()))
            prints.append(fingerprint(votes(g).sum(0, keepdims=True))[0])
            known.append((min(k, len(h)), g))
        self.prints = np.array(prints, np.uint64)
        self.size = np.array(self.sizes, np.int64)
        #: shingle lengths in use, each with the benchmark's shingles and a bit table over them
        self.known = {}
        for m in {m for m, _ in known}:
            every = np.unique(np.concatenate([g for n, g in known if n == m]))
            table = np.zeros(1 << max(16, 8 + len(every).bit_length()), bool)
            table[(every & np.uint64(len(table) - 1)).astype(np.int64)] = True
            self.known[m] = every, table
        near = RADIUS // BLOCKS
        masks = [0] + [sum(1 << b for b in bits) for r in range(1, near + 1) for bits in combinations(range(WIDTH), r)]
        masks = np.array(masks, np.uint64)
        self.tables = []
        for b in range(BLOCKS):
            part = self.prints >> np.uint64(b * WIDTH) & np.uint64((1 << WIDTH) - 1)
            value = (part[:, None] ^ masks).ravel().astype(np.int64)
            item = np.repeat(np.arange(len(part)), len(masks))
            order = np.argsort(value, kind="stable")
            self.tables.append((item[order].astype(np.int32), np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)).astype(np.int64)))

    def lookup(self, prints: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) of all fingerprints within the radius of an item of their size."""
        out = set()
        for b, (items, starts) in enumerate(self.tables):
            value = (prints >> np.uint64(b * WIDTH) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            lo, n = starts[value], starts[value + 1] - starts[value]
            who = np.repeat(np.arange(len(prints)), n)
            item = items[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            ok = self.size[item] == size[who]
            who, item = who[ok], item[ok]
            ok = np.bitwise_count(prints[who] ^ self.prints[item]) <= RADIUS
            out.update(zip(who[ok].tolist(), item[ok].tolist(), strict=True))
        return sorted(out)

    def member(self, g: np.ndarray, m: int) -> np.ndarray:
        """Which shingles of m words are shingles of the benchmark."""
        every, quick = self.known[m]
        out = quick[(g & np.uint64(len(quick) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = every[np.minimum(np.searchsorted(every, g[at]), len(every) - 1)] == g[at]
        return out

    def search(self, h: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item id, first word, words, similarity) of every similar window of one text."""
        out = []
        for m in self.known:
            g = grams(h, m)
            total = np.r_[0, np.cumsum(self.member(g, m))]
            found = []
            for size in sorted({s for s in self.sizes if min(self.k, s) == m}):
                span = size - m + 1
                if len(g) >= span:
                    least = int(np.ceil(2 * self.similarity / (1 + self.similarity) * span - 1e-9))
                    found.append((span, np.flatnonzero(total[span:] - total[: len(g) - span + 1] >= least)))
            if not sum(len(s) for _, s in found):
                continue
            span, start = (np.concatenate(x) for x in zip(*((np.full(len(s), n), s) for n, s in found), strict=True))
            order = np.argsort(start, kind="stable")
            span, start = span[order], start[order]
            # batches are bounded in windows and in the stretch of text that they lie in
            region = start // REGION
            cuts = np.flatnonzero((np.diff(region) != 0) | (np.arange(1, len(start)) % 8192 == 0)) + 1
            for at in np.split(np.arange(len(start)), cuts):
                first, last = start[at].min(), (start[at] + span[at]).max()
                out += self._similar(g, first, last, start[at], span[at], m)
        return out

    def _similar(self, g: np.ndarray, first: int, last: int, start: np.ndarray, span: np.ndarray, m: int) -> list[tuple[int, int, int, float]]:
        """Fingerprint, look up and compare windows that lie from ``first`` to ``last``."""
        sums = np.zeros((last - first + 1, 64), np.int32)
        np.cumsum(votes(g[first:last]), axis=0, out=sums[1:])
        prints = fingerprint(sums[start + span - first] - sums[start - first])
        out = []
        for w, i in self.lookup(prints, span + m - 1):
            n = int(span[w])
            seen = Counter(g[start[w] : start[w] + n].tolist())
            both = sum((seen & self.sets[i]).values())
            alike = both / (2 * n - both)
            if alike >= self.similarity - 1e-12:
                out.append((self.ids[i], int(start[w]), n + m - 1, alike))
        return out


def finder(index_ref):  # noqa: ANN001, ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = pickle.loads(index_ref.value)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                words = words_of(part.column(1), separators=NON_WORD)
                hot = worth(index, words)
                rows = [(i, *x) for i in np.flatnonzero(hot) for x in index.search(words.hashes[words.offsets[i] : words.offsets[i + 1]])]
                who, item, start, size, alike = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(alike, pa.float64())],
                    names=["id", "item_id", "start_word", "n_words", "similarity"],
                )

    return run


def worth(index: Index, words) -> np.ndarray:  # noqa: ANN001
    """Texts with as many benchmark shingles as the shortest item's match needs."""
    n = len(words.offsets) - 1
    out = np.zeros(n, bool)
    for m in index.known:
        found = np.flatnonzero(index.member(grams(words.hashes, m), m))
        least = min(s for s in index.sizes if min(index.k, s) == m) - m + 1
        owner = np.searchsorted(words.offsets, found, "right") - 1
        out |= np.bincount(owner, minlength=n)[:n] >= 2 * index.similarity / (1 + index.similarity) * least - 1e-9
    return out


def indexes(benchmark: DataFrame, item_col: str = "item_id", k: int = SHINGLE, similarity: float = SIMILARITY, slice_items: int = SLICE_ITEMS) -> Iterator[Index]:
    """The benchmark in slices of about ``slice_items`` items, one at a time on the driver."""
    items = benchmark.where(F.col("text").isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), "text")
    slices = max(1, -(-items.count() // slice_items))
    for s in range(slices):
        part = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).toLocalIterator()]
        index = Index(sorted(part), k, similarity)
        if index.ids:
            yield index


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:  # noqa: ANN003
    """All similar (document, item) pairs with the most similar, then first window of each."""
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double"
    found = [base.mapInArrow(finder(sc.broadcast(pickle.dumps(index))), schema) for index in indexes(benchmark, **how)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    best = Window.partitionBy("id", "item_id").orderBy(F.desc("similarity"), "start_word")
    return reduce(DataFrame.union, found).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r").withColumnRenamed("id", id_col)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item; a row is decided where it is read."""

    def keeper(index_ref):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = pickle.loads(index_ref.value)
            for batch in batches:
                for part in pieces(batch, text_col, 2 << 20):
                    words = words_of(part.column(text_col), separators=NON_WORD)
                    keep = ~worth(index, words)
                    for i in np.flatnonzero(~keep):
                        keep[i] = not index.search(words.hashes[words.offsets[i] : words.offsets[i + 1]])
                    yield part.filter(pa.array(keep))

        return run

    for index in indexes(benchmark):
        docs = docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))), docs.schema)
    return docs


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
