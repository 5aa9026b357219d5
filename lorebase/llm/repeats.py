"""Substring deduplication by seed and extend.

A passage of ``window`` words or more that also starts earlier (in a document of
smaller id, or before in the same one) is removed, word by word: a word goes if some
window over it is a repeat.  Seeds are winnowed anchors: of the runs of ``k`` words
in a window the one with the smallest hash, so equal windows have the same anchor at
the same place.  Blocks first learn which of their anchors occur elsewhere.  Round
those, a seed stands for the windows that hold it; each meets the first place of its
words in the corpus, and windows that follow one another in both documents extend to
a maximal repeat: its first word and length, and the document and word it repeats.
A longer repeat is cut only where its words also start at a still earlier place.  Of
windows that a block holds several times only the earliest is sent, so a passage
that a third of all documents share costs one entry per block, and documents are
joined with the first that holds a passage, not pairwise.

The texts are dealt out once; the three steps use that exchange again.

Defined results: a null or empty text has no words; texts shorter than a window lose
nothing; rows that tie in id and place are not earlier than one another; rows with a
null id come after all others; repeated rows each get their row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.arrays import _BASE, Words, inside, mix, tidied, words_of
from lorebase.llm.blocks import block_count, block_of, bucket_bounds, bucket_count, buffers, from_low, low_bytes, packed, text_size, unpacked
from lorebase.llm.tables import table

LAST = np.iinfo(np.int64).max
SEED_WORDS = 8


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, across texts too."""
    n = max(len(h) - k + 1, 0)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total *= np.uint64(_BASE)
        total += h[i : i + n]
    return mix(total)


def leftmost_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of the w values from each position, the leftmost of equals."""
    best, at, reach = v, np.arange(len(v), dtype=np.int32), 1
    while reach < w:
        step = min(reach, w - reach)
        n = len(best) - step
        right = best[step:] < best[:n]
        at = np.where(right, at[step:], at[:n])
        best = np.where(right, best[step:], best[:n])
        reach += step
    return at


class Block:
    """The words of a block's texts in the order of id and text, and their windows' anchors."""

    def __init__(self, part: pa.Table, window: int):
        part = part.sort_by([("id", "ascending"), ("text", "ascending")])
        self.part = part
        self.words: Words = words_of(part.column("text").combine_chunks(), lower=False)
        self.ids = pc.fill_null(part.column("id").combine_chunks(), LAST).to_numpy()
        h = self.words.hashes
        k = min(SEED_WORDS, max(1, window // 2))
        self.starts = inside(self.words, window)
        if not len(self.starts):
            self.distinct = np.zeros(0, np.uint64)
            return
        grams = rolled(h, k)
        anchor = leftmost_minimum(grams, window - k + 1)[self.starts]
        new = np.r_[True, anchor[1:] != anchor[:-1]]
        # anchors are minima, so their hashes crowd at the low end; mixed again they are even over the buckets
        self.distinct, place, self.times = np.unique(mix(grams[anchor[new]] + np.uint64(0x51ED)), return_inverse=True, return_counts=True)
        #: each window's anchor among the distinct ones
        self.place = place[np.cumsum(new) - 1]

    def chosen(self, repeated: np.ndarray, window: int, buckets: int):  # noqa: ANN201
        """Windows on repeated anchors, of which the earliest of equals are to be sent.

        Returns positions, the index of each one's earliest equal, whether it is later
        than that, and the earliest ones' indices in the order they are sent, with
        bucket bounds.
        """
        use = np.flatnonzero(repeated[self.place]) if len(self.starts) else np.zeros(0, np.int64)
        at = self.starts[use]
        owner = np.searchsorted(self.words.offsets, at, "right") - 1
        ids, start = self.ids[owner], at - self.words.offsets[owner]
        full = rolled(self.words.hashes, window)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.lexsort((start, ids, full))
        head = np.r_[True, full[order][1:] != full[order][:-1]] if len(order) else np.zeros(0, bool)
        lead = np.empty(len(order), np.int64)
        lead[order] = order[head][np.cumsum(head) - 1] if len(order) else 0
        later = (ids > ids[lead]) | (start > start[lead])
        sent = order[head]
        edges = bucket_bounds(self.distinct, buckets)
        bucket = np.searchsorted(edges[1:], self.place[use[sent]], "right") if len(sent) else np.zeros(0, np.int64)
        by = np.lexsort((start[sent], ids[sent], bucket))
        sent, bucket = sent[by], bucket[by]
        return at, lead, later, sent, np.searchsorted(bucket, np.arange(buckets + 1)), full, ids, start


ROWS = pa.schema([("block", pa.int32()), ("step", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
ROWS_SQL = "block int, step int, bucket int, a binary, b binary, c binary"
REPLY = pa.schema([("block", pa.int32()), ("step", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary())])
REPLY_SQL = "block int, step int, bucket int, bits binary, ids binary, starts binary"


REPEAT = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())])
REPEAT_SQL = "array<struct<start:int,length:int,source_id:bigint,source_start:int>>"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def seeds(window: int, buckets: int):  # noqa: ANN201
    """Step 1: a block's distinct anchors, and whether it has each more than once."""

    def run(part: pa.Table) -> pa.Table:
        block = Block(part, window)
        d = block.distinct
        cuts = bucket_bounds(d, buckets)
        number = part.column("block")[0].as_py()
        return _rows([(number, 1, b, low_bytes(d[i:j]), np.packbits(block.times[i:j] > 1).tobytes(), None) for b in range(buckets) if (i := cuts[b]) < (j := cuts[b + 1])], ROWS)

    return run


def shared_seeds(part: pa.Table) -> pa.Table:
    """A bucket's answer: which anchors occur more than once in all blocks."""
    hashes = [from_low(x) for x in buffers(part.column("a"))]
    sizes = [len(x) for x in hashes]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(buffers(part.column("b")), sizes, strict=True)])
    _, place, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    several = (times > 1) | (np.bincount(place, weights=twice) > 0)
    return _replies(part, several[place], sizes)


def _replies(part: pa.Table, bits: np.ndarray, sizes: list[int], ids: np.ndarray | None = None, starts: np.ndarray | None = None) -> pa.Table:
    """Answers to each row's entries: a bit, and where it is set and places are given, the place."""
    cuts = np.cumsum(sizes)[:-1]
    each = np.split(bits, cuts)
    parts = [np.packbits(x).tobytes() for x in each]
    if ids is None:
        places = [[None] * len(parts)] * 2
    else:
        places = [[x[b].tobytes() for x, b in zip(np.split(ids, cuts), each, strict=True)], [packed(x[b]) for x, b in zip(np.split(starts, cuts), each, strict=True)]]
    return pa.table([part.column("block"), part.column("step"), part.column("bucket"), *(pa.array(x, pa.binary()) for x in (parts, *places))], schema=REPLY)


def _places(replies: pa.Table, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of the first equal of each sent window that has an earlier one."""
    steps, bucket = replies.column("step").to_numpy(), replies.column("bucket").to_numpy()
    rows = [i for i in np.argsort(bucket, kind="stable") if steps[i] == 2]
    ids, starts = (dict(zip(rows, buffers(replies.column(c).take(pa.array(rows, pa.int64()))), strict=True)) for c in ("ids", "starts"))
    out = np.zeros(len(earlier), np.int64), np.zeros(len(earlier), np.int64)
    if rows:
        out[0][earlier] = np.concatenate([np.frombuffer(ids[i], np.int64) for i in rows])
        out[1][earlier] = np.concatenate([unpacked(starts[i]) for i in rows])
    return out


def _bits(replies: pa.Table, step: int, sizes: np.ndarray) -> np.ndarray:
    """The answers of one step in the order in which a block asked."""
    steps, bucket, values = replies.column("step").to_numpy(), replies.column("bucket").to_numpy(), buffers(replies.column("bits"))
    out = [np.unpackbits(np.frombuffer(values[i], np.uint8), count=int(sizes[bucket[i]])) for i in np.argsort(bucket, kind="stable") if steps[i] == step]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def extensions(window: int, buckets: int):  # noqa: ANN201
    """Step 2: the windows round a block's repeated anchors, the earliest of equals."""

    def run(part: pa.Table, replies: pa.Table) -> pa.Table:
        if not part.num_rows or not replies.num_rows:
            return _rows([], ROWS)
        block = Block(part, window)
        repeated = _bits(replies, 1, np.diff(bucket_bounds(block.distinct, buckets)))
        _, _, _, sent, cuts, full, ids, start = block.chosen(repeated, window, buckets)
        number, rows = part.column("block")[0].as_py(), []
        for b in range(buckets):
            i, j = cuts[b], cuts[b + 1]
            if i < j:
                at = sent[i:j]
                rows.append((number, 2, b, full[at].tobytes(), ids[at].tobytes(), np.diff(start[at], prepend=0).astype(np.int32).tobytes()))
        return _rows(rows, ROWS)

    return run


def later_windows(part: pa.Table) -> pa.Table:
    """A bucket's answer: which windows have an earlier equal."""
    full = [np.frombuffer(x, np.uint64) for x in buffers(part.column("a"))]
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in buffers(part.column("b"))])
    start = np.concatenate([np.cumsum(np.frombuffer(x, np.int32), dtype=np.int64) for x in buffers(part.column("c"))])
    sizes = [len(x) for x in full]
    hashes = np.concatenate(full)
    order = np.lexsort((start, ids, hashes))
    head = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[head][np.cumsum(head) - 1]
    return _replies(part, (ids > ids[lead]) | (start > start[lead]), sizes, ids[lead], start[lead])


def cleaned(window: int, buckets: int, cut: bool, keep: tuple[str, ...] = ()):  # noqa: ANN201
    """Step 3: windows extend to maximal repeats; the texts without them, with word counts."""

    def run(part: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["id", "text", "n_words", "n_removed", "spans", "repeats", *(f"keep_{c}" for c in keep)]
        if not part.num_rows:
            return pa.table([part.column("id"), part.column("text"), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(REPEAT))), *(part.column(c) for c in names[6:])], names=names)
        block = Block(part, window)
        words = block.words
        gone = np.zeros(len(words.hashes) + 1, np.int32)
        found: list[list[dict]] = [[] for _ in range(block.part.num_rows)]
        if replies.num_rows and len(block.distinct):
            repeated = _bits(replies, 1, np.diff(bucket_bounds(block.distinct, buckets)))
            at, lead, later, sent, cuts, _, ids, start = block.chosen(repeated, window, buckets)
            earlier = np.zeros(len(at), bool)
            earlier[sent] = _bits(replies, 2, np.diff(cuts))
            # a window's source is the first place of all, or else its block's first
            first_id, first_start, known = ids.copy(), start.copy(), earlier[sent]
            got_id, got_start = _places(replies, known)
            first_id[sent], first_start[sent] = np.where(known, got_id, ids[sent]), np.where(known, got_start, start[sent])
            hit = np.flatnonzero(later | earlier[lead])
            hit = hit[np.argsort(at[hit], kind="stable")]
            place, source, begin = at[hit], first_id[lead[hit]], first_start[lead[hit]]
            owner = np.searchsorted(words.offsets, place, "right") - 1
            # windows that follow one another here and there are one repeat
            head = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(owner) != 0) | (np.diff(source) != 0) | (np.diff(begin) != 1)]) if len(hit) else np.zeros(0, np.int64)
            long = np.diff(np.r_[head, len(hit)]) + window - 1
            np.add.at(gone, place[head], 1)
            np.add.at(gone, place[head] + long, -1)
            for o, p, n, d, q in zip(owner[head].tolist(), (place[head] - words.offsets[owner[head]]).tolist(), long.tolist(), source[head].tolist(), begin[head].tolist(), strict=True):
                found[o].append({"start": p, "length": n, "source_id": None if d == LAST else d, "source_start": q})
        gone = np.cumsum(gone)[:-1] > 0
        texts, removed, spans = [], [], []
        data = words.data.tobytes()
        bounds = np.r_[0, np.cumsum([len(x) for x in buffers(pc.cast(block.part.column("text"), pa.binary()))])]
        total = np.r_[0, np.cumsum(gone)]
        for i in range(block.part.num_rows):
            a, b = words.offsets[i], words.offsets[i + 1]
            lost = int(total[b] - total[a])
            removed.append(lost)
            if not lost:
                raw = data[bounds[i] : bounds[i + 1]]
                texts.append(raw if cut else b" ".join(raw.split()))
                spans.append([])
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False].astype(np.int8)))
            spans.append(edge.reshape(-1, 2).tolist())
            kept = np.flatnonzero(np.diff(np.r_[False, ~gone[a:b], False].astype(np.int8))).reshape(-1, 2) + a
            runs = [data[words.starts[s] : words.ends[e - 1]] for s, e in kept.tolist()]
            texts.append(b"\n".join(runs) if cut else b" ".join(w for r in runs for w in r.split()))
        return pa.table(
            [block.part.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(found, pa.list_(REPEAT)), *(block.part.column(c) for c in names[6:])],
            names=names,
        )

    return run


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", cut: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, kept text, n_words, n_removed, ``spans`` of removed words [first, after last],
    the maximal ``repeats`` they come from, and the columns in ``keep``.

    ``cut``: leave the text as it is but for the removed spans; else join words by one space.
    """
    size = text_size(docs, text_col)
    blocks, buckets = block_count(size), bucket_count(size)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    texts = base.withColumn("block", block_of(blocks, "id", "text")).repartition(blocks, "block")
    by_block = texts.groupBy("block")
    known = by_block.applyInArrow(tidied(seeds(window, buckets)), ROWS_SQL).groupBy("bucket").applyInArrow(tidied(shared_seeds), REPLY_SQL)
    sent = by_block.cogroup(known.groupBy("block")).applyInArrow(tidied(extensions(window, buckets)), ROWS_SQL)
    replies = known.union(sent.groupBy("bucket").applyInArrow(tidied(later_windows), REPLY_SQL))
    kinds = "".join(f", `keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = by_block.cogroup(replies.groupBy("block")).applyInArrow(tidied(cleaned(window, buckets, cut, keep)), f"id bigint, text string, n_words bigint, n_removed bigint, spans array<array<int>>, repeats {REPEAT_SQL}{kinds}")
    return out.withColumnsRenamed({"id": id_col, "text": text_col, **{f"keep_{c}": c for c in keep}})


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: Every window of 20 words as text; all but the first of equal ones cover what is removed.
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
g AS (SELECT doc_id, pos, word, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS run
      FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY n, run ORDER BY doc_id, pos) > 1 AS later FROM g),
c AS (SELECT doc_id, pos, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""
QUERIES = {"op6_repeats": op6_repeats}
ORACLES = {"op6_repeats": ORACLE}
