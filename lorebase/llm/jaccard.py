"""N-gram Jaccard self-join with several global token orders.

A document is the set of its distinct k-word shingles.  For a similarity of t, two
sets share ``LEAST`` tokens (or all they must share) among the first
``n - ceil(t * n) + LEAST`` of either under *every* global order, and one among the
first ``n - ceil(t * n) + 1``.  The first order puts rare shingles first: a table
holds how common the repeated ones are (any function of the token is a valid order,
so a coarse table costs time, never links).  Pairs that share enough prefix tokens
under it must also share one under two pseudo-random orders, whose prefixes travel
as fingerprints; only the pairs in the intersection have their sets compared.

Copies are one class before they are joined.  A long posting list, as a group of
thousands of near copies makes, is first joined as a star.  What a pair shares in long
lists is not counted, so pairs of short lists may lack as many tokens as either set has
in long ones; only sets with all that a pair must share in long lists can have a link
that no short list shows.  Those that are then in different components meet again under
another order of rare shingles first, where lists of unrelated documents fall apart; what
is long there too is dealt as pairs of parts of bounded size.  So the pairs of a group are
never all made, and no link between components is lost.

Defined results: null and empty texts, and texts of white space, have empty sets and
link with nothing; a text of fewer than k words is one shingle; equal sets always
link; rows that repeat an id are one node; rows with a null id keep their count and
have no component; very long texts are hashed in slices; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.arrays import _BASE, mix, pieces, runs, tidied, words_of
from lorebase.llm.blocks import bucket_count, buffers, from_low, low_bytes, packed, text_size, unpacked
from lorebase.llm.components import components
from lorebase.llm.tables import release, scratch, settle, table

#: Prefix tokens of the first order that a pair must share, where it must share so many at all.
LEAST = 4
#: Members of a posting list up to which all its pairs are made at once.
SHORT = 48
#: Members in a part of a list that is long under two orders.
PART = 256
#: Parity bits of a set that are compared within such parts.
SKETCH = 2048
#: Most cells of the table of common shingles (a byte each) and bits of the table of candidates; both grow with the input up to here.
CELLS, ID_BITS = 1 << 24, 1 << 28
#: Cells or bits that one task sums up; entries that a task holds before it sends them.
SLICE, FLUSH = 1 << 18, 1 << 20
#: Salts that deal a hot token's rows out before a join on it.
SALTED = 32
ORDERS = (np.uint64(0), np.uint64(0xA5A5F00D12345677), np.uint64(0x5DEECE66D1234567))


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle) of all distinct shingles in order of text and shingle, and each text's number of them."""
    words = words_of(column)
    count = words.counts()
    hashes, where = runs(words, k)
    owner = np.repeat(np.arange(len(count)), count)[where]
    all_h, all_o = [hashes], [owner]
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            total = np.full(len(short), m, np.uint64)
            for i in range(m):
                total = total * np.uint64(_BASE) + words.hashes[words.offsets[short] + i]
            all_h.append(mix(total))
            all_o.append(short)
    h, o = np.concatenate(all_h), np.concatenate(all_o)
    order = np.argsort((o.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    h, o = h[order], o[order]
    if len(h) and ((o[1:] == o[:-1]) & (h[1:] < h[:-1])).any():  # hashes that agree in 48 bits
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[first], o[first]
    return o, h, np.bincount(o, minlength=len(count))


def digests(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set as two longs."""
    out = []
    starts = np.r_[0, np.cumsum(n)]
    for salt in (0x1111, 0x2222222222):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h + np.uint64(salt)), out=sums[1:])
        out.append((sums[starts[1:]] - sums[starts[:-1]]).view(np.int64))
    return out[0], out[1]


def prefix_length(n: np.ndarray, percent: int, shared: int = 1) -> np.ndarray:
    return np.where(n > 0, np.minimum(n - -(-percent * n // 100) + shared, n), 0)


def prefixes(o: np.ndarray, h: np.ndarray, n: np.ndarray, size: np.ndarray, order: int, cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of the first ``size`` tokens of each text, a token being its place in the order in 48 bits."""
    key = mix(h ^ ORDERS[order]) >> np.uint64(20)
    if cells is not None:
        key |= cells[(h & np.uint64(len(cells) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(44)
    both = np.sort((o.astype(np.uint64) << np.uint64(48)) | key)
    rank = np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n)
    take = both[rank < np.repeat(size, n)]
    # two tokens of a text at one place count as two
    take[1:] ^= (take[1:] == take[:-1]).astype(np.uint64)
    return (take >> np.uint64(48)).astype(np.int64), take & np.uint64((1 << 48) - 1)


def enough(nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Do the sizes allow the similarity?"""
    return 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)


def fingerprints(o: np.ndarray, h: np.ndarray, n: np.ndarray, percent: int) -> list[bytes]:
    """Each text's prefixes under the second and third order, two bytes a token (four in long prefixes)."""
    size = prefix_length(n, percent)
    cuts = np.cumsum(size)[:-1]
    parts = [np.split(prefixes(o, h, n, size, order)[1].astype(np.uint32), cuts) for order in (1, 2)]
    return [b"".join(x.astype(np.uint16 if len(x) <= 256 else np.uint32).tobytes() for x in pair) for pair in zip(*parts, strict=True)]


def profile(k: int, percent: int, cells: int):  # noqa: ANN201
    """Per row: id, set size, digest and fingerprints; per part of the input: its shingles that several texts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                o, h, n = shingle_sets(part.column(1), k)
                a, b = digests(h, n)
                many, times = np.unique(h, return_counts=True)
                common = times > 1
                at = (many[common] & np.uint64(cells - 1)).astype(np.int64)
                order = np.argsort(at)
                at, times = at[order], times[common][order]
                slices = np.unique(at // SLICE)
                cuts = np.searchsorted(at, slices[1:] * SLICE)
                rows, extra = part.num_rows, len(slices)
                blank = pa.nulls(extra, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column(0), pa.nulls(extra, part.column(0).type)]),
                        pa.concat_arrays([pa.array(n, pa.int64()), blank]),
                        pa.concat_arrays([pa.array(a), blank]),
                        pa.concat_arrays([pa.array(b), blank]),
                        pa.array([*fingerprints(o, h, n, percent), *([None] * extra)], pa.binary()),
                        pa.concat_arrays([pa.nulls(rows, pa.int32()), pa.array(slices, pa.int32())]),
                        pa.array([None] * rows + [(x % SLICE).astype(np.int32).tobytes() for x in np.split(at, cuts)][:extra], pa.binary()),
                        pa.array([None] * rows + [x.astype(np.int32).tobytes() for x in np.split(times, cuts)][:extra], pa.binary()),
                    ],
                    names=["id", "n", "a", "b", "prints", "slice", "cells", "times"],
                )

    return run


def common_cells(profiles: DataFrame, cells: int) -> np.ndarray:
    """Class of how often each cell's commonest shingles were seen, 0 to 15: a byte a cell."""

    def summed(part: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for c, t in zip(buffers(part.column("cells")), buffers(part.column("times")), strict=True):
            np.add.at(total, np.frombuffer(c, np.int32), np.frombuffer(t, np.int32))
        at = np.flatnonzero(total)
        return pa.table({"slice": part.column("slice")[:1], "part": part.column("part")[:1], "cells": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "times": pa.array([np.minimum(total[at], 1 << 30).astype(np.int32).tobytes()], pa.binary())})

    sparse = profiles.where("cells IS NOT NULL").select("slice", F.pmod(F.xxhash64("cells"), F.lit(32)).cast("int").alias("part"), "cells", "times")
    schema = "slice int, part int, cells binary, times binary"
    found = sparse.groupBy("slice", "part").applyInArrow(tidied(summed), schema).withColumn("part", F.lit(0)).groupBy("slice", "part").applyInArrow(tidied(summed), schema)
    out = np.zeros(cells, np.uint8)
    for row in found.toLocalIterator():  # cells / SLICE rows
        at, times = np.frombuffer(row.cells, np.int32), np.frombuffer(row.times, np.int32)
        out[row.slice * SLICE + at] = np.minimum(15, 1 + np.log2(times) / 2)
    return out


def postings(k: int, percent: int, buckets: int, cells_ref):  # noqa: ANN001, ANN201
    """Prefix entries (token, id, set size, digest) under the first order, by bucket.

    A task collects the entries of all its texts up to FLUSH of them, so rows are long.
    """
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("tokens", "ids", "sizes", "digests"))])

    def sent(entries: list[tuple]) -> pa.RecordBatch:
        token, ids, n, digest = (np.concatenate(x) for x in zip(*entries, strict=True))
        bucket = ((mix(token) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((token, bucket))
        token, ids, n, digest, bucket = token[order], ids[order], n[order], digest[order], bucket[order]
        have, begin = np.unique(bucket, return_index=True)
        rows: list[list] = [have.tolist(), [], [], [], []]
        for i, j in zip(begin, [*begin[1:], len(token)], strict=True):
            least = int(ids[i:j].min())
            rows[1].append(low_bytes(token[i:j]))
            rows[2].append(least.to_bytes(8, "little", signed=True) + packed((ids[i:j] - least).view(np.uint64)))
            rows[3].append(packed(n[i:j]))
            rows[4].append(digest[i:j].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(cells_ref.value, np.uint8)
        held: list[tuple] = []
        for batch in batches:
            for part in pieces(batch, "text"):
                o, h, n = shingle_sets(part.column(1), k)
                digest = digests(h, n)[0]
                ids = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                # of equal sets the smallest id stands for its class
                chosen = np.flatnonzero(np.asarray(part.column(0).is_valid()) & (n > 0))
                chosen = chosen[np.lexsort((ids[chosen], digest[chosen]))]
                fresh = np.ones(len(chosen), bool)
                fresh[1:] = digest[chosen][1:] != digest[chosen][:-1]
                size = np.zeros(len(n), np.int64)
                size[chosen[fresh]] = prefix_length(n, percent, LEAST)[chosen[fresh]]
                who, token = prefixes(o, h, n, size, 0, cells)
                held.append((token, ids[who], n[who], digest[who]))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield sent(held)
                    held = []
        if held and sum(len(x[0]) for x in held):
            yield sent(held)

    return run


def candidates(percent: int):  # noqa: ANN201
    """Pairs of one bucket's lists (y set) with how many tokens they share, and members of its long lists (token set)."""

    def run(part: pa.Table) -> pa.Table:
        token = np.concatenate([from_low(x) for x in buffers(part.column("tokens"))])
        ids = np.concatenate([unpacked(x[8:]) + int.from_bytes(x[:8], "little", signed=True) for x in buffers(part.column("ids"))])
        n = np.concatenate([unpacked(x) for x in buffers(part.column("sizes"))])
        digest = np.concatenate([np.frombuffer(x, np.int64) for x in buffers(part.column("digests"))])
        order = np.lexsort((ids, digest, n, token))
        token, ids, n, digest = token[order], ids[order], n[order], digest[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1]) | (n[1:] != n[:-1])
        token, ids, n = token[fresh], ids[fresh], n[fresh]
        _, start, size = np.unique(token, return_index=True, return_counts=True)
        several = np.repeat(size > 1, size)  # a token of one class is no list
        token, ids, n, size = token[several], ids[several], n[several], size[size > 1]
        start = np.cumsum(size) - size
        long = np.repeat(size > SHORT, size)
        xs, ys, sure = [], [], []
        for d in range(1, min(SHORT, len(token))):
            i = np.flatnonzero((token[:-d] == token[d:]) & ~(long[d:] & (d > 2)))
            if not len(i):
                break
            i = i[enough(n[i], n[i + d], percent)]
            # what a pair must share under this order; in long lists it is not counted
            need = np.minimum(LEAST, -(-percent * n[i + d] // 100))
            xs.append(ids[i]), ys.append(ids[i + d]), sure.append(np.where(long[i], 0, need))
        # stars of long lists: every member with the first whose size is compatible
        for s, c in zip(start[size > SHORT], size[size > SHORT], strict=True):
            sizes, members, at = n[s : s + c], ids[s : s + c], 0
            while at < c:
                end = max(int(np.searchsorted(sizes * percent, sizes[at] * 100, "right")), at + 1)
                xs.append(np.full(end - at - 1, members[at])), ys.append(members[at + 1 : end]), sure.append(np.zeros(end - at - 1, np.int64))
                at = end
        x, y, need = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys, sure))
        x, y, need = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], need[x != y]
        order = np.lexsort((need, y, x))
        x, y, need = x[order], y[order], need[order]
        head = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
        times = np.diff(np.r_[head, len(x)])
        x, y, need = x[head], y[head], need[head]
        m = int(long.sum())
        own = np.minimum(LEAST, -(-percent * n[long] // 100))
        return pa.table(
            {
                "x": pa.array(np.r_[x, ids[long]], pa.int64()),
                "y": pa.concat_arrays([pa.array(y, pa.int64()), pa.nulls(m, pa.int64())]),
                "times": pa.array(np.r_[times, np.zeros(m, np.int64)], pa.int32()),
                "need": pa.array(np.r_[need, own], pa.int32()),
                "token": pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(token[long].astype(np.int64), pa.int64())]),
            }
        )

    return run


def sharing(prints: list[list[memoryview]]) -> np.ndarray:
    """Which pairs share a prefix token under both further orders, by their fingerprints."""
    wide = [np.array([len(p) > 1024 for p in side]) for side in prints]
    short = ~(wide[0] & wide[1])
    out = np.ones(len(short), bool)
    for half in (0, 1):
        keys = []
        for side, w in zip(prints, wide, strict=True):
            values, sizes = [], []
            for p, four in zip(side, w, strict=True):
                middle = len(p) // 2
                v = np.frombuffer(p[middle:] if half else p[:middle], np.uint32 if four else np.uint16)
                values.append(v.astype(np.uint64))
                sizes.append(len(v))
            pair = np.repeat(np.arange(len(sizes)), sizes)
            token = np.concatenate(values) if values else np.zeros(0, np.uint64)
            token = np.where(short[pair], token & np.uint64(0xFFFF), token)
            keys.append((pair.astype(np.uint64) << np.uint64(32)) | token)
        met = np.zeros(len(short), bool)
        met[(np.intersect1d(*keys) >> np.uint64(32)).astype(np.int64)] = True
        out &= met
    return out


def tasks_for(pairs: DataFrame) -> int:
    """Tasks that many settled pairs are worth: a few pairs don't need a Python worker in every partition."""
    return max(12, pairs.count() // 4000)


def intersected(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes allow and that share prefix tokens under the other orders too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["x", "y"]).filter(pa.array(sharing([buffers(batch.column(2)), buffers(batch.column(3))])))

    left, right = (profiles.select(F.col("id").alias(c), F.col("prints").alias(f"p{c}"), F.col("n").alias(f"n{c}")) for c in "xy")
    fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    # merge joins: a broadcast would put several Python workers into one stage
    return pairs.hint("merge").join(left, "x").hint("merge").join(right, "y").where(fits).select("x", "y", "px", "py").coalesce(tasks_for(pairs)).mapInArrow(run, "x bigint, y bigint")


def id_bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)


def candidate_bits(ids: DataFrame, bits: int) -> bytes:
    """A bit for each candidate id; other ids may pass, none is lost.  Tasks OR their slices; the driver gets ``bits`` bits."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(id_bit(batch.column(0).to_numpy(), bits))
            slices, begin = np.unique(at // SLICE, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([(x % SLICE).astype(np.int32).tobytes() for x in np.split(at, begin[1:])][: len(slices)], pa.binary())], names=["slice", "at"])

    def merged(part: pa.Table) -> pa.Table:
        own = np.zeros(SLICE, bool)
        for x in buffers(part.column("at")):
            own[np.frombuffer(x, np.int32)] = True
        return pa.table({"slice": part.column("slice")[:1], "at": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(max(bits, SLICE) // 8, np.uint8)
    for row in ids.mapInArrow(opened, "slice int, at binary").groupBy("slice").applyInArrow(tidied(merged), "slice int, at binary").toLocalIterator():
        out[row.slice * SLICE // 8 : (row.slice + 1) * SLICE // 8] = np.frombuffer(row.at, np.uint8)
    return out.tobytes()


def of_candidates(make, bits_ref, bits: int, schema: pa.Schema | None):  # noqa: ANN001, ANN201
    """mapInArrow function: ``make`` of the parts of the input (themselves if None), less rows whose id is no candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.frombuffer(bits_ref.value, np.uint8)
        for batch in batches:
            for part in pieces(batch, "text") if make else [batch]:
                known = part.filter(part.column(0).is_valid())
                at = id_bit(known.column(0).to_numpy(), bits)
                part = known.filter(pa.array((table_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
                if make is None:
                    yield part
                elif part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(make(part), schema, strict=True)], schema=schema)

    return run


def parity(h: np.ndarray, o: np.ndarray, rows: int) -> np.ndarray:
    """SKETCH parity bits of each set: as many differ at most as the sets do."""
    bit = (mix(h + np.uint64(99)) & np.uint64(SKETCH - 1)).astype(np.int64)
    odd = np.bincount(o * SKETCH + bit, minlength=rows * SKETCH).reshape(rows, SKETCH) & 1
    return np.packbits(odd.astype(bool), axis=1)


def apart(x: np.ndarray, y: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Do the sketches show that sets of ``both`` shingles together are not similar?"""
    return np.bitwise_count(x ^ y).sum(1) > both - 2 * -(-percent * both // (100 + percent))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact comparison of two sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Join:
    """One self-join: its base (id, text), profiles, and the sizes of its tables."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        self.k, self.percent, self.spark = k, percent, docs.sparkSession
        self.base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        size = text_size(self.base, "text")
        self.buckets = bucket_count(size)
        self.cells = min(CELLS, max(SLICE, 1 << (size // 64).bit_length()))
        profiles = settle(self.base.mapInArrow(profile(k, percent, self.cells), "id bigint, n bigint, a bigint, b bigint, prints binary, slice int, cells binary, times binary"))
        self.profiles = profiles
        self.rows = profiles.where("slice IS NULL").select("id", "n", "a", "b")
        # rows that repeat id and text would multiply in joins on the id
        if not self.rows.where("id IS NOT NULL").groupBy("id", "a", "b").count().where("count > 1").isEmpty():
            self.base = settle(self.base.dropDuplicates(["id", "text"]))
        self.bits = min(ID_BITS, max(SLICE, 1 << (16 * profiles.count()).bit_length()))

    def prints(self) -> DataFrame:
        return self.profiles.where("slice IS NULL AND id IS NOT NULL AND n > 0").select("id", "n", "prints")

    def bits_of(self, pairs: DataFrame):  # noqa: ANN201
        return self.spark.sparkContext.broadcast(candidate_bits(pairs.select("x").union(pairs.select("y")), self.bits))

    def candidates(self) -> DataFrame:
        self.common = cells = self.spark.sparkContext.broadcast(common_cells(self.profiles, self.cells).tobytes())
        entries = self.base.mapInArrow(postings(self.k, self.percent, self.buckets, cells), "bucket int, tokens binary, ids binary, sizes binary, digests binary")
        return settle(entries.groupBy("bucket").applyInArrow(tidied(candidates(self.percent)), "x bigint, y bigint, times int, need int, token bigint"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The distinct ``pairs`` that pass the other orders' filters and whose sets are similar."""
        percent, k = self.percent, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [similar(from_low(p), from_low(q), percent) for p, q in zip(buffers(batch.column(2)), buffers(batch.column(3)), strict=True)]
                yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

        def sets(part: pa.RecordBatch) -> list:
            _, h, n = shingle_sets(part.column(1), k)
            return [part.column(0), [low_bytes(x) for x in np.split(h, np.cumsum(n)[:-1])]]

        pairs = settle(pairs)
        bits = self.bits_of(pairs)
        near = self.prints().mapInArrow(of_candidates(None, bits, self.bits, None), "id bigint, n bigint, prints binary")
        left = settle(intersected(pairs, near, percent))
        if 4 * left.count() < pairs.count():  # many pairs fell away: so do their sets
            bits = self.bits_of(left)
        schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])
        texts = self.base.mapInArrow(of_candidates(sets, bits, self.bits, schema), "id bigint, shingles binary")
        p, q = (texts.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "xy")
        out = settle(left.hint("merge").join(p, "x").hint("merge").join(q, "y").select("x", "y", "sx", "sy").coalesce(tasks_for(left)).mapInArrow(run, "x bigint, y bigint").distinct())
        release(left, pairs)
        return out

    def across(self, members: DataFrame, links: DataFrame) -> DataFrame | None:
        """Links between members (token, x, need) of long lists that ``links`` leave in different components and that no short list shows."""
        percent, k = self.percent, self.k
        known = components(links)
        labelled = settle(heavy(members).join(known, F.col("x") == known.id, "left").select("token", "x", "need", F.coalesce("component", "x").alias("component")))
        several = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        # both of a pair are in all lists that they share
        apart_ = settle(heavy(salted(labelled, several), ("component",)).select("x", "component").distinct())
        if apart_.isEmpty():
            return None
        bits = self.spark.sparkContext.broadcast(candidate_bits(apart_.select("x"), self.bits))
        common = self.common

        def second(part: pa.RecordBatch) -> list:
            cells = np.frombuffer(common.value, np.uint8)
            o, h, n = shingle_sets(part.column(1), k)
            size = prefix_length(n, percent, LEAST)
            return [part.column(0), n, np.split(prefixes(o, h, n, size, 1, cells)[1].astype(np.int64), np.cumsum(size)[:-1])]

        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])
        met = self.base.mapInArrow(of_candidates(second, bits, self.bits, schema), "id bigint, n bigint, tokens array<bigint>").where("n > 0")
        met = settle(met.join(apart_.withColumnRenamed("x", "id"), "id"))
        need = F.least(F.lit(LEAST), F.ceil(F.col("n") * percent / 100)).cast("int")
        entries = met.select(F.explode("tokens").alias("token"), F.col("id").alias("x"), "n", need.alias("need"), "component")
        # component sizes of each list, counted before they are shuffled
        sizes = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("many"))
        lists = sizes.groupBy("token").agg(F.max_by("component", F.struct("many", "component")).alias("main"), F.max("many").alias("most"), F.sum("many").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        lists = settle(lists.select("token", "main", "all", F.ceil(F.col("most") / PART).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / PART).cast("int").alias("others")))
        brief = settle(entries.join(lists.where(F.col("all") <= SHORT).select("token"), "token"))
        left, right = (brief.select("token", F.col("x").alias(c), F.col("n").alias(f"n{c}"), F.col("need").alias(f"need{c}"), F.col("component").alias(f"c{c}")) for c in "xy")
        fits = (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
        counted = left.join(right, "token").where(fits).groupBy("x", "y").agg(F.count(F.lit(1)).alias("times"), F.max(F.greatest("needx", "needy")).alias("need"))
        long = settle(salted(entries, lists.where(F.col("all") > SHORT)).select("token", "x", "n", "need", "component", "main", "mains", "others"))
        found = self.verified(enough_shared(counted, long))
        # what is long here too
        rest = settle(heavy(long, ("n", "component", "main", "mains", "others")))
        if rest.isEmpty():
            return found
        bits = self.spark.sparkContext.broadcast(candidate_bits(rest.select("x"), self.bits))

        def whole(part: pa.RecordBatch) -> list:
            o, h, n = shingle_sets(part.column(1), k)
            return [part.column(0), n, [x.tobytes() for x in parity(h, o, part.num_rows)], [low_bytes(x) for x in np.split(h, np.cumsum(n)[:-1])]]

        schema = pa.schema([("x", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.binary())])
        sets = self.base.mapInArrow(of_candidates(whole, bits, self.bits, schema), "x bigint, n bigint, sketch binary, shingles binary")
        sets = settle(sets.join(rest.select("x").distinct(), "x"))
        dealt = rest.select("token", "x", "n", "component", F.explode(parts_of()).alias("at")).select("token", "x", "n", "component", "at.a", "at.b")
        # sets only travel to where a sketch leaves a link open
        kept = "token bigint, x bigint, n bigint, component bigint, a int, b int"
        open_ = settle(dealt.join(sets.drop("shingles"), ["x", "n"]).groupBy("token", "a", "b").applyInArrow(tidied(sketched(percent)), kept))
        more = settle(open_.join(sets, ["x", "n"]).groupBy("token", "a", "b").applyInArrow(tidied(apart_links(percent)), "x bigint, y bigint").distinct())
        return found.union(more)


def heavy(members: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``members`` (token, x, need) whose set has all that a pair must share in their lists."""
    enough_ = members.groupBy("x").agg(F.count(F.lit(1)).alias("long"))
    return members.join(enough_, "x").where("long >= need").select("token", "x", "need", *keep)


def enough_shared(counted: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y) of the pairs (x, y, times, need) that share enough tokens, or lack no more than either set has among the ``members`` of long lists."""
    sure = counted.where("times >= need").select("x", "y")
    long = members.groupBy("x").agg(F.count(F.lit(1)).alias("long"))
    if long.isEmpty():
        return sure
    fewer = counted.where("times < need").join(long.withColumnRenamed("long", "lx"), "x").where("times + lx >= need")
    fewer = fewer.join(long.select(F.col("x").alias("y"), F.col("long").alias("ly")), "y").where("times + ly >= need")
    return sure.union(fewer.select("x", "y"))


def salted(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Join on ``token`` with a hot token's rows dealt over SALTED keys."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTED - 1))).alias("salt")
    return rows.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTED)).cast("int")).join(lists.select("*", salts), ["token", "salt"]).drop("salt")


def parts_of():  # noqa: ANN201
    """Where a member goes: members of the main component meet all others' parts, these all main parts and one another."""
    main = F.pmod(F.xxhash64("x"), F.col("mains")).cast("int")
    other = F.pmod(F.xxhash64("x"), F.col("others")).cast("int")
    at = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    others = F.sequence(F.lit(0), F.col("others") - 1)
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: at(i, other))
    with_others = F.transform(others, lambda j: at(-1 - F.least(j, other), F.greatest(j, other)))
    return F.when(F.col("component") == F.col("main"), F.transform(others, lambda j: at(main, j))).otherwise(F.concat(with_main, with_others))


def sketched(percent: int):  # noqa: ANN201
    """The members of two parts of a list that may be similar to one of another component, by size and sketch."""

    def run(part: pa.Table) -> pa.Table:
        n, root = (part.column(c).to_numpy() for c in ("n", "component"))
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in buffers(part.column("sketch"))]).view(np.uint64)
        met = np.zeros(len(n), bool)
        for i in range(1, len(n)):
            j = np.flatnonzero((root[:i] != root[i]) & enough(n[:i], n[i], percent))
            j = j[~apart(sketch[j], sketch[i], n[j] + n[i], percent)]
            met[j] = True
            met[i] |= len(j) > 0
        return part.select(["token", "x", "n", "component", "a", "b"]).filter(pa.array(met))

    return run


def apart_links(percent: int):  # noqa: ANN201
    """Links that join the components met in two parts of a list; one for each two that become one."""

    def run(part: pa.Table) -> pa.Table:
        ids, n, root = (part.column(c).to_numpy().copy() for c in ("x", "n", "component"))
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in buffers(part.column("sketch"))]).view(np.uint64)
        packed_sets, sets = buffers(part.column("shingles")), {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = from_low(packed_sets[i])
            return sets[i]

        xs, ys = [], []
        for i in range(1, len(ids)):
            j = np.flatnonzero((root[:i] != root[i]) & enough(n[:i], n[i], percent))
            j = j[~apart(sketch[j], sketch[i], n[j] + n[i], percent)]
            for k in j.tolist():
                if root[k] != root[i] and similar(of(i), of(k), percent):
                    xs.append(min(ids[k], ids[i])), ys.append(max(ids[k], ids[i]))
                    root[root == root[k]] = root[i]
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return run


def groups(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component of every row."""
    with scratch(docs.sparkSession) as kept:
        join = Join(docs, k, percent, id_col, text_col)
        found = join.candidates()
        counted = found.where("y IS NOT NULL").groupBy("x", "y").agg(F.sum("times").alias("times"), F.min("need").alias("need"))
        members = found.where("y IS NULL").select("token", "x", "need")
        links = join.verified(enough_shared(counted, members))
        more = None if members.isEmpty() else join.across(members, links)
        classes = settle(join.rows.where("n > 0 AND id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("id").alias("first")))
        # rows of one id with different texts are one node
        tied = join.rows.where("n > 0 AND id IS NOT NULL").join(classes, ["n", "a", "b"]).select("id", "first")
        several = tied.groupBy("id").agg(F.min("first").alias("x"), F.max("first").alias("y")).where("x <> y").select("x", "y")
        label = components(reduce(DataFrame.union, [x for x in (links, more, several) if x is not None]))
        named = settle(classes.join(label, classes["first"] == label.id, "left").select("n", "a", "b", F.coalesce("component", "first").alias("component")))
        kept += [join.profiles, named]
    out = join.rows.join(named, ["n", "a", "b"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the first document of each group of near copies."""
    others = groups(docs, k, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


#: Shingles as text, links counted over shared ones, and what links reach.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (SELECT doc_id, len(words) AS n, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM t),
s AS (
  SELECT DISTINCT doc_id, run FROM (
    SELECT doc_id, n, pos, string_agg(a, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM w)
  WHERE pos <= greatest(n - 2, 1)
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT t.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id FROM t LEFT JOIN size ON size.doc_id = t.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = t.doc_id
"""
QUERIES = {"op4_jaccard": op4_jaccard}
ORACLES = {"op4_jaccard": ORACLE}
