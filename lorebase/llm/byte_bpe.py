"""Byte-level BPE by corpus-level merge replay.

A block of texts is split by the tokenizer's pattern, its distinct pieces are laid
out as one array of byte tokens, and an inverted index maps each token pair to the
positions where it stands.  The merges are replayed over that index in rank order;
each changes all its positions at once and only re-indexes the neighbours that it
touched.  Pieces are independent of one another, so blocks are too: there is no
shuffle, and a task holds one block.

Defined results: a null text is the empty text; an empty text has no tokens and
the digests of empty strings; equal texts have equal digests; extra columns of the
input are ignored, as only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.arrays import pieces
from lorebase.llm.tables import table

#: Characters of text whose distinct pieces are merged together.
BLOCK_CHARS = 2 << 20


class Merges:
    """The ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        #: Every split of a token into two tokens is a pair that merges at its rank.
        left, right, to = [], [], []
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        code = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(code)
        self.size, self.codes, self.to = size, code[order], np.array(to, np.int64)[order]
        self.none = size

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to, or ``none``."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.to[at], self.none)

    def one(self, piece: bytes) -> list[int]:
        """Encode one piece, one merge at a time, the lowest rank and leftmost first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        token = [int(self.byte[b]) for b in piece]
        n = len(token)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        text = [piece[i : i + 1] for i in range(n)]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                r = self.ranks.get(text[i] + text[after[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, len(text[i]), len(text[after[i]])))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or len(text[i]) != x or len(text[j]) != y:
                continue
            token[i], text[i], alive[j] = r, text[i] + text[j], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            push(before[i])
        return [t for t, a in zip(token, alive, strict=True) if a]

    def replay(self, found: list[bytes]) -> list[list[int]]:
        """Token ids of every piece in ``found``."""
        out: list[list[int] | None] = [[w] if (w := self.ranks.get(p)) is not None else None for p in found]
        rest = [i for i, x in enumerate(out) if x is None]
        if not rest:
            return out  # type: ignore[return-value]
        lengths = np.array([len(found[i]) for i in rest])
        data = np.frombuffer(b"".join(found[i] for i in rest), np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        n = len(data)
        owner = np.repeat(np.arange(len(rest)), lengths)
        tok = self.byte[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = n
        before[starts] = -1
        odd = np.zeros(len(rest), bool)  # pieces where merges of one rank overlap or a lower rank turns up late
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else [], np.split(at, cuts), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        here = np.flatnonzero(after < n)
        ranks = self.rank(tok[here], tok[after[here]])
        here, ranks = here[ranks < self.none], ranks[ranks < self.none]
        want = np.full(n + 1, self.none, np.int32)  # the rank at which each position merges with its successor
        want[here] = ranks
        enter(here, ranks)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[want[at] == r]
            if len(parts) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            nxt = after[at]
            clash = want[nxt] == r
            if clash.any():
                odd[owner[at[clash]]] = True
                keep = ~odd[owner[at]]
                at, nxt = at[keep], nxt[keep]
                if not len(at):
                    continue
            tok[at] = r
            want[nxt] = self.none
            beyond = after[nxt]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            want[at] = self.none
            prev = before[at]
            touched = np.concatenate([at[inner], prev[prev >= 0]])
            if not len(touched):
                continue
            new = self.rank(tok[touched], tok[after[touched]])
            want[touched] = new
            low = new < r
            if low.any():
                odd[owner[touched[low]]] = True
            ok = new < self.none
            if ok.any():
                enter(touched[ok], new[ok])
        live = np.zeros(n + 1, bool)
        # a position lives if some predecessor points at it or it starts a piece
        live[starts] = True
        reach = starts
        while len(reach):
            reach = after[reach]
            reach = reach[reach < n]
            live[reach] = True
        ids = tok[live[:n]]
        count = np.bincount(owner[live[:n]], minlength=len(rest))
        flat, at = ids.tolist(), 0
        for k, (i, c) in enumerate(zip(rest, count.tolist(), strict=True)):
            out[i] = self.one(found[i]) if odd[k] else flat[at : at + c]
            at += c
        return out  # type: ignore[return-value]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    with open(path, "rb") as lines:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encoder(path: str, pattern: str, id_type: str, with_ids: bool, block_chars: int):
    """mapInArrow function from (id, text) to tokens and digests, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        vocabulary, split, none = merges(path), regex.compile(pattern), np.zeros(0, np.int32)
        for batch in batches:
            for block in pieces(batch, batch.schema.names[1], block_chars):
                number: defaultdict[str, int] = defaultdict(count().__next__)
                texts = [t or "" for t in block.column(1).to_pylist()]
                cut = [np.fromiter(map(number.__getitem__, split.findall(t)), np.int32) if t else none for t in texts]
                raw = [p.encode() for p in number]
                coded = vocabulary.replay(raw)
                del number
                many = np.array([len(ids) for ids in coded], np.int64)
                as_text = [" ".join(map(str, ids)) for ids in coded]
                as_bytes = [b"".join(map(vocabulary.token.__getitem__, ids)) for ids in coded]
                sizes, same = np.array([len(x) for x in as_bytes]), np.array([x == y for x, y in zip(as_bytes, raw, strict=True)])

                def decoded(text: str, c: np.ndarray, as_bytes: list = as_bytes, sizes: np.ndarray = sizes, same: np.ndarray = same) -> bytes:
                    """Where every piece decodes to itself and the pieces fill the text, they join to the text."""
                    whole = text.encode()
                    return whole if same[c].all() and int(sizes[c].sum()) == len(whole) else b"".join(map(as_bytes.__getitem__, c.tolist()))

                columns = [
                    block.column(0),
                    pa.array([int(many[c].sum()) for c in cut], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(as_text.__getitem__, c.tolist())).encode()).hexdigest() for c in cut], pa.string()),
                    pa.array([hashlib.sha256(decoded(t, c)).hexdigest() for t, c in zip(texts, cut, strict=True)], pa.string()),
                ]
                names = [batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([[i for p in c.tolist() for i in coded[p]] for c in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Ids, their count, and the digests of ids and of the bytes they decode to, per text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encoder(vocabulary, pattern, kind, with_ids, block_chars), schema)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that each row's ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def joined(ids):  # noqa: ANN001, ANN202
        token = merges(vocabulary).token
        return ids.map(lambda x: None if x is None else b"".join(token[int(i)] for i in x))

    return tokens.withColumn(out, joined(F.col(ids_col)))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
