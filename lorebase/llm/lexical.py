"""Ranked lexical search with whole-number scores.

``build`` writes postings: for each term the rows that hold it, with their lengths and
the term's occurrences, in lists of a batch of documents each, dealt by term and
clustered; a term of a great many documents is spread over several partitions.
``search`` joins the items' terms with them, scores each match, sums by item and
document and numbers the best.

No pair of item and document is made that cannot be among the best: an item's rarest
terms give a score that its k-th best document reaches at least; terms that cannot
reach that score together are only looked up for the documents that the other terms
leave in question, the rarer of them first.  Bounds are the exact largest contributions
of the postings, so the result is that of scoring everything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.llm.arrays import pieces, tidy
from lorebase.llm.blocks import bucket_count
from lorebase.llm.tables import scratch, settle, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 20
#: Postings that a task gathers before it sends their lists, and rows of one term in one partition of the index, about.
GATHERED, TOGETHER = 1_000_000, 100_000
#: The share of documents that an item's rarest terms match in the first look; the share of that look's score that the
#: terms which are put off can reach together at most, and those that are put off further. They change time, never results.
FIRST_LOOK, PUT_OFF, LATER = 0.01, 0.6, (0.25, 0.0)
#: Rows and bytes of text of a side that is broadcast at most; beyond them the join shuffles both sides.
BROADCAST_ROWS, BROADCAST_TEXT = 400_000, 16 << 20
#: A row without a term lists the documents of a batch: their ids and lengths.
SCHEMA = "term string, rows array<bigint>, ns array<int>, tfs array<int>, docs array<bigint>"


@dataclass
class Index:
    """Postings with the number of documents that have a term and of all terms."""

    postings: DataFrame
    documents: int
    terms: int


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) to lists of postings by term, and of documents."""
    find, lower = re.compile(TERM).findall, str.maketrans(UPPER, LOWER)
    number: dict[str, int] = {}
    of: list[int] = []
    tf: list[int] = []
    docs: list[tuple[int, int | None, int, int]] = []

    def sent() -> pa.RecordBatch:
        row, doc, n, size = (pa.array(c, pa.int64()) for c in zip(*docs, strict=True))
        terms = np.array(of, np.int32)
        order = np.argsort(terms, kind="stable")
        at = np.repeat(np.arange(len(docs)), size.to_numpy())[order]
        cuts = np.r_[0, np.cumsum(np.bincount(terms, minlength=len(number)))]
        # the list of the documents comes last
        offsets = pa.array(np.r_[cuts, len(of) + len(docs)].astype(np.int32))
        listed = lambda one, all_: pa.ListArray.from_arrays(offsets, pa.concat_arrays([one, all_]))
        n = n.cast(pa.int32())
        out = [
            pa.array([*number, None], pa.string()), listed(row.take(pa.array(at)), row), listed(n.take(pa.array(at)), n),
            listed(pa.array(np.array(tf, np.int32)[order]), pa.nulls(len(docs), pa.int32())), pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(len(cuts), np.int32), len(docs)].astype(np.int32)), doc),
        ]
        for x in (number, of, tf, docs):
            x.clear()
        return pa.RecordBatch.from_arrays(out, names=["term", "rows", "ns", "tfs", "docs"])

    for batch in batches:
        for part in pieces(batch, "text"):
            for row, doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                held = Counter(find(text.translate(lower)))
                if held:
                    of.extend([number.setdefault(w, len(number)) for w in held])
                    tf.extend(held.values())
                    docs.append((row, doc, sum(held.values()), len(held)))
                if len(of) >= GATHERED:
                    yield sent()
                    tidy()
    if docs:
        yield sent()


def build(docs: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text): each row is a document, rows without a term have no posting."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)), F.count(F.lit(1))).first()
    spread = max(1, -(-count // TOGETHER))
    # lists of one term meet in as many partitions as keep them short; lists of documents are dealt by themselves
    lot = F.xxhash64("term", F.pmod(F.xxhash64(F.get("rows", F.lit(0))), F.when(F.col("term").isNull(), F.lit(1 << 20)).otherwise(F.lit(spread))))
    dealt = rows.mapInArrow(postings, SCHEMA).repartition(bucket_count(int(size)), lot)
    made = settle(dealt.sortWithinPartitions(F.xxhash64("term")))
    total = F.aggregate("ns", F.lit(0).cast("bigint"), lambda s, n: s + n)
    known, terms = made.where("term IS NULL").agg(F.coalesce(F.sum(F.size("rows")), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first()
    return Index(made, known, terms)


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term, q): an item's terms with their number; rows of one id are one item, items without id have none."""
    found = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1)))
    return items.where("item_id IS NOT NULL").select("item_id", found.alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("q"))


def bounded(df: DataFrame, text: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is proven small, else as it is."""
    size = F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0)) if text else F.lit(0)
    rows, held = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_TEXT else df


def _floor(scores: DataFrame, k: int) -> DataFrame:
    """(item_id, floor): the k-th best score, 0 with fewer documents."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"))
    best = scores.select("item_id", "score").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return best.groupBy("item_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(0).cast("bigint")).alias("floor"))


def _matched(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of ``terms`` (term and other columns), one by one, with what an occurrence there is worth."""
    met = index.postings.join(bounded(terms, "term"), "term").select(*terms.columns, F.explode(F.arrays_zip("rows", "ns", "tfs")).alias("p"))
    n, tf = F.col("p.ns").cast("bigint"), F.col("p.tfs").cast("bigint")
    m = _div(25 * n * index.documents, index.terms) + 75
    return met.select(*terms.columns, F.col("p.rows").alias("row"), _div(1_000_000_000 * tf, 1000 * tf + 12 * m).alias("worth"))


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division of numbers from 0."""
    return F.call_function("div", a, F.lit(b).cast("bigint") if isinstance(b, int) else b)


def _scored(matched: DataFrame) -> DataFrame:
    return matched.groupBy("item_id", "row").agg(F.sum(F.col("w") * F.col("worth")).alias("score"))


def search(items: DataFrame, index: Index, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of each item, scores above 0, ties by ascending doc_id.

    Documents without id come first among equal scores; rows that repeat an id are documents of their own; items without
    a term, an empty index and an empty table of items give no rows; other columns are not read.
    """
    if not index.documents:
        return items.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    n = index.documents
    asked = settle(terms_of(items))
    known = _matched(index, asked.select("term").distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("worth").alias("most"))
    # a weight of 0 adds nothing
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(known.withColumn("w", weight).where("w > 0"), "term").select("item_id", "term", "df", (F.col("q") * F.col("w")).alias("w"), (F.col("q") * F.col("w") * F.col("most")).alias("most"))
    before = Window.partitionBy("item_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    weighed = settle(weighed.withColumn("first", F.coalesce(F.sum("df").over(before), F.lit(0)) < max(10 * k, int(n * FIRST_LOOK))))
    floor = _floor(_scored(_matched(index, weighed.where("first").select("item_id", "term", "w"))), k)
    rising = Window.partitionBy("item_id").orderBy("most", "term")
    parted = settle(weighed.join(floor, "item_id", "left").select("item_id", "term", "w", "most", F.coalesce("floor", F.lit(0)).alias("look"), F.sum("most").over(rising).alias("reach")))
    scores = _scored(_matched(index, parted.where(F.col("reach") >= F.col("look") * PUT_OFF).select("item_id", "term", "w")))
    done = PUT_OFF
    for share in LATER:
        put_off = F.col("reach") < F.col("look") * done
        left = parted.groupBy("item_id").agg(F.coalesce(F.sum(F.when(put_off, F.col("most"))), F.lit(0)).alias("left"))
        scores = settle(scores)
        bar = bounded(_floor(scores, k).join(left, "item_id"))
        open_ = settle(scores.join(bar, "item_id").where(F.col("score") + F.col("left") >= F.col("floor")).select("item_id", "row", "score"))
        now = parted.where(put_off & (F.col("reach") >= F.col("look") * share)).select("item_id", "term", "w")
        # terms are met with the documents in question first, then with the items that ask for them
        found = _matched(index, now.select("term").distinct()).join(bounded(open_.select("row").distinct()), "row", "left_semi")
        more = _scored(found.join(bounded(now, "term"), "term")).join(bounded(open_.select("item_id", "row")), ["item_id", "row"], "left_semi")
        scores = open_.unionByName(more).groupBy("item_id", "row").agg(F.sum("score").alias("score"))
        done = share
    docs = index.postings.where("term IS NULL").select(F.explode(F.arrays_zip("rows", "docs")).alias("d")).select(F.col("d.rows").alias("row"), F.col("d.docs").alias("doc_id"))
    best = settle(scores.where("score > 0"))
    # ties at the k-th score stay until ids are known
    close = best.join(bounded(_floor(best, k)), "item_id").where("score >= floor").select("item_id", "row", "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    named = docs.join(bounded(close), "row")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as kept:
        out = settle(search(table(spark, sf_dir, "benchmark"), build(table(spark, sf_dir, "documents"))))
        kept.append(out)
    return out


_TERMS = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term"
QUERIES = {"op12_lexical": op12_lexical}
ORACLES = {
    "op12_lexical": f"""
WITH p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
t AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, big_n),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), t GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""
}
