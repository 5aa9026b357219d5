"""Spelling variants: frequent words, their near words, and the form that each goes back to.

Words are counted in Arrow batches, so a word that every document holds is one row
for each batch.  Near words are found by an even-partition pigeonhole join.  A word
is indexed by its two halves; one edit leaves one half as it is, so an equally long or
one letter longer word holds that half at the start, or at the end, shifted by the
difference of the lengths.  What is left beside the half differs by the same one
edit, so it is parted evenly again: a half that a great many words share (an ending,
say) is never one group of the join.  Candidates are verified inside the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.llm.arrays import pieces
from lorebase.llm.tables import scratch, settle, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run whose checksum this divides loses a code point.
SLIP = 199
#: Distinct words that a task counts before it sends them on.
HELD = 400_000


def counter(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id as text, text) to (word, n) with words of at least ``least`` code points."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        lower: dict[str, tuple[str, bytes]] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            lower.clear()
            return out

        for batch in batches:
            for part in pieces(batch, "text"):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    begin = zlib.crc32(f"{key}:".encode())
                    for run, n in Counter(RUN.findall(text)).items():
                        low = lower.get(run)
                        if low is None:
                            word = run.translate(LOWER)
                            low = lower[run] = word, word.encode()
                        word, coded = low
                        h = zlib.crc32(coded, begin)
                        if h % SLIP == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            held[word] += n
                if len(lower) >= HELD:
                    yield sent()
        yield sent()

    return count


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur ``least_count`` times or more."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(counter(least_length), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _cut(text: Column, length: Column, half: Column, longer: int) -> list[tuple[Column, Column, Column]]:
    """For both halves of a text of ``length``: the half's place and letters, and what is left; ``longer``: the text is that much longer."""
    start, end = F.substring(text, F.lit(1), half), F.substring(text, half + 1 + longer, length - half)
    rest_of_start, rest_of_end = F.substring(text, half + 1, length - half + longer), F.substring(text, F.lit(1), half + longer)
    return [(F.lit(0), start, rest_of_start), (F.lit(1), end, rest_of_end)]


def _keys(words: DataFrame, longer: int) -> DataFrame:
    """(word, n, length, place, half, place2, half2) of words as texts of ``length`` code points, or ``longer`` than that."""
    length = F.length("word") - longer
    first = F.array(*[F.struct(p.alias("place"), h.alias("half"), r.alias("rest")) for p, h, r in _cut(F.col("word"), length, F.floor(length / 2).cast("int"), longer)])
    one = words.select("word", "n", length.alias("length"), F.explode(first).alias("a")).select("word", "n", "length", "a.*")
    left = F.length("rest") - longer
    second = F.array(*[F.struct(p.alias("place2"), h.alias("half2")) for p, h, _ in _cut(F.col("rest"), left, F.floor(left / 2).cast("int"), longer)])
    return one.select("word", "n", "length", "place", "half", F.explode(second).alias("b")).select("word", "n", "length", "place", "half", "b.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of words (word, n; distinct, two code points or more) that one edit parts, once."""
    index = _keys(words, 0).withColumnsRenamed({"word": "a", "n": "an"})
    on = ["length", "place", "half", "place2", "half2"]
    verified = F.levenshtein("a", "b", 1) == 1
    probes = _keys(words, 0).withColumn("same", F.lit(True)).unionByName(_keys(words, 1).withColumn("same", F.lit(False))).withColumnsRenamed({"word": "b", "n": "bn"})
    met = index.join(probes, [index[c] == probes[c] for c in on] + [~F.col("same") | (F.col("a") < F.col("b")), verified])
    return met.select("a", "an", "b", "bn").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's form is its most frequent near word, if that is ``ratio`` times as frequent; ties go to the smaller word."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best")
    known = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    much = -F.col("best.m") >= ratio * F.col("n")
    return words.join(known, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.m")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` (settled) with ``root``: the end of a word's chain of forms, by doubling steps; counts grow along a chain, so it ends."""
    up = settle(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(up.join(above, "root").select("word", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")))
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            return forms.join(up, "word")


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the frequent words of all texts.

    Null and empty texts have no words; a null id counts as an empty one; rows that
    repeat an id count each; ties of frequency go to the smaller word in code-point
    order; an empty table gives no rows; other columns are not read.
    """
    with scratch(docs.sparkSession) as kept:
        words = settle(vocabulary(docs))
        forms = settle(variants(words))
        out = settle(rooted(forms).select("word", "form", "root", "n", "n_near", "form_n"))
        kept.append(out)
    return out


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "list_transform(string_split(regexp_replace(hex(encode(k)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: CAST('0x' || x AS BIGINT))"
QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {
    "op13_spelling": f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY 1, 2),
k AS (SELECT run, n, doc_id || ':' || run AS k FROM l WHERE length(run) >= 6),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM k, t),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.d UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.d),
q AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-o.n, p.near)) AS near, max(o.n) AS near_n FROM p JOIN v o ON o.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN q ON q.word = v.word),
up AS (SELECT word, word AS at FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL),
roots AS (SELECT up.word, up.at AS root FROM up JOIN f ON f.word = up.at WHERE f.form IS NULL)
SELECT f.word, f.form, roots.root, f.n, f.n_near, f.form_n FROM f JOIN roots ON roots.word = f.word"""
}
