"""The training-data pipeline: ``documents`` in, token counts and digests out.

Each stage calls one operator on all that the stage before it kept.  ``run`` writes
every stage's result to the shared folder and reads it back, so a lost executor
costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import byte_bpe, decontaminate, jaccard, repeats, tables, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of labelled tokens does not reject.

    Null, empty and very long texts are scored like others; rows that repeat an id stay or go by their own
    text; without labels of both kinds all stay; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, tables.table(spark, sf_dir, "labels")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose five-word shingles are 0.8 or more alike.

    Null and empty texts and null ids stay; of rows that repeat the first id all stay; an empty table stays empty.
    """
    return jaccard.one_of_each(docs, k=5, percent=80).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that start earlier; all rows stay.

    A null text becomes empty; rows with a null id come after all others; rows that tie in id and place keep
    their passages; an empty table stays empty.
    """
    out = repeats.without_repeats(docs, window=50, cut=True, keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; each row of an id goes by its own text; an empty benchmark keeps all.
    """
    return decontaminate.clean(docs, tables.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document that is left, repeated rows and null or empty texts included."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminated),
    ("byte_bpe", tokenised),
]
#: The stages learn, iterate and tokenise: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; a stage's own folders go when its result is written, and its input with them."""
    docs = tables.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with tables.scratch(spark) as kept:
            out = tables.settle(stage(spark, docs, sf_dir))
            kept.append(out)
        tables.release(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
