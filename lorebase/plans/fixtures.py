"""The driver's tables as a corpus, questions, vectors and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators.answering import HashingEmbedder, OverlapReranker
from lorebase.operators.search import Models

MODELS = Models(HashingEmbedder(64), OverlapReranker())
AS_OF = "1998-06-01"
#: Words of the fixtures that take the place of the topic's vocabulary.
WORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was"]
STOP = ["the", "and", "for"]
EXPANSIONS = {"thin": ["edin ther"], "ander": ["onder then"], "is to": ["with that"]}
QUESTIONS = [(1, "reat thin and heath"), (2, "is to be ander the stion"), (3, "tionen ing"), (4, "ed er of")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of their source's book, four children to a parent."""
    d = table(spark, sf_dir, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("s/"), F.col("doc_id")).alias("section_key"),
        F.col("source").alias("rulebook_id"),
        F.lit("e1").alias("edition"),
        F.when(F.col("doc_id") > 0, F.concat(F.lit("s/"), F.expr("doc_id div 4"))).alias("parent_section_key"),
        F.when(F.col("doc_id") % 10 == 0, "definition").otherwise("section").alias("kind"),
        first.alias("section_title"),
        F.col("text").alias("body"),
        F.array("source", "lang", first).alias("heading_path"),
        F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 200 + 1).cast("int")).alias("page_start"),
        F.col("doc_id").alias("position"),
        "lang",
    )


SECTIONS_SQL = """
  SELECT doc_id AS id, 's/' || doc_id AS section_key, source AS rulebook_id, 'e1' AS edition,
         CASE WHEN doc_id > 0 THEN 's/' || (doc_id // 4) END AS parent_section_key,
         CASE WHEN doc_id % 10 = 0 THEN 'definition' ELSE 'section' END AS kind,
         split_part(text, chr(10), 1) AS section_title, text AS body,
         CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 200 + 1 AS INTEGER) END AS page_start, doc_id AS position, source, lang
  FROM documents
"""


def blocks(section_rows: DataFrame) -> DataFrame:
    """A block for each line that is not blank: a heading, then paragraphs."""
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    page = F.col("page_start")
    made = F.transform(
        lines,
        lambda x, i: F.struct(
            F.when(i == 0, "heading").otherwise("paragraph").alias("type"), x.alias("text"), F.when(i % 3 == 0, page).when(i % 3 == 1, page + 1).otherwise(F.lit(0)).alias("page")
        ),
    )
    return section_rows.withColumn("blocks", made)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.lit("e1").alias("edition"), F.col("o_orderpriority").alias("title"), F.lit("ORG").alias("authority"), F.array(F.lit("generic")).alias("competition_scope"),
        start.alias("effective_from"), F.when(F.col("o_orderkey") % 11 != 0, F.date_add(start, (F.col("o_orderkey") % 400 + 30).cast("int"))).alias("effective_until"),
        F.when(F.col("o_orderstatus").isin("O", "P"), "ready").otherwise("blocked").alias("status"), F.lit(None).cast("timestamp").alias("last_checked_at"), F.lit(None).cast("string").alias("sha256"),
    )


def book_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("rulebook_id"), F.lit("e1").alias("edition"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linenumber") != 1, F.to_date("l_shipdate")).alias("effective_from"), F.lit(None).cast("date").alias("effective_until"),
    )


CURRENT_SQL = f"""
  WITH b AS (
    SELECT o_orderkey AS id, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS f,
           CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 + 30 AS INTEGER) END AS u,
           o_orderstatus IN ('O', 'P') AS ready FROM orders
  ), cur AS (
    SELECT l.l_orderkey AS rulebook_id, l.l_linenumber AS line, l.l_partkey AS part, l.l_suppkey AS supp, l.l_quantity AS quantity, b.title AS rulebook
    FROM lineitem l JOIN b ON b.id = l.l_orderkey
    WHERE b.ready AND b.f <= DATE '{AS_OF}' AND (b.u IS NULL OR DATE '{AS_OF}' < b.u)
      AND (l.l_linenumber = 1 OR CAST(l.l_shipdate AS DATE) <= DATE '{AS_OF}')
  )
"""


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id long, question string")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", "user_id", F.col("event_type").alias("outcome"), "ts", F.round(F.col("value") * 10).cast("bigint").alias("latency_ms"), F.nullif(k % 7, F.lit(0)).alias("tokens"))


RUNS_SQL = "SELECT event_id, user_id, event_type AS outcome, ts, CAST(round(value * 10) AS BIGINT) AS latency_ms, nullif(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7, 0) AS tokens FROM events"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
