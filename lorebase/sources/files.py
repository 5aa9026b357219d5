"""Readers of documents, receipts, words and exported corpora, with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.functions.slices import slices

DELETED = frozenset("del s strike removed deleted".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Sections(HTMLParser):
    """Paragraphs of an article's content without deleted parts."""

    def __init__(self, anchor: str | None, css: str | None):
        super().__init__(convert_charrefs=True)
        self.anchor, self.css = anchor, css
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, in article, in content, deleted
        self.found = [False, False]
        self.paragraphs: list[list[str]] = []
        self.open_p: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        article, content, gone = self.stack[-1][1:] if self.stack else (False, False, False)
        attr = dict(attrs)
        if tag == "article" and not self.found[0] and (self.anchor is None or attr.get("id") == self.anchor):
            article = self.found[0] = True
            content = content or self.css is None
        if article and not content and self.css in (attr.get("class") or "").split() and not self.found[1]:
            content = True
        self.found[1] |= content
        if tag in VOID:
            return
        self.stack.append((tag, article, content, gone or tag in DELETED))
        if tag == "p" and content and not gone:
            self.paragraphs.append([])
            self.open_p.append(len(self.stack))

    def handle_endtag(self, tag: str) -> None:
        if any(s[0] == tag for s in self.stack):
            while self.stack.pop()[0] != tag:
                pass
            while self.open_p and self.open_p[-1] > len(self.stack):
                self.open_p.pop()

    def handle_data(self, data: str) -> None:
        if self.open_p and not self.stack[-1][3]:
            self.paragraphs[-1].append(data)


def section_paragraphs(html: str | None, anchor: str | None, css: str | None) -> list[str]:
    """Paragraphs of the article ``anchor`` under the class ``css``; raises if any of these is missing or empty."""
    parser = _Sections(anchor, css)
    parser.feed(html or "")
    parser.close()
    if not parser.found[0]:
        raise ValueError("missing section")
    if not parser.found[1]:
        raise ValueError("missing content")
    out = [" ".join("".join(p).split()) for p in parser.paragraphs]
    if not out or not all(out):
        raise ValueError("empty section")
    return out


def html_sections(pages: DataFrame, html: str = "html", anchor: str | None = None, css: str | None = None) -> DataFrame:
    """``pages`` with ``paragraphs``; null where the section is missing or empty."""

    @F.pandas_udf("array<string>")
    def read(s: pd.Series) -> pd.Series:
        def one(h: str | None) -> list[str] | None:
            try:
                return section_paragraphs(h, anchor, css)
            except ValueError:
                return None

        return pd.Series([one(h) for part in slices(s) for h in part], dtype=object)

    return pages.withColumn("paragraphs", read(F.col(html)))


def receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RECEIPT).json(path)


def processed(spark: SparkSession, path: str) -> DataFrame:
    """An exported corpus: JSON lines as ``snapshot.write_records`` makes them, or files of one JSON array each."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    whole = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.schema(schemas.CHUNKS).option("multiLine", whole).json(path)


def words(spark: SparkSession, path: str) -> DataFrame:
    """Positioned words, as a layout reader has written them."""
    return spark.read.schema(schemas.WORDS).parquet(path)


def layout_words(spark: SparkSession, path: str, read_page_words: Callable[[bytes], list[dict]], sha256: str | None = None) -> DataFrame:
    """Words of documents in binary form by a reader of their format; ``sha256`` pins the content."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if sha256 is not None:
        files = files.where(F.sha2("content", 256) == sha256)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield pd.DataFrame(read_page_words(bytes(content)), columns=["page", "text", "x0", "x1", "top", "bottom", "fontname"])

    return files.select("content").mapInPandas(run, schemas.WORDS)


def pdf_faults(files: DataFrame, sha256: str | None = None) -> DataFrame:
    """Downloaded files that are no PDF or not the expected one."""
    bad = ~F.col("content").startswith(F.lit(b"%PDF-"))
    if sha256 is not None:
        bad = bad | (F.sha2("content", 256) != sha256)
    return files.where(bad)
