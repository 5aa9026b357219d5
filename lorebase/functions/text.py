"""Text expressions: slugs, normal forms, tokens, query expansion, scores, excerpts, windows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrase -> text that a question with the phrase is expanded by.
EXPANSIONS = {
    "pen": ["penalty", "penalty kick"],
    "dogso": ["denying goal obvious goal-scoring opportunity"],
    "second yellow": ["second caution", "sent off"],
    "back pass": ["deliberately kicked goalkeeper indirect free kick"],
    "back-pass": ["deliberately kicked goalkeeper indirect free kick"],
    "handball": ["hand ball hand arm"],
    "offside trap": ["offside position interfering play opponent"],
    "var": ["video assistant referee review check"],
    "studs": ["serious foul play excessive force"],
}
# Words that make a question one about the rules.
TOPIC_WORDS = (
    "ball card corner foul free goal goalkeeper handball ifab "
    "kick match offside penalty player ref referee restart soccer "
    "substitute tackle throw var yellow red dogso football law"
).split()
# Words that do not count for scores.
STOP_WORDS = (
    "about after against also and are ball before being can "
    "directly does during for from has have how into may must "
    "not player players should that the their then there this "
    "what when where which with would"
).split()
# Weights of the additive score, its floor and the number of results.
WEIGHTS = {"title": 7.0, "body": 2.0, "section": 5.0, "all_terms": 14.0, "phrase": 20.0, "definition": 0.25}
SCORE_FLOOR, RESULT_LIMIT = 2.0, 6
EXCERPT_CHARS = 420


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize(c: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one space.  Accents separate; see ``normalize_unicode``."""
    # the one letter whose lower case is a letter and an accent in Spark and the letter alone in SQL
    return F.trim(F.regexp_replace(F.lower(F.translate(c, "İ", "i")), "[^a-z0-9]+", " "))


def normalize_unicode(c: Column) -> Column:
    """As ``normalize`` after compatibility decomposition, which Spark has no function for."""

    @F.pandas_udf(T.StringType())
    def fold(s: pd.Series) -> pd.Series:
        low = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x.lower()))
        return low.str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()

    return fold(c)


def tokens(c: Column, normal: Callable[[Column], Column] = normalize) -> Column:
    return F.filter(F.split(normal(c), " "), lambda t: F.length(t) > 1)


def query_terms(c: Column) -> Column:
    """Distinct words in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)))


def expand(question: Column, expansions: dict[str, list[str]] | None = None, normal: Callable[[Column], Column] = normalize) -> Column:
    """The question and the expansions of every phrase that its normal form contains."""
    from_text = normal(question)
    extra = [F.when(F.contains(from_text, normalize(F.lit(p))), F.lit(" ".join(v))) for p, v in (expansions or EXPANSIONS).items()]
    return F.concat(question, F.lit(" "), F.concat_ws(" ", *extra))


def on_topic(question: Column, words: list[str] | None = None, expansions: dict[str, list[str]] | None = None) -> Column:
    expansions = expansions or EXPANSIONS
    hit = F.arrays_overlap(tokens(expand(question, expansions)), F.array(*map(F.lit, words or TOPIC_WORDS)))
    normal = normalize(question)
    for phrase in expansions:
        hit = hit | F.contains(normal, normalize(F.lit(phrase)))
    return hit


def score_tokens(question: Column, stop_words: list[str] | None = None, expansions: dict[str, list[str]] | None = None, normal: Callable[[Column], Column] = normalize) -> Column:
    stop = F.array(*map(F.lit, stop_words or STOP_WORDS))
    return F.array_distinct(F.filter(tokens(expand(question, expansions, normal), normal), lambda t: ~F.array_contains(stop, t)))


def original_terms(question: Column, stop_words: list[str] | None = None, normal: Callable[[Column], Column] = normalize) -> Column:
    stop = F.array(*map(F.lit, stop_words or STOP_WORDS))
    return F.filter(tokens(question, normal), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def additive_score(words: Column, terms: Column, phrase: Column, title: Column, section: Column, body: Column, is_definition: Column) -> Column:
    """Sum over query words of where they occur, and bonuses.  ``title``, ``section``, ``body``: normal forms."""
    one = lambda where, w, key: F.when(F.contains(where, w), F.lit(WEIGHTS[key])).otherwise(F.lit(0.0))
    base = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + one(title, w, "title") + one(body, w, "body") + one(section, w, "section"))
    both = F.concat(title, F.lit(" "), body)
    every = (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(both, t))
    return (
        base
        + F.when(every, WEIGHTS["all_terms"]).otherwise(0.0)
        + F.when((F.length(phrase) > 4) & F.contains(body, phrase), WEIGHTS["phrase"]).otherwise(0.0)
        + F.when(is_definition, WEIGHTS["definition"]).otherwise(0.0)
    )


def best_line(body: Column, words: Column) -> Column:
    """(short, misses, at, line): the first line of more than 20 characters with the most query words, else the first; null if all are blank.

    Of several bodies' lines the least is the best.
    """
    lines = F.filter(F.transform(F.split(body, "\n+"), lambda x: F.trim(x)), lambda x: x != "")
    said = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.when(F.length(x) > 20, normalize(x)).alias("normal")))
    misses = lambda x: -F.aggregate(words, F.lit(0), lambda n, w: n + F.contains(x["normal"], w).cast("int"))
    marked = F.transform(said, lambda x: F.struct(x["normal"].isNull().alias("short"), F.coalesce(misses(x), F.lit(0)).alias("misses"), x["at"].alias("at"), x["line"].alias("line")))
    return F.array_min(marked)


def shortened(line: Column) -> Column:
    """The line, or its beginning without blanks of any kind at the end."""
    return F.when(F.length(line) > EXCERPT_CHARS, F.concat(F.regexp_replace(F.substring(line, 1, EXCERPT_CHARS - 3), r"\p{Zs}+\z", ""), F.lit("…"))).otherwise(line)


def excerpt(body: Column, words: Column) -> Column:
    """The body's best line, shortened; a body of blanks as it is."""
    return shortened(F.coalesce(best_line(body, words)["line"], body))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_parentheses(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s*\([^)]*\)", ""))


def is_list_item(c: Column) -> Column:
    return c.rlike(r"^(?:[•●]|\d+[.)]|[a-z][.)])\s")


def untrusted_format(c: Column) -> Column:
    """Markup that a claim may not bring along."""
    return c.rlike(r"[\[\]<>`\n\r]|https?://|\]\(|^\s*#")


def windows(words: Column, limit: int, overlap: int = 32) -> Column:
    """Runs of ``limit`` words, each sharing ``overlap`` with the one before, until the tail is covered."""
    if limit <= overlap:
        raise ValueError("limit must exceed overlap")
    stride = limit - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s + F.lit(overlap) < F.size(words)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, limit).alias("words")))


#: Bytes that a request may hold beside its answer, and a margin for what the runtime adds.
CONTEXT, MARGIN = 32_768, 512


def fits_context(instruction: Column, payload: Column, answer: int) -> Column:
    """Does a request leave room for ``answer`` tokens?  A byte is at least a token's worth, so this never lets too much through."""
    return F.octet_length(instruction) + F.octet_length(payload) + F.lit(answer + MARGIN) <= CONTEXT


def pinned(name: Column, revision: Column) -> Column:
    """A model's identifier; null unless both parts are there."""
    return F.concat(name, F.lit("@"), revision)


def midnight(day: Column) -> Column:
    """The day's first instant in UTC, whatever the session's zone."""
    return F.from_utc_timestamp(F.to_timestamp(day), F.current_timezone())


def iso(moment: Column) -> Column:
    """Date, time and offset in ISO 8601, in the session's zone."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssxxx")
