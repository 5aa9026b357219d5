"""URL filters by link-graph propagation.

Pages that an allow or block rule decides are the seeds.  A host's trust seed is
the share of its pages that rules allow, its distrust seed the share they block.
Trust flows along host edges as personalised PageRank from the trusted seeds;
distrust flows against them, from blocked hosts to the hosts that link to them.  A
page that no rule decides takes its host's verdict: block where distrust exceeds
trust by ``THRESHOLD`` or more of what a wholly blocked, unlinked host has.

Links are counted per (host, host) before any shuffle, so one host with a third of
all pages is one row per task there, and ranks are kept per host, never on the
driver.

Defined results: a null url or one without ``://`` has an empty host and path, fits
no rule and is allowed; links with no host, and links of a host to itself, are no
edges; a page whose host has no decided page and no links is allowed; repeated rows
each get their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.tables import release, scratch, settle, table

#: (host, path, verdict); the longest that fits decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
RESTART, SETTLED, THRESHOLD = 0.15, 1e-6, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:  # noqa: ANN001
    """The longest rule that fits, as (rule, verdict) columns."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, kind in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) over different hosts, counted before they are shuffled."""
    links = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))
    out = pages.where(F.col(html_col).contains("//")).select(host_of(F.col(url_col)).alias("src"), links.alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return out.select("src", host_of(full).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, start: str, source: str, target: str) -> DataFrame:
    """host, mass: restart share of the seed plus what flows in from ``source`` to ``target``, until no host changes by ``SETTLED``.

    A round passes on 1 - ``RESTART`` of the last one's changes at most, so the rounds end: some 85 for a seed of 1.
    """
    total = edges.groupBy(F.col(source).alias("host")).agg(F.sum("links").alias("total"))
    flow = edges.select(F.col(source).alias("host"), F.col(target).alias("to"), "links").join(total, "host").select("host", "to", (F.col("links") / F.col("total")).alias("share"))
    flow = settle(flow)
    base = settle(seeds.select("host", (F.col(start) * RESTART).alias("base")))
    mass = base.withColumnRenamed("base", "mass")
    if flow.isEmpty():
        return mass
    before = base
    while True:
        into = flow.join(mass, "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("mass") * F.col("share") * (1 - RESTART)).alias("more"))
        new = base.join(into, "host", "left").join(mass.withColumnRenamed("mass", "old"), "host").select("host", (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("mass"), "old")
        new = settle(new)
        moved = new.agg(F.max(F.abs(F.col("mass") - F.col("old")))).first()[0]
        mass = new.select("host", "mass")
        if before is not base:
            release(before)
        if moved is None or moved < SETTLED:
            return mass
        before = new


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:  # noqa: ANN001
    """Verdict of every page, with its host's trust and distrust."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict})
    share = lambda kind: F.coalesce(F.avg(F.when(F.col("ruled") == kind, 1.0).otherwise(0.0)), F.lit(0.0))
    seeds = base.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    edges = settle(host_edges(pages, url_col, html_col))
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    seeds = settle(seeds.join(linked, "host", "full").fillna(0.0, ["allowed", "blocked"]))
    trust = propagate(seeds, edges, "allowed", "src", "dst").withColumnRenamed("mass", "trust")
    distrust = propagate(seeds, edges, "blocked", "dst", "src").withColumnRenamed("mass", "distrust")
    score = trust.join(distrust, "host")
    out = base.join(score, "host", "left")
    method = F.when(F.col("distrust") - F.col("trust") >= threshold * RESTART, "block").otherwise("allow")
    return out.select(F.col(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def op3_hostgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as kept:
        out = settle(judge(table(spark, sf_dir, "pages")))
        kept.append(out)
    return out


QUERIES = {"op3_hostgraph": op3_hostgraph}
ORACLES: dict[str, str] = {}
