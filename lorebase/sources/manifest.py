"""The manifest of sources: a small configuration file, read on the driver."""

from __future__ import annotations

from datetime import date

import yaml
from pyspark.sql import DataFrame, SparkSession

from lorebase import schemas
from lorebase.operators import corpus

FIELDS = tuple(x.split()[0] for x in schemas.SOURCE.split(", corrections")[0].split(", "))


def parse_manifest(text: str) -> list[dict]:
    """Sources of the manifest; unknown keys and repeated ids are errors."""
    raw = yaml.safe_load(text) or {}
    if raw.get("schema_version") != 1:
        raise ValueError("unknown manifest version")
    out = []
    for source in raw.get("sources") or []:
        if unknown := set(source) - {*FIELDS, "corrections", "notes"}:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        row = {name: source.get(name) for name in FIELDS}
        for name in ("effective_from", "effective_until", "verified_on"):
            if isinstance(row[name], str):
                row[name] = date.fromisoformat(row[name])
        row["corrections"] = [{k: c.get(k) for k in ("section_key", "url", "anchor", "sha256")} for c in source.get("corrections") or []]
        out.append(row)
    ids = [s["id"] for s in out]
    if len(ids) != len(set(ids)):
        raise ValueError("repeated source ids")
    return out


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as rows, read through Spark so that any store will do; sources that break a rule are errors."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    rows = spark.createDataFrame(parse_manifest(text), schemas.SOURCE)
    if broken := corpus.breaks(rows, corpus.source_rules()).select("id", "broken").collect():
        raise ValueError("; ".join(f"{r.id}: {r.broken}" for r in broken))
    return rows


def selected(manifest: DataFrame, ids: list[str]) -> DataFrame:
    """The named sources; unknown names are an error."""
    known = {r.id for r in manifest.select("id").collect()}
    if unknown := set(ids) - known:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    return manifest.where(manifest["id"].isin(ids)) if ids else manifest
