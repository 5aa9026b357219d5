"""Training-data operators. Nothing outside this subpackage imports it.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__.py`` registers.
"""

from __future__ import annotations

from importlib import import_module

#: Modules that each give QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES = (
    "decontaminate",
    "toxicity",
    "hostgraph",
    "jaccard",
    "pathratio",
    "repeats",
    "byte_bpe",
    "licences",
    "interpolation",
    "bitcodes",
    "records",
    "lexical",
    "spelling",
)


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
