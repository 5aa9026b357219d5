"""Checks of source addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, user information, host and port; empty strings where there is none."""
    at = lambda i: F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^@/?#]*)@)?([^:/?#]*)(?::(\d+))?(?:[/?#]|$)", i)
    return F.lower(at(1)), at(2), F.lower(at(3)), at(4)


def within(url: Column, hosts: Column) -> Column:
    """https, one of the hosts, no user information, no port but 443."""
    scheme, user, host, port = parts(url)
    return F.coalesce((scheme == "https") & (user == "") & F.array_contains(hosts, host) & port.isin("", "443"), F.lit(False))


def allowed(url: Column, hosts: list[str]) -> Column:
    """``within`` a fixed list of hosts."""
    return within(url, F.array(*map(F.lit, hosts)).cast("array<string>"))
