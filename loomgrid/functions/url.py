"""Columns over URLs. Unreadable ones give null or false, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(url: Column) -> Column:
    return F.coalesce((F.length(url) >= 7) & url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def is_request(url: Column) -> Column:
    return is_valid(F.trim(url)) & F.trim(url).rlike("(?i)^https?://")


def normal(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "/+$", ""))


def domain(url: Column) -> Column:
    parts = F.split(url, "/")
    return F.when(url.contains("//"), F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0)))


def unwrapped(url: Column, parameter: str = "uddg") -> Column:
    """The target of a redirect link: its query parameter, decoded twice; a link without it is its own target."""
    raw = F.nullif(F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(F.replace(F.try_url_decode(raw), F.lit("+"), F.lit("%2B"))), url)


def shown(url: Column) -> Column:
    return F.when(F.length(url) > 60, domain(url)).otherwise(url)


def acceptable_link(href: Column, title: Column, own_host: str) -> Column:
    return (F.length(href) > 0) & ~href.startswith("#") & ~href.contains(own_host) & (F.length(title) >= 3)
