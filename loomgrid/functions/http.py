"""Columns over HTTP messages: status, body kind, errors, back-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status_category(code: Column) -> Column:
    of = F.floor(code / 100)
    return F.when(of == 2, "success").when(of == 3, "redirection").when(of == 4, "client_error").when(of == 5, "server_error").otherwise("unknown")


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def response_type(text: Column, parsed: Column) -> Column:
    """json for parsed bodies, json_string for text that parses, else text."""
    return F.when(parsed, "json").when(is_json(text), "json_string").when(text.isNotNull(), "text").otherwise("other")


def request_type(text: Column, mapping: Column) -> Column:
    """What a request body announces: a mapping and whatever looks like JSON is JSON, the rest a form."""
    looks = text.startswith("{") | text.startswith("[")
    return F.when(mapping | is_json(text) | looks, "application/json").otherwise("application/x-www-form-urlencoded")


def error_class(message: Column) -> Column:
    """The first that matches, in any case."""
    m = F.lower(message)
    has = lambda *x: [m.contains(y) for y in x]
    any_ = lambda xs: xs[0] if len(xs) == 1 else xs[0] | xs[1]
    return F.when(any_(has("timeout")), "timeout").when(any_(has("connection", "network")), "network").when(any_(has("rate limit", "too many")), "rate_limit").when(any_(has("all search strategies failed")), "unavailable").otherwise("other")


def back_off(attempt: Column, delay: float = 1.0, factor: float | None = None) -> Column:
    """Seconds before the next attempt: linear, or a power of the factor."""
    return F.pow(F.lit(factor), attempt.cast("double")) if factor else F.lit(delay) * (attempt + 1)
