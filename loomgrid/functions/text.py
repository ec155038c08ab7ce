"""Columns over page text, titles and snippets."""

from __future__ import annotations

import shlex

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def clean_text(text: Column) -> Column:
    """White space runs to single spaces, then six references in this order, so that an escaped reference is resolved twice."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    for a, b in NAMED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def shortened(text: Column, most: int, keep: int) -> Column:
    """Texts of more than `most` characters become their first `keep` and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def topic_title(text: Column) -> Column:
    return F.substring_index(text, " - ", 1)


def snippet(text: Column, query: str) -> Column:
    """Up to 150 characters whole; else the first sentence of over 20 characters that holds the query; else the first 150."""
    sentences = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: F.contains(F.lower(s), F.lit(query.lower())) & (F.length(s) > 20))
    first = F.get(sentences, F.lit(0))
    return F.when(F.length(text) <= 150, text).when(first.isNotNull(), shortened(first, 200, 200)).otherwise(F.concat(F.substring(text, 1, 150), F.lit("...")))


def is_html(kind: Column, text: Column) -> Column:
    t = F.trim(text)
    return kind.contains("text/html") | t.startswith("<!DOCTYPE html") | t.startswith("<html")


def is_code(kind: Column, text: Column) -> Column:
    t = F.trim(text)
    starts = t.startswith("function") | t.startswith("var ") | t.startswith("const ") | t.startswith("let ")
    return kind.contains("javascript") | kind.contains("css") | starts


def capped(text: Column, most: int = 8000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" [truncated]"))).otherwise(text)


def arguments(command: Column) -> Column:
    """A command line split as a shell would; null where its quotes don't match."""
    def split(x: str | None) -> list[str] | None:
        try:
            return None if x is None else shlex.split(x)
        except ValueError:
            return None

    @F.arrow_udf("array<string>")
    def f(commands: pa.Array) -> pa.Array:
        return pa.array([split(x) for x in commands.to_pylist()], pa.list_(pa.string()))

    return f(command)
