"""Content search and file predicates. Texts are split, matched and framed inside one row, so nothing is shuffled before the limit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A shell pattern (* ? [seq] [!seq]) as an anchored regular expression; * crosses everything."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def name_matches(name: Column, glob: str | None = None, regex: str | None = None, case_sensitive: bool = True) -> Column:
    """Both the anchored shell pattern and the unanchored regular expression, where given; a bad expression raises at once."""
    out = F.lit(True)
    if glob is not None:
        out &= name.rlike(glob_regex(glob)) if case_sensitive else F.lower(name).rlike(glob_regex(glob.lower()))
    if regex is not None:
        re.compile(regex)
        out &= name.rlike(regex if case_sensitive else f"(?i){regex}")
    return out


def size_within(kind: Column, size: Column, least: int | None = None, most: int | None = None) -> Column:
    """Inclusive bounds for files; directories pass; a file without a size doesn't."""
    ok = size.isNotNull() & (F.lit(True) if least is None else size >= least) & (F.lit(True) if most is None else size <= most)
    return (kind != "file") | ok


#: Bytes of the largest file whose content is searched, unless another limit is given.
MOST_BYTES = 10_485_760


def searched(text: Column, most: int = MOST_BYTES) -> Column:
    """The file is small enough to be searched."""
    return F.octet_length(text) <= most


def hidden(path: Column) -> Column:
    """Some part of the path begins with a dot."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


#: Any line separator.
SEPARATORS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def split_lines(text: Column, separators: str = SEPARATORS) -> Column:
    """Lines without the empty last one."""
    parts = F.split(text, separators)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_matches(line: Column, pattern: str, regex: bool = False, case_sensitive: bool = True) -> Column:
    if regex:
        re.compile(pattern)
        return line.rlike(pattern if case_sensitive else f"(?i){pattern}")
    return F.contains(line, F.lit(pattern)) if case_sensitive else F.contains(F.lower(line), F.lit(pattern.lower()))


def search(files: DataFrame, pattern: str, file_col: str = "file", text_col: str = "text", regex: bool = False, case_sensitive: bool = True, context: int = 0, keep: Column | None = None) -> DataFrame:
    """file, line_number, line, match, context: a row a matching line.

    Whole texts are tested before they are split; context frames are slices of the split array, so there is no window and no shuffle.
    """
    if keep is not None:
        files = files.filter(keep)
    text = files[text_col]
    rough = line_matches(text, pattern, regex, case_sensitive)
    lines = files.filter(rough if not regex else text.isNotNull()).select(files[file_col].alias("file"), split_lines(text).alias("lines"))
    each = lines.select("file", "lines", F.posexplode("lines").alias("i", "raw")).filter(line_matches(F.col("raw"), pattern, regex, case_sensitive))
    start = F.greatest(F.col("i") - context, F.lit(0))
    frame = F.transform(F.slice("lines", start + 1, F.col("i") - start + 1 + context), lambda x, k: F.struct((start + k + 1).cast("long").alias("line_number"), strip(x).alias("content"), (start + k == F.col("i")).alias("is_match")))
    return each.select("file", (F.col("i") + 1).cast("long").alias("line_number"), strip(F.col("raw")).alias("line"), F.lit(pattern).alias("match"), frame.alias("context"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def limited(found: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows in a fixed order: a top-k, not a sort of everything."""
    return found.orderBy(*order).limit(limit)


def counters(searched: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """files_searched, files_with_matches, total_matches, truncated, after the limit."""
    hits = found.agg(F.countDistinct("file").alias("files_with_matches"), F.count(F.lit(1)).alias("total_matches"))
    return searched.agg(F.count(F.lit(1)).alias("files_searched")).crossJoin(hits).withColumn("truncated", F.col("total_matches") >= limit)


def text_stats(text: Column, separators: str = SEPARATORS) -> list[Column]:
    return [F.size(split_lines(text, separators)).cast("long").alias("lines"), F.length(text).cast("long").alias("characters")]
