"""Quality rules as a short-circuit cascade.

Every rule is true where a document fails. On a sample each rule is tried on each document, which gives its cost (the time, with
all that it has to measure) and its selectivity. Rules are then ordered by rejections per cost: first the rule that is best on
the whole sample, next the one that is best on what the first leaves, and so on; a document stops at the first rule that it fails.
The order changes the time, never the result.

The sample are up to `sample` rows of partitions chosen at random; it is measured where it is read, and the driver gets times and outcomes alone.

The cascade runs in Arrow batches: a rule measures only what it needs, keeps it for the next, and leaves off as soon as
its outcome is settled, which expressions over whole texts can't do.

Rules hold for documents of every length, over the whole text. Where few words say little, the bound is a function of their number n:
the mean length of words lies between least_length - short_least / n and most_length + short_most / n; a text repeats itself with fewer distinct
words than the lesser of distinct_words * n and distinct_root * sqrt(n) (texts gain distinct words ever more slowly); a single symbol or, in place of each word, a single capital is never too many.

Defined results: a null or blank text fails `blank`; a null in any other column has no effect; ties in rank keep the
order in which the rules are given; repeated rows are judged one by one; an empty table gives an empty table; all columns
of the input are returned, whatever their names.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from functools import cached_property
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\r"
STOP = sorted(
    "the of and to in is that a for it on with as be by are this from or at der die und das in zu den von mit ist des ein auf für le la les de et un une que en du el los las y con se por est pour dans pas del al".split()
)
#: Ratios follow the published rules of Gopher and C4, loosened where the rule says.
LIMITS = {"symbols": 0.1, "least_symbols": 2, "upper": 0.6, "least_length": 3.0, "short_least": 2.0, "most_length": 10.0, "short_most": 30.0, "repeated_lines": 0.5, "distinct_words": 0.2, "distinct_root": 4.5, "stutter": 0.3, "least_stutter": 2, "stop_words": 2, "stop_from": 50}
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
SMALL = CAPITALS.lower()


ASCII_CAPITALS, ASCII_LETTERS = (bytes(c for c in map(ord, x) if c < 128) for x in (CAPITALS, CAPITALS + SMALL))
OTHER_CAPITALS, OTHER_SMALL = ("".join(c for c in x if not c.isascii()) for x in (CAPITALS, SMALL))
SPLIT, STOPS = re.compile(rb"[ \t\n\r]+"), frozenset(STOP)


class Measures:
    """What the rules measure of a text, each when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "replace")

    @cached_property
    def spaces(self) -> int:
        return sum(self.raw.count(c.encode()) for c in SPACES)

    @cached_property
    def words(self) -> list[bytes]:
        if b"\x0b" in self.raw or b"\x0c" in self.raw:
            return SPLIT.split(self.raw.strip(SPACES.encode()))
        return self.raw.split()

    @cached_property
    def capitals(self) -> int:
        n = len(self.raw) - len(self.raw.translate(None, ASCII_CAPITALS))
        return n if self.text.isascii() else n + sum(map(self.text.count, OTHER_CAPITALS))

    @cached_property
    def letters(self) -> int:
        n = len(self.raw) - len(self.raw.translate(None, ASCII_LETTERS))
        return n if self.text.isascii() else n + sum(map(self.text.count, OTHER_CAPITALS + OTHER_SMALL))

    def lines_repeat(self, most: float) -> bool:
        lines = [x for x in (x.strip(SPACES) for x in self.text.split("\n")) if x]
        return len(set(lines)) < (1 - most) * len(lines)

    def distinct_under(self, n: float) -> bool:
        seen: set[bytes] = set()
        for w in self.words:
            seen.add(w)
            if len(seen) >= n:
                return False
        return len(seen) < n

    @cached_property
    def doubled(self) -> int:
        """Words that are the same as the word before."""
        return sum(map(eq, self.words, self.words[1:]))

    def stop_words_under(self, n: int) -> bool:
        seen: set[str] = set()
        for w in self.words:
            x = w.translate(None, b".,!").decode("utf-8", "replace").lower()
            if x in STOPS:
                seen.add(x)
                if len(seen) >= n:
                    return False
        return len(seen) < n


def rules(limits: dict = LIMITS) -> dict[str, Callable[[Measures], bool]]:
    """Name -> test that is true where the text fails."""
    at = limits.__getitem__
    marks = [c.encode() for c in SYMBOLS]

    def symbols(x: Measures) -> bool:
        n = sum(map(x.raw.count, marks))
        return n >= at("least_symbols") and n > at("symbols") * len(x.words)

    def length(x: Measures) -> bool:
        n = len(x.words)
        return n > 0 and not at("least_length") - at("short_least") / n <= (len(x.text) - x.spaces) / n <= at("most_length") + at("short_most") / n

    def repeats(x: Measures) -> bool:
        n = len(x.words)
        return x.distinct_under(min(at("distinct_words") * n, at("distinct_root") * n**0.5))

    return {
        "blank": lambda x: not x.text.strip(SPACES),
        "symbols": symbols,
        "upper": lambda x: x.capitals > at("upper") * x.letters and x.capitals > len(x.words),
        "length": length,
        "lines": lambda x: x.lines_repeat(at("repeated_lines")),
        "stutter": lambda x: x.doubled >= at("least_stutter") and x.doubled > at("stutter") * (len(x.words) - 1),
        "repeats": repeats,
        "stop": lambda x: len(x.words) >= at("stop_from") and x.stop_words_under(at("stop_words")),
    }


def measured(docs: DataFrame, text_col: str = "text", sample: int = 400, limits: dict = LIMITS, partitions: int = 16, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of partitions chosen at random the seconds and the outcome of each rule, a row a document. Only the chosen partitions are read, by a job over them alone."""
    texts = docs.select(docs[text_col].cast("string").alias("text")).filter("text is not null").rdd
    every = texts.getNumPartitions()
    chosen = sorted(random.Random(seed).sample(range(every), min(every, partitions)))
    most = -(-sample // max(1, len(chosen)))

    def tried(rows):
        found = []
        for (t,) in islice(rows, most):
            row = []
            for test in rules(limits).values():
                began = time.perf_counter()
                failed = test(Measures(t))
                row.append((time.perf_counter() - began, float(failed)))
            found.append(row)
        return found

    rows = docs.sparkSession.sparkContext.runJob(texts, tried, chosen) if chosen else []
    got = np.array(rows, float).reshape(-1, len(rules(limits)), 2)
    return got[..., 0], got[..., 1] > 0


def ranked(seconds: np.ndarray, failed: np.ndarray, limits: dict = LIMITS) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) in the order of the cascade, each over the documents that the rules before it leave."""
    names, left, out = list(rules(limits)), np.ones(len(seconds), bool), []
    todo = list(range(len(names)))
    while todo:
        n = max(1, left.sum())
        cost, share = seconds[left].sum(axis=0) / n, failed[left].sum(axis=0) / n
        k = max(todo, key=lambda k: (share[k] / max(cost[k], 1e-9), -k))
        out.append((names[k], float(cost[k]), float(share[k])))
        todo.remove(k)
        left &= ~failed[:, k]
    return out


def fails(docs: DataFrame, text_col: str = "text", sample: int = 400, limits: dict = LIMITS, order: list[str] | None = None) -> Column:
    """True where any rule fails, tested in the order that a sample gives, or in the given one."""
    every = rules(limits)
    names = order or [x[0] for x in ranked(*measured(docs, text_col, sample, limits), limits)]

    @F.arrow_udf("boolean")
    def cascade(texts: pa.Array) -> pa.Array:
        tests = [every[k] for k in names]
        out = []
        for t in texts.to_pylist():
            x = None if t is None else Measures(t)
            out.append(x is None or any(test(x) for test in tests))
        return pa.array(out, pa.bool_())

    return cascade(docs[text_col].cast("string"))


def keep(docs: DataFrame, text_col: str = "text", sample: int = 400, limits: dict = LIMITS, order: list[str] | None = None) -> DataFrame:
    """The documents that fail no rule, with all their columns. A map without a shuffle."""
    return docs.filter(~fails(docs, text_col, sample, limits, order))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and languages of the documents that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return keep(docs).select("doc_id", "lang", "source")


def sql(limits: dict = LIMITS, table: str = "documents", columns: str = "doc_id, lang, source") -> str:
    """The same in DuckDB's SQL."""
    c = CAPITALS + SMALL
    stop = ", ".join(f"'{x}'" for x in STOP)
    sp = "' ' || chr(9) || chr(10) || chr(13)"
    cut = lambda t, chars: f"length(translate({t}, {chars}, ''))"
    many = lambda chars: f"(length(x_) - {cut('x_', chars)})"
    num = {k: f"cast({v} as double)" for k, v in limits.items()}
    return f"""
with a as (select *, trim(text, {sp}) as t_, text as x_ from {table} where text is not null),
b as (select *, string_split_regex(t_, '[ \\t\\n\\r]+') as w_,
  list_filter(list_transform(string_split(x_, chr(10)), lambda l: trim(l, {sp})), lambda l: length(l) > 0) as l_ from a where length(t_) > 0),
c as (select *, len(w_) as n_, {many(f"'{SYMBOLS}'")} as symbols_, {many(f"'{CAPITALS}'")} as capitals_, {many(f"'{c}'")} as letters_,
  len(list_filter(list_zip(w_, w_[2:]), lambda z: z[1] = z[2])) as doubled_ from b)
select {columns} from c
where not (symbols_ >= {limits['least_symbols']} and symbols_ > {num['symbols']} * n_)
and not (capitals_ > {num['upper']} * letters_ and capitals_ > n_)
and cast({cut('x_', sp)} as double) / n_ between {num['least_length']} - {num['short_least']} / n_ and {num['most_length']} + {num['short_most']} / n_
and not (len(list_distinct(l_)) < cast({1 - limits['repeated_lines']} as double) * len(l_))
and not (doubled_ >= {limits['least_stutter']} and doubled_ > {num['stutter']} * (n_ - 1))
and not (len(list_distinct(w_)) < least({num['distinct_words']} * n_, {num['distinct_root']} * sqrt(cast(n_ as double))))
and not (n_ >= {limits['stop_from']} and len(list_distinct(list_filter(string_split_regex(lower(translate(t_, '.,!', '')), '[ \\t\\n\\r]+'), lambda w: list_contains([{stop}], w)))) < {limits['stop_words']})
"""
