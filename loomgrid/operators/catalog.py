"""Catalog listing, look-up, keyword search, statistics and schema shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.search import name_matches


def list_where(tools: DataFrame, status: str | None = None, category: str | None = None, tags: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Every filter that is given holds; all are case-sensitive, and all tags must be there. Ordered by name and version."""
    tests = [] if status is None else [F.col("status") == status]
    tests += [] if category is None else [F.col("category") == category]
    tests += [F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0] if tags else []
    tests += [] if pattern is None else [name_matches(F.col("name"), pattern)]
    return tools.filter(reduce(lambda a, b: a & b, tests, F.lit(True))).orderBy("name", "version")


def keyword(query: str) -> Column:
    """The word, in any case, in the name, a description or a tag."""
    q = query.strip().lower()
    if not q:
        raise ValueError("the query is empty")
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return has(F.col("name")) | has(F.col("description")) | has(F.col("brief_description")) | F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q))), F.lit(False))


def search(tools: DataFrame, query: str, category: str | None = None, tags: list[str] | None = None, limit: int = 20, ties: tuple[str, ...] = ()) -> DataFrame:
    """Keyword search with any of the tags; the limit takes the first by name, version and `ties`, then names that hold the query come first."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    found = tools.filter(keyword(query))
    if category is not None:
        found = found.filter(F.lower("category") == category.lower())
    if tags:
        found = found.filter(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(x.lower()) for x in tags])))
    order = [F.asc_nulls_last(c) for c in ("name", "version", *ties)]
    some = found.orderBy(*order).limit(limit)
    return some.orderBy(~F.contains(F.lower("name"), F.lit(query.strip().lower())), *order)


def latest(tools: DataFrame) -> DataFrame:
    """Of each name the row registered last; of several at that time the first seen. One aggregation, no sort."""
    pick = F.max_by(F.struct(*tools.columns), F.struct("registered_at", -F.col("seq")))
    return tools.groupBy("name").agg(pick.alias("r")).select("r.*")


def resolve(wanted: DataFrame, tools: DataFrame, aliases: DataFrame) -> DataFrame:
    """identifier -> tool_id: an id, else an alias, else the latest of that name, else null."""
    by_id = tools.select(F.col("tool_id").alias("by_id")).distinct()
    by_alias = aliases.select(F.col("alias"), F.col("tool_id").alias("by_alias"))
    by_name = latest(tools).select("name", F.col("tool_id").alias("by_name"))
    out = wanted.join(by_id, wanted.identifier == by_id.by_id, "left").join(by_alias, wanted.identifier == by_alias["alias"], "left").join(by_name, wanted.identifier == by_name.name, "left")
    return out.select("identifier", F.coalesce("by_id", "by_alias", "by_name").alias("tool_id"))


def tag_index(tools: DataFrame) -> DataFrame:
    return tools.select(F.explode("tags").alias("tag"), "tool_id").distinct()


def group_counts(tools: DataFrame) -> DataFrame:
    """kind, key, n for the whole, each status, each category and each tag: one aggregation over labels of each row."""
    labels = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("key")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("key")))
    tags = F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("key")))
    return tools.select(F.explode(F.concat(labels, tags)).alias("l")).groupBy("l.kind", "l.key").agg(F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't renewed, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def parameter_schema(name: Column, kind: Column, least: Column, most: Column, required: Column, default: Column) -> Column:
    """JSON of a parameter, with the limits that aren't null."""
    return F.to_json(F.struct(name.alias("name"), kind.alias("type"), least.alias("minimum"), most.alias("maximum"), required.alias("required"), default.alias("default")))


def example_value(kind: Column) -> Column:
    return F.when(kind == "string", '"example"').when(kind == "integer", "42").when(kind == "number", "3.14").when(kind == "boolean", "true").when(kind == "array", "[]").when(kind == "object", "{}").otherwise("null")


def retagged(tools: DataFrame, changes: DataFrame) -> DataFrame:
    """tool_id, tags after a log of (tool_id, seq, action, tag): the last action on a tag counts. One aggregation and one join."""
    last = changes.groupBy("tool_id", "tag").agg(F.max_by("action", "seq").alias("action")).groupBy("tool_id").agg(F.collect_set(F.when(F.col("action") == "add", F.col("tag"))).alias("added"), F.collect_set(F.when(F.col("action") == "remove", F.col("tag"))).alias("removed"))
    none = F.array().cast("array<string>")
    kept = F.array_except(F.array_distinct(F.concat("tags", F.coalesce("added", none))), F.coalesce("removed", none))
    return tools.join(last, "tool_id", "left").select("tool_id", F.array_sort(kept).alias("tags"))


def spark_type(kind: Column) -> Column:
    """Names of parameter types as column types; unknown ones are strings."""
    return F.when(kind == "integer", "bigint").when(kind == "number", "double").when(kind == "boolean", "boolean").when(kind == "array", "array<string>").when(kind == "object", "map<string,string>").otherwise("string")


def registered(requests: DataFrame, order: str) -> DataFrame:
    """accepted: whether a registration is the first of its name and version; a later one is refused.

    One partial aggregation by the key, so many requests for one name are counted before they are shuffled.
    """
    first = requests.groupBy(F.col("name").alias("__n"), F.col("version").alias("__v")).agg(F.min(order).alias("__first"))
    same = F.col("name").eqNullSafe(F.col("__n")) & F.col("version").eqNullSafe(F.col("__v"))
    return requests.join(first, same).withColumn("accepted", F.col(order) == F.col("__first")).drop("__n", "__v", "__first")


def unregistered(tools: DataFrame, aliases: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tools, aliases and tag index without the tools in `gone` (tool_id): what points at a tool goes with it."""
    gone = gone.select("tool_id")
    left = tools.join(gone, "tool_id", "left_anti")
    return left, aliases.join(gone, "tool_id", "left_anti"), tag_index(left)


def folded(tools: DataFrame, log: DataFrame) -> DataFrame:
    """tool_id, status, usage_count, last_used after a log of (tool_id, at, status, used): the latest status that isn't null, counts and times added up."""
    at = F.struct("at", "status")
    change = log.groupBy("tool_id").agg(
        F.max(F.when(F.col("status").isNotNull(), at)).alias("c"),
        F.count_if(F.col("used")).alias("n"),
        F.max(F.when(F.col("used"), F.col("at"))).alias("l"),
    )
    now = tools.select("tool_id", "status", "usage_count", "last_used").join(change, "tool_id", "left")
    return now.select("tool_id", F.coalesce("c.status", "status").alias("status"), (F.col("usage_count") + F.coalesce("n", F.lit(0))).alias("usage_count"), F.greatest("last_used", "l").alias("last_used"))
