"""Event fan-out, bounded history, and folds of event logs into the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Subscriptions go to every worker up to this many.
BROADCAST_ROWS = 100_000


def fan_out(events: DataFrame, subscriptions: DataFrame, name: str = "name") -> DataFrame:
    """A row a delivery. The equal names and the wildcard are two joins, since an OR of them would compare every pair.

    Subscriptions that are off get nothing.
    """
    on = subscriptions.filter("enabled")
    if on.count() <= BROADCAST_ROWS:  # else the optimiser decides; a local table has no size that it knows
        on = F.broadcast(on)
    exact = events.join(on.filter("pattern <> '*'"), events[name] == F.col("pattern"))
    return exact.unionByName(events.crossJoin(on.filter("pattern = '*'")))


def once(deliveries: DataFrame, order: str) -> DataFrame:
    """Subscriptions of once get their first event alone."""
    first = deliveries.filter("once").groupBy("subscription").agg(F.min_by(F.struct(*deliveries.columns), order).alias("r")).select("r.*")
    return deliveries.filter("not once").unionByName(first)


def last_n(events: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n in order, oldest first."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def history(events: DataFrame, per: str, n: int, *order: str) -> DataFrame:
    """The last n of each key; the rank is limited before the shuffle."""
    return events.withColumn("__n", F.row_number().over(W.partitionBy(per).orderBy(*[F.desc(c) for c in order]))).filter(F.col("__n") <= n).drop("__n")


def state(log: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """The latest status of each key."""
    return log.groupBy(key).agg(F.max_by(status, order).alias("status"), F.max(order).alias("since"))


def unsubscribed(subscriptions: DataFrame, handles: DataFrame | None = None, handlers: DataFrame | None = None) -> DataFrame:
    """Subscriptions without those named: by handle a subscription, by handler all that it has, wildcards among them.

    A handle or handler that nothing has, and one that is null, takes nothing away.
    """
    left = subscriptions
    if handles is not None:
        left = left.join(handles.select("subscription"), "subscription", "left_anti")
    return left if handlers is None else left.join(handlers.select("handler"), "handler", "left_anti")


def report(errors: DataFrame, error_type: str, order: str, recent: int = 10) -> DataFrame:
    """kind, key, n: the total, the count of each type, and the last errors with their places, oldest first."""
    n = F.count(F.lit(1)).alias("n")
    total = errors.agg(n).select(F.lit("total").alias("kind"), F.lit("").alias("key"), "n")
    types = errors.groupBy(error_type).agg(n).select(F.lit("type").alias("kind"), F.col(error_type).alias("key"), "n")
    last = errors.select(order).orderBy(F.desc(order)).limit(recent)
    place = F.row_number().over(W.orderBy(order)).cast("long")  # of `recent` rows
    return total.unionByName(types).unionByName(last.select(F.lit("recent").alias("kind"), F.col(order).cast("string").alias("key"), place.alias("n")))
