"""The event bus on Structured Streaming. Each form has a batch twin among the queries, and its tests compare the two."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgrid.operators.events import fan_out

log = logging.getLogger(__name__)


def timed(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event times as instants, with a watermark: tables hold them without a zone, which a watermark refuses."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def publish(events: DataFrame, subscriptions: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str, trigger: str = "1 second", name: str = "name", order: str = "event_id", stats: dict[str, int] | None = None) -> StreamingQuery:
    """Each batch goes to each subscription's handler, lowest priority value first. One that raises is logged and counted; the others go on.

    A subscription of once gets its first event alone, and is spent unless its handler raised; what is spent is written beside the checkpoint, so that a restart knows it.
    stats, where given, counts handlers_called and errors.
    """
    spark, spent_at = subscriptions.sparkSession, f"{checkpoint.rstrip('/')}-spent"
    live = subscriptions.filter("enabled").orderBy("priority", F.col("pattern") == "*", "subscription").collect()  # each has a handler in this process
    path = spark._jvm.org.apache.hadoop.fs.Path(spent_at)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    spent = {r[0] for r in spark.read.schema("subscription string").json(spent_at).collect()} if there else set()

    def count(what: str) -> None:
        if stats is not None:
            stats[what] = stats.get(what, 0) + 1

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for s in live:
            if s["subscription"] in spent:
                continue
            own = batch if s["pattern"] == "*" else batch.filter(F.col(name) == s["pattern"])
            if s["once"]:
                own = own.orderBy(order).limit(1)
                if own.isEmpty():
                    continue
            try:
                handlers[s["subscription"]](own)
                count("handlers_called")
            except Exception:
                count("errors")
                log.exception("the handler of %s failed on batch %s", s["subscription"], epoch)
                continue
            if s["once"]:
                spent.add(s["subscription"])
                spark.createDataFrame([(s["subscription"],)], "subscription string").write.mode("append").json(spent_at)
        batch.unpersist()

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def deliveries(events: DataFrame, subscriptions: DataFrame, name: str = "name") -> DataFrame:
    """The stream joined with the fixed subscriptions, by equal names and by wildcard."""
    return fan_out(events, subscriptions, name)


def once(delivered: DataFrame, order: str = "event_id") -> DataFrame:
    """The first delivery of each subscription: state remembers that it has been made."""

    def first(key, frames, state: GroupState):
        if state.exists:
            return
        rows = pd.concat(list(frames))
        if len(rows):
            state.update((True,))
            yield pd.DataFrame({"subscription": [key[0]], order: [rows[order].min()]})

    return delivered.filter("once").groupBy("subscription").applyInPandasWithState(first, f"subscription string, {order} long", "done boolean", "append", GroupStateTimeout.NoTimeout)


def snapshots(events: DataFrame, every: str = "30 seconds", late: str = "1 hour") -> DataFrame:
    """Counts by window; a window is final once the watermark has passed its end."""
    n = timed(events, late=late).groupBy(F.window("ts", every)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return n.select(F.col("window.start").alias("start"), "n", "failed")


def latest_status(events: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """The latest status by key, kept up to date."""
    return events.groupBy(key).agg(F.max_by(status, order).alias("status"), F.max(order).alias("since"))


def live_tasks(events: DataFrame, key: str, ttl_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Tasks that reached an end: one row each when it is swept, ttl_hours after its last event, by event time."""

    def fold(k, frames, state: GroupState):
        if state.hasTimedOut:
            (last, n) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last": [pd.Timestamp(last, unit="us", tz="UTC")], "events": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for f in frames:
            last, n = max(last, int(f["ts"].max().value // 1000)), n + len(f)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    return timed(events, late=late).select(key, "ts").groupBy(key).applyInPandasWithState(fold, f"{key} long, last timestamp, events long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def progress(events: DataFrame, key: str, total: int) -> DataFrame:
    """Per cent of a workflow's steps seen so far, one row an event batch and key."""

    def fold(k, frames, state: GroupState):
        (n,) = state.get if state.exists else (0,)
        n += sum(map(len, frames))
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "progress": [min(100.0, 100.0 * n / total)]})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} long, progress double", "n long", "append", GroupStateTimeout.NoTimeout)
