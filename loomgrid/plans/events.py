"""The events as a bus: the type is an event's name, the user its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import events as E
from loomgrid.plans.registry import Tables, query

SUBSCRIPTIONS = [("s1", "error", 0, False, True), ("s2", "purchase", 50, False, True), ("s3", "*", 100, False, True), ("s4", "signup", 25, True, True), ("s5", "view", 75, False, False), ("s6", "*", 10, True, True)]
VALUES = "subs(subscription, pattern, priority, once, enabled) as (values " + ", ".join(f"('{a}', '{b}', {c}, {str(d).lower()}, {str(e).lower()})" for a, b, c, d, e in SUBSCRIPTIONS) + ")"
FAN = f"with {VALUES}, d as (select event_id, ts, event_type, subscription, pattern, priority, once from events, subs where enabled and (pattern = event_type or pattern = '*')), o as (select * from d where not once union all select d.* from d join (select subscription, min(event_id) as event_id from d where once group by 1) using (subscription, event_id))"


def subscriptions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(SUBSCRIPTIONS, "subscription string, pattern string, priority int, once boolean, enabled boolean")


def deliveries(t: Tables) -> DataFrame:
    return E.once(E.fan_out(t.events, subscriptions(t), "event_type"), "event_id")


@query("j08_event_fanout", "J-08 U-01 T-01 T-02 S-17", FAN + " select event_id, subscription from d")
def fan_out(t: Tables) -> DataFrame:
    return E.fan_out(t.events, subscriptions(t), "event_type").select("event_id", "subscription")


@query("t03_once", "T-03 T-04", FAN + " select event_id, subscription from o")
def once(t: Tables) -> DataFrame:
    return deliveries(t).select("event_id", "subscription")


@query("o06_handler_order", "O-06", FAN + " select event_id, string_agg(subscription, ',' order by priority, pattern = '*', subscription) as handlers from d group by 1")
def handler_order(t: Tables) -> DataFrame:
    d = E.fan_out(t.events, subscriptions(t), "event_type")
    ordered = F.array_sort(F.collect_list(F.struct("priority", (F.col("pattern") == "*").alias("g"), "subscription")))
    return d.groupBy("event_id").agg(F.array_join(F.transform(ordered, lambda x: x["subscription"]), ",").alias("handlers"))


@query("a10_bus_stats", "A-10 A-24", FAN + ", h as (select event_id, count(*) as c from o group by 1) select (select count(*) from events) as published, (select count(*) from h) as handled, (select count(*) from o) as handlers_called, (select count(*) from subs) as subscriptions, (select count(distinct event_type) from events) as event_types, least((select count(*) from events), 1000) as history_size")
def bus_stats(t: Tables) -> DataFrame:
    e = t.events.agg(F.count(F.lit(1)).alias("published"), F.countDistinct("event_type").alias("event_types"))
    h = deliveries(t).agg(F.countDistinct("event_id").alias("handled"), F.count(F.lit(1)).alias("handlers_called"))
    return e.crossJoin(h).crossJoin(subscriptions(t).agg(F.count(F.lit(1)).alias("subscriptions"))).withColumn("history_size", F.least("published", F.lit(1000).cast("long")))


@query("a24_subscription_calls", "A-24", FAN + " select subscription, count(event_id) as calls, max(ts) as last_called from subs left join o using (subscription) group by 1")
def subscription_calls(t: Tables) -> DataFrame:
    n = deliveries(t).groupBy("subscription").agg(F.count(F.lit(1)).alias("calls"), F.max("ts").alias("last_called"))
    return subscriptions(t).select("subscription").join(n, "subscription", "left").select("subscription", F.coalesce("calls", F.lit(0).cast("long")).alias("calls"), "last_called")


@query("t05_history", "T-05 P-19 W-06 W-07", "with h as (select * from events order by event_id desc limit 1000) select event_id, ts from h where event_type = 'purchase' order by event_id desc limit 50")
def history(t: Tables) -> DataFrame:
    kept = E.last_n(t.events, 1000, "event_id")
    return E.last_n(kept.filter("event_type = 'purchase'").select("event_id", "ts"), 50, "event_id")


@query("w06_history_per_bus", "W-06 T-06", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n <= 20")
def history_per_bus(t: Tables) -> DataFrame:
    return E.history(t.events, "user_id", 20, "event_id").select("user_id", "event_id")


@query("a11_error_stats", "A-11 F-18", """with e as (select event_id, case when value < 20 then 'timeout' when value < 50 then 'network' when value < 90 then 'rate_limit' when value < 120 then 'unavailable' else 'other' end as error_type from events where event_type = 'error')
select error_type, count(*) as n, max(event_id) as latest from e group by 1""")
def error_stats(t: Tables) -> DataFrame:
    return errors(t).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"))


def errors(t: Tables) -> DataFrame:
    from loomgrid.functions.http import error_class

    v = F.col("value")
    message = F.when(v < 20, "Read TIMEOUT after 30 s").when(v < 50, "Network is down").when(v < 90, "Too many requests").when(v < 120, "All search strategies failed").otherwise("Something else")
    return t.events.filter("event_type = 'error'").withColumn("error_type", error_class(message))


@query("a11_error_report", "A-11 F-18", """with e as (select event_id, case when value < 20 then 'timeout' when value < 50 then 'network' when value < 90 then 'rate_limit' when value < 120 then 'unavailable' else 'other' end as error_type from events where event_type = 'error'), l as (select event_id from e order by event_id desc limit 10)
select 'total' as kind, '' as key, count(*) as n from e union all select 'type', error_type, count(*) from e group by 2 union all select 'recent', cast(event_id as varchar), row_number() over (order by event_id) from l""")
def error_report(t: Tables) -> DataFrame:
    return E.report(errors(t), "error_type", "event_id")


@query("a10_delivery_errors", "A-10", FAN + """, f as (select subscription, subscription = 's3' and value > 400 or subscription = 's1' and value < 100 as failed from o join events using (event_id))
select subscription, count(failed) as calls, count(*) filter (where not failed) as handled, count(*) filter (where failed) as errors from subs left join f using (subscription) group by 1""")
def delivery_errors(t: Tables) -> DataFrame:
    """What a handler raises is counted as an error, and the others go on."""
    s, v = F.col("subscription"), F.col("value")
    failed = (s == "s3") & (v > 400) | (s == "s1") & (v < 100)
    n = deliveries(t).groupBy("subscription").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~failed).alias("handled"), F.count_if(failed).alias("errors"))
    return subscriptions(t).select("subscription").join(n, "subscription", "left").na.fill(0)


@query("t04_unsubscribe", "T-04", FAN.replace(" where enabled and", " where subscription <> 's2' and enabled and").replace("events, subs", "events, (select * from subs where subscription not in ('s3', 's6'))") + " select event_id, subscription from o")
def unsubscribe(t: Tables) -> DataFrame:
    """By handle s2; by handler the wildcards s3 and s6, which share one."""
    subs = subscriptions(t).withColumn("handler", F.when(F.col("pattern") == "*", "audit").otherwise(F.col("subscription")))
    of = t.spark.createDataFrame
    left = E.unsubscribed(subs, of([("s2",), ("nothing",)], "subscription string"), of([("audit",)], "handler string"))
    return E.once(E.fan_out(t.events, left, "event_type"), "event_id").select("event_id", "subscription")


@query("t07_lifecycle", "T-07 T-13 T-14", "select user_id, arg_max(event_type, event_id) as status, max(event_id) as since from events group by 1")
def lifecycle(t: Tables) -> DataFrame:
    return E.state(t.events, "user_id", "event_type", "event_id")


@query("t09_status_snapshots", "T-09 T-08", "select time_bucket(interval '1 day', ts) as start, count(*) as n, count(*) filter (where event_type = 'error') as failed from events group by 1")
def snapshots(t: Tables) -> DataFrame:
    n = t.events.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return n.select(F.col("window.start").alias("start"), "n", "failed")


@query("t10_ttl_sweep", "T-10 T-11 P-22", "select event_id, ts + interval 3 day as ends, ts + interval 3 day <= timestamp '2024-01-31' as completed from events where not (event_type in ('purchase', 'error') and ts < timestamp '2024-01-30')")
def ttl_sweep(t: Tables) -> DataFrame:
    e, at = t.events, lambda x: F.lit(x).cast("timestamp_ntz")
    live = e.filter(~(F.col("event_type").isin("purchase", "error") & (F.col("ts") < at("2024-01-30 00:00:00"))))
    ends = F.col("ts") + F.expr("interval 3 days")
    return live.select("event_id", ends.alias("ends"), (ends <= at("2024-01-31 00:00:00")).alias("completed"))
