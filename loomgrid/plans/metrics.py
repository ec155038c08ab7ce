"""Metrics over the events table: an event is a task, of its user, that failed when its type is error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import metrics as M
from loomgrid.plans.registry import Tables, query

AS_OF, DAYS = "2024-01-31 00:00:00", 7
LOG = "(select user_id, event_id, ts, event_type <> 'error' as success, value as response_time, cast(json_extract_string(props, '$.k') as double) as quality_score from events)"
SINCE = "ts >= timestamp '2024-01-24 00:00:00'"
RATES = """count(*) as total_tasks, count(*) filter (where success) as successful_tasks, count(*) filter (where not success) as failed_tasks,
cast(count(*) filter (where success) as double) / count(*) * 100 as success_rate, cast(count(*) filter (where success) as double) / count(*) * 100 as completion_rate,
cast(count(*) filter (where not success) as double) / count(*) * 100 as error_rate,
round(coalesce(avg(response_time), 0), 6) as average_response_time, round(coalesce(avg(quality_score), 0), 6) as average_quality"""


def log(t: Tables) -> DataFrame:
    e = t.events
    return e.select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time"), F.get_json_object("props", "$.k").cast("double").alias("quality_score"))


@query("a01_agent_metrics", "A-01 P-16 P-17 F-48", f"select user_id, {RATES} from {LOG} where {SINCE} group by 1")
def agent_metrics(t: Tables) -> DataFrame:
    return M.task_metrics(M.trailing(log(t), AS_OF, DAYS), "user_id")


@query("a01_agent_metrics_all_agents", "A-01 J-05", f"""with m as (select user_id, {RATES} from {LOG} where ts >= timestamp '2024-01-30 00:00:00' group by 1), k as (select distinct user_id from events)
select k.user_id, coalesce(total_tasks, 0) as total_tasks, coalesce(successful_tasks, 0) as successful_tasks, coalesce(failed_tasks, 0) as failed_tasks, coalesce(success_rate, 0) as success_rate,
coalesce(completion_rate, 0) as completion_rate, coalesce(error_rate, 0) as error_rate, coalesce(average_response_time, 0) as average_response_time, coalesce(average_quality, 0) as average_quality from k left join m using (user_id)""")
def all_agents(t: Tables) -> DataFrame:
    return M.with_absent(t.events, M.task_metrics(M.trailing(log(t), AS_OF, 1), "user_id"), "user_id")


AB = f"""(select *, cast((row_number() over (order by event_id) - 1) % 3 as bigint) as variation from {LOG} l)"""


@query("w03_round_robin", "W-03", f"select event_id, variation from {AB}")
def round_robin(t: Tables) -> DataFrame:
    return M.assign(log(t), "event_id", 3).select("event_id", "variation")


@query("a02_variation_metrics", "A-02 J-04", f"select variation, {RATES} from {AB} group by 1")
def variation_metrics(t: Tables) -> DataFrame:
    assigned = M.assign(log(t), "event_id", 3).select("event_id", "variation")  # task -> assignment -> variation, tasks without one drop out
    return M.task_metrics(log(t).join(assigned, "event_id"), "variation")


PAIR = f"with m as (select variation, {RATES} from {AB} group by 1), v as (select m.*, b.success_rate as bs, b.average_response_time as br, b.average_quality as bq from m, m b where b.variation = 0 and m.variation > 0)"


@query("a03_comparison", "A-03 A-26", PAIR + """ select variation, round(case when bs > 0 then (success_rate - bs) / bs * 100 end, 6) as success_change,
round(case when br > 0 then (br - average_response_time) / br * 100 end, 6) as time_change, round(case when bq > 0 then (average_quality - bq) / bq * 100 end, 6) as quality_change from v""")
def comparison(t: Tables) -> DataFrame:
    m = variation_metrics(t)
    b = m.filter("variation = 0").select(F.col("success_rate").alias("bs"), F.col("average_response_time").alias("br"), F.col("average_quality").alias("bq"))
    c = F.col
    return m.filter("variation > 0").crossJoin(b).select("variation", F.round(M.change(c("success_rate"), c("bs")), 6).alias("success_change"), F.round(M.change(c("average_response_time"), c("br"), True), 6).alias("time_change"), F.round(M.change(c("average_quality"), c("bq")), 6).alias("quality_change"))


SCORED = f"with m as (select variation, {RATES} from {AB} group by 1), s as (select *, 0.4 * success_rate + 0.3 * average_quality + 0.2 * (average_quality * 0.9) + 0.1 * (100 - error_rate) as score from m where total_tasks >= 30)"


def scored(t: Tables) -> DataFrame:
    c = F.col
    return variation_metrics(t).filter("total_tasks >= 30").withColumn("score", M.score(c("success_rate"), c("average_quality"), c("average_quality") * 0.9, c("error_rate")))


@query("a04_variation_scores", "A-04 P-20", SCORED + " select variation, round(score, 6) as score from s")
def variation_scores(t: Tables) -> DataFrame:
    return scored(t).select("variation", F.round("score", 6).alias("score"))


@query("a05_ab_winner", "A-05 A-06 C-21", SCORED + """, b as (select max(score) as base from s where variation = 0), w as (select * from s order by score desc, variation limit 1)
select variation, total_tasks, round(score, 6) as score, round(case when base > 0 then (score - base) / base * 100 else 0 end, 6) as lift, round(cast(least(95.0, total_tasks * 0.95) as double), 6) as confidence from w, b""")
def ab_winner(t: Tables) -> DataFrame:
    return M.winner(scored(t))


@query("a07_promotion", "A-07", SCORED + """, b as (select max(score) as base from s where variation = 0)
select variation, cast(least(95.0, total_tasks * 0.95) as double) >= 80 and (score - base) / base * 100 > 5 as promoted from s, b""")
def promotion(t: Tables) -> DataFrame:
    s = scored(t)
    b = s.filter("variation = 0").agg(F.max("score").alias("base"))
    return s.crossJoin(b).select("variation", ((F.least(F.lit(95.0), F.col("total_tasks") * 0.95) >= 80) & ((F.col("score") - F.col("base")) / F.col("base") * 100 > 5)).alias("promoted"))


@query("a16_ema", "A-16", f"""with p as (select user_id, success, row_number() over (partition by user_id order by event_id) as i, count(*) over (partition by user_id) as n from {LOG})
select user_id, round(sum(0.1 * pow(0.9, n - i) * success::int) + pow(0.9, max(n)), 6) as ema from p group by 1""")
def ema(t: Tables) -> DataFrame:
    return M.ema(log(t).withColumn("success", F.col("success").cast("int")), "user_id", "event_id", "success")


@query("a25_failure_streak", "A-25 W-11", f"""with l as (select user_id, max(event_id) filter (where success) as last from {LOG} group by 1)
select user_id, count(*) filter (where last is null or event_id > last) as streak from events join l using (user_id) group by 1""")
def streak(t: Tables) -> DataFrame:
    return M.failure_streak(log(t), "user_id", "event_id", "success")


@query("a31_elapsed", "A-31 F-48", "select user_id, cast(epoch_us(max(ts)) - epoch_us(min(ts)) as bigint) as elapsed_us, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') as started from events group by 1")
def elapsed(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t.events.groupBy("user_id").agg((us(F.max("ts")) - us(F.min("ts"))).alias("elapsed_us"), F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("started"))


@query("a27_optimizer_status", "A-27 W-07 O-05", """with r as (select event_id, ts from events where event_type = 'error' order by ts desc, event_id desc limit 5)
select (select count(*) from events) as total, (select count(*) from events where event_type <> 'error') as completed, string_agg(event_id, ',' order by ts, event_id) as recent from r""")
def optimizer_status(t: Tables) -> DataFrame:
    e = t.events
    totals = e.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("completed"))
    last = e.filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)
    recent = last.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("recent"))
    return totals.crossJoin(recent)
