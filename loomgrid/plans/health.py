"""Health: a user is a manager, the last event of each type a check; signups and purchases are critical, views have no result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import health as H
from loomgrid.plans.registry import Tables, query

CHECKS = "(select user_id as manager, event_type in ('signup', 'purchase') as critical, case when event_type <> 'view' then v < 150 end as ok from (select user_id, event_type, arg_max(value, event_id) as v from events group by 1, 2))"
MANAGERS = f"m as (select manager, case when bool_or(critical and not ok) then 'unhealthy' when bool_or(not coalesce(ok, false)) then 'degraded' else 'healthy' end as status, bool_and(coalesce(ok, true)) as is_healthy from {CHECKS} group by 1)"


def checks(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    kind = F.col("event_type")
    return last.select(F.col("user_id").alias("manager"), kind.isin("signup", "purchase").alias("critical"), F.when(kind != "view", F.col("v") < 150).alias("ok"))


@query("a13_manager_health", "A-13 A-14 F-51", f"with {MANAGERS} select * from m")
def manager_health(t: Tables) -> DataFrame:
    return H.manager_health(checks(t))


@query("a12_system_health", "A-12 F-51", f"with {MANAGERS} select case when bool_or(status = 'unhealthy') then 'unhealthy' when bool_or(status = 'degraded') then 'degraded' else 'healthy' end as status, count(*) as managers from m")
def system_health(t: Tables) -> DataFrame:
    return H.system_health(H.manager_health(checks(t)))


@query("a28_agent_status", "A-28 A-22", "with a as (select user_id, count(*) filter (where event_type = 'view') as running, count(*) filter (where event_type = 'purchase') as completed from events where ts >= timestamp '2024-01-29' group by 1) select *, running > 0 as is_busy, running < 3 as can_accept from a")
def agent_status(t: Tables) -> DataFrame:
    recent = t.events.filter(F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    n = recent.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("running"), F.count_if(F.col("event_type") == "purchase").alias("completed"))
    return n.select("*", (F.col("running") > 0).alias("is_busy"), (F.col("running") < 3).alias("can_accept"))


@query("f53_error_message", "F-53 F-52", "select event_id, case when event_id % 2 = 0 then props else 'Tool execution failed: ' || props end as message from events where event_type = 'error'")
def error_message(t: Tables) -> DataFrame:
    own = F.col("event_id") % 2 == 0  # errors of the framework itself pass as they are
    return t.events.filter("event_type = 'error'").select("event_id", F.when(own, F.col("props")).otherwise(F.concat(F.lit("Tool execution failed: "), "props")).alias("message"))


@query("f43_command_result", "F-43", "select event_id, event_id % 3 = 0 as success, cast(length(props) as bigint) as stdout_size, case when length(props) > 8 then left(props, 8) || ' [truncated]' else props end as stdout from events")
def command_result(t: Tables) -> DataFrame:
    from loomgrid.functions.text import capped

    return t.events.select("event_id", ((F.col("event_id") % 3) == 0).alias("success"), F.length("props").cast("long").alias("stdout_size"), capped(F.col("props"), 8).alias("stdout"))


@query("f44_arguments", "F-44 S-12", "select n_nationkey, 'grep|-n|' || n_name || ' x' as arguments from nation")
def arguments(t: Tables) -> DataFrame:
    from loomgrid.functions.text import arguments as split

    return t.nation.select("n_nationkey", F.array_join(split(F.concat(F.lit("grep -n '"), "n_name", F.lit(" x'"))), "|").alias("arguments"))
